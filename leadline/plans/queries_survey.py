"""Queries over the survey source: point checks, file-cells, cells, overlap, flags."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells as C
from ..operators import checks as K
from ..operators import flags as FL
from ..operators import overlap as O
from ..operators import points as P
from ..operators import tables as TB
from . import oracle_shared as S
from .fixtures import LINE_ORDER, view
from .registry import query
from .stages import Survey

POINT = " ".join(LINE_ORDER[:3])


@query("point_qc", f"{POINT} file_id {' '.join(P.SURVEY_CHECKS)} qc_zero_depth qc_pass_basic qc_reason",
       "lon lat depth_m_positive_down elev_m", "qc_a")
def _(spark, d):
    return Survey.of(spark, d).points


@query("point_qc_summary", "file_id n_points_in " + " ".join(f"n_fail_{c}" for c in P.SURVEY_CHECKS) + " n_points_pass", "",
       "SELECT file_id, count(*) AS n_points_in, " + ", ".join(f"count(*) FILTER (WHERE NOT {c}) AS n_fail_{c}" for c in P.SURVEY_CHECKS)
       + ", count(*) FILTER (WHERE qc_pass_basic) AS n_points_pass FROM qc_a GROUP BY file_id")
def _(spark, d):
    return P.qc_summary(Survey.of(spark, d).points, "file_id", P.SURVEY_CHECKS, "qc_pass_basic")


@query("point_index", f"{' '.join(LINE_ORDER[:3])} l_extendedprice file_id point_index", "",
       f"SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {', '.join(LINE_ORDER)}) - 1 AS point_index FROM soundings")
def _(spark, d):
    return P.with_point_index(view(spark, d, "soundings"), "file_id", [F.col(c) for c in LINE_ORDER],
                              F.floor(F.col("l_orderkey") / 100_000))


@query("point_duplicates", f"{POINT} l_extendedprice file_id is_first", "", f"""
SELECT *, row_number() OVER (PARTITION BY file_id, lon, lat, depth_m_positive_down ORDER BY {', '.join(LINE_ORDER)}) = 1 AS is_first FROM points_a""")
def _(spark, d):
    points = P.survey_points(view(spark, d, "soundings"))
    return P.mark_duplicates(points, ["file_id", "lon", "lat", "depth_m_positive_down"], LINE_ORDER)


@query("cell_geometry", f"{POINT} l_extendedprice lat_bin lon_bin cell_id cell_key key_lat key_lon lat_band region", "lon_center lat_center", f"""
SELECT *, {S.CELL_ID}, lat_bin * 21601 + lon_bin AS cell_key, lat_bin AS key_lat, lon_bin AS key_lon, {S.CENTER},
  {S.lat_band('lat')} AS lat_band, {S.region('lon', 'lat')} AS region FROM binned_a""")
def _(spark, d):
    binned = geo.with_cell_geometry(geo.with_bins(Survey.of(spark, d).points.where("qc_pass_basic")))
    return binned.withColumn("cell_key", geo.cell_key("lat_bin", "lon_bin")).withColumns({
        "key_lat": geo.cell_key_lat("cell_key"), "key_lon": geo.cell_key_lon("cell_key"),
        "lat_band": geo.lat_band("lat"), "region": geo.region_10deg("lon", "lat")})


@query("file_cells", "file_id cell_id lat_bin lon_bin n_points n_date_nonnull n_time_nonnull n_sonar_idx_nonnull cruise_id archive_id track_kind data_layout",
       "lon_center lat_center median_depth_m_positive_down mean_depth_m_positive_down std_depth_m min_depth_m max_depth_m q25_depth_m "
       "q75_depth_m iqr_depth_m mean_elev_m median_elev_m", "fc_a")
def _(spark, d):
    return Survey.of(spark, d).file_cells


CELLS = "cell_id lat_bin lon_bin n_points_total n_file_cells n_files n_cruises_guess n_archives n_3col_file_cells n_6col_file_cells " \
        "dominant_file_id dominant_cruise_id dominant_track_kind dominant_data_layout"
CELL_VALUES = "lon_center lat_center median_depth_file_balanced median_elev_file_balanced mean_depth_file_balanced mean_elev_file_balanced " \
              "weighted_mean_depth_point_weighted weighted_mean_elev_point_weighted std_depth_between_file_cells " \
              "q25_depth_between_file_cells q75_depth_between_file_cells iqr_depth_between_file_cells min_depth_file_cell " \
              "max_depth_file_cell range_depth_file_cell"


@query("cells", CELLS, CELL_VALUES, "cells_a")
def _(spark, d):
    return Survey.of(spark, d).cells


@query("file_cell_manifest", "file_id n_cells n_points_total n_points_min n_points_max", "n_points_mean median_depth_min median_depth_max", """
SELECT file_id, count(*) AS n_cells, CAST(sum(n_points) AS BIGINT) AS n_points_total, min(n_points) AS n_points_min, max(n_points) AS n_points_max,
  avg(n_points) AS n_points_mean, min(median_depth_m_positive_down) AS median_depth_min, max(median_depth_m_positive_down) AS median_depth_max
FROM fc_a GROUP BY file_id""")
def _(spark, d):
    return C.file_cell_manifest(Survey.of(spark, d).file_cells, ["file_id"], "n_points", "median_depth_m_positive_down")


@query("multi_cruise_flag", "file_id cell_id is_multi_cruise", "",
       "SELECT f.file_id, f.cell_id, c.n_cruises_guess > 1 AS is_multi_cruise FROM fc_a f JOIN cells_a c USING (lat_bin, lon_bin)")
def _(spark, d):
    s = Survey.of(spark, d)
    return C.flag_multi_cruise(s.file_cells_t, s.cells_t)


@query("overlap_residuals", "file_id cell_id cell_n_file_cells is_multi_cruise", "residual_depth_m residual_elev_m", "res_a")
def _(spark, d):
    return Survey.of(spark, d).residuals


X = "residual_depth_m"
BIAS = f"{X}_mean {X}_std {X}_rmse max_abs_{X} {X}_median {X}_iqr {X}_p05 {X}_p95 abs_{X}_median abs_{X}_p95 {X}_mad"
for _key, _name in (("file_id", "file"), ("cruise_id", "cruise"), ("archive_id", "archive")):
    def _build(spark, d, key=_key):
        return Survey.of(spark, d).bias(key)
    query(f"bias_by_{_name}", f"{_key} n_overlap_file_cells n_overlap_cruises n_points_total_overlap", BIAS, f"bias_{_name}")(_build)


@query("cell_disagreement", "lat_bin lon_bin n_file_cells n_cruises_guess has_large_disagreement",
       "residual_depth_range residual_depth_iqr residual_depth_std max_abs_file_residual_depth",
       "SELECT *, residual_depth_range >= 100 OR residual_depth_iqr >= 50 OR max_abs_file_residual_depth >= 100 AS has_large_disagreement FROM disagreement_a")
def _(spark, d):
    s = Survey.of(spark, d)
    return O.cell_disagreement(s.residuals)


SUSPECT = f"n_overlap_file_cells >= 50 AND (abs({X}_median) >= 20 OR {X}_mad >= 20 OR {X}_rmse >= 50 OR abs_{X}_p95 >= 100)"


@query("suspicious_sources", "kind id n_overlap_file_cells", "", f"""
SELECT 'file' AS kind, file_id AS id, n_overlap_file_cells FROM bias_file WHERE {SUSPECT}
UNION ALL SELECT 'cruise', cruise_id, n_overlap_file_cells FROM bias_cruise WHERE {SUSPECT}""")
def _(spark, d):
    s = Survey.of(spark, d)
    return TB.union_all([O.flag_suspicious(s.bias(k)).select(F.lit(n).alias("kind"), F.col(k).alias("id"), "n_overlap_file_cells")
                         for n, k in (("file", "file_id"), ("cruise", "cruise_id"))])


@query("suspicious_cells", "lat_bin lon_bin n_file_cells", "residual_depth_range", """
SELECT * FROM disagreement_a WHERE n_file_cells > 1
  AND (residual_depth_range >= 100 OR residual_depth_iqr >= 50 OR max_abs_file_residual_depth >= 100)""")
def _(spark, d):
    s = Survey.of(spark, d)
    return O.flag_suspicious_cells(O.cell_disagreement(s.residuals))


@query("bias_candidates", "kind id", "", f"""
SELECT 'file' AS kind, file_id AS id FROM (SELECT file_id FROM bias_file ORDER BY abs({X}_median) DESC, file_id LIMIT 5)
UNION SELECT 'file', file_id FROM (SELECT file_id FROM bias_file ORDER BY {X}_rmse DESC, file_id LIMIT 5)
UNION SELECT 'file', file_id FROM bias_file WHERE file_id = 'S1::1'
UNION SELECT 'cruise', cruise_id FROM (SELECT cruise_id FROM bias_cruise ORDER BY abs({X}_median) DESC, cruise_id LIMIT 3)
UNION SELECT 'cruise', cruise_id FROM (SELECT cruise_id FROM bias_cruise ORDER BY {X}_rmse DESC, cruise_id LIMIT 3)""")
def _(spark, d):
    s = Survey.of(spark, d)
    files = O.select_candidates(s.bias("file_id"), "file_id", 5, ["S1::1"])
    cruises = O.select_candidates(s.bias("cruise_id"), "cruise_id", 3)
    return TB.union_all([files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id")),
                         cruises.select(F.lit("cruise").alias("kind"), F.col("cruise_id").alias("id"))])


@query("leave_out_residuals", "file_id cell_id cell_n_file_cells",
       "residual_to_all_cell_median residual_to_other_cruise_median residual_to_other_file_median", "three_a")
def _(spark, d):
    return Survey.of(spark, d).three


AUDIT_N = "n_total_file_cells n_overlap_file_cells n_other_cruise_overlap_cells n_other_file_overlap_cells n_points_total n_single_source_cells"
AUDIT_V = "lon_min lon_max lat_min lat_max depth_min depth_max " + " ".join(
    f"{p}_{s}" for p in ("residual_all", "residual_other_cruise", "residual_other_file") for s in ("median", "mad", "rmse", "p05", "p95"))
for _key, _name in (("file_id", "file"), ("cruise_id", "cruise")):
    def _build(spark, d, key=_key):
        return Survey.of(spark, d).audit(key)
    query(f"audit_by_{_name}", f"{_key} {AUDIT_N}", AUDIT_V, f"audit_{_name}")(_build)


@query("recommended_actions", "candidate_type candidate_id recommended_action action_reason", "", "actions_a")
def _(spark, d):
    return Survey.of(spark, d).actions


_LOST = """
SELECT candidate_type, candidate_id, count(*) AS n_cells_total, count(*) FILTER (WHERE c.n_file_cells > 1) AS n_cells_overlap,
  count(*) FILTER (WHERE c.n_file_cells = 1) AS n_cells_single_source, count(*) FILTER (WHERE c.n_cruises_guess > 1) AS n_cells_multi_cruise,
  CAST(sum(pts) AS BIGINT) AS n_points_total,
  count(*) FILTER (WHERE CASE candidate_type WHEN 'file' THEN c.n_file_cells = 1 ELSE c.n_cruises_guess <= 1 END) AS n_cells_lost_all_coverage
FROM (SELECT candidate_type, candidate_id, lat_bin, lon_bin, sum(n_points) AS pts
      FROM (SELECT * FROM actions_a WHERE recommended_action IN ('exclude_candidate', 'review_candidate')) a
      JOIN fc_a f ON (candidate_type = 'file' AND f.file_id = candidate_id) OR (candidate_type = 'cruise' AND f.cruise_id = candidate_id)
      GROUP BY ALL) x JOIN cells_a c USING (lat_bin, lon_bin) GROUP BY candidate_type, candidate_id"""


@query("removal_impact", "candidate_type candidate_id n_cells_total n_cells_overlap n_cells_single_source n_cells_multi_cruise n_points_total "
       "n_cells_lost_all_coverage n_cells_retained_coverage", "",
       f"SELECT *, n_cells_total - n_cells_lost_all_coverage AS n_cells_retained_coverage FROM ({_LOST})")
def _(spark, d):
    s = Survey.of(spark, d)
    return TB.union_all([O.removal_impact(s.file_cells_t, s.cells_t, s.actions, k, n) for k, n in (("file_id", "file"), ("cruise_id", "cruise"))])


@query("file_quality_flags", "file_id cruise_id n_file_cells n_points_total quality_flag exclude_from_primary_cells flag_reason flag_source "
       "recommended_action", "", "flags_a")
def _(spark, d):
    return Survey.of(spark, d).flags


@query("action_errors", "error_type candidate_type candidate_id", "", """
SELECT 'unmatched_file' AS error_type, 'file' AS candidate_type, a.candidate_id FROM actions_a a
  WHERE candidate_type = 'file' AND candidate_id NOT IN (SELECT file_id FROM files_a WHERE n_points_total % 7 > 0)
UNION ALL SELECT 'unmatched_cruise', 'cruise', a.candidate_id FROM actions_a a
  WHERE candidate_type = 'cruise' AND candidate_id NOT IN (SELECT cruise_id FROM files_a WHERE n_points_total % 7 > 0)""")
def _(spark, d):
    s = Survey.of(spark, d)
    some = s.files.where("n_points_total % 7 > 0").withColumn("quality_flag", F.lit("keep"))
    return FL.action_errors(some, s.actions)


@query("cells_filtered", CELLS + " n_excluded_file_cells_in_original n_excluded_points_in_original had_excluded_source_in_original", CELL_VALUES, "filtered_a")
def _(spark, d):
    return Survey.of(spark, d).filtered


@query("cells_compared", "lat_bin lon_bin presence had_excluded_source_in_original", "depth_orig depth_filtered depth_shift_m abs_shift_m", "comparison_a")
def _(spark, d):
    return Survey.of(spark, d).comparison


_SHIFT = ", ".join(f"count(*) FILTER (WHERE abs_shift_m > {t}) AS n_gt_{t}m" for t in O.SHIFT_LIMITS)


@query("shift_stats", "n_common " + " ".join(f"n_gt_{t}m" for t in O.SHIFT_LIMITS), "min mean max rmse p05 p25 p50 p75 p95 mad", f"""
SELECT a.*, (SELECT median(abs(depth_shift_m - (SELECT median(depth_shift_m) FROM comparison_a WHERE presence = 'common'))) FROM comparison_a
  WHERE presence = 'common') AS mad
FROM (SELECT count(*) AS n_common, min(depth_shift_m) AS min, avg(depth_shift_m) AS mean, max(depth_shift_m) AS max, sqrt(avg(depth_shift_m * depth_shift_m)) AS rmse,
  {', '.join(f"{S.q('depth_shift_m', p / 100)} AS p{p:02d}" for p in (5, 25, 50, 75, 95))}, {_SHIFT} FROM comparison_a WHERE presence = 'common') a""")
def _(spark, d):
    s = Survey.of(spark, d)
    return O.shift_stats(s.comparison)


@query("shift_extent", "direction n_cells", "lon_min lon_max lat_min lat_max", """
SELECT CASE WHEN depth_shift_m > 0 THEN 'positive' ELSE 'negative' END AS direction, count(*) AS n_cells, min(lon_center) AS lon_min,
  max(lon_center) AS lon_max, min(lat_center) AS lat_min, max(lat_center) AS lat_max
FROM comparison_a WHERE presence = 'common' AND abs_shift_m > 50 GROUP BY 1""")
def _(spark, d):
    return O.shift_extent(Survey.of(spark, d).comparison)


@query("large_shifts", "lat_bin lon_bin dominant_cruise_id", "depth_shift_m",
       "SELECT * FROM comparison_a WHERE presence = 'common' AND abs_shift_m > 50")
def _(spark, d):
    return O.large_shifts(Survey.of(spark, d).comparison)


@query("lost_cells", "lat_bin lon_bin n_points_total", "depth_orig", "SELECT * FROM comparison_a WHERE presence = 'lost'")
def _(spark, d):
    return O.lost_cells(Survey.of(spark, d).comparison)


@query("shift_sources", "dominant_cruise_id n_rows", "", """
SELECT dominant_cruise_id, count(*) AS n_rows FROM comparison_a WHERE presence = 'common' AND abs_shift_m > 50 AND dominant_cruise_id IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return TB.top_values(O.large_shifts(Survey.of(spark, d).comparison), "dominant_cruise_id", 20)


def _describe(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
            f"{S.q(c, .25)} AS p25, {S.q(c, .5)} AS p50, {S.q(c, .75)} AS p75 FROM cells_a")


@query("cells_described", "column_name n", "mean std min p25 p50 p75 max", " UNION ALL ".join(_describe(c) for c in (
    "n_points_total", "n_file_cells", "range_depth_file_cell")), digits=4)
def _(spark, d):
    s = Survey.of(spark, d)
    return TB.describe_cols(s.cells, ["n_points_total", "n_file_cells", "range_depth_file_cell"])


@query("primary_validation_cells", "cell_id quality_tier n_points_total n_file_cells n_cruises_guess use_for_primary_validation "
       "use_for_sensitivity_validation", "ship_depth_m ship_elev_m validation_weight",
       "SELECT *, true AS use_for_primary_validation, false AS use_for_sensitivity_validation FROM primary_a")
def _(spark, d):
    return Survey.of(spark, d).primary


@query("sensitivity_cells", "cell_id quality_tier use_for_primary_validation use_for_sensitivity_validation qcfiltered quality_filter_version",
       "ship_depth_m ship_elev_m validation_weight", """
SELECT *, 'original' AS quality_tier, false AS use_for_primary_validation, true AS use_for_sensitivity_validation, false AS qcfiltered,
  'original_unfiltered' AS quality_filter_version, median_depth_file_balanced AS ship_depth_m, median_elev_file_balanced AS ship_elev_m,
  0.0::DOUBLE AS validation_weight FROM cells_a""")
def _(spark, d):
    return Survey.of(spark, d).sensitivity


@query("validation_summary", "metric", "value", """
SELECT metric, value FROM (SELECT
  (SELECT count(*) FROM primary_a)::DOUBLE AS primary_cells, (SELECT count(*) FROM cells_a)::DOUBLE AS sensitivity_cells,
  count(*) FILTER (WHERE quality_tier = 'A_tier')::DOUBLE AS "primary_A_tier_count", count(*) FILTER (WHERE quality_tier = 'B_tier')::DOUBLE AS "primary_B_tier_count",
  count(*) FILTER (WHERE quality_tier = 'C_tier')::DOUBLE AS "primary_C_tier_count", count(*)::DOUBLE AS common_cells,
  ((SELECT count(*) FROM cells_a) - count(*))::DOUBLE AS lost_cells,
  round(100.0 * ((SELECT count(*) FROM cells_a) - count(*)) / (SELECT count(*) FROM cells_a), 4)::DOUBLE AS lost_ratio_pct,
  round(min(ship_depth_m), 2)::DOUBLE AS primary_depth_min_m, round(max(ship_depth_m), 2)::DOUBLE AS primary_depth_max_m,
  round(min(ship_elev_m), 2)::DOUBLE AS primary_elev_min_m, round(max(ship_elev_m), 2)::DOUBLE AS primary_elev_max_m
  FROM primary_a) UNPIVOT (value FOR metric IN (COLUMNS(*)))""")
def _(spark, d):
    s = Survey.of(spark, d)
    return C.validation_summary(s.primary, s.sensitivity)


@query("weight_grid", "", "lon_deg lat_deg mean_validation_weight",
       "SELECT floor(lon_center) AS lon_deg, floor(lat_center) AS lat_deg, avg(validation_weight) AS mean_validation_weight FROM primary_a GROUP BY 1, 2")
def _(spark, d):
    return TB.coarse_grid(Survey.of(spark, d).primary, "validation_weight", 1.0)


@query("shift_histogram", "bin n_rows", "", """
SELECT CAST(least(floor((greatest(-100, least(100, depth_shift_m)) + 100) / 1.0), 199) AS BIGINT) AS bin, count(*) AS n_rows
FROM comparison_a WHERE depth_shift_m IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return TB.histogram(Survey.of(spark, d).comparison, "depth_shift_m", -100.0, 100.0, 200)


@query("survey_checks", "check_name n_bad status", "", """
SELECT check_name, n_bad, CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'unique_key' AS check_name, (SELECT count(*) - count(DISTINCT (lat_bin, lon_bin)) FROM cells_a) AS n_bad
  UNION ALL SELECT 'planted_unique_key', (SELECT count(*) FROM cells_a WHERE lat_bin % 3 = 0)) AS u
UNION ALL SELECT 'median_recheck', (SELECT count(*) FROM cells_a a JOIN cells_kept_a b USING (lat_bin, lon_bin)
  WHERE a.median_depth_file_balanced <> b.median_depth_file_balanced) + (SELECT count(*) FROM cells_a a ANTI JOIN cells_kept_a b USING (lat_bin, lon_bin)) , 'FAIL'""")
def _(spark, d):
    s = Survey.of(spark, d)
    twice = s.cells_t.unionByName(s.cells_t.where("lat_bin % 3 = 0"))
    return TB.union_all([K.check_unique(s.cells_t, C.CELL), K.check_unique(twice, C.CELL, "planted_unique_key"),
                         K.check_median(s.cells_t, s.filtered, C.CELL, "median_depth_file_balanced")])
