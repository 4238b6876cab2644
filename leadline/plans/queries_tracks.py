"""Queries over the track source: normalisation, file-cells, residuals, calibration, policy."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells as C
from ..operators import checks as K
from ..operators import overlap as O
from ..operators import points as P
from ..operators import policy as Q
from . import oracle_shared as S
from .registry import query
from .stages import Tracks

KEY = "l_orderkey l_linenumber l_partkey l_suppkey track_id"


@query("positions_shifted", KEY, "lon lat lon_wrapped", f"SELECT *, {S.wrap_lon('lon_raw')} AS lon_wrapped FROM normalized_b")
def _(spark, d):
    raw = Tracks.of(spark, d).raw
    return raw.withColumns({"lon": geo.shift_lon("lon_raw"), "lat": geo.clean_lat("lat_raw"), "lon_wrapped": geo.wrap_lon("lon_raw")})


@query("track_signs", "track_id depth_sign_raw", "", "signs_b")
def _(spark, d):
    return P.track_signs(Tracks.of(spark, d).raw)


@query("depth_normalized", f"{KEY} depth_sign_raw sign_warning was_clipped", "depth_raw depth_m_positive_down elev_m", "normalized_b")
def _(spark, d):
    return Tracks.of(spark, d).points


@query("track_point_checks", f"{KEY} {' '.join(P.TRACK_CHECKS)} point_check_pass_basic", "", "checked_b")
def _(spark, d):
    return Tracks.of(spark, d).points


@query("track_check_summary", "track_id n_points_in " + " ".join(f"n_fail_{c}" for c in P.TRACK_CHECKS) + " n_points_pass", "",
       "SELECT track_id, count(*) AS n_points_in, " + ", ".join(f"count(*) FILTER (WHERE NOT {c}) AS n_fail_{c}" for c in P.TRACK_CHECKS)
       + ", count(*) FILTER (WHERE point_check_pass_basic) AS n_points_pass FROM checked_b GROUP BY track_id")
def _(spark, d):
    return P.qc_summary(Tracks.of(spark, d).points, "track_id", P.TRACK_CHECKS, "point_check_pass_basic")


@query("track_summary", "track_id n_points_out time_min time_max n_warnings n_clipped",
       "bbox_lon_min bbox_lon_max bbox_lat_min bbox_lat_max depth_min depth_max", """
SELECT track_id, count(*) AS n_points_out, min(time) AS time_min, max(time) AS time_max, count(*) FILTER (WHERE sign_warning) AS n_warnings,
  count(*) FILTER (WHERE was_clipped) AS n_clipped, min(lon) AS bbox_lon_min, max(lon) AS bbox_lon_max, min(lat) AS bbox_lat_min, max(lat) AS bbox_lat_max,
  min(depth_m_positive_down) AS depth_min, max(depth_m_positive_down) AS depth_max FROM normalized_b GROUP BY track_id""")
def _(spark, d):
    return P.summarize_points(Tracks.of(spark, d).points, "track_id")


@query("duplicate_points", "track_id n_depth_eq_zero n_depth_negative_finite n_duplicate_points n_unique_triples", "", """
SELECT track_id, count(*) FILTER (WHERE depth_m_positive_down = 0) AS n_depth_eq_zero, count(*) FILTER (WHERE depth_m_positive_down < 0) AS n_depth_negative_finite,
  count(*) - any_value(u) AS n_duplicate_points, any_value(u) AS n_unique_triples
FROM checked_b JOIN (SELECT track_id, count(*) AS u FROM (SELECT DISTINCT track_id, lon, lat, depth_m_positive_down FROM checked_b) GROUP BY track_id) USING (track_id)
GROUP BY track_id""")
def _(spark, d):
    return P.duplicate_counts(Tracks.of(spark, d).points, "track_id")


@query("track_file_cells", "branch track_id cell_id lat_bin lon_bin n_points_pass n_unique_triples source_type source_completeness instrument_class_pred manual_review_flag",
       "lon_center lat_center duplicate_ratio median_depth_m mean_depth_m std_depth_m min_depth_m max_depth_m range_depth_m iqr_depth_m "
       "median_depth_m_unique_triples", "fc_b")
def _(spark, d):
    return Tracks.of(spark, d).file_cells


@query("branch_cells", "branch cell_id lat_bin lon_bin lat_band_10deg n_track_cells n_tracks n_points_pass_total n_unique_triples_total n_source_decoded "
       "n_source_xyz n_source_regional n_completeness_nc_xyz_intersect n_completeness_xyz_only n_completeness_nc_only n_instrument_singlebeam "
       "n_instrument_multibeam manual_review_track_cell_count manual_review_unique_triples manual_review_any manual_review_reasons",
       "lon_center lat_center median_depth_m mean_of_track_medians std_of_track_medians min_track_median max_track_median range_track_median "
       "iqr_of_track_medians duplicate_ratio_cell manual_review_unique_triples_share", "cells_b")
def _(spark, d):
    return Tracks.of(spark, d).cells


@query("branch_totals", "branch n_cells_total n_track_cells_total n_points_pass_grand_total n_unique_triples_grand_total n_lat_bands_occupied "
       "n_manual_review_cells", "manual_review_cell_share", """
SELECT branch, count(*) AS n_cells_total, CAST(sum(n_track_cells) AS BIGINT) AS n_track_cells_total, CAST(sum(n_points_pass_total) AS BIGINT) AS n_points_pass_grand_total,
  CAST(sum(n_unique_triples_total) AS BIGINT) AS n_unique_triples_grand_total, count(DISTINCT lat_band_10deg) AS n_lat_bands_occupied,
  count(*) FILTER (WHERE manual_review_any) AS n_manual_review_cells, avg(manual_review_any::INT) AS manual_review_cell_share FROM cells_b GROUP BY branch""")
def _(spark, d):
    return C.branch_totals(Tracks.of(spark, d).cells)


@query("track_cell_residuals", "branch track_id cell_id branch_cell_manual_review_any",
       "residual_m abs_residual_m branch_cell_median_depth_m branch_cell_duplicate_ratio_cell", "res_b")
def _(spark, d):
    return Tracks.of(spark, d).residuals


@query("track_residual_summary", "branch track_id source_type source_completeness instrument_class_pred manual_review_flag manual_review_reasons "
       "n_overlap_cells n_unique_triples_total", "median_residual_m mean_residual_m mad_residual_m iqr_residual_m rmse_residual_m p95_abs_residual_m "
       "max_abs_residual_m duplicate_ratio_summary manual_review_cell_share", f"""
SELECT a.*, m.mad_residual_m FROM (
  SELECT branch, track_id, source_type, source_completeness, instrument_class_pred, bool_or(manual_review_flag) AS manual_review_flag,
    CASE WHEN bool_or(manual_review_flag) THEN 'supplementary_check_flag' ELSE '' END AS manual_review_reasons,
    count(DISTINCT cell_id) AS n_overlap_cells, CAST(sum(n_unique_triples) AS BIGINT) AS n_unique_triples_total, median(residual_m) AS median_residual_m,
    avg(residual_m) AS mean_residual_m, {S.q('residual_m', .75)} - {S.q('residual_m', .25)} AS iqr_residual_m, sqrt(avg(residual_m * residual_m)) AS rmse_residual_m,
    {S.q('abs_residual_m', .95)} AS p95_abs_residual_m, max(abs_residual_m) AS max_abs_residual_m,
    1.0 - sum(n_unique_triples) / sum(n_points_pass) AS duplicate_ratio_summary, avg(branch_cell_manual_review_any::INT) AS manual_review_cell_share
  FROM res_b GROUP BY ALL) a
JOIN (SELECT branch, track_id, median(abs(residual_m - med)) AS mad_residual_m
      FROM (SELECT *, median(residual_m) OVER (PARTITION BY branch, track_id) AS med FROM res_b) GROUP BY branch, track_id) m USING (branch, track_id)""")
def _(spark, d):
    t = Tracks.of(spark, d)
    return O.track_residuals(t.residuals)


TEN = " ".join(O.TEN_QUANTILES)


@query("branch_residual_summary", "branch n_branch_cells_total n_overlap_cells n_overlap_track_cell_rows", f"overlap_share rmse_residual_m_branch {TEN}", "branch_res_b")
def _(spark, d):
    return Tracks.of(spark, d).branch_residuals


@query("cross_branch_residuals", "pair_label left_branch right_branch cell_id left_n_track_cells right_n_track_cells left_manual_review_any "
       "right_manual_review_any left_lat_band_10deg", "left_median_depth_m right_median_depth_m residual_m abs_residual_m left_duplicate_ratio_cell "
       "right_iqr_of_track_medians", "cross_b")
def _(spark, d):
    return Tracks.of(spark, d).cross


@query("pair_residual_summary", "pair_label left_branch right_branch n_overlap_cells n_left_cells_total n_right_cells_total n_overlap_both_flagged "
       "n_overlap_either_flagged", f"overlap_share_of_left overlap_share_of_right rmse_pair_m {TEN}", "pair_res_b")
def _(spark, d):
    return Tracks.of(spark, d).pair_residuals


_DIST = (f"count(*) AS n_overlap_rows, sqrt(avg(residual_m * residual_m)) AS rmse, median(residual_m) AS residual_p50, median(abs_residual_m) AS abs_residual_p50, "
         f"{S.q('abs_residual_m', .95)} AS abs_residual_p95, {S.q('abs_residual_m', .99)} AS abs_residual_p99")
_DIST_V = "rmse residual_p50 abs_residual_p50 abs_residual_p95 abs_residual_p99"


def _labels(key: str, groups, fixed: dict) -> str:
    rows = ", ".join(f"('{g}', '{k}', '{v}')" for g in groups for k, vs in fixed.items() for v in vs)
    return f"(SELECT * FROM (VALUES {rows}) AS l({key}, breakdown_type, group_value))"


def _breakdown(key: str, table: str, columns: dict, groups, fixed) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, '{k}' AS breakdown_type, CAST({c} AS VARCHAR) AS group_value, {_DIST} FROM {table} GROUP BY ALL"
                               for k, c in columns.items())
    cols = ", ".join(f"s.{c}" for c in _DIST_V.split())
    return (f"SELECT {key}, breakdown_type, group_value, coalesce(s.n_overlap_rows, 0) AS n_overlap_rows, {cols} "
            f"FROM ({parts}) s FULL JOIN {_labels(key, groups, fixed)} l USING ({key}, breakdown_type, group_value)")


_FLAGS = ["false", "true"]


@query("within_breakdowns", "branch breakdown_type group_value n_overlap_rows", _DIST_V, _breakdown(
    "branch", "res_b", {"manual_review_flag": "manual_review_flag", "source_type": "source_type",
                        "duplicate_ratio_cell_bin": S.dup_label("branch_cell_duplicate_ratio_cell")}, O.BRANCHES,
    {"manual_review_flag": _FLAGS, "duplicate_ratio_cell_bin": S.bins.DUPLICATE_RATIO_LABELS}))
def _(spark, d):
    t = Tracks.of(spark, d)
    return O.breakdowns_within(t.residuals)


@query("cross_breakdowns", "pair_label breakdown_type group_value n_overlap_rows", _DIST_V, _breakdown(
    "pair_label", "cross_b", {"manual_review_either": "(left_manual_review_any OR right_manual_review_any)",
                              "dup_ratio_either_bin": S.dup_label("greatest(left_duplicate_ratio_cell, right_duplicate_ratio_cell)"),
                              "lat_band_10deg": "left_lat_band_10deg"}, [p[0] for p in O.PAIRS],
    {"manual_review_either": _FLAGS, "dup_ratio_either_bin": S.bins.DUPLICATE_RATIO_LABELS}))
def _(spark, d):
    t = Tracks.of(spark, d)
    return O.breakdowns_cross(t.cross_t)


@query("calibration_by_branch", "branch n_cells_total n_cells_with_within_branch_overlap n_cells_with_cross_branch_overlap_any n_cells_no_overlap_evidence "
       "highdup_cell_count", "share_with_overlap_evidence manual_review_cell_share within_branch_rmse_m abs_residual_p95_within_branch "
       "cross_branch_rmse_m_avg abs_residual_p95_cross_branch_max", """
SELECT b.*, w.rmse_residual_m_branch AS within_branch_rmse_m, w.abs_residual_p95 AS abs_residual_p95_within_branch, x.cross_branch_rmse_m_avg, x.abs_residual_p95_cross_branch_max
FROM (SELECT branch, count(*) AS n_cells_total, count(*) FILTER (WHERE n_track_cells >= 2) AS n_cells_with_within_branch_overlap,
    count(*) FILTER (WHERE n_cross_branch_overlap >= 1) AS n_cells_with_cross_branch_overlap_any,
    count(*) FILTER (WHERE n_track_cells < 2 AND n_cross_branch_overlap = 0) AS n_cells_no_overlap_evidence,
    avg((n_track_cells >= 2 OR n_cross_branch_overlap >= 1)::INT) AS share_with_overlap_evidence, avg(manual_review_any::INT) AS manual_review_cell_share,
    CASE WHEN count(*) FILTER (WHERE branch = 'multibeam' AND duplicate_ratio_cell > 0.5 AND manual_review_any) > 0
      THEN count(*) FILTER (WHERE branch = 'multibeam' AND duplicate_ratio_cell > 0.5 AND manual_review_any)
      ELSE count(*) FILTER (WHERE branch = 'multibeam' AND duplicate_ratio_cell > 0.5) END AS highdup_cell_count
  FROM annotated_b GROUP BY branch) b LEFT JOIN branch_res_b w USING (branch)
LEFT JOIN (SELECT branch, avg(rmse_pair_m) AS cross_branch_rmse_m_avg, max(abs_residual_p95) AS abs_residual_p95_cross_branch_max
  FROM (SELECT left_branch AS branch, * FROM pair_res_b UNION ALL SELECT right_branch, * FROM pair_res_b) GROUP BY branch) x USING (branch)""")
def _(spark, d):
    t = Tracks.of(spark, d)
    return Q.calib_branch(t.cells_t, t.cross_t, t.branch_residuals, t.pair_residuals)


@query("calibration_by_lat_depth", "branch lat_band_10deg depth_bin_lo depth_bin_hi n_cells n_cells_with_overlap highdup_cell_count_local "
       "cross_branch_n_overlap_total", "manual_review_share_local within_branch_residual_p50 within_branch_residual_p95 within_branch_residual_p99 "
       "cross_branch_residual_max_p95", "lat_depth_b")
def _(spark, d):
    return Tracks.of(spark, d).lat_depth


_SP = "rmse residual_p50 residual_p95 residual_p99 abs_residual_p50 abs_residual_p95 abs_residual_p99"


@query("calibration_by_source_pair", "pair_label dup_bin_lo dup_bin_hi n_unique_lo n_unique_hi n_cells_in_slice", _SP, "source_pair_b")
def _(spark, d):
    return Tracks.of(spark, d).source_pair


@query("squared_error_share", "lat_band_10deg n_cells", "rmse share_of_squared_error", """
SELECT lat_band_10deg, n_cells, rmse, sq / sum(sq) OVER () AS share_of_squared_error FROM (
  SELECT left_lat_band_10deg AS lat_band_10deg, count(*) AS n_cells, sqrt(avg(residual_m * residual_m)) AS rmse, sum(residual_m * residual_m) AS sq
  FROM cross_b WHERE pair_label = 'mb_vs_sb' GROUP BY 1)""")
def _(spark, d):
    return Q.sq_error_share(Tracks.of(spark, d).cross, "mb_vs_sb")


@query("consistency_zones", "lat_band_10deg depth_bin_lo depth_bin_hi n_cells", "rmse abs_residual_p95", f"""
SELECT * FROM (SELECT left_lat_band_10deg AS lat_band_10deg, {S.policy_depth('left_median_depth_m', 0)} AS depth_bin_lo, {S.policy_depth('left_median_depth_m', 1)} AS depth_bin_hi,
  count(*) AS n_cells, sqrt(avg(residual_m * residual_m)) AS rmse, {S.q('abs_residual_m', .95)} AS abs_residual_p95 FROM cross_b WHERE pair_label = 'mb_vs_regional'
  GROUP BY 1, 2, 3) WHERE rmse < 150""")
def _(spark, d):
    t = Tracks.of(spark, d)
    return Q.consistency_zones(t.cross)


@query("overlap_strength", "n_track_lo n_track_hi n_cells", "median_n_unique_triples_total share", f"""
SELECT n_track_lo, n_track_hi, n_cells, median_n_unique_triples_total, n_cells / sum(n_cells) OVER () AS share FROM (
  SELECT {S.case_right_open('CAST(n_track_cells AS DOUBLE)', S.bins.TRACK_COUNT_EDGES, 0)} AS n_track_lo, {S.case_right_open('CAST(n_track_cells AS DOUBLE)', S.bins.TRACK_COUNT_EDGES, 1)} AS n_track_hi,
    count(*) AS n_cells, median(n_unique_triples_total) AS median_n_unique_triples_total FROM cells_b WHERE branch = 'singlebeam' GROUP BY 1, 2)""")
def _(spark, d):
    t = Tracks.of(spark, d)
    return Q.overlap_strength(t.cells)


@query("high_duplicate_profile", "branch n_cells dominant_lat_band_10deg", "median_lon_center median_lat_center", """
SELECT branch, count(*) AS n_cells, median(lon_center) AS median_lon_center, median(lat_center) AS median_lat_center,
  (SELECT lat_band_10deg FROM cells_b WHERE branch = 'multibeam' AND duplicate_ratio_cell > 0.5 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_lat_band_10deg
FROM cells_b WHERE branch = 'multibeam' AND duplicate_ratio_cell > 0.5 GROUP BY branch""")
def _(spark, d):
    t = Tracks.of(spark, d)
    return Q.highdup_profile(t.cells_t)


@query("cross_membership", "branch cell_id n_cross_branch_overlap in_cross_pair", "", "annotated_b")
def _(spark, d):
    t = Tracks.of(spark, d)
    return Q.annotate_cross(t.cells_t, t.cross_t).withColumn("in_cross_pair", F.array_join("in_cross_pair", "|"))


@query("slice_lookups", "branch cell_id depth_bin_lo", "within_or_cross_p95 within_branch_residual_p95 cross_branch_residual_max_p95 mb_vs_regional_p95 "
       "mb_vs_regional_rmse", "sliced_b")
def _(spark, d):
    t = Tracks.of(spark, d)
    return t.sliced


POLICY = ("branch cell_id matched_rule_id matched_rule_priority quality_tier exclude_from_primary evidence_class branch_role highdup_flag "
          "sensitivity_only_flag low_evidence_flag source_risk_class use_for_primary_validation use_for_supplementary_validation "
          "use_for_regional_experiment exclusion_or_review_reason manual_review_any")


@query("quality_policy", POLICY, "validation_weight", "policy_b")
def _(spark, d):
    return Tracks.of(spark, d).flagged


@query("rule_usage", "rule_id applies_as priority n_cells", "recommended_weight", """
SELECT r.matched_rule_id AS rule_id, 'first_match' AS applies_as, r.pr AS priority, count(p.cell_id) AS n_cells, any_value(r.validation_weight) AS recommended_weight
FROM rule_values r LEFT JOIN policy_b p USING (matched_rule_id) WHERE r.pr < 99 GROUP BY 1, 2, 3
UNION ALL SELECT 'manual_review_not_exclusion', 'invariant', NULL, 0, 0.6""")
def _(spark, d):
    t = Tracks.of(spark, d)
    used = t.flagged.groupBy(F.col("matched_rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    return Q.candidate_rules(spark).join(used, "rule_id", "left").withColumn("n_cells", F.coalesce("n", F.lit(0)).cast("bigint"))


def _summary(name: str, cols: list[str]) -> str:
    key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
    return (f"SELECT '{name}' AS summary, {key} AS group_key, count(*) AS n_cells, avg(validation_weight) AS mean_weight, "
            f"count(*) FILTER (WHERE highdup_flag) AS n_highdup, count(*) FILTER (WHERE low_evidence_flag) AS n_low_evidence FROM policy_b GROUP BY 1, 2")


@query("policy_summaries", "summary group_key n_cells n_highdup n_low_evidence", "mean_weight", " UNION ALL ".join([
    _summary("branch", ["branch", "quality_tier", "branch_role", "use_for_primary_validation", "use_for_supplementary_validation", "use_for_regional_experiment"]),
    _summary("lat_depth", ["branch", "lat_band_10deg", "depth_bin_lo", "quality_tier"]),
    _summary("rule", ["matched_rule_priority", "matched_rule_id", "quality_tier", "exclude_from_primary"]),
    _summary("evidence", ["branch", "evidence_class", "quality_tier"])]))
def _(spark, d):
    return Q.policy_summaries(Tracks.of(spark, d).flagged)


def _track_checks(cells: str, fc: str, cross: str, prefix: str = "") -> str:
    rows = {"cells_unique": f"SELECT count(*) - count(DISTINCT (branch, lat_bin, lon_bin)) FROM {cells}",
            "positive_points": f"SELECT count(*) FILTER (WHERE NOT coalesce(n_points_pass > 0, false)) FROM {fc}",
            "unique_triples_present": f"SELECT count(*) FILTER (WHERE n_unique_triples IS NULL) FROM {fc}",
            "known_branch": f"SELECT count(*) FILTER (WHERE NOT coalesce(branch IN ('singlebeam', 'multibeam', 'regional'), false)) FROM {fc}",
            "residual_formula": f"SELECT count(*) FILTER (WHERE residual_m <> left_median_depth_m - right_median_depth_m) FROM {cross}"}
    return " UNION ALL ".join(f"SELECT '{prefix}{k}' AS check_name, n AS n_bad, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({q}) AS c(n)" for k, q in rows.items())


@query("track_checks", "check_name n_bad status", "", _track_checks("cells_b", "fc_b", "cross_b") + " UNION ALL " + _track_checks(
    "(SELECT branch, lat_bin, lon_bin FROM cells_b UNION ALL SELECT branch, lat_bin, lon_bin FROM cells_b WHERE lat_bin % 3 = 0)",
    "(SELECT * REPLACE (CASE WHEN lat_bin % 3 = 0 THEN NULL ELSE n_unique_triples END AS n_unique_triples, CASE WHEN lat_bin % 5 = 0 THEN 0 ELSE n_points_pass END AS n_points_pass, "
    "CASE WHEN lat_bin % 2 = 0 THEN 'unheard' ELSE branch END AS branch) FROM fc_b)",
    "(SELECT * REPLACE (CASE WHEN lat_bin % 2 = 0 THEN residual_m + 1 ELSE residual_m END AS residual_m) FROM cross_b)", "planted_")
    + " UNION ALL SELECT 'manual_review_not_exclusion', n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT count(*) AS n FROM matched_b m LEFT JOIN matched_unflagged u "
    "USING (branch, lat_bin, lon_bin) WHERE u.matched_rule_priority IS DISTINCT FROM m.matched_rule_priority) AS c")
def _(spark, d):
    """The checks on cells, file-cells and residuals, and on damaged copies."""
    t = Tracks.of(spark, d)
    unflagged = Q.apply_rules(Q.with_slices(Q.annotate_cross(t.cells_t.withColumn("manual_review_any", F.lit(False)), t.cross_t), t.lat_depth, t.source_pair))
    lat = F.col("lat_bin")
    twice = t.cells_t.unionByName(t.cells_t.where("lat_bin % 3 = 0"))
    damaged = t.file_cells_t.withColumns({"n_unique_triples": F.when(lat % 3 != 0, F.col("n_unique_triples")), "n_points_pass": F.when(lat % 5 == 0, 0).otherwise(F.col("n_points_pass")),
                                          "branch": F.when(lat % 2 == 0, "unheard").otherwise(F.col("branch"))})
    shifted = t.cross_t.withColumn("residual_m", F.when(lat % 2 == 0, F.col("residual_m") + 1).otherwise(F.col("residual_m")))
    formula = ("left_median_depth_m", "right_median_depth_m")
    planted = K.check_cells_b(twice, damaged).unionByName(K.check_residual_formula(shifted, *formula))
    return (K.check_cells_b(t.cells_t, t.file_cells_t)
            .unionByName(K.check_residual_formula(t.cross_t, *formula))
            .unionByName(K.check_review_invariant(t.flagged_t, unflagged))
            .unionByName(planted.withColumn("check_name", F.concat(F.lit("planted_"), "check_name"))))


@query("overlap_deviation", "pair_label n_overlap_cells expected_overlap gt_5pct_deviation", "deviation_pct", """
SELECT pair_label, n_overlap_cells, e AS expected_overlap, 100.0 * (n_overlap_cells - e) / e AS deviation_pct, abs((n_overlap_cells - e) / e) > 0.05 AS gt_5pct_deviation
FROM (SELECT pair_label, n_overlap_cells, least(n_left_cells_total, n_right_cells_total) AS e FROM pair_res_b)""")
def _(spark, d):
    pairs = Tracks.of(spark, d).pair_residuals
    expected = pairs.select("pair_label", F.least("n_left_cells_total", "n_right_cells_total").alias("expected_overlap"))
    return K.check_overlap_deviation(pairs, expected)
