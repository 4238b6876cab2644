"""Shared sub-results of the oracle SQL (DuckDB dialect)."""
from __future__ import annotations

from ..functions import bins
from ..operators import policy
from ..operators.overlap import PAIRS
from .fixtures import oracle_views
from .registry import shared

for _name, _sql in oracle_views().items():
    shared(_name, _sql)


def wrap_lon(x: str) -> str:
    return f"(({x} + 180) - floor(({x} + 180) / 360) * 360 - 180)"


def lat_band(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(-90, least(80, CAST(floor(({x}) / 10) * 10 AS BIGINT))) END"


def pad4(x: str) -> str:
    v = f"CAST(floor({x} / 10) * 10 AS BIGINT)"
    return f"CASE WHEN {v} < 0 THEN '-' || lpad(CAST(-{v} AS VARCHAR), 3, '0') ELSE lpad(CAST({v} AS VARCHAR), 4, '0') END"


def region(lon: str = "lon_center", lat: str = "lat_center") -> str:
    return f"'lon' || {pad4(lon)} || '_lat' || {pad4(lat)}"


def case_right_open(x: str, edges: list[float], side: int, kind: str = "DOUBLE") -> str:
    spans = list(zip(edges[:-1], edges[1:]))

    def lit(v: float) -> str:
        return f"CAST('Infinity' AS {kind})" if v == float("inf") else f"CAST({v} AS {kind})"
    whens = " ".join(f"WHEN {x} < {s[1]} THEN {lit(s[side])}" for s in spans[:-1])
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {lit(spans[-1][side])} END"


def depth_metric(x: str) -> str:
    edges = bins.METRIC_DEPTH_EDGES[1:]
    whens = " ".join(f"WHEN {x} < {e} THEN '{label}'" for e, label in zip(edges, bins.METRIC_DEPTH_LABELS))
    return f"CASE WHEN {x} IS NULL OR {x} < 0 THEN 'unknown' {whens} ELSE '>7000m' END"


def depth_regional(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {e} THEN '{label}'" for e, label in zip(bins.REGIONAL_DEPTH_EDGES, bins.REGIONAL_DEPTH_LABELS))
    return f"CASE {whens} WHEN {x} IS NOT NULL THEN '>7000' END"


def dup_label(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {e} THEN '{label}'" for e, label in zip(bins.DUPLICATE_RATIO_EDGES[1:-1], bins.DUPLICATE_RATIO_LABELS))
    return f"CASE {whens} WHEN {x} IS NOT NULL THEN '{bins.DUPLICATE_RATIO_LABELS[-1]}' END"


def policy_depth(x: str, side: int) -> str:
    clipped = f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, 0), 11500) END)"
    return case_right_open(clipped, bins.POLICY_DEPTH_EDGES, side, "BIGINT")


def q(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


CENTER = "-180 + (lon_bin + 0.5) / 60 AS lon_center, -90 + (lat_bin + 0.5) / 60 AS lat_center"
CELL_ID = "concat('1min_', lat_bin, '_', lon_bin) AS cell_id"

# --- source A -------------------------------------------------------------------------------------------

shared("points_a", f"SELECT *, {wrap_lon('lon_raw')} AS lon, lat_raw AS lat, depth_raw AS depth_m_positive_down, "
       "-depth_raw AS elev_m FROM soundings")
shared("checked_a", """
SELECT *, coalesce(lon >= -180 AND lon < 180, false) AS qc_valid_lon, coalesce(lat BETWEEN -90 AND 90, false) AS qc_valid_lat,
  coalesce(depth_m_positive_down > 0, false) AS qc_depth_positive, coalesce(depth_m_positive_down <= 12000, false) AS qc_depth_not_extreme,
  coalesce(elev_m < 0, false) AS qc_elev_negative,
  (lon IS NOT NULL AND lat IS NOT NULL AND depth_m_positive_down IS NOT NULL AND elev_m IS NOT NULL) AS qc_no_nan,
  coalesce(depth_m_positive_down = 0, false) AS qc_zero_depth FROM points_a""")
shared("qc_a", """
SELECT *, (qc_valid_lon AND qc_valid_lat AND qc_depth_positive AND qc_depth_not_extreme AND qc_elev_negative AND qc_no_nan) AS qc_pass_basic,
  concat_ws(',', CASE WHEN NOT qc_valid_lon THEN 'invalid_lon' END, CASE WHEN NOT qc_valid_lat THEN 'invalid_lat' END,
    CASE WHEN NOT qc_depth_positive THEN 'non_positive_depth' END, CASE WHEN NOT qc_depth_not_extreme THEN 'extreme_depth' END,
    CASE WHEN NOT qc_elev_negative THEN 'non_negative_elev' END, CASE WHEN NOT qc_no_nan THEN 'nan_value' END) AS qc_reason
FROM checked_a""")
shared("binned_a", "SELECT *, CAST(floor((lon + 180) * 60) AS BIGINT) AS lon_bin, CAST(floor((lat + 90) * 60) AS BIGINT) AS lat_bin "
       "FROM qc_a WHERE qc_pass_basic")
shared("fc_a_raw", f"""
SELECT file_id, lat_bin, lon_bin, any_value(cruise_id) AS cruise_id, any_value(archive_id) AS archive_id,
  any_value(track_kind) AS track_kind, any_value(data_layout) AS data_layout, count(*) AS n_points,
  median(depth_m_positive_down) AS median_depth_m_positive_down, avg(depth_m_positive_down) AS mean_depth_m_positive_down,
  coalesce(stddev_samp(depth_m_positive_down), 0) AS std_depth_m, min(depth_m_positive_down) AS min_depth_m,
  max(depth_m_positive_down) AS max_depth_m, {q('depth_m_positive_down', .25)} AS q25_depth_m, {q('depth_m_positive_down', .75)} AS q75_depth_m,
  avg(elev_m) AS mean_elev_m, count(date_raw) AS n_date_nonnull, count(time_raw) AS n_time_nonnull, count(sonar_idx) AS n_sonar_idx_nonnull
FROM binned_a GROUP BY file_id, lat_bin, lon_bin""")
shared("fc_a", f"SELECT *, {CELL_ID}, {CENTER}, -median_depth_m_positive_down AS median_elev_m, q75_depth_m - q25_depth_m AS iqr_depth_m FROM fc_a_raw")


def merge_a(source: str) -> str:
    return f"""
SELECT lat_bin, lon_bin, {CELL_ID}, {CENTER}, CAST(sum(n_points) AS BIGINT) AS n_points_total, count(*) AS n_file_cells,
  count(DISTINCT file_id) AS n_files, count(DISTINCT cruise_id) AS n_cruises_guess, count(DISTINCT archive_id) AS n_archives,
  median(median_depth_m_positive_down) AS median_depth_file_balanced, -median(median_depth_m_positive_down) AS median_elev_file_balanced,
  avg(median_depth_m_positive_down) AS mean_depth_file_balanced, -avg(median_depth_m_positive_down) AS mean_elev_file_balanced,
  sum(mean_depth_m_positive_down * n_points) / sum(n_points) AS weighted_mean_depth_point_weighted,
  -sum(mean_depth_m_positive_down * n_points) / sum(n_points) AS weighted_mean_elev_point_weighted,
  coalesce(stddev_samp(median_depth_m_positive_down), 0) AS std_depth_between_file_cells,
  {q('median_depth_m_positive_down', .25)} AS q25_depth_between_file_cells, {q('median_depth_m_positive_down', .75)} AS q75_depth_between_file_cells,
  {q('median_depth_m_positive_down', .75)} - {q('median_depth_m_positive_down', .25)} AS iqr_depth_between_file_cells,
  min(min_depth_m) AS min_depth_file_cell, max(max_depth_m) AS max_depth_file_cell, max(max_depth_m) - min(min_depth_m) AS range_depth_file_cell,
  count(*) FILTER (WHERE data_layout = 'lon_lat_depth_3col') AS n_3col_file_cells,
  count(*) FILTER (WHERE data_layout = 'date_time_sonar_lon_lat_depth_6col') AS n_6col_file_cells,
  first(file_id ORDER BY n_points DESC, file_id) AS dominant_file_id, first(cruise_id ORDER BY n_points DESC, file_id) AS dominant_cruise_id,
  first(track_kind ORDER BY n_points DESC, file_id) AS dominant_track_kind, first(data_layout ORDER BY n_points DESC, file_id) AS dominant_data_layout
FROM {source} GROUP BY lat_bin, lon_bin"""


shared("cells_a", merge_a("fc_a"))
shared("res_a", """
SELECT f.*, c.n_cruises_guess > 1 AS is_multi_cruise, c.n_file_cells AS cell_n_file_cells,
  f.median_depth_m_positive_down - c.median_depth_file_balanced AS residual_depth_m,
  f.median_elev_m - c.median_elev_file_balanced AS residual_elev_m
FROM fc_a f JOIN cells_a c USING (lat_bin, lon_bin) WHERE c.n_file_cells > 1""")


def bias_a(key: str) -> str:
    x = "residual_depth_m"
    return f"""
SELECT b.*, m.residual_depth_m_mad FROM (
  SELECT {key}, count(*) AS n_overlap_file_cells, count(DISTINCT cruise_id) AS n_overlap_cruises,
    CAST(sum(n_points) AS BIGINT) AS n_points_total_overlap, avg({x}) AS {x}_mean, coalesce(stddev_samp({x}), 0) AS {x}_std,
    sqrt(avg({x} * {x})) AS {x}_rmse, max(abs({x})) AS max_abs_{x}, median({x}) AS {x}_median,
    {q(x, .75)} - {q(x, .25)} AS {x}_iqr, {q(x, .05)} AS {x}_p05, {q(x, .95)} AS {x}_p95,
    median(abs({x})) AS abs_{x}_median, {q(f'abs({x})', .95)} AS abs_{x}_p95
  FROM res_a WHERE {key} IS NOT NULL GROUP BY {key}) b
JOIN (SELECT {key}, median(abs({x} - med)) AS residual_depth_m_mad
      FROM (SELECT {key}, {x}, median({x}) OVER (PARTITION BY {key}) AS med FROM res_a) GROUP BY {key}) m USING ({key})"""


shared("bias_file", bias_a("file_id"))
shared("bias_cruise", bias_a("cruise_id"))
shared("bias_archive", bias_a("archive_id"))
shared("disagreement_a", f"""
SELECT lat_bin, lon_bin, count(*) AS n_file_cells, count(DISTINCT cruise_id) AS n_cruises_guess,
  max(residual_depth_m) - min(residual_depth_m) AS residual_depth_range, {q('residual_depth_m', .75)} - {q('residual_depth_m', .25)} AS residual_depth_iqr,
  coalesce(stddev_samp(residual_depth_m), 0) AS residual_depth_std, max(abs(residual_depth_m)) AS max_abs_file_residual_depth
FROM res_a GROUP BY lat_bin, lon_bin""")


def leave_out(group: str, out: str) -> str:
    return f"""
SELECT o.lat_bin, o.lon_bin, o.{group}, median(f.median_depth_m_positive_down) AS {out}
FROM (SELECT DISTINCT lat_bin, lon_bin, {group} FROM fc_a) o
JOIN fc_a f ON f.lat_bin = o.lat_bin AND f.lon_bin = o.lon_bin AND f.{group} <> o.{group}
GROUP BY o.lat_bin, o.lon_bin, o.{group}"""


shared("other_cruise", leave_out("cruise_id", "other_cruise_median"))
shared("other_file", leave_out("file_id", "other_file_median"))
shared("three_a", """
SELECT f.*, c.n_file_cells AS cell_n_file_cells, c.n_cruises_guess AS cell_n_cruises,
  f.median_depth_m_positive_down - c.median_depth_file_balanced AS residual_to_all_cell_median,
  f.median_depth_m_positive_down - oc.other_cruise_median AS residual_to_other_cruise_median,
  f.median_depth_m_positive_down - ofi.other_file_median AS residual_to_other_file_median
FROM fc_a f JOIN cells_a c USING (lat_bin, lon_bin)
LEFT JOIN other_cruise oc USING (lat_bin, lon_bin, cruise_id) LEFT JOIN other_file ofi USING (lat_bin, lon_bin, file_id)""")


def audit_a(key: str) -> str:
    sets = {"residual_all": "residual_to_all_cell_median", "residual_other_cruise": "residual_to_other_cruise_median",
            "residual_other_file": "residual_to_other_file_median"}
    stats = ", ".join(f"median({c}) AS {p}_median, sqrt(avg({c} * {c})) AS {p}_rmse, {q(c, .05)} AS {p}_p05, {q(c, .95)} AS {p}_p95"
                      for p, c in sets.items())
    mads = ", ".join(f"median(abs({c} - m{i})) AS {p}_mad" for i, (p, c) in enumerate(sets.items()))
    meds = ", ".join(f"median({c}) OVER (PARTITION BY {key}) AS m{i}" for i, c in enumerate(sets.values()))
    return f"""
SELECT a.*, d.* EXCLUDE ({key}), n_total_file_cells - n_overlap_file_cells AS n_single_source_cells FROM (
  SELECT {key}, count(*) AS n_total_file_cells,
    count(DISTINCT CASE WHEN cell_n_file_cells > 1 THEN cell_id END) AS n_overlap_file_cells,
    count(residual_to_other_cruise_median) AS n_other_cruise_overlap_cells, count(residual_to_other_file_median) AS n_other_file_overlap_cells,
    CAST(sum(n_points) AS BIGINT) AS n_points_total, min(lon_center) AS lon_min, max(lon_center) AS lon_max, min(lat_center) AS lat_min,
    max(lat_center) AS lat_max, min(median_depth_m_positive_down) AS depth_min, max(median_depth_m_positive_down) AS depth_max, {stats}
  FROM three_a GROUP BY {key}) a
JOIN (SELECT {key}, {mads} FROM (SELECT *, {meds} FROM three_a) GROUP BY {key}) d USING ({key})"""


shared("audit_file", audit_a("file_id"))
shared("audit_cruise", audit_a("cruise_id"))


# files judged by the other-file median first, and cruises judged without a minimum overlap
BY_OTHER_FILE, ALWAYS_JUDGED = ["S3::3", "S3::13", "S5::5", "S1::1"], ["C3"]


def recommend(key: str, kind: str) -> str:
    size, file_med = "abs(residual_other_cruise_median)", "abs(residual_other_file_median)"
    special = f"{key} IN ({', '.join(map(repr, BY_OTHER_FILE))})"
    cases = [(f"{special} AND {file_med} >= 500", "exclude_candidate", "other_file_median"), (f"{special} AND {file_med} >= 50", "review_candidate", "other_file_median"),
             ("residual_other_cruise_median IS NULL", "keep", "no_overlap"),
             (f"{key} IN ({', '.join(map(repr, ALWAYS_JUDGED))}) AND {size} > 500", "exclude_candidate", "listed_cruise_median"),
             (f"n_other_cruise_overlap_cells >= 50 AND {size} >= 500", "exclude_candidate", "other_cruise_median"),
             (f"n_other_cruise_overlap_cells >= 50 AND {size} >= 50", "review_candidate", "other_cruise_median"),
             (f"{size} < 50 AND residual_other_cruise_rmse >= 500", "high_variance_review", "other_cruise_rmse")]
    action, reason = (" ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) for k in (1, 2))
    return f"""
SELECT '{kind}' AS candidate_type, {key} AS candidate_id, n_other_cruise_overlap_cells, residual_other_cruise_median, residual_other_cruise_rmse,
  CASE {action} ELSE 'keep' END AS recommended_action, CASE {reason} ELSE 'within_limits' END AS action_reason
FROM audit_{kind}"""


shared("actions_a", f"{recommend('file_id', 'file')} UNION ALL {recommend('cruise_id', 'cruise')}")
shared("files_a", "SELECT file_id, any_value(cruise_id) AS cruise_id, any_value(archive_id) AS archive_id, count(*) AS n_file_cells, "
       "CAST(sum(n_points) AS BIGINT) AS n_points_total FROM fc_a GROUP BY file_id")
shared("proposals_a", """
SELECT file_id, 'exclude' AS flag, 'extreme_cruise_bias' AS reason, 'listed_cruise:C3' AS source, 3 AS pr, 0 AS seq FROM files_a WHERE cruise_id = 'C3'
UNION ALL SELECT file_id, 'exclude', 'extreme_file_bias', 'listed_file:extreme_file_bias', 3, 1 FROM files_a
  WHERE contains(cruise_id, 'C5') AND contains(file_id, 'S5::15')
UNION ALL SELECT f.file_id, CASE WHEN recommended_action = 'review_candidate' THEN 'review' ELSE 'high_variance_review' END,
  CASE WHEN recommended_action = 'review_candidate' THEN 'review_candidate_overlap_bias' ELSE 'high_variance_overlap_scatter' END,
  'overlap_file:' || f.file_id, CASE WHEN recommended_action = 'review_candidate' THEN 2 ELSE 1 END, 0
  FROM files_a f JOIN actions_a a ON a.candidate_type = 'file' AND a.candidate_id = f.file_id
  WHERE recommended_action IN ('review_candidate', 'high_variance_review')
UNION ALL SELECT f.file_id, CASE WHEN recommended_action = 'review_candidate' THEN 'review' ELSE 'high_variance_review' END,
  CASE WHEN recommended_action = 'review_candidate' THEN 'review_candidate_overlap_bias' ELSE 'high_variance_overlap_scatter' END,
  'overlap_cruise:' || f.cruise_id, CASE WHEN recommended_action = 'review_candidate' THEN 2 ELSE 1 END, 1
  FROM files_a f JOIN actions_a a ON a.candidate_type = 'cruise' AND a.candidate_id = f.cruise_id
  WHERE recommended_action IN ('review_candidate', 'high_variance_review')""")
shared("best_flags_a", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pr DESC, seq) AS rn FROM proposals_a) WHERE rn = 1")
shared("flags_a", """
SELECT f.*, coalesce(p.flag, 'keep') AS quality_flag, coalesce(p.flag = 'exclude', false) AS exclude_from_primary_cells,
  coalesce(p.reason, '') AS flag_reason, coalesce(p.source, '') AS flag_source,
  coalesce(a1.recommended_action, a2.recommended_action) AS recommended_action
FROM files_a f LEFT JOIN best_flags_a p ON p.file_id = f.file_id
LEFT JOIN actions_a a1 ON a1.candidate_type = 'file' AND a1.candidate_id = f.file_id
LEFT JOIN actions_a a2 ON a2.candidate_type = 'cruise' AND a2.candidate_id = f.cruise_id""")
shared("excluded_a", "SELECT file_id FROM files_a WHERE cruise_id = 'C3' OR (contains(cruise_id, 'C5') AND contains(file_id, 'S5::15'))")
shared("fc_kept_a", "SELECT * FROM fc_a WHERE file_id NOT IN (SELECT file_id FROM excluded_a)")
shared("cells_kept_a", merge_a("fc_kept_a"))
shared("filtered_a", """
SELECT c.*, coalesce(x.n, 0) AS n_excluded_file_cells_in_original, coalesce(x.pts, 0) AS n_excluded_points_in_original,
  coalesce(x.n, 0) > 0 AS had_excluded_source_in_original
FROM cells_kept_a c LEFT JOIN (SELECT lat_bin, lon_bin, count(*) AS n, CAST(sum(n_points) AS BIGINT) AS pts FROM fc_a
  WHERE file_id IN (SELECT file_id FROM excluded_a) GROUP BY lat_bin, lon_bin) x USING (lat_bin, lon_bin)""")
shared("primary_a", """
SELECT *, CASE quality_tier WHEN 'A_tier' THEN 1.0 WHEN 'B_tier' THEN 0.7 ELSE 0.4 END::DOUBLE AS validation_weight FROM (
  SELECT *, median_depth_file_balanced AS ship_depth_m, median_elev_file_balanced AS ship_elev_m,
  CASE WHEN n_cruises_guess >= 2 AND n_file_cells >= 2 AND iqr_depth_between_file_cells <= 50 AND n_points_total >= 100 THEN 'A_tier'
       WHEN n_points_total >= 50 AND range_depth_file_cell <= 500 THEN 'B_tier' ELSE 'C_tier' END AS quality_tier FROM filtered_a)""")
shared("comparison_a", """
SELECT lat_bin, lon_bin, a.median_depth_file_balanced AS depth_orig, b.median_depth_file_balanced AS depth_filtered, a.n_points_total, a.n_file_cells,
  a.dominant_cruise_id, a.lon_center, a.lat_center, b.had_excluded_source_in_original,
  CASE WHEN a.cell_id IS NOT NULL AND b.cell_id IS NOT NULL THEN 'common' WHEN a.cell_id IS NOT NULL THEN 'lost' ELSE 'new' END AS presence,
  b.median_depth_file_balanced - a.median_depth_file_balanced AS depth_shift_m,
  abs(b.median_depth_file_balanced - a.median_depth_file_balanced) AS abs_shift_m
FROM cells_a a FULL JOIN filtered_a b USING (lat_bin, lon_bin)""")

# --- source B -------------------------------------------------------------------------------------------

shared("signs_b", """
SELECT track_id, CASE WHEN n = 0 THEN 'no_depth_values' WHEN p + m = 0 THEN 'all_zero' WHEN p / (p + m) >= 0.95 THEN 'mostly_positive'
  WHEN m / (p + m) >= 0.95 THEN 'mostly_negative' ELSE 'mixed_sign' END AS depth_sign_raw
FROM (SELECT track_id, count(depth_raw) AS n, count(*) FILTER (WHERE depth_raw > 0) AS p, count(*) FILTER (WHERE depth_raw < 0) AS m
      FROM track_soundings GROUP BY track_id)""")
shared("normalized_b", """
SELECT *, CASE WHEN down <= 11500 THEN down END AS depth_m_positive_down, CASE WHEN down <= 11500 THEN -down END AS elev_m,
  coalesce(down > 11500, false) AS was_clipped FROM (
  SELECT t.*, s.depth_sign_raw, CASE WHEN lon_raw > 180 THEN lon_raw - 360 ELSE lon_raw END AS lon,
    CASE WHEN lat_raw BETWEEN -90 AND 90 THEN lat_raw END AS lat,
    CASE WHEN depth_sign_raw IN ('mostly_positive', 'mostly_negative') THEN abs(depth_raw) END AS down,
    coalesce((depth_sign_raw = 'mostly_positive' AND depth_raw < 0) OR (depth_sign_raw = 'mostly_negative' AND depth_raw > 0)
             OR depth_sign_raw NOT IN ('mostly_positive', 'mostly_negative'), false) AS sign_warning
  FROM track_soundings t JOIN signs_b s USING (track_id))""")
shared("checked_b", """
SELECT *, (valid_lon AND valid_lat AND valid_depth_pos AND valid_depth_max AND valid_core_fields) AS point_check_pass_basic FROM (
  SELECT *, coalesce(lon >= -180 AND lon < 180, false) AS valid_lon, coalesce(lat BETWEEN -90 AND 90, false) AS valid_lat,
    coalesce(depth_m_positive_down > 0, false) AS valid_depth_pos, coalesce(depth_m_positive_down <= 12000, false) AS valid_depth_max,
    (lon IS NOT NULL AND lat IS NOT NULL AND depth_m_positive_down IS NOT NULL) AS valid_core_fields FROM normalized_b)""")
shared("binned_b", "SELECT *, CAST(floor((lon + 180) * 60) AS BIGINT) AS lon_bin, CAST(floor((lat + 90) * 60) AS BIGINT) AS lat_bin "
       "FROM checked_b WHERE point_check_pass_basic")
shared("fc_b", f"""
SELECT s.*, u.n_unique_triples, u.median_depth_m_unique_triples, {CELL_ID}, {CENTER}, 1.0 - n_unique_triples / n_points_pass AS duplicate_ratio
FROM (SELECT branch, track_id, lat_bin, lon_bin, any_value(source_type) AS source_type, any_value(source_completeness) AS source_completeness,
    any_value(instrument_class_pred) AS instrument_class_pred, any_value(manual_review_flag) AS manual_review_flag, count(*) AS n_points_pass,
    median(depth_m_positive_down) AS median_depth_m, avg(depth_m_positive_down) AS mean_depth_m, stddev_samp(depth_m_positive_down) AS std_depth_m,
    min(depth_m_positive_down) AS min_depth_m, max(depth_m_positive_down) AS max_depth_m, max(depth_m_positive_down) - min(depth_m_positive_down) AS range_depth_m,
    {q('depth_m_positive_down', .75)} - {q('depth_m_positive_down', .25)} AS iqr_depth_m
  FROM binned_b GROUP BY branch, track_id, lat_bin, lon_bin) s
JOIN (SELECT branch, track_id, lat_bin, lon_bin, count(*) AS n_unique_triples, median(depth_m_positive_down) AS median_depth_m_unique_triples
  FROM (SELECT DISTINCT branch, track_id, lat_bin, lon_bin, lon, lat, depth_m_positive_down FROM binned_b)
  GROUP BY branch, track_id, lat_bin, lon_bin) u USING (branch, track_id, lat_bin, lon_bin)""")
shared("cells_b", f"""
SELECT *, {CELL_ID}, {CENTER}, {lat_band('-90 + (lat_bin + 0.5) / 60')} AS lat_band_10deg, max_track_median - min_track_median AS range_track_median,
  1.0 - n_unique_triples_total / n_points_pass_total AS duplicate_ratio_cell, manual_review_track_cell_count > 0 AS manual_review_any,
  manual_review_unique_triples / n_unique_triples_total AS manual_review_unique_triples_share,
  CASE WHEN manual_review_track_cell_count > 0 THEN 'supplementary_check_flag' ELSE '' END AS manual_review_reasons
FROM (SELECT branch, lat_bin, lon_bin, count(*) AS n_track_cells, count(DISTINCT track_id) AS n_tracks,
  CAST(sum(n_points_pass) AS BIGINT) AS n_points_pass_total, CAST(sum(n_unique_triples) AS BIGINT) AS n_unique_triples_total,
  median(median_depth_m) AS median_depth_m, avg(median_depth_m) AS mean_of_track_medians, stddev_samp(median_depth_m) AS std_of_track_medians,
  min(median_depth_m) AS min_track_median, max(median_depth_m) AS max_track_median,
  {q('median_depth_m', .75)} - {q('median_depth_m', .25)} AS iqr_of_track_medians,
  count(*) FILTER (WHERE source_type = 'decoded') AS n_source_decoded, count(*) FILTER (WHERE source_type = 'xyz') AS n_source_xyz,
  count(*) FILTER (WHERE source_type = 'regional') AS n_source_regional,
  count(*) FILTER (WHERE source_completeness = 'nc_xyz_intersect') AS n_completeness_nc_xyz_intersect,
  count(*) FILTER (WHERE source_completeness = 'xyz_only') AS n_completeness_xyz_only,
  count(*) FILTER (WHERE source_completeness = 'nc_only') AS n_completeness_nc_only,
  count(*) FILTER (WHERE instrument_class_pred = 'singlebeam') AS n_instrument_singlebeam,
  count(*) FILTER (WHERE instrument_class_pred = 'multibeam') AS n_instrument_multibeam,
  count(*) FILTER (WHERE manual_review_flag) AS manual_review_track_cell_count,
  CAST(coalesce(sum(n_unique_triples) FILTER (WHERE manual_review_flag), 0) AS BIGINT) AS manual_review_unique_triples
  FROM fc_b GROUP BY branch, lat_bin, lon_bin)""")
shared("res_b", """
SELECT f.*, c.median_depth_m AS branch_cell_median_depth_m, c.duplicate_ratio_cell AS branch_cell_duplicate_ratio_cell,
  c.manual_review_any AS branch_cell_manual_review_any, c.lat_band_10deg,
  f.median_depth_m - c.median_depth_m AS residual_m, abs(f.median_depth_m - c.median_depth_m) AS abs_residual_m
FROM fc_b f JOIN cells_b c USING (branch, lat_bin, lon_bin) WHERE c.n_track_cells >= 2""")


def ten(x: str = "residual_m", a: str = "abs_residual_m") -> str:
    signed = ", ".join(f"{q(x, n / 100)} AS residual_p{n:02d}" for n in (1, 5, 25, 50, 75, 95, 99))
    return signed + ", " + ", ".join(f"{q(a, n / 100)} AS abs_residual_p{n}" for n in (50, 95, 99))


shared("branch_res_b", f"""
SELECT t.*, n_overlap_cells / n_branch_cells_total AS overlap_share, s.* EXCLUDE (branch)
FROM (SELECT branch, count(*) AS n_branch_cells_total, count(*) FILTER (WHERE n_track_cells >= 2) AS n_overlap_cells FROM cells_b GROUP BY branch) t
JOIN (SELECT branch, count(*) AS n_overlap_track_cell_rows, sqrt(avg(residual_m * residual_m)) AS rmse_residual_m_branch, {ten()} FROM res_b GROUP BY branch) s
USING (branch)""")
_PAIR = """
SELECT '{label}' AS pair_label, '{left}' AS left_branch, '{right}' AS right_branch, l.lat_bin, l.lon_bin, l.cell_id, l.lon_center, l.lat_center,
  l.median_depth_m AS left_median_depth_m, r.median_depth_m AS right_median_depth_m, l.n_track_cells AS left_n_track_cells,
  r.n_track_cells AS right_n_track_cells, l.n_tracks AS left_n_tracks, r.n_tracks AS right_n_tracks,
  l.n_unique_triples_total AS left_n_unique_triples_total, r.n_unique_triples_total AS right_n_unique_triples_total,
  l.duplicate_ratio_cell AS left_duplicate_ratio_cell, r.duplicate_ratio_cell AS right_duplicate_ratio_cell,
  l.manual_review_any AS left_manual_review_any, r.manual_review_any AS right_manual_review_any, l.lat_band_10deg AS left_lat_band_10deg,
  l.iqr_of_track_medians AS left_iqr_of_track_medians, r.iqr_of_track_medians AS right_iqr_of_track_medians,
  r.lat_band_10deg AS right_lat_band_10deg,
  l.median_depth_m - r.median_depth_m AS residual_m, abs(l.median_depth_m - r.median_depth_m) AS abs_residual_m
FROM (SELECT * FROM cells_b WHERE branch = '{left}') l JOIN (SELECT * FROM cells_b WHERE branch = '{right}') r USING (lat_bin, lon_bin)"""
shared("cross_b", " UNION ALL ".join(_PAIR.format(label=a, left=b, right=c) for a, b, c in PAIRS))
shared("pair_res_b", f"""
SELECT s.*, tl.n AS n_left_cells_total, tr.n AS n_right_cells_total, n_overlap_cells / tl.n AS overlap_share_of_left, n_overlap_cells / tr.n AS overlap_share_of_right
FROM (SELECT pair_label, left_branch, right_branch, count(*) AS n_overlap_cells, sqrt(avg(residual_m * residual_m)) AS rmse_pair_m,
  count(*) FILTER (WHERE left_manual_review_any AND right_manual_review_any) AS n_overlap_both_flagged,
  count(*) FILTER (WHERE left_manual_review_any OR right_manual_review_any) AS n_overlap_either_flagged, {ten()}
  FROM cross_b GROUP BY pair_label, left_branch, right_branch) s
JOIN (SELECT branch, count(*) AS n FROM cells_b GROUP BY branch) tl ON tl.branch = left_branch
JOIN (SELECT branch, count(*) AS n FROM cells_b GROUP BY branch) tr ON tr.branch = right_branch""")
shared("sides_b", """
SELECT pair_label, left_branch AS branch, lat_bin, lon_bin, lat_center, left_median_depth_m AS branch_depth_m, abs_residual_m FROM cross_b
UNION ALL SELECT pair_label, right_branch, lat_bin, lon_bin, lat_center, right_median_depth_m, abs_residual_m FROM cross_b""")
shared("annotated_b", f"""
SELECT c.*, coalesce(x.n, 0) AS n_cross_branch_overlap, coalesce(x.pairs, '') AS in_cross_pair,
  {policy_depth('median_depth_m', 0)} AS depth_bin_lo, {policy_depth('median_depth_m', 1)} AS depth_bin_hi
FROM cells_b c LEFT JOIN (SELECT branch, lat_bin, lon_bin, count(*) AS n, string_agg(DISTINCT pair_label, '|' ORDER BY pair_label) AS pairs
  FROM sides_b GROUP BY branch, lat_bin, lon_bin) x USING (branch, lat_bin, lon_bin)""")
shared("lat_depth_b", f"""
SELECT * FROM (SELECT branch, lat_band_10deg, depth_bin_lo, depth_bin_hi, count(*) AS n_cells, count(*) FILTER (WHERE n_track_cells >= 2) AS n_cells_with_overlap,
    count(*) FILTER (WHERE branch = 'multibeam' AND duplicate_ratio_cell > 0.5) AS highdup_cell_count_local,
    avg(manual_review_any::INT) AS manual_review_share_local FROM annotated_b GROUP BY ALL) b
LEFT JOIN (SELECT branch, lat_band_10deg, {policy_depth('branch_cell_median_depth_m', 0)} AS depth_bin_lo, {policy_depth('branch_cell_median_depth_m', 1)} AS depth_bin_hi,
    {', '.join(f"{q('abs_residual_m', n / 100)} AS within_branch_residual_p{n}" for n in (50, 95, 99))} FROM res_b GROUP BY ALL) w
  USING (branch, lat_band_10deg, depth_bin_lo, depth_bin_hi)
LEFT JOIN (SELECT branch, lat_band_10deg, depth_bin_lo, depth_bin_hi, max(p95) AS cross_branch_residual_max_p95, CAST(sum(n) AS BIGINT) AS cross_branch_n_overlap_total
  FROM (SELECT branch, {lat_band('lat_center')} AS lat_band_10deg, {policy_depth('branch_depth_m', 0)} AS depth_bin_lo,
      {policy_depth('branch_depth_m', 1)} AS depth_bin_hi, pair_label, count(*) AS n, {q('abs_residual_m', .95)} AS p95 FROM sides_b GROUP BY ALL)
  GROUP BY ALL) x USING (branch, lat_band_10deg, depth_bin_lo, depth_bin_hi)""")


def pair_bins(dup: str, uniq: str) -> str:
    d = f"least(greatest({dup}, 0), 1)"
    u = f"CAST(greatest({uniq}, 1) AS DOUBLE)"
    return ", ".join([f"{case_right_open(d, bins.DUPLICATE_RATIO_EDGES, 0)} AS dup_bin_lo", f"{case_right_open(d, bins.DUPLICATE_RATIO_EDGES, 1)} AS dup_bin_hi",
                      f"{case_right_open(u, bins.UNIQUE_COUNT_EDGES, 0)} AS n_unique_lo", f"{case_right_open(u, bins.UNIQUE_COUNT_EDGES, 1)} AS n_unique_hi"])


shared("source_pair_b", f"""
SELECT pair_label, dup_bin_lo, dup_bin_hi, n_unique_lo, n_unique_hi, count(*) AS n_cells_in_slice, sqrt(avg(residual_m * residual_m)) AS rmse,
  {', '.join(f"{q('residual_m', n / 100)} AS residual_p{n}" for n in (50, 95, 99))},
  {', '.join(f"{q('abs_residual_m', n / 100)} AS abs_residual_p{n}" for n in (50, 95, 99))}
FROM (SELECT *, {pair_bins('greatest(left_duplicate_ratio_cell, right_duplicate_ratio_cell)', 'greatest(left_n_unique_triples_total, right_n_unique_triples_total)')} FROM cross_b)
GROUP BY pair_label, dup_bin_lo, dup_bin_hi, n_unique_lo, n_unique_hi""")
shared("sliced_b", f"""
SELECT c.*, least(l.within_branch_residual_p95, l.cross_branch_residual_max_p95) AS within_or_cross_p95, l.within_branch_residual_p95,
  l.cross_branch_residual_max_p95, CASE WHEN contains(in_cross_pair, 'mb_vs_regional') THEN s.abs_residual_p95 END AS mb_vs_regional_p95,
  CASE WHEN contains(in_cross_pair, 'mb_vs_regional') THEN s.rmse END AS mb_vs_regional_rmse
FROM (SELECT *, {pair_bins('duplicate_ratio_cell', 'n_unique_triples_total')} FROM annotated_b) c
LEFT JOIN (SELECT branch, lat_band_10deg, depth_bin_lo, depth_bin_hi, within_branch_residual_p95, cross_branch_residual_max_p95 FROM lat_depth_b) l
  USING (branch, lat_band_10deg, depth_bin_lo, depth_bin_hi)
LEFT JOIN (SELECT dup_bin_lo, dup_bin_hi, n_unique_lo, n_unique_hi, abs_residual_p95, rmse FROM source_pair_b WHERE pair_label = 'mb_vs_regional') s
  USING (dup_bin_lo, dup_bin_hi, n_unique_lo, n_unique_hi)""")
_NEAR = "lat_band_10deg IN (-80, -70, -30, -20) AND depth_bin_lo IN (500, 2000, 4000)"
_LOW = "lat_band_10deg BETWEEN -50 AND 50"
RULE_CASES = [
    f"branch = 'multibeam' AND {_NEAR} AND n_track_cells >= 2 AND duplicate_ratio_cell <= 0.1 AND mb_vs_regional_p95 < 175",
    f"branch = 'singlebeam' AND {_LOW} AND depth_bin_lo IN (0, 200, 500) AND n_track_cells >= 2 AND n_unique_triples_total >= 10 AND duplicate_ratio_cell <= 0.1 AND within_or_cross_p95 < 200",
    f"branch = 'singlebeam' AND {_LOW} AND depth_bin_lo IN (2000, 4000) AND n_track_cells >= 2 AND n_unique_triples_total >= 10 AND within_branch_residual_p95 < 300",
    f"branch = 'regional' AND {_NEAR} AND contains(in_cross_pair, 'mb_vs_regional') AND mb_vs_regional_rmse < 150 AND mb_vs_regional_p95 < 200",
    "branch = 'regional' AND depth_bin_lo = 0",
    "branch = 'singlebeam' AND lat_band_10deg IN (-70, -60, -50) AND n_cross_branch_overlap = 0",
    "branch = 'singlebeam' AND lat_band_10deg >= 60 AND cross_branch_residual_max_p95 > 300",
    "branch = 'multibeam' AND n_track_cells = 1 AND duplicate_ratio_cell <= 0.1 AND n_unique_triples_total >= 100",
    "branch = 'multibeam' AND duplicate_ratio_cell > 0.5 AND n_unique_triples_total >= 100",
    "branch = 'singlebeam' AND n_track_cells = 1 AND n_cross_branch_overlap = 0",
    "branch = 'regional'",
    "n_track_cells >= 2 AND n_cross_branch_overlap >= 1 AND cross_branch_residual_max_p95 < 150 AND duplicate_ratio_cell <= 0.1",
    "n_unique_triples_total >= 1000 AND duplicate_ratio_cell <= 0.1 AND (n_track_cells >= 2 OR n_cross_branch_overlap >= 1)",
    "n_unique_triples_total < 10", "duplicate_ratio_cell > 0.5 AND n_cross_branch_overlap = 0"]
_OUT = [(r.rule_id, i, r.tier, r.weight, r.exclude) for i, r in enumerate(policy.RULES, 1)] + [policy.DEFAULT_RULE]
shared("matched_b", "SELECT *, CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(RULE_CASES, 1)) + " ELSE 99 END AS matched_rule_priority FROM sliced_b")
shared("matched_unflagged", "SELECT *, CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(RULE_CASES, 1)) + " ELSE 99 END AS matched_rule_priority FROM (SELECT * REPLACE (false AS manual_review_any) FROM sliced_b) AS u")
shared("rule_values", " UNION ALL ".join(
    f"SELECT '{i}' AS matched_rule_id, {p} AS pr, '{t}' AS quality_tier, CAST({w} AS DOUBLE) AS validation_weight, {str(x).lower()} AS exclude_from_primary"
    for i, p, t, w, x in _OUT))
shared("policy_b", """
SELECT *, evidence_class = 'none' AS low_evidence_flag,
  CASE WHEN highdup_flag THEN 'highdup_survey' WHEN matched_rule_id = 'any_v0_dup_heavy_downweight' THEN 'high_dup_unsupported'
       WHEN evidence_class = 'none' THEN 'low_evidence' ELSE '' END AS source_risk_class,
  (branch <> 'regional' AND NOT exclude_from_primary AND quality_tier IN ('high_confidence', 'medium_confidence')) AS use_for_primary_validation,
  (NOT exclude_from_primary AND quality_tier IN ('high_confidence', 'medium_confidence', 'low_confidence')) AS use_for_supplementary_validation,
  (branch = 'regional' AND validation_weight > 0) AS use_for_regional_experiment,
  CASE WHEN exclude_from_primary AND sensitivity_only_flag THEN matched_rule_id || ':sensitivity_only'
       WHEN exclude_from_primary THEN matched_rule_id || ':excluded_from_primary'
       WHEN sensitivity_only_flag THEN matched_rule_id || ':review_only' ELSE '' END AS exclusion_or_review_reason
FROM (SELECT m.*, v.* EXCLUDE (pr),
  CASE WHEN n_track_cells >= 2 AND n_cross_branch_overlap >= 1 THEN 'both' WHEN n_track_cells >= 2 THEN 'within'
       WHEN n_cross_branch_overlap >= 1 THEN 'cross' ELSE 'none' END AS evidence_class,
  CASE branch WHEN 'singlebeam' THEN 'supplementary_coverage' WHEN 'multibeam' THEN 'multibeam_supplement' ELSE 'regional_experiment' END AS branch_role,
  v.matched_rule_id = 'mb_v0_highdup_sentry_downweight' AS highdup_flag, v.quality_tier = 'review_or_sensitivity_only' AS sensitivity_only_flag
  FROM matched_b m JOIN rule_values v ON v.pr = m.matched_rule_priority)""")

# --- products -------------------------------------------------------------------------------------------

CORE = ("cell_id, lat_bin, lon_bin, lon_center, lat_center, lat_band_10deg, source_provider, branch, branch_role, representative_depth_m, "
        "validation_weight, quality_tier, evidence_class, highdup_flag, source_risk_class, n_unique_triples_total, n_points_pass_total, n_track_cells, "
        "duplicate_ratio_cell, n_tracks, manual_review_any, low_evidence_flag, n_cross_branch_overlap, sensitivity_only_flag, matched_rule_id")
shared("survey_rows", f"""
SELECT cell_id, lat_bin, lon_bin, lon_center, lat_center, {lat_band('lat_center')} AS lat_band_10deg, 'survey' AS source_provider,
  'survey_mb' AS branch, 'multibeam_primary' AS branch_role, ship_depth_m AS representative_depth_m, validation_weight,
  CASE quality_tier WHEN 'A_tier' THEN 'high_confidence' WHEN 'B_tier' THEN 'medium_confidence' ELSE 'low_confidence' END AS quality_tier,
  'survey_legacy' AS evidence_class, false AS highdup_flag, '' AS source_risk_class, CAST(NULL AS BIGINT) AS n_unique_triples_total,
  n_points_total AS n_points_pass_total, n_file_cells AS n_track_cells, CAST(NULL AS DOUBLE) AS duplicate_ratio_cell, n_files AS n_tracks,
  false AS manual_review_any, false AS low_evidence_flag, 0 AS n_cross_branch_overlap, false AS sensitivity_only_flag, 'survey_legacy' AS matched_rule_id
FROM primary_a""")
shared("track_rows", f"""
SELECT {CORE}, use_for_primary_validation, use_for_supplementary_validation FROM (SELECT *, median_depth_m AS representative_depth_m,
  CASE branch WHEN 'singlebeam' THEN 'track_singlebeam' WHEN 'multibeam' THEN 'track_multibeam' ELSE 'regional' END AS source_provider FROM policy_b)""")
shared("strict_p", f"""
SELECT {CORE}, source_provider AS final_primary_source, '' AS precedence_resolution FROM survey_rows
UNION ALL SELECT {CORE}, source_provider, '' FROM track_rows WHERE branch = 'multibeam' AND use_for_primary_validation""")
shared("sb_primary", "SELECT * FROM track_rows WHERE branch = 'singlebeam' AND use_for_primary_validation")
shared("expanded_p", f"""
SELECT {CORE}, final_primary_source, CASE WHEN (lat_bin, lon_bin) IN (SELECT (lat_bin, lon_bin) FROM sb_primary)
  THEN CASE source_provider WHEN 'survey' THEN 'survey_over_sb' WHEN 'track_multibeam' THEN 'mb_over_sb' ELSE '' END ELSE '' END AS precedence_resolution,
  false AS expanded_fill FROM strict_p
UNION ALL SELECT {CORE}, source_provider, '', true FROM sb_primary WHERE (lat_bin, lon_bin) NOT IN (SELECT (lat_bin, lon_bin) FROM strict_p)""")
_CORE_T = ", ".join(f"t.{c.strip()}" for c in CORE.split(",") if c.strip() != "branch_role")
shared("supplementary_p", f"""
SELECT {_CORE_T}, 'supplementary_coverage' AS branch_role, coalesce(e.source_provider, '') AS final_primary_source,
  CASE s.source_provider WHEN 'survey' THEN 'superseded_by_survey' WHEN 'track_multibeam' THEN 'superseded_by_mb' ELSE '' END AS precedence_resolution
FROM track_rows t LEFT JOIN strict_p s ON s.lat_bin = t.lat_bin AND s.lon_bin = t.lon_bin
LEFT JOIN expanded_p e ON e.lat_bin = t.lat_bin AND e.lon_bin = t.lon_bin WHERE t.branch = 'singlebeam' AND t.use_for_supplementary_validation""")
shared("regional_p", f"""
SELECT {_CORE_T}, 'regional_experiment' AS branch_role, '' AS final_primary_source,
  CASE e.source_provider WHEN 'survey' THEN 'primary_survey_regional_parallel' WHEN 'track_multibeam' THEN 'primary_mb_regional_parallel'
    WHEN 'track_singlebeam' THEN 'primary_sb_regional_parallel' ELSE '' END AS precedence_resolution
FROM track_rows t LEFT JOIN expanded_p e ON e.lat_bin = t.lat_bin AND e.lon_bin = t.lon_bin WHERE t.branch = 'regional'""")
_P = CORE + ", final_primary_source, precedence_resolution"
shared("catalog_p", f"""
SELECT {_P}, 'strict_primary_multibeam' AS product_label, 'strict_primary_multibeam' AS product_membership FROM strict_p
UNION ALL SELECT {_P}, 'supplementary_singlebeam', 'supplementary_singlebeam' FROM supplementary_p
UNION ALL SELECT {_P}, 'regional_experiment', 'regional_experiment' FROM regional_p
UNION ALL SELECT {_P}, 'supplementary_singlebeam', 'expanded_primary_ship' FROM expanded_p WHERE source_provider = 'track_singlebeam'""")
shared("non_primary_p", f"SELECT {_P}, 'supplementary' AS product_key FROM supplementary_p UNION ALL SELECT {_P}, 'regional' FROM regional_p")
shared("labelled_np", f"SELECT *, {depth_metric('representative_depth_m')} AS depth_bin_label, {region()} AS region_10deg, "
       "coalesce(n_cross_branch_overlap > 0, false) AS has_cross_branch_overlap FROM non_primary_p")
