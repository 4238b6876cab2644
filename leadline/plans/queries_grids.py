"""Queries over grid sampling and error metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins, geo
from ..operators import metrics as M
from ..operators import raster as R
from . import oracle_grids as G
from . import oracle_shared as S
from .fixtures import GRID_CONFIG
from .registry import query
from .stages import Products, Survey

SAMPLE = "lat_bin lon_bin"


def _pixels(p: Products, name: str):
    return R.decode_pixels(p.pixels, p.grid(name))


def _cells(p: Products, name: str):
    return p.survey.primary_t.where(geo.in_footprint("lon_center", "lat_center", p.grid(name).footprint))


@query("pixels_decoded", "product_name row_idx col_idx", "lat lon z", " UNION ALL ".join(
    f"SELECT product_name, row_idx, col_idx, lat, lon, {'nullif(z_raw, -99999)' if 'fill_value' in g else 'z_raw'} AS z FROM pixels WHERE product_name = '{n}'"
    for n, g in G.GRIDS.items()))
def _(spark, d):
    p = Products.of(spark, d)
    return R.union_all([_pixels(p, n) for n in G.GRIDS])


def _axis(tag: str, w: str, name: str) -> str:
    return (f"SELECT '{tag}' AS product_name, '{name}' AS axis, count(*) AS n_lines, any_value(up) AS ascending, coalesce(min(step) > 0 OR max(step) < 0, false) AS is_monotonic, "
            f"median(step) AS median_step FROM (SELECT x - lag(x) OVER (ORDER BY idx) AS step, first_value(x) OVER (ORDER BY idx) < last_value(x) OVER (ORDER BY idx "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS up FROM {w})")


@query("axis_checks", "product_name axis n_lines ascending is_monotonic", "median_step", " UNION ALL ".join(
    _axis(g, f"{w}_strict_{g}", n) for g in G.GRIDS for w, n in (("la", "lat"), ("lo", "lon"))), digits=7)
def _(spark, d):
    p = Products.of(spark, d)
    return R.union_all([R.axis_check(p.store(n)).withColumn("product_name", F.lit(n)) for n in G.GRIDS])


@query("sample_nearest", SAMPLE, "raw_z", "nearest_sa")
def _(spark, d):
    p = Products.of(spark, d)
    return R.sample_nearest(_cells(p, "grid_a"), p.store("grid_a"), p.grid("grid_a"))


@query("sample_bilinear", SAMPLE, "raw_z", "bilinear_sa")
def _(spark, d):
    p = Products.of(spark, d)
    return R.sample_bilinear(_cells(p, "grid_a"), p.store("grid_a"), p.grid("grid_a"))


for _how in ("median", "mean"):
    def _build(spark, d, how=_how):
        p = Products.of(spark, d)
        return R.sample_cell_agg(_cells(p, "grid_a"), p.store("grid_a"), p.grid("grid_a"), how)
    query(f"sample_cell_{_how}", SAMPLE, "raw_z", f"{_how}_sa")(_build)


def _legacy(w: str, tag: str) -> str:
    # a one-minute cell holds 3 lines of 0.005 degrees, so the window is one line to each side
    return (f"SELECT p.bin, a.idx FROM pos_{w}_{tag} p JOIN {w}_{tag} a ON a.ord BETWEEN least(before, p.n - 1) - 1 AND least(before, p.n - 1) + 1")


@query("sample_index_window", SAMPLE, "raw_z", f"""
SELECT k.lat_bin, k.lon_bin, median(p.z) AS raw_z FROM (SELECT DISTINCT lat_bin, lon_bin FROM in_sa) k
JOIN ({_legacy('la', 'sa')}) a ON a.bin = lat_bin JOIN ({_legacy('lo', 'sa')}) b ON b.bin = lon_bin
LEFT JOIN px_sa p ON p.row_idx = a.idx AND p.col_idx = b.idx GROUP BY k.lat_bin, k.lon_bin""")
def _(spark, d):
    p = Products.of(spark, d)
    return R.sample_index_window(_cells(p, "grid_a"), p.store("grid_a"), p.grid("grid_a"))


BY_CELL = "product_name sampling_method config_sampling_method cell_id z_convention lon_convention"
BY_CELL_V = "raw_z model_elev_m model_depth_m elev_error_m depth_error_m abs_elev_error_m ship_depth_m ship_elev_m"


@query("survey_by_cell", BY_CELL + " requested_ship_cells total_primary_cells", BY_CELL_V, "bc_survey")
def _(spark, d):
    return Products.of(spark, d).survey_by_cell


@query("strict_by_cell", BY_CELL + " depth_bin_label region_10deg", BY_CELL_V, "bc_strict")
def _(spark, d):
    return Products.of(spark, d).strict_by_cell


@query("expanded_by_cell", BY_CELL + " depth_bin_label region_10deg", BY_CELL_V, "bc_expanded")
def _(spark, d):
    return Products.of(spark, d).expanded_by_cell


_ENABLED = "(VALUES " + ", ".join(f"('{g['name']}')" for g in GRID_CONFIG if g.get("enabled", True)) + ") AS configured(name)"


@query("product_status", "product_name status reason rows_processed valid_count nodata_count", "", """
SELECT product_name, 'ok' AS status, '' AS reason, count(*) AS rows_processed, count(model_elev_m) AS valid_count, count(*) - count(model_elev_m) AS nodata_count
FROM bc_strict GROUP BY product_name UNION ALL SELECT name, 'skipped', 'no pixels', 0, 0, 0 FROM """ + _ENABLED + " WHERE name NOT IN (SELECT product_name FROM pixels)")
def _(spark, d):
    p = Products.of(spark, d)
    return R.product_status(*p.strict_run)


@query("product_completion", "product_name expected_status status expected_rows rows_processed status_match row_count_match", "", """
SELECT product_name, 'ok' AS expected_status, 'ok' AS status, count(*) FILTER (WHERE sampling_method IS NOT NULL) AS expected_rows, count(*) AS rows_processed,
  true AS status_match, 'PASS' AS row_count_match FROM bc_strict GROUP BY product_name
UNION ALL SELECT name, 'ok', 'skipped', 1, 0, false, 'FAIL' FROM """ + _ENABLED + " WHERE name NOT IN (SELECT product_name FROM pixels)")
def _(spark, d):
    p = Products.of(spark, d)
    status = R.product_status(*p.strict_run)
    wanted = p.validation_cells("strict")
    grids = F.explode(F.array(*[F.struct(F.lit(g.name).alias("name"), geo.in_footprint("lon_center", "lat_center", g.footprint).alias("inside"))
                                for g in p.grids if g.footprint])).alias("g")
    expected = wanted.select(grids).where("g.inside").groupBy(F.col("g.name").alias("product_name")).agg(F.count(F.lit(1)).alias("expected_rows"))
    missing = status.where("status = 'skipped'").select("product_name", F.lit(1).cast("bigint").alias("expected_rows"))
    return M.completion(status, expected.unionByName(missing).withColumn("expected_status", F.lit("ok")))


A_V = "bias_mean bias_median MAE RMSE STD MAD p05 p25 p75 p95 abs_error_p95 coverage_fraction global_fraction"
_QA = ", ".join(f'm."{c}"' if c.isupper() else f"m.{c}" for c in A_V.split()[:-2])


@query("metrics_by_survey_stratum", "product_name sampling_method stratification stratum count n_rows requested_ship_cells", A_V, f"""
SELECT product_name, sampling_method, stratification, stratum, coalesce(m.count, 0) AS count, coalesce(m.n_rows, 0) AS n_rows,
  coalesce(m.requested_ship_cells, 0) AS requested_ship_cells, {_QA}, coalesce(m.coverage_fraction, 0) AS coverage_fraction, coalesce(m.global_fraction, 0) AS global_fraction
FROM labels_survey l FULL JOIN (SELECT * FROM metrics_survey WHERE stratification NOT IN ('dominant_track_kind', 'region_10deg') OR n_rows >= 10) m
USING (product_name, sampling_method, stratification, stratum)""")
def _(spark, d):
    p = Products.of(spark, d)
    return M.metrics_all_a(p.survey_by_cell_t)


B_V = "bias MAE RMSE weighted_MAE weighted_RMSE median_error MAD abs_error_p90 abs_error_p95 abs_error_p99 coverage_fraction"


@query("metrics_by_track_stratum", "product_name product_role sampling_method stratification stratum requested_cells count nodata_count", B_V, "metrics_both")
def _(spark, d):
    return Products.of(spark, d).metrics


T_V = "bias MAE RMSE STD median_error MAD p05_error p95_error p95_abs_error correlation"
shared_rows = f"(SELECT *, {S.depth_regional('ship_depth_m')} AS depth_bin FROM bc_survey WHERE sampling_method = 'center_bilinear_sensitivity')"


@query("metrics_by_depth_and_tier", "product_name depth_bin quality_tier n", T_V, G.metrics_t1(shared_rows, "product_name, depth_bin, quality_tier"))
def _(spark, d):
    p = Products.of(spark, d)
    rows = M.prefer_method(p.survey_by_cell_t).withColumn("depth_bin", bins.depth_bin_regional("ship_depth_m"))
    return M.summarize(rows, ["depth_bin", "quality_tier"])


_NP = ("CASE WHEN n_points_total <= 0 THEN NULL " + " ".join(f"WHEN n_points_total <= {e} THEN '{label}'" for e, label in zip(bins.POINT_COUNT_EDGES[1:], bins.POINT_COUNT_LABELS))
       + " WHEN n_points_total IS NOT NULL THEN '>1000' END")


@query("metrics_by_count_bins", "product_name n_points_bin n_file_cells_bin n", T_V, G.metrics_t1(
    f"(SELECT *, {_NP} AS n_points_bin, CASE WHEN n_file_cells = 1 THEN '1' WHEN n_file_cells = 2 THEN '2' WHEN n_file_cells BETWEEN 3 AND 5 THEN '3–5' WHEN n_file_cells > 5 THEN '>5' END AS n_file_cells_bin "
    "FROM bc_survey WHERE sampling_method = 'center_bilinear_sensitivity')", "product_name, n_points_bin, n_file_cells_bin"))
def _(spark, d):
    p = Products.of(spark, d)
    rows = M.prefer_method(p.survey_by_cell_t).withColumns({
        "n_points_bin": bins.n_points_bin("n_points_total"), "n_file_cells_bin": bins.n_file_cells_bin("n_file_cells")})
    return M.summarize(rows, ["n_points_bin", "n_file_cells_bin"])


_DROWS = (f"(SELECT *, {S.depth_regional('ship_depth_m')} AS depth_bin, avg({G.E}) OVER () AS gm, avg({G.E}) OVER (PARTITION BY {S.depth_regional('ship_depth_m')}) AS bm "
          f"FROM bc_survey WHERE sampling_method = 'cell_median' AND {G.E} IS NOT NULL)")


def _diag(name: str, e: str, where: str = "") -> str:
    return (f"SELECT {name} AS diagnostic, count(*) AS n, avg({e}) AS bias, avg(abs({e})) AS \"MAE\", sqrt(avg(({e}) * ({e}))) AS \"RMSE\", "
            f"CASE WHEN count(*) >= 2 THEN corr(model_elev_m, ship_elev_m) END AS correlation FROM {_DROWS} {where}")


_D3 = " UNION ALL ".join([_diag("'original'", G.E), _diag("'constant_bias_corrected'", f"{G.E} - gm"), _diag("'depth_bin_bias_corrected'", f"{G.E} - bm")])


@query("bias_diagnostics", "diagnostic n", "bias MAE RMSE correlation RMSE_improvement_m RMSE_improvement_pct bias2 centered_error_variance bias_fraction_of_rmse2", f"""
SELECT diagnostic, n, bias, "MAE", "RMSE", correlation, base - "RMSE" AS "RMSE_improvement_m", 100.0 * (base - "RMSE") / nullif(base, 0) AS "RMSE_improvement_pct",
  NULL::DOUBLE AS bias2, NULL::DOUBLE AS centered_error_variance, NULL::DOUBLE AS bias_fraction_of_rmse2
FROM (SELECT *, max(CASE WHEN diagnostic = 'original' THEN "RMSE" END) OVER () AS base FROM ({_D3}))
UNION ALL SELECT *, NULL, NULL, NULL, NULL, NULL FROM ({_diag("'depth_bin_bias_' || depth_bin", G.E, "GROUP BY depth_bin")})
UNION ALL SELECT 'bias_variance_decomposition', count(*), avg({G.E}), NULL, sqrt(avg({G.E} * {G.E})), corr(model_elev_m, ship_elev_m), NULL, NULL,
  avg({G.E}) * avg({G.E}), var_pop({G.E}), avg({G.E}) * avg({G.E}) / avg({G.E} * {G.E}) FROM {_DROWS}""", digits=5)
def _(spark, d):
    rows = Products.of(spark, d).survey_by_cell_t.where("sampling_method = 'cell_median'")
    return M.bias_diagnostics(rows, "grid_a")


@query("convention_diagnostics", "product_name sampling_method n_cells_requested nodata_count valid_count z_convention lon_convention "
       "lon_0_360_conversion_applied sign_error_suspected likely_issue", "raw_z_min raw_z_max converted_model_elev_min converted_model_elev_max model_depth_min "
       "model_depth_max elevation_correlation", """
SELECT *, lon_convention = '0_360' AS lon_0_360_conversion_applied, coalesce(elevation_correlation < 0, false) AS sign_error_suspected,
  CASE WHEN coalesce(elevation_correlation < 0, false) THEN 'turned_sign' WHEN bad > 0 OR nodata_count > 0 THEN 'fill_values'
    WHEN valid_count < greatest(10, 0.5 * n_cells_requested) THEN 'few_valid_cells' ELSE 'none_found' END AS likely_issue
FROM (SELECT product_name, sampling_method, count(*) AS n_cells_requested, count(*) - count(raw_z) AS nodata_count, count(model_elev_m) AS valid_count,
  any_value(z_convention) AS z_convention, any_value(lon_convention) AS lon_convention, min(raw_z) AS raw_z_min, max(raw_z) AS raw_z_max,
  min(model_elev_m) AS converted_model_elev_min, max(model_elev_m) AS converted_model_elev_max, min(model_depth_m) AS model_depth_min, max(model_depth_m) AS model_depth_max,
  count(*) FILTER (WHERE abs(raw_z) > 50000) AS bad, CASE WHEN count(model_elev_m) >= 2 THEN corr(model_elev_m, ship_elev_m) END AS elevation_correlation
  FROM bc_strict GROUP BY product_name, sampling_method)""")
def _(spark, d):
    return M.classify_issue(M.convention_diag(Products.of(spark, d).strict_by_cell_t))


@query("worst_strata", "product_name product_role sampling_method stratification stratum count", "RMSE bias", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_name, product_role, sampling_method, stratification ORDER BY "RMSE" DESC, stratum) AS rn
  FROM metrics_both WHERE stratification IN ('depth_bin', 'lat_band', 'region_10deg') AND "RMSE" IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    return M.worst_strata(Products.of(spark, d).metrics)


_TIERS = ["high_confidence", "medium_confidence", "low_confidence"]
_W = f"FILTER (WHERE validation_weight > 0 AND {G.E} IS NOT NULL)"
_TSQL = ", ".join(f"count({G.E}) FILTER (WHERE quality_tier = '{t}') AS {t}_count, sqrt(avg({G.E} * {G.E}) FILTER (WHERE quality_tier = '{t}')) AS \"{t}_RMSE\"" for t in _TIERS)


@query("weighting_effect", "product_name count weighted_RMSE_lower_than_unweighted " + " ".join(f"{t}_count" for t in _TIERS),
       "unweighted_MAE unweighted_RMSE weighted_MAE weighted_RMSE delta_RMSE_m pct_RMSE_change " + " ".join(f"{t}_RMSE" for t in _TIERS), f"""
SELECT *, "weighted_RMSE" - "unweighted_RMSE" AS "delta_RMSE_m", 100.0 * ("weighted_RMSE" - "unweighted_RMSE") / nullif("unweighted_RMSE", 0) AS "pct_RMSE_change",
  "weighted_RMSE" - "unweighted_RMSE" < -1e-9 AS "weighted_RMSE_lower_than_unweighted" FROM (
  SELECT product_name, count({G.E}) AS count, avg(abs({G.E})) AS "unweighted_MAE", sqrt(avg({G.E} * {G.E})) AS "unweighted_RMSE",
    sum(validation_weight * abs({G.E})) {_W} / sum(validation_weight) {_W} AS "weighted_MAE",
    sqrt(sum(validation_weight * {G.E} * {G.E}) {_W} / sum(validation_weight) {_W}) AS "weighted_RMSE", {_TSQL} FROM bc_strict GROUP BY product_name)""")
def _(spark, d):
    return M.weighting_effect(Products.of(spark, d).strict_by_cell_t)


@query("largest_errors", "product_name cell_id", "abs_elev_error_m", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY abs_elev_error_m DESC, cell_id) AS rn FROM bc_strict WHERE {G.E} IS NOT NULL) WHERE rn <= 20""")
def _(spark, d):
    return M.top_errors(Products.of(spark, d).strict_by_cell_t, 20, group=["product_name"])


@query("grid_reconstructed", "row_idx col_idx", "z", """
SELECT p.row_idx, p.col_idx, p.z_raw + (a.z - s.z) AS z FROM pixels p JOIN px_sa a USING (row_idx, col_idx)
JOIN (SELECT row_idx, col_idx, nullif(z_raw, -99999::DOUBLE) AS z FROM pixels WHERE product_name = 'grid_south') s USING (row_idx, col_idx)
WHERE p.product_name = 'grid_mid'""")
def _(spark, d):
    p = Products.of(spark, d)
    return R.reconstruct(_pixels(p, "grid_mid"), _pixels(p, "grid_a"), _pixels(p, "grid_south"))


@query("grid_reconstructed_resampled", "row_idx col_idx", "z")
def _(spark, d):
    """Low-pass grid sampled at the pixels of a coarser prediction; tested against numpy interpolation."""
    p = Products.of(spark, d)
    coarse = _pixels(p, "grid_a").where("row_idx % 2 = 0 AND col_idx % 2 = 0").withColumns({
        "row_idx": F.floor(F.col("row_idx") / 2).cast("bigint"), "col_idx": F.floor(F.col("col_idx") / 2).cast("bigint")})
    return R.reconstruct_resampled(coarse, _pixels(p, "grid_a"), _pixels(p, "grid_south"))


_BM = "error_m"


def _batch_bin(name: str, lo: int, hi: int) -> str:
    f = f"FILTER (WHERE ship_depth_m >= {lo} AND ship_depth_m < {hi})"
    return (f"CASE WHEN count({_BM}) {f} >= 5 THEN avg({_BM}) {f} END AS \"bias_{name}\", CASE WHEN count({_BM}) {f} >= 5 THEN sqrt(avg({_BM} * {_BM}) {f}) END AS \"rmse_{name}\"")


_EXP = """SELECT *, -raw_z - ship_depth_m AS error_m FROM (
  SELECT 'base' AS experiment, ship_depth_m, raw_z FROM in_sa JOIN bilinear_sa USING (lat_bin, lon_bin)
  UNION ALL SELECT 'shifted', ship_depth_m, raw_z - 30 FROM in_sa JOIN bilinear_sa USING (lat_bin, lon_bin))"""


@query("batch_validation", "experiment n_cells", "bias_m mae_m rmse_m medae_m correlation pred_range_min pred_range_max " + " ".join(
    f"bias_{n} rmse_{n}" for n in M.BATCH_DEPTH_BINS), f"""
SELECT experiment, count(*) AS n_cells, avg({_BM}) AS bias_m, avg(abs({_BM})) AS mae_m, sqrt(avg({_BM} * {_BM})) AS rmse_m, median(abs({_BM})) AS medae_m,
  corr(-raw_z, ship_depth_m) AS correlation, min(raw_z) AS pred_range_min, max(raw_z) AS pred_range_max,
  {', '.join(_batch_bin(n, lo, hi) for n, (lo, hi) in M.BATCH_DEPTH_BINS.items())} FROM ({_EXP}) WHERE {_BM} IS NOT NULL GROUP BY experiment""")
def _(spark, d):
    p = Products.of(spark, d)
    base = _pixels(p, "grid_a").withColumn("product_name", F.lit("base"))
    predictions = base.unionByName(base.withColumns({"product_name": F.lit("shifted"), "z": F.col("z") - 30.0}))
    return R.validate_batch(p.survey.primary_t, predictions, ["base", "shifted"], p.grid("grid_a").footprint)


@query("bin_labels", "cell_id depth_bin_metric depth_bin_regional policy_lo policy_hi n_points_bin n_file_cells_bin overlap_class file_cell_class cruise_class", "", f"""
SELECT cell_id, {S.depth_metric('median_depth_file_balanced')} AS depth_bin_metric, {S.depth_regional('median_depth_file_balanced')} AS depth_bin_regional,
  {S.policy_depth('median_depth_file_balanced', 0)} AS policy_lo, {S.policy_depth('median_depth_file_balanced', 1)} AS policy_hi,
  {_NP} AS n_points_bin, CASE WHEN n_file_cells = 1 THEN '1' WHEN n_file_cells = 2 THEN '2' WHEN n_file_cells BETWEEN 3 AND 5 THEN '3–5' WHEN n_file_cells > 5 THEN '>5' END AS n_file_cells_bin,
  {G.STRATA_A['overlap_class']} AS overlap_class, {G.STRATA_A['n_file_cells_class']} AS file_cell_class, {G.STRATA_A['n_cruises_guess_class']} AS cruise_class FROM cells_a""")
def _(spark, d):
    c, depth = Survey.of(spark, d).cells_t, "median_depth_file_balanced"
    b = bins.policy_depth_bin(depth)
    return c.withColumns({"depth_bin_metric": bins.depth_bin_metric(depth), "depth_bin_regional": bins.depth_bin_regional(depth),
                          "policy_lo": b["lo"].cast("bigint"), "policy_hi": b["hi"].cast("bigint"), "n_points_bin": bins.n_points_bin("n_points_total"),
                          "n_file_cells_bin": bins.n_file_cells_bin("n_file_cells"), "overlap_class": bins.overlap_class("n_file_cells"),
                          "file_cell_class": bins.file_cell_class("n_file_cells"), "cruise_class": bins.cruise_class("n_cruises_guess")})
