"""Error metrics of gridded products, overall and by stratum."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins, geo
from ..functions.stats import corr_pairs, mean_abs, n_true, rmse, std_or_zero, weighted_mae, weighted_rmse
from .groups import digest_agg, head_per_group, null_safe_join, strata

E_COL = "elev_error_m"
BATCH_DEPTH_BINS = {"A_shallow": (0, 4000), "B_mid": (4000, 5000), "C_deep": (5000, 7000)}
SURVEY_LABELS = {"quality_tier": ["A_tier", "B_tier", "C_tier"], "depth_bin": bins.METRIC_DEPTH_LABELS,
                 "overlap_class": bins.OVERLAP_CLASSES, "n_file_cells_class": bins.FILE_CELL_CLASSES,
                 "n_cruises_guess_class": bins.CRUISE_CLASSES}
OPEN_STRATA_MIN_ROWS = 10


ABS_ERROR = {"__abs": E_COL}


def metrics_a(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted metrics with coverage against the requested and the total number of cells."""
    aggs = [F.max("requested_ship_cells").alias("requested_ship_cells"),
            F.max("total_primary_cells").alias("total_primary_cells"), F.count(F.lit(1)).alias("n_rows"),
            F.count(E_COL).alias("count"), F.avg(E_COL).alias("bias_mean"), mean_abs(E_COL).alias("MAE"),
            rmse(E_COL).alias("RMSE"), std_or_zero(E_COL).alias("STD")]
    out = digest_agg(df, keys, aggs, {
        "bias_median": (E_COL, 0.5), **{f"p{p:02d}": (E_COL, p / 100) for p in (5, 25, 75, 95)},
        "abs_error_p95": ("__abs", 0.95)}, mads={"MAD": E_COL}, absolute=ABS_ERROR, coarse=True)
    return out.withColumns({
        "coverage_fraction": F.coalesce(F.try_divide("count", "requested_ship_cells"), F.lit(0.0)),
        "global_fraction": F.coalesce(F.try_divide("count", "total_primary_cells"), F.lit(0.0))})


def metrics_b(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted and weighted metrics; only positive weights count."""
    e, w = F.col(E_COL), F.col("validation_weight")
    aggs = [F.count(F.lit(1)).alias("requested_cells"), F.count(e).alias("count"),
            F.count_if(e.isNull()).alias("nodata_count"), F.avg(e).alias("bias"), mean_abs(e).alias("MAE"),
            rmse(e).alias("RMSE"), weighted_mae(e, w).alias("weighted_MAE"), weighted_rmse(e, w).alias("weighted_RMSE")]
    out = digest_agg(df, keys, aggs, {"median_error": (E_COL, 0.5), **{
        f"abs_error_p{p}": ("__abs", p / 100) for p in (90, 95, 99)}}, mads={"MAD": E_COL}, absolute=ABS_ERROR, coarse=True)
    return out.withColumn("coverage_fraction", F.col("count") / F.col("requested_cells"))


def metrics_t1(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics with correlation; the MAD here is about zero, i.e. the median absolute error."""
    valid = df.where(F.col(E_COL).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(E_COL).alias("bias"), mean_abs(E_COL).alias("MAE"),
            rmse(E_COL).alias("RMSE"), std_or_zero(E_COL).alias("STD"),
            corr_pairs("model_elev_m", "ship_elev_m").alias("correlation")]
    return digest_agg(valid, keys, aggs, {
        "median_error": (E_COL, 0.5), "MAD": ("__abs", 0.5), "p05_error": (E_COL, 0.05), "p95_error": (E_COL, 0.95),
        "p95_abs_error": ("__abs", 0.95)}, absolute=ABS_ERROR, coarse=True)


def summarize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """T1 metrics by product and any further columns."""
    return metrics_t1(df, ["product_name", *columns])


GROUP_A = ["product_name", "sampling_method"]


def metrics_all_a(by_cell: DataFrame) -> DataFrame:
    """All survey strata in one pass; fixed labels appear even when empty, open ones need ten rows."""
    rows = by_cell.withColumns({
        "overall": F.lit("all"), "depth_bin": bins.depth_bin_metric("ship_depth_m"),
        "overlap_class": bins.overlap_class("n_file_cells"), "n_file_cells_class": bins.file_cell_class("n_file_cells"),
        "n_cruises_guess_class": bins.cruise_class("n_cruises_guess"),
        "region_10deg": geo.region_10deg("lon_center", "lat_center")})
    names = ["overall", *SURVEY_LABELS, "dominant_track_kind", "region_10deg"]
    carry = [*GROUP_A, E_COL, "requested_ship_cells", "total_primary_cells"]
    long = strata(rows, carry, {n: n for n in names})
    keys = [*GROUP_A, "stratification", "stratum"]
    out = metrics_a(long, keys)
    fixed = F.col("stratification").isin("overall", *SURVEY_LABELS)
    out = out.where((fixed & F.col("stratum").isNotNull())
                    | (F.col("stratum").isNotNull() & (F.col("n_rows") >= OPEN_STRATA_MIN_ROWS)))
    labels = F.array(*[F.struct(F.lit(k).alias("stratification"), F.lit(v).alias("stratum"))
                       for k, vs in SURVEY_LABELS.items() for v in vs])
    frame = by_cell.select(*GROUP_A).distinct().select(*GROUP_A, F.explode(labels).alias("s")).select(*GROUP_A, "s.*")
    out = null_safe_join(frame.withColumn("__listed", F.lit(True)), out, keys, "left").drop("__listed").unionByName(
        null_safe_join(out, frame, keys, "left_anti"))
    zero = F.lit(0).cast("bigint")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("count", "n_rows", "requested_ship_cells", "total_primary_cells")}
                           | {c: F.coalesce(c, F.lit(0.0)) for c in ("coverage_fraction", "global_fraction")})


STRATA_B = {"overall": "overall", "quality_tier": "quality_tier", "evidence_class": "evidence_class",
            "source_role": "branch_role", "branch": "branch", "depth_bin": "depth_bin_label",
            "lat_band": "lat_band_10deg", "region_10deg": "region_10deg"}
GROUP_B = ["product_name", "product_role", "sampling_method"]


def metrics_all_b(by_cell: DataFrame) -> DataFrame:
    """All track strata in one pass."""
    rows = by_cell.withColumn("overall", F.lit("all"))
    long = strata(rows, [*GROUP_B, E_COL, "validation_weight"], STRATA_B)
    return metrics_b(long, [*GROUP_B, "stratification", "stratum"])


def bias_diagnostics(by_cell: DataFrame, product: str) -> DataFrame:
    """What a constant or a per-depth-bin correction would gain, and how RMSE^2 splits into bias and variance."""
    rows = by_cell.where((F.col("product_name") == product) & F.col(E_COL).isNotNull()).withColumn(
        "depth_bin", bins.depth_bin_regional("ship_depth_m"))
    e, whole = F.col(E_COL), Window.partitionBy(F.lit(1))
    means = rows.groupBy("depth_bin").agg(F.avg(e).alias("__bin"), F.sum(e).alias("__s"), F.count(e).alias("__c"))
    means = means.select("depth_bin", "__bin", (F.sum("__s").over(whole) / F.sum("__c").over(whole)).alias("__mean"))
    rows = null_safe_join(rows, F.broadcast(means), ["depth_bin"])                   # one row for each depth bin
    kinds = F.array(*[F.struct(F.lit(k).alias("diagnostic"), v.alias("v")) for k, v in (
        ("original", e), ("constant_bias_corrected", e - F.col("__mean")), ("depth_bin_bias_corrected", e - F.col("__bin")))])
    long = rows.select("model_elev_m", "ship_elev_m", F.explode(kinds).alias("k")).select("model_elev_m", "ship_elev_m", "k.*")
    out = long.groupBy("diagnostic").agg(
        F.count("v").alias("n"), F.avg("v").alias("bias"), mean_abs("v").alias("MAE"), rmse("v").alias("RMSE"),
        corr_pairs("model_elev_m", "ship_elev_m").alias("correlation"))
    per_bin = rows.groupBy(F.concat(F.lit("depth_bin_bias_"), F.col("depth_bin")).alias("diagnostic")).agg(
        F.count(e).alias("n"), F.avg(e).alias("bias"), mean_abs(e).alias("MAE"), rmse(e).alias("RMSE"),
        corr_pairs("model_elev_m", "ship_elev_m").alias("correlation"))
    split = rows.agg(F.lit("bias_variance_decomposition").alias("diagnostic"), F.count(e).alias("n"), F.avg(e).alias("bias"),
                     F.lit(None).cast("double").alias("MAE"), rmse(e).alias("RMSE"),
                     corr_pairs("model_elev_m", "ship_elev_m").alias("correlation"),
                     (F.avg(e) * F.avg(e)).alias("bias2"), F.var_pop(e).alias("centered_error_variance"))
    original = F.max(F.when(F.col("diagnostic") == "original", F.col("RMSE")))
    out = out.withColumn("__base", original.over(Window.partitionBy(F.lit(1))))      # three rows
    gain = F.col("__base") - F.col("RMSE")
    out = out.withColumns({"RMSE_improvement_m": gain, "RMSE_improvement_pct": F.try_divide(100.0 * gain, F.col("__base"))})
    split = split.withColumn("bias_fraction_of_rmse2", F.try_divide(F.col("bias2"), F.col("RMSE") * F.col("RMSE")))
    return out.drop("__base").unionByName(per_bin, allowMissingColumns=True).unionByName(split, allowMissingColumns=True)


def convention_diag(by_cell: DataFrame, keys: Sequence[str] = ("product_name", "sampling_method")) -> DataFrame:
    """Value ranges, missing counts, correlation and the suspicion of a turned sign."""
    out = by_cell.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells_requested"), F.min("raw_z").alias("raw_z_min"), F.max("raw_z").alias("raw_z_max"),
        F.min("model_elev_m").alias("converted_model_elev_min"), F.max("model_elev_m").alias("converted_model_elev_max"),
        F.min("model_depth_m").alias("model_depth_min"), F.max("model_depth_m").alias("model_depth_max"),
        F.count_if(F.col("raw_z").isNull()).alias("nodata_count"),
        n_true(F.col("model_elev_m").isNotNull() & F.col("ship_elev_m").isNotNull()).alias("valid_count"),
        n_true(F.abs(F.col("raw_z")) > 50000).alias("n_out_of_range"),
        corr_pairs("model_elev_m", "ship_elev_m").alias("elevation_correlation"),
        F.any_value("z_convention").alias("z_convention"), F.any_value("lon_convention").alias("lon_convention"))
    return out.withColumns({"lon_0_360_conversion_applied": F.col("lon_convention") == "0_360",
                            "sign_error_suspected": F.coalesce(F.col("elevation_correlation") < 0, F.lit(False))})


def classify_issue(diag: DataFrame) -> DataFrame:
    n, valid = F.col("n_cells_requested"), F.col("valid_count")
    label = (F.when(F.col("sign_error_suspected"), "turned_sign")
             .when((F.col("n_out_of_range") > 0) | (F.col("nodata_count") > 0), "fill_values")
             .when(valid < F.greatest(F.lit(10.0), 0.5 * n), "few_valid_cells")
             .when(F.col("lon_0_360_conversion_applied") & (valid == 0), "shifted_longitudes")
             .otherwise("none_found"))
    return diag.withColumn("likely_issue", label)


def worst_strata(metrics: DataFrame, kinds: Sequence[str] = ("depth_bin", "lat_band", "region_10deg"),
                 group: Sequence[str] = GROUP_B) -> DataFrame:
    """The stratum with the largest RMSE of each kind."""
    rows = metrics.where(F.col("stratification").isin(list(kinds)) & F.col("RMSE").isNotNull())
    return head_per_group(rows, [*group, "stratification"], [F.col("RMSE").desc(), F.col("stratum")], 1, salts=1)


def weighting_effect(by_cell: DataFrame, tiers: Sequence[str] = ("high_confidence", "medium_confidence", "low_confidence")) -> DataFrame:
    """Weighted against unweighted error, with the error of each tier, one row per product."""
    e, w = F.col(E_COL), F.col("validation_weight")
    per_tier = []
    for t in tiers:
        own = F.when(F.col("quality_tier") == t, e)
        per_tier += [F.count(own).alias(f"{t}_count"), rmse(own).alias(f"{t}_RMSE")]
    out = by_cell.groupBy("product_name").agg(
        F.count(e).alias("count"), mean_abs(e).alias("unweighted_MAE"), rmse(e).alias("unweighted_RMSE"),
        weighted_mae(e, w).alias("weighted_MAE"), weighted_rmse(e, w).alias("weighted_RMSE"), *per_tier)
    delta = F.col("weighted_RMSE") - F.col("unweighted_RMSE")
    return out.withColumns({"delta_RMSE_m": delta, "pct_RMSE_change": F.try_divide(100.0 * delta, F.col("unweighted_RMSE")),
                            "weighted_RMSE_lower_than_unweighted": delta < -1e-9})


def top_errors(by_cell: DataFrame, n: int, by: str = "abs_elev_error_m", group: Sequence[str] | None = None) -> DataFrame:
    """The n largest errors, overall or per group."""
    order = [F.col(by).desc(), F.col("cell_id")]
    rows = by_cell.where(F.col(by).isNotNull())
    return rows.orderBy(*order).limit(n) if group is None else head_per_group(rows, group, order, n)


def batch_metrics(rows: DataFrame, min_valid: int) -> DataFrame:
    """Metrics per experiment with three depth bins of at least five cells."""
    valid = rows.where(F.col("error_m").isNotNull()).withColumn("__abs", F.abs(F.col("error_m")))
    extra = []
    for name, (lo, hi) in BATCH_DEPTH_BINS.items():
        own = F.when((F.col("ship_depth_m") >= lo) & (F.col("ship_depth_m") < hi), F.col("error_m"))
        extra += [F.when(F.count(own) >= 5, F.avg(own)).alias(f"bias_{name}"),
                  F.when(F.count(own) >= 5, rmse(own)).alias(f"rmse_{name}")]
    out = digest_agg(valid, ["experiment"], [
        F.count(F.lit(1)).alias("n_cells"), F.avg("error_m").alias("bias_m"), F.avg("__abs").alias("mae_m"),
        rmse("error_m").alias("rmse_m"), corr_pairs(-F.col("raw_z"), "ship_depth_m").alias("correlation"),
        F.min("raw_z").alias("pred_range_min"), F.max("raw_z").alias("pred_range_max"), *extra],
        {"medae_m": ("__abs", 0.5)})
    return out.where(F.col("n_cells") >= min_valid)


def completion(status: DataFrame, expected: DataFrame) -> DataFrame:
    """Does each product's status and row count match what was expected?"""
    out = expected.join(status, "product_name", "left")
    return out.withColumns({
        "status_match": F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)),
        "row_count_match": F.when(F.col("rows_processed") == F.col("expected_rows"), "PASS").otherwise("FAIL")})


def prefer_method(by_cell: DataFrame, order: Mapping[str, int] | None = None) -> DataFrame:
    """One sampling method per product: bilinear, else its sensitivity run, else whatever there is.

    The choice is made on the list of methods per product (a few rows), then joined back.
    """
    order = order or {"center_bilinear": 0, "center_bilinear_sensitivity": 1}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]),
                                       F.col("sampling_method")), F.lit(len(order)))
    methods = by_cell.select("product_name", "sampling_method").distinct().withColumn("__rank", rank)
    best = methods.withColumn("__best", F.min("__rank").over(Window.partitionBy("product_name"))).where(
        "__rank = __best").drop("__rank", "__best")
    return by_cell.join(F.broadcast(best), ["product_name", "sampling_method"], "left_semi")
