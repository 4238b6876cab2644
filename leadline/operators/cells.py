"""File-cells (file x 1-arc-minute cell) and merged cells, for both sources."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stats import n_true, std_or_zero
from .groups import digest_agg, null_safe_join, quantile_agg, sorted_agg
from .manifests import LAYOUT_3COL, LAYOUT_6COL
from .points import passing
from .tables import flag_ids, drop_ids, keep_ids

CELL = ["lat_bin", "lon_bin"]
# Tier limits and weights of the survey cells.
TIER_A = {"min_cruises": 2, "min_file_cells": 2, "max_iqr_m": 50, "min_points": 100}
TIER_B = {"min_points": 50, "max_range_m": 500}
TIER_WEIGHTS = {"A_tier": 1.0, "B_tier": 0.7, "C_tier": 0.4}
FALLBACK_REVIEW_REASON = "supplementary_check_flag"


def file_cells_a(points: DataFrame,
                 attributes: Sequence[str] = ("cruise_id", "archive_id", "track_kind", "data_layout")) -> DataFrame:
    """Depth statistics per file and cell over the points that passed the checks, exact in one pass.

    Grouped by the file and the two integer bins; file attributes ride along instead of widening the key.
    """
    d = "depth_m_positive_down"
    passed = passing(geo.with_bins(points), "qc_pass_basic")
    aggs = [F.count(F.lit(1)).alias("n_points"), F.avg(d).alias("mean_depth_m_positive_down"),
            std_or_zero(d).alias("std_depth_m"), F.min(d).alias("min_depth_m"), F.max(d).alias("max_depth_m"),
            F.avg("elev_m").alias("mean_elev_m"), F.count("date_raw").alias("n_date_nonnull"),
            F.count("time_raw").alias("n_time_nonnull"), F.count("sonar_idx").alias("n_sonar_idx_nonnull"),
            *[F.any_value(c).alias(c) for c in attributes]]
    out = digest_agg(passed, ["file_id", *CELL], aggs, {
        "median_depth_m_positive_down": (d, 0.5), "q25_depth_m": (d, 0.25), "q75_depth_m": (d, 0.75)})
    return geo.with_cell_geometry(out).withColumns({
        "median_elev_m": -F.col("median_depth_m_positive_down"),
        "iqr_depth_m": F.col("q75_depth_m") - F.col("q25_depth_m")})


def dominant(n: str, ident: str, attributes: Sequence[str]) -> Column:
    """Attributes of the row with the largest count; the smallest id wins a tie."""
    return F.min_by(F.struct(ident, *attributes), F.struct(-F.col(n), F.col(ident)))


def merge_cells_a(fc: DataFrame) -> DataFrame:
    """Merge file-cells to cells: the median of file medians, so that every file counts once."""
    m = "median_depth_m_positive_down"
    aggs = [
        F.sum("n_points").alias("n_points_total"), F.count(F.lit(1)).alias("n_file_cells"),
        F.sum(F.col("mean_depth_m_positive_down") * F.col("n_points")).alias("__weighted"),
        F.avg(m).alias("mean_depth_file_balanced"), std_or_zero(m).alias("std_depth_between_file_cells"),
        F.min("min_depth_m").alias("min_depth_file_cell"), F.max("max_depth_m").alias("max_depth_file_cell"),
        n_true(F.col("data_layout") == LAYOUT_3COL).alias("n_3col_file_cells"),
        n_true(F.col("data_layout") == LAYOUT_6COL).alias("n_6col_file_cells"),
        dominant("n_points", "file_id", ["cruise_id", "track_kind", "data_layout"]).alias("__dom")]
    out = sorted_agg(fc, CELL, aggs, {
        "median_depth_file_balanced": (m, 0.5), "q25_depth_between_file_cells": (m, 0.25),
        "q75_depth_between_file_cells": (m, 0.75)}, distinct={"n_files": "file_id", "n_cruises_guess": "cruise_id", "n_archives": "archive_id"})
    out = geo.with_cell_geometry(out).withColumns({
        "median_elev_file_balanced": -F.col("median_depth_file_balanced"),
        "mean_elev_file_balanced": -F.col("mean_depth_file_balanced"),
        "weighted_mean_depth_point_weighted": F.col("__weighted") / F.col("n_points_total"),
        "iqr_depth_between_file_cells": F.col("q75_depth_between_file_cells") - F.col("q25_depth_between_file_cells"),
        "range_depth_file_cell": F.col("max_depth_file_cell") - F.col("min_depth_file_cell"),
        "dominant_file_id": F.col("__dom.file_id"), "dominant_cruise_id": F.col("__dom.cruise_id"),
        "dominant_track_kind": F.col("__dom.track_kind"), "dominant_data_layout": F.col("__dom.data_layout")})
    return out.withColumn("weighted_mean_elev_point_weighted", -F.col("weighted_mean_depth_point_weighted")).drop(
        "__weighted", "__dom")


def rebuild_without(fc: DataFrame, flags: DataFrame) -> DataFrame:
    """Cells rebuilt without the excluded files, with what the excluded files had contributed."""
    excluded = flags.where("exclude_from_primary_cells").select("file_id")
    lost = keep_ids(fc, excluded, "file_id").groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_excluded_file_cells_in_original"),
        F.sum("n_points").alias("n_excluded_points_in_original"))
    kept = merge_cells_a(drop_ids(fc, excluded, "file_id"))
    out = kept.join(lost, CELL, "left")
    n = F.coalesce("n_excluded_file_cells_in_original", F.lit(0).cast("bigint"))
    return out.withColumns({
        "n_excluded_file_cells_in_original": n,
        "n_excluded_points_in_original": F.coalesce("n_excluded_points_in_original", F.lit(0).cast("bigint")),
        "had_excluded_source_in_original": n > 0, "qcfiltered": F.lit(True),
        "quality_filter_version": F.lit("v1_extreme_bias_exclusion")})


def assign_tier(cells: DataFrame) -> DataFrame:
    n = F.col("n_points_total")
    a = ((F.col("n_cruises_guess") >= TIER_A["min_cruises"]) & (F.col("n_file_cells") >= TIER_A["min_file_cells"])
         & (F.col("iqr_depth_between_file_cells") <= TIER_A["max_iqr_m"]) & (n >= TIER_A["min_points"]))
    b = (n >= TIER_B["min_points"]) & (F.col("range_depth_file_cell") <= TIER_B["max_range_m"])
    out = cells.withColumn("quality_tier", F.when(a, "A_tier").when(b, "B_tier").otherwise("C_tier"))
    return out.withColumn("validation_weight", tier_weight(F.col("quality_tier")))


def tier_weight(tier: Column) -> Column:
    pairs = [F.lit(x) for kv in TIER_WEIGHTS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), tier)


def primary_validation_cells(cells: DataFrame) -> DataFrame:
    """Validation table of the survey cells: ship depth, tier, weight and role flags."""
    return assign_tier(cells).withColumns({
        "ship_depth_m": F.col("median_depth_file_balanced"), "ship_elev_m": F.col("median_elev_file_balanced"),
        "use_for_primary_validation": F.lit(True), "use_for_sensitivity_validation": F.lit(False)})


def sensitivity_table(cells: DataFrame) -> DataFrame:
    """The same layout from unfiltered cells, with weight 0 and the role flags turned round."""
    return cells.withColumns({
        "ship_depth_m": F.col("median_depth_file_balanced"), "ship_elev_m": F.col("median_elev_file_balanced"),
        "quality_tier": F.lit("original"), "validation_weight": F.lit(0.0),
        "use_for_primary_validation": F.lit(False), "use_for_sensitivity_validation": F.lit(True),
        "qcfiltered": F.lit(False), "quality_filter_version": F.lit("original_unfiltered")})


def validation_summary(primary: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Key/value summary of the two tables."""
    p = primary.select(*CELL, "quality_tier", "ship_depth_m", "ship_elev_m", F.lit(1).alias("__p"))
    s = sensitivity.select(*CELL, F.lit(1).alias("__s"))
    both = p.join(s, CELL, "full_outer")
    is_p, is_s = F.col("__p").isNotNull(), F.col("__s").isNotNull()
    values = {"primary_cells": n_true(is_p), "sensitivity_cells": n_true(is_s),
              **{f"primary_{t}_count": n_true(F.col("quality_tier") == t) for t in TIER_WEIGHTS},
              "common_cells": n_true(is_p & is_s), "lost_cells": n_true(is_s & ~is_p),
              "lost_ratio_pct": F.round(F.try_divide(100.0 * n_true(is_s & ~is_p), n_true(is_s)), 4),
              "primary_depth_min_m": F.round(F.min("ship_depth_m"), 2),
              "primary_depth_max_m": F.round(F.max("ship_depth_m"), 2),
              "primary_elev_min_m": F.round(F.min("ship_elev_m"), 2),
              "primary_elev_max_m": F.round(F.max("ship_elev_m"), 2)}
    wide = both.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return wide.unpivot([], list(values), "metric", "value")


# --- source B -----------------------------------------------------------------------------------------

TRACK_KEYS = ["branch", "track_id"]
#: Copies of one point that are counted one by one.
COPIES = 64
TRACK_ATTRIBUTES = ["source_type", "source_completeness", "instrument_class_pred", "manual_review_flag"]


def file_cells_b(points: DataFrame,
                 attributes: Sequence[str] = tuple(TRACK_ATTRIBUTES)) -> DataFrame:
    """Depth statistics per track and cell, over all points and over distinct (lon, lat, depth) triples.

    One pass: copies are collapsed to a triple and its count, and a row for each copy, the first of them marked, goes into the
    group's run. Groups with a triple of more than COPIES copies are read again, their triples apart from their points.
    """
    d, keys = "depth_m_positive_down", [*TRACK_KEYS, *CELL]
    passed = passing(geo.with_bins(points), "point_check_pass_basic")
    triples = passed.groupBy(*keys, "lon", "lat", d).agg(F.count(F.lit(1)).alias("__c"), *[F.any_value(c).alias(c) for c in attributes])
    copy = F.posexplode(F.array_repeat("__c", F.least("__c", F.lit(COPIES)).cast("int")))
    rows = triples.select("*", copy.alias("__copy", "__same")).withColumn("__first", F.when(F.col("__copy") == 0, F.col(d)))
    aggs = [F.count(F.lit(1)).alias("n_points_pass"), F.avg(d).alias("mean_depth_m"),
            F.stddev_samp(d).alias("std_depth_m"), F.min(d).alias("min_depth_m"), F.max(d).alias("max_depth_m"),
            *[F.any_value(c).alias(c) for c in attributes], F.count("__first").alias("n_unique_triples")]
    out = digest_agg(rows, keys, aggs, {
        "median_depth_m": (d, 0.5), "__q25": (d, 0.25), "__q75": (d, 0.75), "median_depth_m_unique_triples": ("__first", 0.5)},
        beyond_if=F.max("__c") > COPIES, beyond=lambda left: _points_and_triples(null_safe_join(passed, left, keys, "left_semi"), keys, attributes))
    return geo.with_cell_geometry(out).withColumns({
        "duplicate_ratio": F.lit(1.0) - F.col("n_unique_triples") / F.col("n_points_pass"),
        "range_depth_m": F.col("max_depth_m") - F.col("min_depth_m"),
        "iqr_depth_m": F.col("__q75") - F.col("__q25"),
        "median_depth_m_all_points": F.col("median_depth_m")}).drop("__q25", "__q75")


def _points_and_triples(passed: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """The same statistics in two passes that collapse equal values, for groups with very many copies."""
    d = "depth_m_positive_down"
    aggs = [F.count(F.lit(1)).alias("n_points_pass"), F.avg(d).alias("mean_depth_m"),
            F.stddev_samp(d).alias("std_depth_m"), F.min(d).alias("min_depth_m"), F.max(d).alias("max_depth_m"),
            *[F.any_value(c).alias(c) for c in attributes]]
    stats = quantile_agg(passed, keys, aggs, {
        "median_depth_m": (d, 0.5), "__q25": (d, 0.25), "__q75": (d, 0.75)})
    triples = passed.select(*keys, "lon", "lat", d).distinct()
    unique = quantile_agg(triples, keys, [F.count(F.lit(1)).alias("n_unique_triples")],
                          {"median_depth_m_unique_triples": (d, 0.5)})
    return null_safe_join(stats, unique, keys)


def merge_cells_b(fc: DataFrame, reason: str | None = None) -> DataFrame:
    """Merge track-cells per branch: median of track medians, source counts, review counts and reasons."""
    m, review = "median_depth_m", F.coalesce(F.col("manual_review_flag"), F.lit(False))
    why = F.coalesce(F.col(reason), F.lit("")) if reason else F.lit(FALLBACK_REVIEW_REASON)

    def has(column: str, value: str) -> Column:
        return n_true(F.col(column) == value)

    unique = F.sum("n_unique_triples")
    reviewed = F.coalesce(F.sum(F.when(review, F.col("n_unique_triples"))), F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("n_track_cells"),
        F.sum("n_points_pass").alias("n_points_pass_total"), unique.alias("n_unique_triples_total"),
        F.avg(m).alias("mean_of_track_medians"), F.stddev_samp(m).alias("std_of_track_medians"),
        F.min(m).alias("min_track_median"), F.max(m).alias("max_track_median"),
        has("source_type", "decoded").alias("n_source_decoded"), has("source_type", "xyz").alias("n_source_xyz"),
        has("source_type", "regional").alias("n_source_regional"),
        has("source_completeness", "nc_xyz_intersect").alias("n_completeness_nc_xyz_intersect"),
        has("source_completeness", "xyz_only").alias("n_completeness_xyz_only"),
        has("source_completeness", "nc_only").alias("n_completeness_nc_only"),
        has("instrument_class_pred", "singlebeam").alias("n_instrument_singlebeam"),
        has("instrument_class_pred", "multibeam").alias("n_instrument_multibeam"),
        n_true(review).alias("manual_review_track_cell_count"), reviewed.alias("manual_review_unique_triples"),
        # the vocabulary of reasons is a handful of labels, so the set stays tiny
        F.array_sort(F.collect_set(F.when(review & (why != ""), why))).alias("__why")]
    out = sorted_agg(fc, ["branch", *CELL], aggs, {
        "median_depth_m": (m, 0.5), "__q25": (m, 0.25), "__q75": (m, 0.75)}, distinct={"n_tracks": "track_id"})
    out = geo.with_cell_geometry(out).withColumns({
        "duplicate_ratio_cell": F.lit(1.0) - F.col("n_unique_triples_total") / F.col("n_points_pass_total"),
        "range_track_median": F.col("max_track_median") - F.col("min_track_median"),
        "iqr_of_track_medians": F.col("__q75") - F.col("__q25"),
        "manual_review_any": F.col("manual_review_track_cell_count") > 0,
        "manual_review_unique_triples_share": F.try_divide("manual_review_unique_triples", "n_unique_triples_total"),
        "manual_review_reasons": F.array_join("__why", ";")})
    return out.withColumn("lat_band_10deg", geo.lat_band("lat_center")).drop("__q25", "__q75", "__why")


def branch_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n_cells_total"), F.sum("n_track_cells").alias("n_track_cells_total"),
        F.sum("n_points_pass_total").alias("n_points_pass_grand_total"),
        F.sum("n_unique_triples_total").alias("n_unique_triples_grand_total"),
        F.count_distinct("lat_band_10deg").alias("n_lat_bands_occupied"),
        n_true("manual_review_any").alias("n_manual_review_cells"),
        F.avg(F.col("manual_review_any").cast("int")).alias("manual_review_cell_share"))


def file_cell_manifest(fc: DataFrame, key: Sequence[str], n: str, median: str) -> DataFrame:
    """Cells, points and median-depth range per file or track."""
    return fc.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(n).alias("n_points_total"), F.min(n).alias("n_points_min"),
        F.max(n).alias("n_points_max"), F.avg(n).alias("n_points_mean"), F.min(median).alias("median_depth_min"),
        F.max(median).alias("median_depth_max"))


def flag_multi_cruise(fc: DataFrame, cells: DataFrame) -> DataFrame:
    return flag_ids(fc, cells.where("n_cruises_guess > 1"), CELL, "is_multi_cruise")
