"""Validation products: strict, expanded, supplementary, regional and the catalog; and their profiles."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins, geo
from ..functions.stats import n_true, rmse, weighted_rmse
from .cells import CELL
from .groups import digest_agg, strata
from .tables import drop_ids, flag_ids, union_all

# Providers, tier vocabulary and the columns every product shares.
PROVIDERS = {"singlebeam": "track_singlebeam", "multibeam": "track_multibeam", "regional": "regional"}
SURVEY_PROVIDER, SURVEY_BRANCH = "survey", "survey_mb"
TIER_NAMES = {"A_tier": "high_confidence", "B_tier": "medium_confidence", "C_tier": "low_confidence"}
CORE_COLUMNS = {
    "cell_id": "string", "lon_bin": "bigint", "lat_bin": "bigint", "lon_center": "double", "lat_center": "double",
    "lat_band_10deg": "bigint", "source_provider": "string", "branch": "string", "branch_role": "string",
    "representative_depth_m": "double", "validation_weight": "double", "quality_tier": "string",
    "evidence_class": "string", "highdup_flag": "boolean", "source_risk_class": "string",
    "n_unique_triples_total": "bigint", "n_points_pass_total": "bigint", "n_track_cells": "bigint",
    "duplicate_ratio_cell": "double", "n_tracks": "bigint", "manual_review_any": "boolean",
    "low_evidence_flag": "boolean", "n_cross_branch_overlap": "bigint", "sensitivity_only_flag": "boolean",
    "precedence_resolution": "string", "final_primary_source": "string", "matched_rule_id": "string"}


def core_frame(df: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Missing columns as null, fixed types and order."""
    wanted = {**CORE_COLUMNS, **(extra or {})}
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def map_tier(tier: Column) -> Column:
    """Survey tiers in the confidence vocabulary; an unknown tier is an error."""
    pairs = F.create_map(*[F.lit(x) for kv in TIER_NAMES.items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit("unexpected quality tier: "), tier)).cast("string")
    return F.when(tier.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(pairs, tier), unknown))


def survey_rows(primary: DataFrame) -> DataFrame:
    """Survey validation cells in the common columns."""
    used = primary.where("use_for_primary_validation")
    return core_frame(used.withColumns({
        "lat_band_10deg": geo.lat_band("lat_center"), "source_provider": F.lit(SURVEY_PROVIDER),
        "branch": F.lit(SURVEY_BRANCH), "branch_role": F.lit("multibeam_primary"),
        "representative_depth_m": F.col("ship_depth_m"), "quality_tier": map_tier(F.col("quality_tier")),
        "evidence_class": F.lit("survey_legacy"), "highdup_flag": F.lit(False), "source_risk_class": F.lit(""),
        "n_points_pass_total": F.col("n_points_total"), "n_track_cells": F.col("n_file_cells"),
        "n_tracks": F.col("n_files"), "manual_review_any": F.lit(False), "low_evidence_flag": F.lit(False),
        "n_cross_branch_overlap": F.lit(0), "sensitivity_only_flag": F.lit(False), "precedence_resolution": F.lit(""),
        "final_primary_source": F.lit(""), "matched_rule_id": F.lit("survey_legacy")}))


USE_FLAGS = {"use_for_primary_validation": "boolean", "use_for_supplementary_validation": "boolean",
             "use_for_regional_experiment": "boolean", "exclude_from_primary": "boolean"}


def track_rows(flagged: DataFrame, branch: str) -> DataFrame:
    """Policy cells of one branch in the common columns."""
    rows = flagged.where(F.col("branch") == branch).withColumns({
        "source_provider": F.lit(PROVIDERS[branch]), "representative_depth_m": F.col("median_depth_m"),
        "precedence_resolution": F.lit(""), "final_primary_source": F.lit("")})
    return core_frame(rows, USE_FLAGS)


def strict_primary(survey: DataFrame, multibeam: DataFrame) -> DataFrame:
    """Survey cells plus the multibeam cells fit for primary use (disjointness is a separate check)."""
    both = union_all([survey, core_frame(multibeam.where("use_for_primary_validation"))])
    return both.withColumn("final_primary_source", F.col("source_provider"))


def precedence_fill(strict: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep the strict cells, add candidates for uncovered cells, and label the winners of a conflict."""
    names = {SURVEY_PROVIDER: "survey_over_sb", PROVIDERS["multibeam"]: "mb_over_sb"}
    kept = flag_ids(strict, candidates, CELL, "__conflict")
    label = F
    for provider, text in names.items():
        label = label.when(F.col("__conflict") & (F.col("source_provider") == provider), F.lit(text))
    kept = kept.withColumns({"precedence_resolution": label.otherwise(""), "expanded_fill": F.lit(False)})
    fill = drop_ids(core_frame(candidates), strict, CELL).withColumns({
        "expanded_fill": F.lit(True), "final_primary_source": F.col("source_provider")})
    return core_frame(union_all([kept.drop("__conflict"), fill]), {"expanded_fill": "boolean"})


def _winner(df: DataFrame, winners: DataFrame, out: str) -> DataFrame:
    side = winners.select(*CELL, F.col("source_provider").alias(out))
    return df.join(side, CELL, "left")


def supplementary(singlebeam: DataFrame, strict: DataFrame, expanded: DataFrame) -> DataFrame:
    """Supplementary singlebeam cells, labelled with whatever supersedes them."""
    rows = core_frame(singlebeam.where("use_for_supplementary_validation"))
    rows = _winner(_winner(rows, strict, "__strict"), expanded, "__expanded")
    label = (F.when(F.col("__strict") == SURVEY_PROVIDER, "superseded_by_survey")
             .when(F.col("__strict") == PROVIDERS["multibeam"], "superseded_by_mb").otherwise(""))
    return core_frame(rows.withColumns({
        "precedence_resolution": label, "final_primary_source": F.coalesce("__expanded", F.lit("")),
        "branch_role": F.lit("supplementary_coverage")}))


def regional_experiment(regional: DataFrame, expanded: DataFrame) -> DataFrame:
    """Regional cells, labelled with the primary source they run parallel to."""
    rows = _winner(core_frame(regional), expanded, "__winner")
    w = F.col("__winner")
    label = (F.when(w == SURVEY_PROVIDER, "primary_survey_regional_parallel")
             .when(w == PROVIDERS["multibeam"], "primary_mb_regional_parallel")
             .when(w == PROVIDERS["singlebeam"], "primary_sb_regional_parallel").otherwise(""))
    return core_frame(rows.withColumns({"precedence_resolution": label, "final_primary_source": F.lit(""),
                                        "branch_role": F.lit("regional_experiment")}))


def build_products(primary: DataFrame, flagged: DataFrame) -> dict[str, DataFrame]:
    """Strict, expanded, supplementary and regional products from the survey cells and the policy cells."""
    sb = track_rows(flagged, "singlebeam")
    strict = strict_primary(survey_rows(primary), track_rows(flagged, "multibeam"))
    expanded = precedence_fill(strict, sb.where("use_for_primary_validation"))
    return {"strict": strict, "expanded": expanded, "supplementary": supplementary(sb, strict, expanded),
            "regional": regional_experiment(track_rows(flagged, "regional"), expanded)}


def build_catalog(products: Mapping[str, DataFrame]) -> DataFrame:
    """Membership rows of all products."""
    labels = {"strict": "strict_primary_multibeam", "supplementary": "supplementary_singlebeam",
              "regional": "regional_experiment"}
    parts = [products[k].withColumns({"product_label": F.lit(v), "product_membership": F.lit(v)})
             for k, v in labels.items()]
    fill = products["expanded"].where(F.col("source_provider") == PROVIDERS["singlebeam"])
    parts.append(fill.withColumns({"product_label": F.lit("supplementary_singlebeam"),
                                   "product_membership": F.lit("expanded_primary_ship")}))
    return core_frame(union_all(parts), {"product_label": "string", "product_membership": "string"})


def catalog_summary(catalog: DataFrame) -> DataFrame:
    sources = F.array_join(F.array_sort(F.collect_set(F.coalesce("final_primary_source", F.lit("")))), ",")
    out = catalog.groupBy("product_label").agg(
        F.count(F.lit(1)).alias("catalog_rows"), F.count_distinct("lat_bin", "lon_bin").alias("unique_cell_ids"),
        sources.alias("final_primary_source_values"))          # four providers at most
    return out.withColumn("duplicate_product_cell_rows", F.col("catalog_rows") - F.col("unique_cell_ids"))


# --- profiles -------------------------------------------------------------------------------------------

PROFILE_STRATA = ["lat_band_10deg", "depth_bin_label", "quality_tier", "evidence_class", "source_risk_class",
                  "low_evidence_flag", "manual_review_any", "sensitivity_only_flag", "region_10deg"]
OVERLAP_STRATA = ["lat_band_10deg", "depth_bin_label", "quality_tier", "evidence_class", "region_10deg"]
COVERAGE_STRATA = ["branch_role", "branch", "quality_tier", "evidence_class", "lat_band_10deg", "depth_bin_label",
                   "region_10deg"]


def with_strata_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"depth_bin_label": bins.depth_bin_metric("representative_depth_m"),
                           "region_10deg": geo.region_10deg("lon_center", "lat_center"),
                           "has_cross_branch_overlap": F.coalesce(F.col("n_cross_branch_overlap") > 0, F.lit(False))})


def profile(df: DataFrame, key: str = "product_key") -> DataFrame:
    """Counts by tier, evidence and flags, ranges, medians and distinct strata per product."""
    rows = with_strata_columns(df)
    tiers = [n_true(F.col("quality_tier") == t).alias(f"{t}_cells") for t in (
        "high_confidence", "medium_confidence", "low_confidence", "review_or_sensitivity_only")]
    # distinct strata are counted apart: several distinct counts in one aggregate would multiply every row
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("representative_depth_m").alias("min_depth_m"),
            F.max("representative_depth_m").alias("max_depth_m"), F.min("validation_weight").alias("min_weight"),
            F.max("validation_weight").alias("max_weight"), *tiers,
            n_true(F.col("evidence_class") == "none").alias("evidence_none_cells"),
            n_true("low_evidence_flag").alias("low_evidence_flag_cells"),
            n_true("manual_review_any").alias("manual_review_cells"),
            n_true("sensitivity_only_flag").alias("sensitivity_only_cells"),
            n_true("highdup_flag").alias("n_highdup"),
            n_true("has_cross_branch_overlap").alias("cells_with_cross_branch_overlap")]
    out = digest_agg(rows, [key], aggs, {
        "median_depth_m": ("representative_depth_m", 0.5), "median_weight": ("validation_weight", 0.5),
        "median_duplicate_ratio": ("duplicate_ratio_cell", 0.5)}, coarse=True)
    per_stratum = rows.groupBy(key, "lat_band_10deg", "depth_bin_label", "region_10deg").agg(
        F.count(F.lit(1)).alias("__n")).groupBy(key).agg(
        F.count_distinct("lat_band_10deg").alias("n_lat_bands"), F.count_distinct("depth_bin_label").alias("n_depth_bins"),
        F.count_distinct("region_10deg").alias("n_regions_10deg"))
    ids = rows.groupBy(key).agg(F.count_distinct("lat_bin", "lon_bin").alias("n_cell_ids"))
    out = out.join(per_stratum, key).join(ids, key)
    return out.withColumn("duplicate_cell_rows", F.col("n_rows") - F.col("n_cell_ids"))


def profile_strata(df: DataFrame, key: str = "product_key") -> DataFrame:
    carry = [key, "representative_depth_m", "validation_weight", "low_evidence_flag", "manual_review_any",
             "sensitivity_only_flag", "has_cross_branch_overlap"]
    long = strata(with_strata_columns(df), carry, {c: c for c in PROFILE_STRATA})
    aggs = [F.count(F.lit(1)).alias("cells"), n_true("low_evidence_flag").alias("low_evidence_cells"),
            n_true("manual_review_any").alias("manual_review_cells"),
            n_true("sensitivity_only_flag").alias("sensitivity_only_cells"),
            n_true("has_cross_branch_overlap").alias("cross_branch_overlap_cells")]
    return digest_agg(long, [key, "stratification", "stratum"], aggs, {
        "median_depth_m": ("representative_depth_m", 0.5), "median_weight": ("validation_weight", 0.5)}, coarse=True)


def overlap_profile(df: DataFrame, strict: DataFrame, expanded: DataFrame, key: str = "product_key") -> DataFrame:
    """Overlap with the primary products, overall and by stratum."""
    marked = flag_ids(flag_ids(with_strata_columns(df), strict, CELL, "__in_strict"), expanded, CELL, "__in_expanded")
    long = strata(marked.withColumn("overall", F.lit("all")), [key, "__in_strict", "__in_expanded"],
                  {"overall": "overall", **{c: c for c in OVERLAP_STRATA}})
    out = long.groupBy(key, "stratification", "stratum").agg(
        F.count(F.lit(1)).alias("non_primary_cells"), n_true("__in_strict").alias("strict_primary_overlap_cells"),
        n_true("__in_expanded").alias("expanded_primary_overlap_cells"), n_true(~F.col("__in_expanded")).alias("outside_expanded_primary_cells"))
    n = F.col("non_primary_cells")
    return out.withColumns({"strict_primary_overlap_fraction": F.col("strict_primary_overlap_cells") / n,
                            "expanded_primary_overlap_fraction": F.col("expanded_primary_overlap_cells") / n})


def pairwise_overlap(df: DataFrame, products: Sequence[str], key: str = "product_key") -> DataFrame:
    """Shared cells of every pair of products.

    One presence flag per product and cell, then all pairs counted in one aggregate: no self-join.
    """
    present = df.groupBy(*CELL).agg(*[F.bool_or(F.col(key) == p).alias(f"has_{i}") for i, p in enumerate(products)])
    names = sorted(products)
    at = {p: F.col(f"has_{i}") for i, p in enumerate(products)}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    counts = present.agg(*[n_true(at[p]).alias(f"n_{p}") for p in names],
                         *[n_true(at[a] & at[b]).alias(f"b_{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("left_product_key"), F.lit(b).alias("right_product_key"),
                              F.col(f"n_{a}").alias("left_cells"), F.col(f"n_{b}").alias("right_cells"),
                              F.col(f"b_{a}_{b}").alias("overlap_cells")) for a, b in pairs])
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumns({f"overlap_fraction_of_{s}": F.try_divide("overlap_cells", f"{s}_cells") for s in ("left", "right")})


def with_membership(expanded: DataFrame, strict: DataFrame) -> DataFrame:
    out = flag_ids(expanded, strict, CELL, "is_retained_multibeam")
    return out.withColumn("is_singlebeam_gapfill", ~F.col("is_retained_multibeam"))


def coverage_gain(expanded: DataFrame, strict: DataFrame) -> DataFrame:
    """Retained and gap-fill cells per stratum."""
    rows = with_membership(with_strata_columns(expanded), strict)
    long = strata(rows, ["is_retained_multibeam", "is_singlebeam_gapfill"], {c: c for c in COVERAGE_STRATA})
    return long.groupBy("stratification", "stratum").agg(
        F.count(F.lit(1)).alias("expanded_cells"), n_true("is_retained_multibeam").alias("retained_multibeam_cells"),
        n_true("is_singlebeam_gapfill").alias("singlebeam_gapfill_cells"))


def _side_metrics(prefix: str, flag: str) -> list[Column]:
    e = F.when(F.col(flag), F.col("depth_error_m"))
    return [F.count(e).alias(f"{prefix}_count"), rmse(e).alias(f"{prefix}_RMSE"),
            weighted_rmse(e, F.col("validation_weight")).alias(f"{prefix}_weighted_RMSE")]


def gapfill_sensitivity(by_cell: DataFrame) -> DataFrame:
    """Error of retained and of gap-fill cells per product."""
    out = by_cell.withColumn("__all", F.lit(True)).groupBy("product_name").agg(
        *_side_metrics("overall", "__all"), *_side_metrics("retained", "is_retained_multibeam"),
        *_side_metrics("gapfill", "is_singlebeam_gapfill"))
    return out.withColumns({"gapfill_minus_retained_RMSE": F.col("gapfill_RMSE") - F.col("retained_RMSE"),
                            "gapfill_to_retained_RMSE_ratio": F.try_divide("gapfill_RMSE", "retained_RMSE")})


def gapfill_strata(by_cell: DataFrame) -> DataFrame:
    """The same per band and depth bin, only where both kinds have a valid error."""
    long = strata(by_cell, ["product_name", "depth_error_m", "validation_weight", "is_retained_multibeam",
                            "is_singlebeam_gapfill"], {"lat_band_10deg": "lat_band_10deg", "depth_bin": "depth_bin_label"})
    out = long.groupBy("product_name", "stratification", "stratum").agg(
        *_side_metrics("retained", "is_retained_multibeam"), *_side_metrics("gapfill", "is_singlebeam_gapfill"))
    return out.where("retained_RMSE is not null and gapfill_RMSE is not null").withColumn(
        "gapfill_minus_retained_RMSE", F.col("gapfill_RMSE") - F.col("retained_RMSE"))


def diagnose(sensitivity: DataFrame) -> DataFrame:
    """Say whether gap-fill cells drive the error difference."""
    r, g = F.col("retained_RMSE"), F.col("gapfill_RMSE")
    text = (F.when(r.isNull() | g.isNull(), "no_data")
            .when((g > r * 1.10) | (g - r > 25.0), "gapfill_worse")
            .when(g < r * 0.90, "gapfill_better")
            .otherwise("comparable"))
    return sensitivity.withColumn("diagnosis", text)


#: Role of each stage in the policy.
STAGE_ROLES = {"strict": "baseline", "expanded": "coverage_sensitivity", "non_primary": "diagnostics_only"}


def stage_outcome(stage: str, scope: str, cells: DataFrame, checks: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """One row for a stage: its cells, finished products, passed and failed checks, what was skipped, and its role.

    A stage passes if no check failed and no product ended in an error; skipped products are listed, with their reasons.
    """
    one = F.lit(stage).alias("stage")
    size = cells.agg(one, F.count(F.lit(1)).alias("cells"))
    tests = checks.agg(one, n_true(F.col("status") == "PASS").alias("safety_pass"), n_true(F.col("status") != "PASS").alias("safety_fail"))
    out = size.join(tests, "stage")
    if status is None:
        out = out.withColumns({"completed_products": F.lit(None).cast("bigint"), "failed_products": F.lit(0).cast("bigint"), "skipped": F.lit("")})
    else:
        listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "skipped", F.concat_ws(": ", "product_name", "reason")))), ";")   # configured products
        out = out.join(status.agg(one, n_true(F.col("status") == "ok").alias("completed_products"), n_true(F.col("status") == "error").alias("failed_products"), listed.alias("skipped")), "stage")
    passed = (F.col("safety_fail") == 0) & (F.col("failed_products") == 0)
    return out.withColumns({"product_scope": F.lit(scope), "policy_role": F.lit(STAGE_ROLES[stage]), "status": F.when(passed, "PASS").otherwise("FAIL")})


def compare_summaries(summary: DataFrame, strict_role: str, expanded_role: str) -> DataFrame:
    """Strict and expanded metrics side by side with their deltas."""
    metrics = ["bias", "MAE", "RMSE", "weighted_MAE", "weighted_RMSE"]

    def side(role: str, prefix: str) -> DataFrame:
        return summary.where(F.col("product_role") == role).select(
            "product_name", "sampling_method", *[F.col(c).alias(f"{prefix}_{c}") for c in ["count", *metrics]])

    out = side(strict_role, "strict").join(side(expanded_role, "expanded"), ["product_name", "sampling_method"])
    gain = F.col("expanded_count") - F.col("strict_count")
    return out.withColumns({
        "coverage_gain_count": gain, "coverage_gain_fraction_vs_strict": F.try_divide(gain, F.col("strict_count")),
        **{f"delta_{m}_expanded_minus_strict": F.col(f"expanded_{m}") - F.col(f"strict_{m}") for m in metrics}})
