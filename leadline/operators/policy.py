"""Calibration slices, priority-ordered rules and the policy sidecars."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins, geo
from ..functions.stats import n_true, rmse
from .cells import CELL
from .groups import digest_agg
from .overlap import PAIRS
from .tables import distinct_ids, union_all

# The band and bin edges rules may name, the roles, and the enforced rules.
LAT_BANDS = list(range(-90, 90, 10))
DEPTH_EDGES = bins.POLICY_DEPTH_EDGES[:-1]
BRANCH_ROLE = {"singlebeam": "supplementary_coverage", "multibeam": "multibeam_supplement",
               "regional": "regional_experiment"}
HIGH_DUPLICATE = 0.5
CONSISTENT_RMSE_M = 150.0
DEFAULT_RULE = ("default_unmatched", 99, "low_confidence", 0.25, False)


@dataclass(frozen=True)
class Rule:
    """`condition` is a Spark SQL expression over the cell and slice columns; a missing value is no match."""
    rule_id: str
    tier: str
    weight: float
    exclude: bool
    condition: str
    branch: str = "*"
    lat: str = "*"
    depth: str = "*"


RULES = [
    Rule("mb_v0_high_overlap_lowdup", "high_confidence", 0.95, False,
         "n_track_cells >= 2 AND duplicate_ratio_cell <= 0.1 AND mb_vs_regional_p95 < 175",
         "multibeam", "-80..-70,-30..-20", "500..6000"),
    Rule("sb_v0_lowlat_shallow_overlap_high", "high_confidence", 0.85, False,
         "n_track_cells >= 2 AND n_unique_triples_total >= 10 AND duplicate_ratio_cell <= 0.1 "
         "AND within_or_cross_p95 < 200", "singlebeam", "-50..50", "0..2000"),
    Rule("sb_v0_lowlat_deep_overlap_medium", "medium_confidence", 0.65, False,
         "n_track_cells >= 2 AND n_unique_triples_total >= 10 AND within_branch_residual_p95 < 300",
         "singlebeam", "-50..50", "2000..6000"),
    Rule("regional_v0_crossvalidated_medium", "medium_confidence", 0.60, True,
         "array_contains(in_cross_pair, 'mb_vs_regional') AND mb_vs_regional_rmse < 150 AND mb_vs_regional_p95 < 200",
         "regional", "-80..-70,-30..-20", "500..6000"),
    Rule("regional_v0_shallow_highrisk", "review_or_sensitivity_only", 0.10, True, "true", "regional", "*", "0..200"),
    Rule("sb_v0_southern_ocean_review", "review_or_sensitivity_only", 0.25, False,
         "cross_branch_residual_p99 > 1000 OR n_cross_branch_overlap = 0", "singlebeam", "-70..-50"),
    Rule("sb_v0_highlat_north_review", "review_or_sensitivity_only", 0.30, False,
         "cross_branch_residual_max_p95 > 300", "singlebeam", "60..90"),
    Rule("mb_v0_singletrack_lowdup", "medium_confidence", 0.75, False,
         "n_track_cells = 1 AND duplicate_ratio_cell <= 0.1 AND n_unique_triples_total >= 100", "multibeam"),
    Rule("mb_v0_highdup_sentry_downweight", "medium_confidence", 0.55, False,
         "duplicate_ratio_cell > 0.5 AND n_unique_triples_total >= 100", "multibeam"),
    Rule("sb_v0_no_overlap_low", "low_confidence", 0.35, False,
         "n_track_cells = 1 AND n_cross_branch_overlap = 0", "singlebeam"),
    Rule("regional_v0_default_sensitivity", "review_or_sensitivity_only", 0.20, True, "true", "regional"),
    Rule("any_v0_overlap_both_high", "high_confidence", 0.90, False,
         "n_track_cells >= 2 AND n_cross_branch_overlap >= 1 AND cross_branch_residual_max_p95 < 150 "
         "AND duplicate_ratio_cell <= 0.1"),
    Rule("any_v0_strong_unique_medium", "medium_confidence", 0.70, False,
         "n_unique_triples_total >= 1000 AND duplicate_ratio_cell <= 0.1 "
         "AND (n_track_cells >= 2 OR n_cross_branch_overlap >= 1)"),
    Rule("any_v0_low_unique_low", "low_confidence", 0.30, False, "n_unique_triples_total < 10"),
    Rule("any_v0_dup_heavy_downweight", "low_confidence", 0.35, False,
         "duplicate_ratio_cell > 0.5 AND n_cross_branch_overlap = 0"),
]
# Checked after the rules and never used for a tier: a review flag alone neither excludes nor upgrades.
INVARIANTS = [Rule("manual_review_not_exclusion", "medium_confidence", 0.60, False, "manual_review_any")]


def candidate_rules(spark) -> DataFrame:
    """The rule table itself: 15 first-match rules by priority and the invariant."""
    rows = [(i, r.rule_id, r.tier, r.branch, r.lat, r.depth, r.condition, r.weight, r.exclude, "first_match")
            for i, r in enumerate(RULES, 1)]
    rows += [(None, r.rule_id, r.tier, r.branch, r.lat, r.depth, r.condition, r.weight, r.exclude, "invariant")
             for r in INVARIANTS]
    return spark.createDataFrame(rows, "priority int, rule_id string, candidate_tier string, applies_to_branch string, "
                                 "lat_filter string, depth_filter string, condition string, recommended_weight double, "
                                 "exclude_from_primary boolean, applies_as string")


# --- calibration ---------------------------------------------------------------------------------------

def with_policy_bins(df: DataFrame, depth: str) -> DataFrame:
    b = bins.policy_depth_bin(depth)
    return df.withColumns({"depth_bin_lo": b["lo"].cast("bigint"), "depth_bin_hi": b["hi"].cast("bigint")})


def _either_side(cross: DataFrame, *columns: str) -> DataFrame:
    """One row per side of every shared cell, named by its branch."""
    return union_all([cross.select("pair_label", F.col(f"{s}_branch").alias("branch"), *CELL, "lat_center",
                                   F.col(f"{s}_median_depth_m").alias("branch_depth_m"), *columns)
                      for s in ("left", "right")])


def annotate_cross(cells: DataFrame, cross: DataFrame) -> DataFrame:
    """Number and list of the cross-branch pairs a cell takes part in."""
    sides = _either_side(cross).groupBy("branch", *CELL).agg(
        F.count("pair_label").alias("n_cross_branch_overlap"),
        F.array_sort(F.collect_set("pair_label")).alias("in_cross_pair"))     # three labels at most
    out = cells.join(sides, ["branch", *CELL], "left")
    return out.withColumns({"n_cross_branch_overlap": F.coalesce("n_cross_branch_overlap", F.lit(0).cast("bigint")),
                            "in_cross_pair": F.coalesce("in_cross_pair", F.array().cast("array<string>"))})


def calib_branch(cells: DataFrame, cross: DataFrame, within: DataFrame, pairs: DataFrame) -> DataFrame:
    """Evidence counts and residual headline numbers per branch; the overlap union is exact."""
    marked = annotate_cross(cells, cross)
    in_within, in_cross = F.col("n_track_cells") >= 2, F.col("n_cross_branch_overlap") >= 1
    highdup = F.col("duplicate_ratio_cell") > HIGH_DUPLICATE
    is_mb = F.col("branch") == "multibeam"
    base = marked.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n_cells_total"), n_true(in_within).alias("n_cells_with_within_branch_overlap"),
        n_true(in_cross).alias("n_cells_with_cross_branch_overlap_any"),
        n_true(~in_within & ~in_cross).alias("n_cells_no_overlap_evidence"),
        F.avg((in_within | in_cross).cast("int")).alias("share_with_overlap_evidence"),
        F.avg(F.col("manual_review_any").cast("int")).alias("manual_review_cell_share"),
        n_true(is_mb & highdup & F.col("manual_review_any")).alias("__flagged"), n_true(is_mb & highdup).alias("__any"))
    proxy = F.when(F.col("__flagged") > 0, F.col("__flagged")).otherwise(F.col("__any"))
    sides = union_all([pairs.select(F.col(f"{s}_branch").alias("branch"), "rmse_pair_m", "abs_residual_p95")
                       for s in ("left", "right")])
    cross_stats = sides.groupBy("branch").agg(F.avg("rmse_pair_m").alias("cross_branch_rmse_m_avg"),
                                              F.max("abs_residual_p95").alias("abs_residual_p95_cross_branch_max"))
    own = within.select("branch", F.col("rmse_residual_m_branch").alias("within_branch_rmse_m"),
                        F.col("abs_residual_p95").alias("abs_residual_p95_within_branch"))
    return (base.withColumn("highdup_cell_count", proxy).drop("__flagged", "__any")
            .join(own, "branch", "left").join(cross_stats, "branch", "left"))


SLICE = ["branch", "lat_band_10deg", "depth_bin_lo", "depth_bin_hi"]


def calib_lat_depth(cells: DataFrame, res: DataFrame, cross: DataFrame) -> DataFrame:
    """Residual quantiles by branch, latitude band and depth bin."""
    highdup = (F.col("branch") == "multibeam") & (F.col("duplicate_ratio_cell") > HIGH_DUPLICATE)
    base = with_policy_bins(cells, "median_depth_m").groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("n_cells"), n_true(F.col("n_track_cells") >= 2).alias("n_cells_with_overlap"),
        n_true(highdup).alias("highdup_cell_count_local"),
        F.avg(F.col("manual_review_any").cast("int")).alias("manual_review_share_local"))
    within = digest_agg(with_policy_bins(res, "branch_cell_median_depth_m"), SLICE, [], {
        f"within_branch_residual_p{n}": ("abs_residual_m", n / 100) for n in (50, 95, 99)}, coarse=True)
    sides = _either_side(cross, "abs_residual_m").withColumn("lat_band_10deg", geo.lat_band("lat_center"))
    per_pair = digest_agg(with_policy_bins(sides, "branch_depth_m"), [*SLICE, "pair_label"],
                            [F.count(F.lit(1)).alias("n")], {"p95": ("abs_residual_m", 0.95)}, coarse=True)
    crossed = per_pair.groupBy(*SLICE).agg(F.max("p95").alias("cross_branch_residual_max_p95"),
                                           F.sum("n").alias("cross_branch_n_overlap_total"))
    return base.join(within, SLICE, "left").join(crossed, SLICE, "left")


def _pair_bins(dup: Column, unique: Column) -> dict[str, Column]:
    d, u = bins.duplicate_ratio_bin(dup), bins.unique_count_bin(unique)
    return {"dup_bin_lo": d["lo"], "dup_bin_hi": d["hi"], "n_unique_lo": u["lo"], "n_unique_hi": u["hi"]}


PAIR_SLICE = ["dup_bin_lo", "dup_bin_hi", "n_unique_lo", "n_unique_hi"]


def calib_source_pair(cross: DataFrame) -> DataFrame:
    """Residual quantiles by pair, duplicate-ratio bin and unique-count bin, either side's larger value."""
    rows = cross.withColumns(_pair_bins(F.greatest("left_duplicate_ratio_cell", "right_duplicate_ratio_cell"),
                                        F.greatest("left_n_unique_triples_total", "right_n_unique_triples_total")))
    return digest_agg(rows, ["pair_label", *PAIR_SLICE], [
        F.count(F.lit(1)).alias("n_cells_in_slice"), rmse("residual_m").alias("rmse")], {
        **{f"residual_p{n}": ("residual_m", n / 100) for n in (50, 95, 99)},
        **{f"abs_residual_p{n}": ("abs_residual_m", n / 100) for n in (50, 95, 99)}}, coarse=True)


def sq_error_share(cross: DataFrame, pair: str) -> DataFrame:
    """Share of the squared error of a pair by latitude band (18 bands, so the total is a window over 18 rows)."""
    sq = F.col("residual_m") * F.col("residual_m")
    by_band = cross.where(F.col("pair_label") == pair).groupBy(geo.lat_band("lat_center").alias("lat_band_10deg")).agg(
        F.count(F.lit(1)).alias("n_cells"), rmse("residual_m").alias("rmse"), F.sum(sq).alias("__sq"))
    total = F.sum("__sq").over(Window.partitionBy(F.lit(1)))
    return by_band.withColumn("share_of_squared_error", F.try_divide(F.col("__sq"), total)).drop("__sq")


def consistency_zones(cross: DataFrame, pair: str = PAIRS[0][0]) -> DataFrame:
    """Latitude/depth slices in which a pair agrees within 150 m RMSE."""
    rows = with_policy_bins(cross.where(F.col("pair_label") == pair), "left_median_depth_m").withColumn(
        "lat_band_10deg", geo.lat_band("lat_center"))
    out = digest_agg(rows, ["lat_band_10deg", "depth_bin_lo", "depth_bin_hi"], [
        F.count(F.lit(1)).alias("n_cells"), rmse("residual_m").alias("rmse")], {"abs_residual_p95": ("abs_residual_m", 0.95)}, coarse=True)
    return out.where(F.col("rmse") < CONSISTENT_RMSE_M)


def overlap_strength(cells: DataFrame, branch: str = "singlebeam") -> DataFrame:
    """Distribution of the track count per cell."""
    b = bins.track_count_bin("n_track_cells")
    rows = cells.where(F.col("branch") == branch).withColumns({"n_track_lo": b["lo"], "n_track_hi": b["hi"]})
    out = digest_agg(rows, ["n_track_lo", "n_track_hi"], [F.count(F.lit(1)).alias("n_cells")],
                       {"median_n_unique_triples_total": ("n_unique_triples_total", 0.5)}, coarse=True)
    return out.withColumn("share", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(F.lit(1))))


def highdup_profile(cells: DataFrame, branch: str = "multibeam") -> DataFrame:
    """Where the heavily duplicated cells lie: count, median position, most frequent band (lowest on a tie)."""
    rows = cells.where((F.col("branch") == branch) & (F.col("duplicate_ratio_cell") > HIGH_DUPLICATE))
    stats = digest_agg(rows, ["branch"], [F.count(F.lit(1)).alias("n_cells")], {
        "median_lon_center": ("lon_center", 0.5), "median_lat_center": ("lat_center", 0.5)}, coarse=True)
    band = rows.groupBy("branch", "lat_band_10deg").agg(F.count(F.lit(1)).alias("n")).groupBy("branch").agg(
        F.min_by("lat_band_10deg", F.struct(-F.col("n"), F.col("lat_band_10deg"))).alias("dominant_lat_band_10deg"))
    return stats.join(band, "branch")


# --- rules ---------------------------------------------------------------------------------------------

def within_or_cross_p95() -> Column:
    """The smaller of the two slice values that exist."""
    return F.least("within_branch_residual_p95", "cross_branch_residual_max_p95")


def lookup_lat_depth(cells: DataFrame, calib: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Slice values by branch, band and depth bin.  The slice table has at most 3 x 18 x 6 rows."""
    return cells.join(F.broadcast(calib.select(*SLICE, *fields)), SLICE, "left")


def lookup_source_pair(cells: DataFrame, calib: DataFrame, pair: str, fields: dict[str, str]) -> DataFrame:
    """Slice values of one pair by duplicate and unique-count bin, only for cells that are in the pair.

    The slice table has at most 4 x 5 rows per pair.
    """
    wanted = calib.where(F.col("pair_label") == pair).select(*PAIR_SLICE, *[F.col(c).alias(a) for a, c in fields.items()])
    binned = cells.withColumns(_pair_bins(F.col("duplicate_ratio_cell"), F.col("n_unique_triples_total")))
    out = binned.join(F.broadcast(wanted), PAIR_SLICE, "left").drop(*PAIR_SLICE)
    inside = F.array_contains("in_cross_pair", pair)
    return out.withColumns({a: F.when(inside, F.col(a)) for a in fields})


def with_slices(cells: DataFrame, lat_depth: DataFrame, source_pair: DataFrame) -> DataFrame:
    """Cells with every slice value a rule may name, pre-joined as columns."""
    out = with_policy_bins(cells, "median_depth_m")
    out = lookup_lat_depth(out, lat_depth, ["within_branch_residual_p95", "cross_branch_residual_max_p95"])
    pair = PAIRS[0][0]
    out = lookup_source_pair(out, source_pair, pair, {f"{pair}_p95": "abs_residual_p95", f"{pair}_rmse": "rmse"})
    # the calibration keeps no cross-branch p99 per slice, so a rule that names it sees a missing value
    return out.withColumns({"within_or_cross_p95": within_or_cross_p95(),
                            "cross_branch_residual_p99": F.lit(None).cast("double")})


def _members(text: str, allowed: Sequence[int], closed: bool) -> list[int] | None:
    """Exact members named by `a..b,c`; band ranges are closed, depth ranges half-open."""
    if text.strip() in ("*", ""):
        return None
    spans = [[int(x) for x in part.split("..")] for part in text.split(",")]
    return [v for v in allowed if any(s[0] <= v <= s[-1] if closed or len(s) == 1 else s[0] <= v < s[-1] for s in spans)]


def rule_scope(rule: Rule) -> Column:
    scope = F.lit(True)
    if rule.branch != "*":
        scope = scope & (F.col("branch") == rule.branch)
    for text, column, allowed, closed in ((rule.lat, "lat_band_10deg", LAT_BANDS, True),
                                          (rule.depth, "depth_bin_lo", DEPTH_EDGES, False)):
        members = _members(text, allowed, closed)
        if members is not None:
            scope = scope & F.col(column).isin(members)
    return F.coalesce(scope, F.lit(False))


def rule_condition(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.condition), F.lit(False))


def apply_rules(cells: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """First matching rule by priority, as one `when` chain; unmatched cells take the default."""
    def outcome(rule_id, priority, tier, weight, exclude) -> Column:
        return F.struct(F.lit(rule_id).alias("matched_rule_id"), F.lit(priority).cast("bigint").alias("matched_rule_priority"),
                        F.lit(tier).alias("quality_tier"), F.lit(weight).alias("validation_weight"),
                        F.lit(exclude).alias("exclude_from_primary"))

    chain = F
    for i, r in enumerate(rules, 1):
        chain = chain.when(rule_scope(r) & rule_condition(r), outcome(r.rule_id, i, r.tier, r.weight, r.exclude))
    default = outcome(*DEFAULT_RULE)
    return cells.withColumn("__m", chain.otherwise(default) if rules else default).select("*", "__m.*").drop("__m")


def policy_sidecars(cells: DataFrame) -> DataFrame:
    """Evidence class, role, risk class, use flags and the reason for an exclusion or review."""
    within, cross = F.col("n_track_cells") >= 2, F.col("n_cross_branch_overlap") >= 1
    evidence = F.when(within & cross, "both").when(within, "within").when(cross, "cross").otherwise("none")
    role = F.try_element_at(F.create_map(*[F.lit(x) for kv in BRANCH_ROLE.items() for x in kv]), F.col("branch"))
    out = cells.withColumns({
        "evidence_class": evidence, "branch_role": F.coalesce(role, F.lit("")),
        "highdup_flag": F.col("matched_rule_id") == "mb_v0_highdup_sentry_downweight",
        "sensitivity_only_flag": F.col("quality_tier") == "review_or_sensitivity_only"})
    low, excl, review = F.col("evidence_class") == "none", F.col("exclude_from_primary"), F.col("sensitivity_only_flag")
    regional = F.col("branch_role") == "regional_experiment"
    tier = F.col("quality_tier")
    return out.withColumns({
        "low_evidence_flag": low,
        "source_risk_class": F.when(F.col("highdup_flag"), "highdup_survey")
        .when(F.col("matched_rule_id") == "any_v0_dup_heavy_downweight", "high_dup_unsupported")
        .when(low, "low_evidence").otherwise(""),
        "use_for_primary_validation": ~regional & ~excl & tier.isin("high_confidence", "medium_confidence"),
        "use_for_supplementary_validation": ~excl & tier.isin("high_confidence", "medium_confidence", "low_confidence"),
        "use_for_regional_experiment": regional & (F.col("validation_weight") > 0),
        "exclusion_or_review_reason": F.when(excl & review, F.concat("matched_rule_id", F.lit(":sensitivity_only")))
        .when(excl, F.concat("matched_rule_id", F.lit(":excluded_from_primary")))
        .when(review, F.concat("matched_rule_id", F.lit(":review_only"))).otherwise("")})


def policy_summaries(flags: DataFrame) -> DataFrame:
    """The four policy summaries stacked: by branch and use, by slice, by rule, by evidence."""
    tables = {
        "branch": ["branch", "quality_tier", "branch_role", "use_for_primary_validation",
                   "use_for_supplementary_validation", "use_for_regional_experiment"],
        "lat_depth": ["branch", "lat_band_10deg", "depth_bin_lo", "quality_tier"],
        "rule": ["matched_rule_priority", "matched_rule_id", "quality_tier", "exclude_from_primary"],
        "evidence": ["branch", "evidence_class", "quality_tier"]}
    # the grain of all four tables, counted once; the summaries then add up a few hundred rows
    grain = list(dict.fromkeys(c for cols in tables.values() for c in cols))
    counted = flags.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"), F.sum("validation_weight").alias("w"),
                                        n_true("highdup_flag").alias("d"), n_true("low_evidence_flag").alias("l"))
    parts = []
    for name, cols in tables.items():
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("group_key")
        parts.append(counted.groupBy(key).agg(
            F.sum("n").alias("n_cells"), (F.sum("w") / F.sum("n")).alias("mean_weight"), F.sum("d").alias("n_highdup"),
            F.sum("l").alias("n_low_evidence")).withColumn("summary", F.lit(name)))
    return union_all(parts)


def attach_rule(df: DataFrame, flags: DataFrame, provider: str = "survey") -> DataFrame:
    """Rule id from the sidecar; a constant for the survey provider, a marker where the sidecar has no row."""
    side = distinct_ids(flags, ["branch", *CELL, "matched_rule_id"]).withColumnRenamed("matched_rule_id", "__rule")
    rule = F.when(F.col("source_provider") == provider, F.lit(f"{provider}_legacy")).otherwise(
        F.coalesce("__rule", F.lit("missing_from_quality_sidecar")))
    return df.join(side, ["branch", *CELL], "left").withColumn("matched_rule_id", rule).drop("__rule")
