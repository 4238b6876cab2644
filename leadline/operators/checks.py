"""Data checks as tables: one row per check with a status and the number of offending rows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import n_true
from .cells import CELL
from .products import CORE_COLUMNS, PROVIDERS, SURVEY_PROVIDER, with_membership
from .tables import distinct_ids, union_all

# Weight ceilings and tolerances.
MAX_WEIGHT = {SURVEY_PROVIDER: 1.0, PROVIDERS["multibeam"]: 0.95}
MIN_REGIONAL_EXCLUDED = 0.99
MAX_OVERLAP_DEVIATION = 0.05


def check_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """All checks over one table in a single aggregate; each column counts the offending rows."""
    wide = df.agg(*[F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_bad")) for n in checks])
    return _status(wide.select(F.explode(rows).alias("r")).select("r.*"))


def _status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL"))


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """Rows beyond the first per key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return check_rows(per_key, {name: F.sum(F.col("n") - 1)})


def check_disjoint(a: DataFrame, b: DataFrame, key: Sequence[str], name: str = "disjoint") -> DataFrame:
    shared = distinct_ids(a, key).join(distinct_ids(b, key), list(key), "left_semi")
    return check_rows(shared, {name: F.count(F.lit(1))})


def check_no_regional(products: Mapping[str, DataFrame]) -> DataFrame:
    bad = (F.col("branch") == "regional") | (F.col("source_provider") == PROVIDERS["regional"])
    return union_all([check_rows(df, {f"no_regional_in_{n}": n_true(bad)}) for n, df in products.items()])


def check_cells_b(cells: DataFrame, fc: DataFrame) -> DataFrame:
    """Positive counts, no missing unique counts, known branches only, unique key."""
    return union_all([
        check_unique(cells, ["branch", *CELL], "cells_unique"),
        check_rows(fc, {"positive_points": n_true(~F.coalesce(F.col("n_points_pass") > 0, F.lit(False))),
                        "unique_triples_present": n_true(F.col("n_unique_triples").isNull()),
                        "known_branch": n_true(~F.coalesce(F.col("branch").isin(list(PROVIDERS)), F.lit(False)))})])


def check_counts(counts: DataFrame, expected: DataFrame, key: str = "product_key") -> DataFrame:
    """Row counts against an expectation table (key, expected_rows, tolerance)."""
    out = expected.join(counts, key, "left")
    off = F.abs(F.coalesce("n_rows", F.lit(0)) - F.col("expected_rows"))
    return out.withColumns({"deviation": off, "status": F.when(off <= F.col("tolerance"), "PASS").otherwise("FAIL")})


def check_weights(strict: DataFrame, flags: DataFrame) -> DataFrame:
    """Weight ceilings, zero weights, the excluded share of the regional branch, and flag consistency."""
    over = [n_true((F.col("source_provider") == p) & (F.col("validation_weight") > w)) for p, w in MAX_WEIGHT.items()]
    regional = F.col("branch") == "regional"
    kept, total = n_true(regional & ~F.col("exclude_from_primary")), n_true(regional)
    too_many_kept = F.when(kept > total * F.lit(1 - MIN_REGIONAL_EXCLUDED), kept).otherwise(0)
    highdup = F.col("matched_rule_id") == "mb_v0_highdup_sentry_downweight"
    wrong = highdup & ~(F.col("highdup_flag") & (F.col("source_risk_class") == "highdup_survey"))
    return check_rows(strict, {f"weight_ceiling_{p}": c for p, c in zip(MAX_WEIGHT, over)}).unionByName(
        check_rows(flags, {"zero_weight": n_true(F.col("validation_weight") == 0),
                           "regional_excluded_share": too_many_kept, "highdup_sidecar": n_true(wrong)}))


def check_review_invariant(flags: DataFrame, reflagged: DataFrame) -> DataFrame:
    """A review flag alone changes nothing: outcomes must agree with outcomes computed without the flag."""
    side = reflagged.select("branch", *CELL, F.col("matched_rule_id").alias("__rule"))
    both = flags.join(side, ["branch", *CELL], "left")
    return check_rows(both, {"manual_review_not_exclusion": n_true(
        ~F.coalesce(F.col("matched_rule_id") == F.col("__rule"), F.lit(False)))})


def preflight(products: Mapping[str, DataFrame], roles: Mapping[str, str], known_products: DataFrame | None = None,
              configured: Sequence[str] = ()) -> DataFrame:
    """Schema, depth sign and role separation of every product; configured grids must have pixels."""
    parts = []
    for name, df in products.items():
        missing = [c for c in CORE_COLUMNS if c not in df.columns]
        d = F.col("representative_depth_m")
        role = F.coalesce(F.col("branch_role") == roles[name], F.lit(False)) if name in roles else F.lit(True)
        parts.append(check_rows(df, {
            f"{name}_schema": F.max(F.lit(len(missing))), f"{name}_null_depth": n_true(d.isNull()),
            f"{name}_nonpositive_depth": n_true(d <= 0), f"{name}_role": n_true(~role)}))
    if known_products is not None:
        names = known_products.select("product_name").distinct()
        parts.append(check_rows(names, {f"grid_{c}": F.when(n_true(F.col("product_name") == c) > 0, 0).otherwise(1)
                                        for c in configured}))
    return union_all(parts)


def safety_table(cells: DataFrame, diag: DataFrame, status: DataFrame, expanded: bool = False) -> DataFrame:
    """Full-run safety: weights, tiers and rules kept, sources where they belong, no sign error, no failed product."""
    sb, regional = F.col("source_provider") == PROVIDERS["singlebeam"], F.col("branch") == "regional"
    checks = {"no_regional": n_true(regional), "validation_weight_preserved": n_true(F.col("validation_weight").isNull())}
    checks |= {f"{c}_preserved": n_true(F.col(c).isNull()) for c in ("quality_tier", "evidence_class", "matched_rule_id")}
    if expanded:
        checks["singlebeam_only_as_fill"] = n_true(sb != F.coalesce(F.col("expanded_fill"), F.lit(False)))
    else:
        checks["no_singlebeam"] = n_true(sb)
    return union_all([check_rows(cells, checks), check_rows(diag, {"sign_error_suspected": n_true("sign_error_suspected")}),
                      check_rows(status, {"product_errors": n_true(F.col("status") == "error")})])


def check_membership(expanded: DataFrame, strict: DataFrame) -> DataFrame:
    """Gap-fill cells are marked and singlebeam, retained cells are neither."""
    rows = with_membership(expanded, strict)
    gap, kept = F.col("is_singlebeam_gapfill"), F.col("is_retained_multibeam")
    fill, sb = F.coalesce(F.col("expanded_fill"), F.lit(False)), F.col("source_provider") == PROVIDERS["singlebeam"]
    return check_rows(rows, {"gapfill_not_marked": n_true(gap & ~fill), "retained_marked": n_true(kept & fill),
                             "gapfill_not_singlebeam": n_true(gap & ~sb), "retained_singlebeam": n_true(kept & sb)})


def check_residual_formula(res: DataFrame, left: str, right: str) -> DataFrame:
    """The stored residual is exactly left minus right on every row."""
    return check_rows(res, {"residual_formula": n_true(F.col("residual_m") != F.col(left) - F.col(right))})


def check_median(cells: DataFrame, recomputed: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    side = recomputed.select(*keys, F.col(column).alias("__again"))
    both = cells.select(*keys, column).join(side, list(keys), "full_outer")
    return check_rows(both, {"median_recheck": n_true(~F.col(column).eqNullSafe(F.col("__again")))})


def check_split(df: DataFrame, block: str = "block_id", split: str = "split") -> DataFrame:
    """Every row is assigned, and no block appears in two splits."""
    blocks = df.groupBy(block).agg((F.min(split) != F.max(split)).alias("leaks"))
    return check_rows(blocks, {"block_leakage": n_true("leaks")}).unionByName(
        check_rows(df, {"unassigned_rows": n_true(F.col(split).isNull() | ~F.col(split).isin("train", "val", "test"))}))


def check_overlap_deviation(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected overlap per pair; more than 5 % off is marked."""
    dev = F.try_divide(F.col("n_overlap_cells") - F.col("expected_overlap"), F.col("expected_overlap"))
    return expected.join(pairs.select("pair_label", "n_overlap_cells"), "pair_label", "left").withColumns({
        "deviation_pct": dev * 100.0, "gt_5pct_deviation": F.coalesce(F.abs(dev) > MAX_OVERLAP_DEVIATION, F.lit(True))})
