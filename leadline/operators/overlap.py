"""Agreement between overlapping files, cruises and branches."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins, geo
from ..functions.stats import n_true, rmse, std_or_zero
from ..session import cut_lineage
from .cells import CELL, FALLBACK_REVIEW_REASON
from .groups import digest_agg, null_safe_join, ranked, value_slice
from .tables import keep_ids, union_all

# Diagnostic limits, action limits and branch pairs.
SUSPICIOUS = {"min_overlap": 50, "median": 20.0, "mad": 20.0, "rmse": 50.0, "abs_p95": 100.0,
              "cell_range": 100.0, "cell_iqr": 50.0, "cell_max_abs": 100.0}
EXCLUDE_MIN_OVERLAP, EXCLUDE_MEDIAN_M, REVIEW_MEDIAN_M, HIGH_VARIANCE_RMSE_M = 50, 500.0, 50.0, 500.0
LARGE_SHIFT_M = 50.0
SHIFT_LIMITS = [10, 50, 100, 500, 1000]
BRANCHES = ["singlebeam", "multibeam", "regional"]
PAIRS = [("mb_vs_regional", "multibeam", "regional"), ("mb_vs_sb", "multibeam", "singlebeam"),
         ("regional_vs_sb", "regional", "singlebeam")]
TEN_QUANTILES = {f"residual_p{n:02d}": ("residual_m", n / 100) for n in (1, 5, 25, 50, 75, 95, 99)} | {
    f"abs_residual_p{n}": ("__abs", n / 100) for n in (50, 95, 99)}
ABS_RESIDUAL = {"__abs": "residual_m"}


# --- source A: file-cells against cells ----------------------------------------------------------------

def residuals_a(fc: DataFrame, cells: DataFrame) -> DataFrame:
    """File-cell minus cell median, for cells with at least two file-cells."""
    ref = cells.where("n_file_cells > 1").select(
        *CELL, "median_depth_file_balanced", "median_elev_file_balanced",
        F.col("n_file_cells").alias("cell_n_file_cells"), F.col("n_cruises_guess").alias("cell_n_cruises"))
    return fc.join(ref, CELL).withColumns({
        "is_multi_cruise": F.col("cell_n_cruises") > 1,
        "residual_depth_m": F.col("median_depth_m_positive_down") - F.col("median_depth_file_balanced"),
        "residual_elev_m": F.col("median_elev_m") - F.col("median_elev_file_balanced")})


def bias_by(res: DataFrame, key: str) -> DataFrame:
    """Bias statistics of the residuals by file, cruise or archive."""
    x = "residual_depth_m"
    rows = res.where(F.col(key).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_overlap_file_cells"), F.count_distinct("cruise_id").alias("n_overlap_cruises"),
            F.sum("n_points").alias("n_points_total_overlap"), F.avg(x).alias(f"{x}_mean"),
            std_or_zero(x).alias(f"{x}_std"), rmse(x).alias(f"{x}_rmse"), F.max(F.abs(x)).alias(f"max_abs_{x}")]
    out = digest_agg(rows, [key], aggs, {
        f"{x}_median": (x, 0.5), "__q25": (x, 0.25), "__q75": (x, 0.75), f"{x}_p05": (x, 0.05), f"{x}_p95": (x, 0.95),
        f"abs_{x}_median": ("__abs", 0.5), f"abs_{x}_p95": ("__abs", 0.95)}, mads={f"{x}_mad": x}, absolute={"__abs": x}, coarse=True)
    return out.withColumn(f"{x}_iqr", F.col("__q75") - F.col("__q25")).drop("__q25", "__q75")


def cell_disagreement(res: DataFrame) -> DataFrame:
    x = F.col("residual_depth_m")
    aggs = [F.count(F.lit(1)).alias("n_file_cells"), F.count_distinct("cruise_id").alias("n_cruises_guess"),
            (F.max(x) - F.min(x)).alias("residual_depth_range"), std_or_zero(x).alias("residual_depth_std"),
            F.max(F.abs(x)).alias("max_abs_file_residual_depth")]
    out = digest_agg(res, CELL, aggs, {"__q25": ("residual_depth_m", 0.25), "__q75": ("residual_depth_m", 0.75)})
    out = out.withColumn("residual_depth_iqr", F.col("__q75") - F.col("__q25")).drop("__q25", "__q75")
    return out.withColumn("has_large_disagreement", _large_disagreement())


def _large_disagreement() -> Column:
    return ((F.col("residual_depth_range") >= SUSPICIOUS["cell_range"])
            | (F.col("residual_depth_iqr") >= SUSPICIOUS["cell_iqr"])
            | (F.col("max_abs_file_residual_depth") >= SUSPICIOUS["cell_max_abs"]))


def flag_suspicious(bias: DataFrame) -> DataFrame:
    """Files or cruises with enough overlap and any diagnostic limit reached."""
    x = "residual_depth_m"
    any_limit = ((F.abs(F.col(f"{x}_median")) >= SUSPICIOUS["median"]) | (F.col(f"{x}_mad") >= SUSPICIOUS["mad"])
                 | (F.col(f"{x}_rmse") >= SUSPICIOUS["rmse"]) | (F.col(f"abs_{x}_p95") >= SUSPICIOUS["abs_p95"]))
    return bias.where((F.col("n_overlap_file_cells") >= SUSPICIOUS["min_overlap"]) & any_limit)


def flag_suspicious_cells(stats: DataFrame) -> DataFrame:
    return stats.where((F.col("n_file_cells") > 1) & _large_disagreement())


def select_candidates(bias: DataFrame, key: str, n: int, pinned: Sequence[str] = ()) -> DataFrame:
    """Ids with the n largest |median| or the n largest RMSE, plus the pinned ids that occur."""
    by_median = bias.orderBy(F.abs(F.col("residual_depth_m_median")).desc(), key).limit(n)
    by_rmse = bias.orderBy(F.col("residual_depth_m_rmse").desc(), key).limit(n)
    parts = [by_median.select(key), by_rmse.select(key)]
    if pinned:
        parts.append(bias.where(F.col(key).isin(list(pinned))).select(key))
    return union_all(parts).distinct()


#: Parts of the rows of one cell that have equal values.
TIE_PARTS = 64


def leave_out_medians(fc: DataFrame, groups: Mapping[str, str], value: str) -> dict[str, DataFrame]:
    """For each {group: out}: the median of `value` over the other groups of the same cell, one row per cell and group.

    No pairs and no per-cell lists.  With r the rank of a row in its cell and i its rank inside the own
    group, r - i rows of other groups come before it; the k-th row of the others therefore has the rank
    k + #(own rows with r - i <= k), and is fetched by one join on (cell, rank).  The rank in the cell does not depend on the
    grouping and is computed once.  Equal values are ordered by a hash of the file and cut by it, so a flat cell splits too.
    """
    parts = F.struct(F.col(value), F.pmod(F.xxhash64("file_id"), F.lit(TIE_PARTS)))
    cut = value_slice(F.col(value))
    rows = fc.where(F.col(value).isNotNull()).select(*dict.fromkeys([*CELL, *groups, "file_id", value]))
    in_cell = cut_lineage(ranked(rows, CELL, [parts, F.col("file_id")], cut, "__r", total="__n", part_by=parts), "ranked-in-cell")
    return {group: _leave_out(in_cell, group, value, out, cut, parts) for group, out in groups.items()}


def _leave_out(in_cell: DataFrame, group: str, value: str, out: str, cut: Column, parts: Column) -> DataFrame:
    both = ranked(in_cell, [*CELL, group], [F.col("__r")], cut, "__i", total="__m", part_by=parts)
    rest, ahead = F.col("__n") - F.col("__m"), F.col("__r") - F.col("__i")
    places = [F.floor((rest - 1) / 2), F.floor(rest / 2)]
    ranks = both.where(rest > 0).groupBy(*CELL, group).agg(*[(F.max(k) + n_true(ahead <= k)).alias(f"__t{j}") for j, k in enumerate(places)])
    wanted = ranks.select(*CELL, group, F.explode(F.array("__t0", "__t1")).alias("__r"))
    values = in_cell.select(*CELL, "__r", F.col(value).alias("__v"))
    return null_safe_join(wanted, values, [*CELL, "__r"]).groupBy(*CELL, group).agg(F.avg("__v").alias(out))


def residuals_three(fc: DataFrame, cells: DataFrame) -> DataFrame:
    """Residuals of every file-cell to the cell, to the other cruises and to the other files."""
    m = "median_depth_m_positive_down"
    ref = cells.select(*CELL, "median_depth_file_balanced", F.col("n_file_cells").alias("cell_n_file_cells"),
                       F.col("n_cruises_guess").alias("cell_n_cruises"))
    out = fc.join(ref, CELL, "left")
    others = leave_out_medians(fc, {"cruise_id": "__other_cruise", "file_id": "__other_file"}, m)
    for group, found in others.items():
        out = null_safe_join(out, found, [*CELL, group], "left")
    return out.withColumns({
        "residual_to_all_cell_median": F.col(m) - F.col("median_depth_file_balanced"),
        "residual_to_other_cruise_median": F.col(m) - F.col("__other_cruise"),
        "residual_to_other_file_median": F.col(m) - F.col("__other_file")}).drop("__other_cruise", "__other_file")


def audit_by(res: DataFrame, key: str) -> DataFrame:
    """Totals, overlap counts, three residual statistics, extent and depth range per file or cruise."""
    sets = {"residual_all": "residual_to_all_cell_median", "residual_other_cruise": "residual_to_other_cruise_median",
            "residual_other_file": "residual_to_other_file_median"}
    rows = res.where(F.col(key).isNotNull())
    overlap_cell = F.when(F.col("cell_n_file_cells") > 1, F.struct(*CELL))
    aggs = [F.count(F.lit(1)).alias("n_total_file_cells"), F.count_distinct(overlap_cell).alias("n_overlap_file_cells"),
            F.count("residual_to_other_cruise_median").alias("n_other_cruise_overlap_cells"),
            F.count("residual_to_other_file_median").alias("n_other_file_overlap_cells"),
            F.sum("n_points").alias("n_points_total"),
            F.min("lon_center").alias("lon_min"), F.max("lon_center").alias("lon_max"),
            F.min("lat_center").alias("lat_min"), F.max("lat_center").alias("lat_max"),
            F.min("median_depth_m_positive_down").alias("depth_min"),
            F.max("median_depth_m_positive_down").alias("depth_max"),
            *[rmse(c).alias(f"{p}_rmse") for p, c in sets.items()]]
    wanted = {f"{p}_{s}": (c, q) for p, c in sets.items() for s, q in (("median", 0.5), ("p05", 0.05), ("p95", 0.95))}
    out = digest_agg(rows, [key], aggs, wanted, mads={f"{p}_mad": c for p, c in sets.items()}, coarse=True)
    return out.withColumn("n_single_source_cells", F.col("n_total_file_cells") - F.col("n_overlap_file_cells"))


def recommend(audit: DataFrame, key: str, kind: str, use_other_file: Sequence[str] = (),
              always_judged: Sequence[str] = ()) -> DataFrame:
    """Recommended action, and which statistic decided (its value is a column of the audit).

    `use_other_file` lists files judged by the other-file median first; `always_judged` lists cruises that
    need no minimum overlap.
    """
    n, med = F.col("n_other_cruise_overlap_cells"), F.col("residual_other_cruise_median")
    spread, file_med = F.col("residual_other_cruise_rmse"), F.abs(F.col("residual_other_file_median"))
    size, ident = F.abs(med), F.col(key)
    enough = n >= EXCLUDE_MIN_OVERLAP
    special = ident.isin(list(use_other_file)) & file_med.isNotNull()
    always = ident.isin(list(always_judged))
    rules = [       # condition, action, what decided
        (special & (file_med >= EXCLUDE_MEDIAN_M), "exclude_candidate", "other_file_median"),
        (special & (file_med >= REVIEW_MEDIAN_M), "review_candidate", "other_file_median"),
        (med.isNull(), "keep", "no_overlap"),
        (always & (size > EXCLUDE_MEDIAN_M), "exclude_candidate", "listed_cruise_median"),
        (enough & (size >= EXCLUDE_MEDIAN_M), "exclude_candidate", "other_cruise_median"),
        (enough & (size >= REVIEW_MEDIAN_M), "review_candidate", "other_cruise_median"),
        ((size < REVIEW_MEDIAN_M) & (spread >= HIGH_VARIANCE_RMSE_M), "high_variance_review", "other_cruise_rmse"),
    ]
    action, reason = F, F
    for cond, label, why in rules:
        action, reason = action.when(cond, F.lit(label)), reason.when(cond, F.lit(why))
    return audit.withColumns({
        "candidate_type": F.lit(kind), "candidate_id": ident, "recommended_action": action.otherwise("keep"),
        "action_reason": reason.otherwise("within_limits")})


def removal_impact(fc: DataFrame, cells: DataFrame, actions: DataFrame, key: str, kind: str) -> DataFrame:
    """What removing an exclude or review candidate would cost in cells."""
    chosen = actions.where((F.col("candidate_type") == kind)
                           & F.col("recommended_action").isin("exclude_candidate", "review_candidate"))
    rows = keep_ids(fc, chosen.select(F.col("candidate_id").alias(key)), key)
    per_cell = rows.groupBy(F.col(key).alias("candidate_id"), *CELL).agg(F.sum("n_points").alias("__pts"))
    info = cells.select(*CELL, "n_file_cells", "n_cruises_guess")
    lost = F.col("n_file_cells") == 1 if kind == "file" else F.col("n_cruises_guess") <= 1
    out = per_cell.join(info, CELL, "left").groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_cells_total"), n_true(F.col("n_file_cells") > 1).alias("n_cells_overlap"),
        n_true(F.col("n_file_cells") == 1).alias("n_cells_single_source"),
        n_true(F.col("n_cruises_guess") > 1).alias("n_cells_multi_cruise"), F.sum("__pts").alias("n_points_total"),
        n_true(lost).alias("n_cells_lost_all_coverage"))
    return out.withColumns({"candidate_type": F.lit(kind),
                            "n_cells_retained_coverage": F.col("n_cells_total") - F.col("n_cells_lost_all_coverage")})


# --- before and after filtering -----------------------------------------------------------------------

def compare_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer comparison of two cell tables: presence and depth shift."""
    left = a.select(*CELL, F.col("median_depth_file_balanced").alias("depth_orig"), "n_points_total", "n_file_cells",
                    "dominant_cruise_id", "lon_center", "lat_center", F.lit(True).alias("__a"))
    right = b.select(*CELL, F.col("median_depth_file_balanced").alias("depth_filtered"),
                     "had_excluded_source_in_original", F.lit(True).alias("__b"))
    presence = (F.when(F.col("__a") & F.col("__b"), "common").when(F.col("__a"), "lost").otherwise("new"))
    shift = F.col("depth_filtered") - F.col("depth_orig")
    return left.join(right, CELL, "full_outer").withColumns({
        "presence": presence, "depth_shift_m": shift, "abs_shift_m": F.abs(shift)}).drop("__a", "__b")


def shift_stats(cmp: DataFrame) -> DataFrame:
    x, rows = "depth_shift_m", cmp.where("presence = 'common'").withColumn("presence", F.lit("common"))
    aggs = [F.count(F.lit(1)).alias("n_common"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"),
            rmse(x).alias("rmse"), *[n_true(F.col("abs_shift_m") > t).alias(f"n_gt_{t}m") for t in SHIFT_LIMITS]]
    return digest_agg(rows, ["presence"], aggs, {f"p{int(q * 100):02d}": (x, q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)}, mads={"mad": x}, coarse=True)


def large_shifts(cmp: DataFrame, limit: float = LARGE_SHIFT_M) -> DataFrame:
    return cmp.where((F.col("presence") == "common") & (F.col("abs_shift_m") > limit))


def lost_cells(cmp: DataFrame) -> DataFrame:
    return cmp.where("presence = 'lost'")


def shift_extent(cmp: DataFrame, limit: float = LARGE_SHIFT_M) -> DataFrame:
    """Bounding boxes of the large positive and of the large negative shifts."""
    side = F.when(F.col("depth_shift_m") > 0, "positive").otherwise("negative").alias("direction")
    return large_shifts(cmp, limit).groupBy(side).agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("lon_center").alias("lon_min"), F.max("lon_center").alias("lon_max"),
        F.min("lat_center").alias("lat_min"), F.max("lat_center").alias("lat_max"))


# --- source B: within and across branches ---------------------------------------------------------------

def residuals_b(fc: DataFrame, cells: DataFrame) -> DataFrame:
    """Track-cell minus branch-cell median, for cells that at least two tracks share."""
    ref = cells.where("n_track_cells >= 2").select(
        "branch", *CELL, F.col("median_depth_m").alias("branch_cell_median_depth_m"),
        F.col("n_track_cells").alias("branch_cell_n_track_cells"),
        F.col("duplicate_ratio_cell").alias("branch_cell_duplicate_ratio_cell"),
        F.col("manual_review_any").alias("branch_cell_manual_review_any"), "lat_band_10deg")
    out = fc.withColumnRenamed("median_depth_m", "track_cell_median_depth_m").join(ref, ["branch", *CELL])
    residual = F.col("track_cell_median_depth_m") - F.col("branch_cell_median_depth_m")
    return out.withColumns({"residual_m": residual, "abs_residual_m": F.abs(residual)})


def track_residuals(res: DataFrame) -> DataFrame:
    keys = ["branch", "track_id", "source_type", "source_completeness", "instrument_class_pred"]
    x = "residual_m"
    aggs = [F.bool_or("manual_review_flag").alias("manual_review_flag"),
            F.count_distinct(F.struct(*CELL)).alias("n_overlap_cells"),
            F.sum("n_unique_triples").alias("n_unique_triples_total"), F.avg(x).alias("mean_residual_m"),
            rmse(x).alias("rmse_residual_m"), F.max("abs_residual_m").alias("max_abs_residual_m"),
            (F.lit(1.0) - F.sum("n_unique_triples") / F.sum("n_points_pass")).alias("duplicate_ratio_summary"),
            F.avg(F.col("branch_cell_manual_review_any").cast("int")).alias("manual_review_cell_share")]
    out = digest_agg(res, keys, aggs, {"median_residual_m": (x, 0.5), "__q25": (x, 0.25), "__q75": (x, 0.75),
                                         "p95_abs_residual_m": ("__abs", 0.95)}, mads={"mad_residual_m": x}, absolute={"__abs": x}, coarse=True)
    return out.withColumns({
        "iqr_residual_m": F.col("__q75") - F.col("__q25"),
        "manual_review_reasons": F.when(F.col("manual_review_flag"), FALLBACK_REVIEW_REASON).otherwise("")}).drop("__q25", "__q75")


def branch_residuals(res: DataFrame, cells: DataFrame) -> DataFrame:
    totals = cells.groupBy("branch").agg(F.count(F.lit(1)).alias("n_branch_cells_total"),
                                         n_true(F.col("n_track_cells") >= 2).alias("n_overlap_cells"))
    stats = digest_agg(res, ["branch"], [F.count(F.lit(1)).alias("n_overlap_track_cell_rows"),
                                           rmse("residual_m").alias("rmse_residual_m_branch")], TEN_QUANTILES, absolute=ABS_RESIDUAL, coarse=True)
    out = totals.join(stats, "branch", "left")
    return out.withColumns({"n_overlap_track_cell_rows": F.coalesce("n_overlap_track_cell_rows", F.lit(0).cast("bigint")),
                            "overlap_share": F.try_divide("n_overlap_cells", "n_branch_cells_total")})


CROSS_COLUMNS = ["median_depth_m", "n_track_cells", "n_tracks", "n_unique_triples_total", "duplicate_ratio_cell",
                 "manual_review_any", "iqr_of_track_medians", "lat_band_10deg"]


def residuals_cross(cells: DataFrame, label: str, left: str, right: str) -> DataFrame:
    """Cells that two branches share, one-to-one; the residual is left minus right."""
    def side(branch: str, prefix: str) -> DataFrame:
        return cells.where(F.col("branch") == branch).select(
            *CELL, *[F.col(c).alias(f"{prefix}_{c}") for c in CROSS_COLUMNS])

    out = side(left, "left").join(side(right, "right"), CELL)
    residual = F.col("left_median_depth_m") - F.col("right_median_depth_m")
    return geo.with_cell_geometry(out).withColumns({
        "pair_label": F.lit(label), "left_branch": F.lit(left), "right_branch": F.lit(right),
        "residual_m": residual, "abs_residual_m": F.abs(residual)})


def all_pairs(cells: DataFrame) -> DataFrame:
    return union_all([residuals_cross(cells, *p) for p in PAIRS])


def pair_residuals(cross: DataFrame, cells: DataFrame) -> DataFrame:
    both = F.col("left_manual_review_any") & F.col("right_manual_review_any")
    either = F.col("left_manual_review_any") | F.col("right_manual_review_any")
    stats = digest_agg(cross, ["pair_label", "left_branch", "right_branch"], [
        F.count(F.lit(1)).alias("n_overlap_cells"), rmse("residual_m").alias("rmse_pair_m"),
        n_true(both).alias("n_overlap_both_flagged"), n_true(either).alias("n_overlap_either_flagged")],
        TEN_QUANTILES, absolute=ABS_RESIDUAL, coarse=True)
    totals = cells.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    for side in ("left", "right"):
        stats = stats.join(totals.withColumnsRenamed({"branch": f"{side}_branch", "n": f"n_{side}_cells_total"}),
                           f"{side}_branch", "left")
    return stats.withColumns({f"overlap_share_of_{s}": F.try_divide("n_overlap_cells", f"n_{s}_cells_total")
                              for s in ("left", "right")})


def breakdowns(rows: DataFrame, key: str, columns: Mapping[str, str], fixed: Mapping[str, Sequence[str]],
               groups: Sequence[str]) -> DataFrame:
    """Residual distribution by several breakdowns at once; fixed labels appear even when empty."""
    pairs = F.array(*[F.struct(F.lit(k).alias("breakdown_type"), F.col(c).cast("string").alias("group_value"))
                      for k, c in columns.items()])
    long = rows.select(key, "residual_m", F.explode(pairs).alias("s")).select(key, "residual_m", "s.*")
    keys = [key, "breakdown_type", "group_value"]
    stats = digest_agg(long, keys, [F.count(F.lit(1)).alias("n_overlap_rows"), rmse("residual_m").alias("rmse")], {
        "residual_p50": ("residual_m", 0.5), "abs_residual_p50": ("__abs", 0.5),
        "abs_residual_p95": ("__abs", 0.95), "abs_residual_p99": ("__abs", 0.99)}, absolute=ABS_RESIDUAL, coarse=True)
    # label rows: every group x fixed label, a short literal list expanded from one row per group
    labels = F.array(*[F.struct(F.lit(k).alias("breakdown_type"), F.lit(v).alias("group_value"))
                       for k, vs in fixed.items() for v in vs])
    listed = F.explode(F.array(*[F.lit(g) for g in groups])).alias(key)
    frame = rows.sparkSession.range(1).select(listed).select(key, F.explode(labels).alias("s")).select(key, "s.*")
    out = stats.join(frame, keys, "full_outer")
    return out.withColumn("n_overlap_rows", F.coalesce("n_overlap_rows", F.lit(0).cast("bigint")))


def breakdowns_within(res: DataFrame) -> DataFrame:
    rows = res.withColumn("__dup", bins.duplicate_ratio_label("branch_cell_duplicate_ratio_cell"))
    return breakdowns(rows, "branch", {
        "manual_review_flag": "manual_review_flag", "source_type": "source_type", "duplicate_ratio_cell_bin": "__dup"},
        {"manual_review_flag": ["false", "true"], "duplicate_ratio_cell_bin": bins.DUPLICATE_RATIO_LABELS}, BRANCHES)


def breakdowns_cross(cross: DataFrame) -> DataFrame:
    rows = cross.withColumns({
        "__review": F.col("left_manual_review_any") | F.col("right_manual_review_any"),
        "__dup": bins.duplicate_ratio_label(F.greatest("left_duplicate_ratio_cell", "right_duplicate_ratio_cell"))})
    return breakdowns(rows, "pair_label", {
        "manual_review_either": "__review", "dup_ratio_either_bin": "__dup", "lat_band_10deg": "left_lat_band_10deg"},
        {"manual_review_either": ["false", "true"], "dup_ratio_either_bin": bins.DUPLICATE_RATIO_LABELS},
        [p[0] for p in PAIRS])
