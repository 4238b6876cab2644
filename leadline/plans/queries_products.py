"""Queries over the validation products: construction, profiles, comparison, checks."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bins
from ..operators import cells as C
from ..operators import checks as K
from ..operators import policy as Q
from ..operators import products as PR
from ..operators import tables as TB
from ..operators.groups import head_per_group
from ..session import fresh_path
from . import oracle_grids as G
from . import oracle_shared as S
from .fixtures import GRID_CONFIG
from .registry import query
from .stages import Products

ROW = ("cell_id lat_bin lon_bin lat_band_10deg source_provider branch branch_role quality_tier evidence_class highdup_flag source_risk_class "
       "n_unique_triples_total n_points_pass_total n_track_cells n_tracks manual_review_any low_evidence_flag n_cross_branch_overlap "
       "sensitivity_only_flag matched_rule_id final_primary_source precedence_resolution")
VAL = "lon_center lat_center representative_depth_m validation_weight duplicate_ratio_cell"

for _name, _extra in (("strict", ""), ("expanded", " expanded_fill"), ("supplementary", ""), ("regional", "")):
    def _build(spark, d, name=_name):
        return Products.of(spark, d).tables[name]
    query(f"product_{_name}", ROW + _extra, VAL, f"{_name}_p")(_build)


@query("product_catalog", ROW + " product_label product_membership", VAL, "catalog_p")
def _(spark, d):
    return PR.build_catalog(Products.of(spark, d).tables_t)


@query("catalog_summary", "product_label catalog_rows unique_cell_ids duplicate_product_cell_rows final_primary_source_values", "", """
SELECT product_label, count(*) AS catalog_rows, count(DISTINCT cell_id) AS unique_cell_ids, count(*) - count(DISTINCT cell_id) AS duplicate_product_cell_rows,
  string_agg(DISTINCT coalesce(final_primary_source, ''), ',' ORDER BY coalesce(final_primary_source, '')) AS final_primary_source_values
FROM catalog_p GROUP BY product_label""")
def _(spark, d):
    return PR.catalog_summary(PR.build_catalog(Products.of(spark, d).tables_t))


@query("rules_attached", "cell_id source_provider matched_rule_id", "", """
SELECT cell_id, source_provider, matched_rule_id FROM expanded_p""")
def _(spark, d):
    p = Products.of(spark, d)
    return Q.attach_rule(p.tables_t["expanded"].drop("matched_rule_id"), p.tracks.flagged_t)


_COUNTS = ["high_confidence", "medium_confidence", "low_confidence", "review_or_sensitivity_only"]
_PROFILE = ", ".join(f"count(*) FILTER (WHERE quality_tier = '{t}') AS {t}_cells" for t in _COUNTS)


@query("non_primary_profile", "product_key n_rows n_cell_ids duplicate_cell_rows " + " ".join(f"{t}_cells" for t in _COUNTS)
       + " evidence_none_cells low_evidence_flag_cells manual_review_cells sensitivity_only_cells n_highdup cells_with_cross_branch_overlap n_lat_bands "
         "n_depth_bins n_regions_10deg", "min_depth_m median_depth_m max_depth_m min_weight median_weight max_weight median_duplicate_ratio", f"""
SELECT product_key, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cell_ids, count(*) - count(DISTINCT cell_id) AS duplicate_cell_rows, {_PROFILE},
  count(*) FILTER (WHERE evidence_class = 'none') AS evidence_none_cells, count(*) FILTER (WHERE low_evidence_flag) AS low_evidence_flag_cells,
  count(*) FILTER (WHERE manual_review_any) AS manual_review_cells, count(*) FILTER (WHERE sensitivity_only_flag) AS sensitivity_only_cells,
  count(*) FILTER (WHERE highdup_flag) AS n_highdup, count(*) FILTER (WHERE has_cross_branch_overlap) AS cells_with_cross_branch_overlap,
  count(DISTINCT lat_band_10deg) AS n_lat_bands, count(DISTINCT depth_bin_label) AS n_depth_bins, count(DISTINCT region_10deg) AS n_regions_10deg,
  min(representative_depth_m) AS min_depth_m, median(representative_depth_m) AS median_depth_m, max(representative_depth_m) AS max_depth_m,
  min(validation_weight) AS min_weight, median(validation_weight) AS median_weight, max(validation_weight) AS max_weight, median(duplicate_ratio_cell) AS median_duplicate_ratio
FROM labelled_np GROUP BY product_key""")
def _(spark, d):
    p = Products.of(spark, d)
    return PR.profile(p.keyed("supplementary", "regional"))


_PS = " UNION ALL ".join(f"SELECT *, '{c}' AS stratification, CAST({c} AS VARCHAR) AS stratum FROM labelled_np" for c in PR.PROFILE_STRATA)


@query("non_primary_strata", "product_key stratification stratum cells low_evidence_cells manual_review_cells sensitivity_only_cells "
       "cross_branch_overlap_cells", "median_depth_m median_weight", f"""
SELECT product_key, stratification, stratum, count(*) AS cells, count(*) FILTER (WHERE low_evidence_flag) AS low_evidence_cells,
  count(*) FILTER (WHERE manual_review_any) AS manual_review_cells, count(*) FILTER (WHERE sensitivity_only_flag) AS sensitivity_only_cells,
  count(*) FILTER (WHERE has_cross_branch_overlap) AS cross_branch_overlap_cells, median(representative_depth_m) AS median_depth_m, median(validation_weight) AS median_weight
FROM ({_PS}) GROUP BY product_key, stratification, stratum""")
def _(spark, d):
    p = Products.of(spark, d)
    return PR.profile_strata(p.keyed("supplementary", "regional"))


@query("top_regions", "product_key stratum cells", "", """
SELECT product_key, stratum, cells FROM (SELECT product_key, region_10deg AS stratum, count(*) AS cells,
  row_number() OVER (PARTITION BY product_key ORDER BY count(*) DESC, region_10deg) AS rn FROM labelled_np GROUP BY 1, 2) WHERE rn <= 15""")
def _(spark, d):
    p = Products.of(spark, d)
    strata = PR.profile_strata(p.keyed("supplementary", "regional")).where("stratification = 'region_10deg'")
    return head_per_group(strata, ["product_key"], [F.col("cells").desc(), F.col("stratum")], 15)


_OS = "SELECT *, 'overall' AS stratification, 'all' AS stratum FROM labelled_np UNION ALL " + " UNION ALL ".join(
    f"SELECT *, '{c}' AS stratification, CAST({c} AS VARCHAR) AS stratum FROM labelled_np" for c in PR.OVERLAP_STRATA)


@query("primary_overlap_profile", "product_key stratification stratum non_primary_cells strict_primary_overlap_cells expanded_primary_overlap_cells "
       "outside_expanded_primary_cells", "strict_primary_overlap_fraction expanded_primary_overlap_fraction", f"""
SELECT product_key, stratification, stratum, count(*) AS non_primary_cells, count(*) FILTER (WHERE in_s) AS strict_primary_overlap_cells,
  count(*) FILTER (WHERE in_e) AS expanded_primary_overlap_cells, count(*) FILTER (WHERE NOT in_e) AS outside_expanded_primary_cells,
  count(*) FILTER (WHERE in_s) / count(*) AS strict_primary_overlap_fraction, count(*) FILTER (WHERE in_e) / count(*) AS expanded_primary_overlap_fraction
FROM (SELECT *, (lat_bin, lon_bin) IN (SELECT (lat_bin, lon_bin) FROM strict_p) AS in_s, (lat_bin, lon_bin) IN (SELECT (lat_bin, lon_bin) FROM expanded_p) AS in_e FROM ({_OS}))
GROUP BY product_key, stratification, stratum""")
def _(spark, d):
    p = Products.of(spark, d)
    return PR.overlap_profile(p.keyed("supplementary", "regional"), p.tables_t["strict"], p.tables_t["expanded"])


_KEYED = " UNION ALL ".join(f"SELECT '{k}' AS k, lat_bin, lon_bin FROM {k}_p" for k in ("strict", "expanded", "supplementary", "regional"))


@query("pairwise_overlap", "left_product_key right_product_key left_cells right_cells overlap_cells", "overlap_fraction_of_left overlap_fraction_of_right", f"""
SELECT l.k AS left_product_key, r.k AS right_product_key, any_value(nl.n) AS left_cells, any_value(nr.n) AS right_cells, count(*) FILTER (WHERE l.lat_bin = r.lat_bin AND l.lon_bin = r.lon_bin) AS overlap_cells,
  count(*) FILTER (WHERE l.lat_bin = r.lat_bin AND l.lon_bin = r.lon_bin) / any_value(nl.n) AS overlap_fraction_of_left,
  count(*) FILTER (WHERE l.lat_bin = r.lat_bin AND l.lon_bin = r.lon_bin) / any_value(nr.n) AS overlap_fraction_of_right
FROM (SELECT DISTINCT * FROM ({_KEYED})) l JOIN (SELECT DISTINCT * FROM ({_KEYED})) r ON l.k < r.k
JOIN (SELECT k, count(DISTINCT (lat_bin, lon_bin)) AS n FROM ({_KEYED}) GROUP BY k) nl ON nl.k = l.k
JOIN (SELECT k, count(DISTINCT (lat_bin, lon_bin)) AS n FROM ({_KEYED}) GROUP BY k) nr ON nr.k = r.k GROUP BY 1, 2""")
def _(spark, d):
    names = ["strict", "expanded", "supplementary", "regional"]
    return PR.pairwise_overlap(Products.of(spark, d).keyed(*names), names)


_CS = " UNION ALL ".join(f"SELECT *, '{c}' AS stratification, CAST({c} AS VARCHAR) AS stratum FROM e" for c in PR.COVERAGE_STRATA)


@query("coverage_gain", "stratification stratum expanded_cells retained_multibeam_cells singlebeam_gapfill_cells", "", f"""
SELECT stratification, stratum, count(*) AS expanded_cells, count(*) FILTER (WHERE kept) AS retained_multibeam_cells, count(*) FILTER (WHERE NOT kept) AS singlebeam_gapfill_cells
FROM (WITH e AS (SELECT *, {S.depth_metric('representative_depth_m')} AS depth_bin_label, {S.region()} AS region_10deg,
  (lat_bin, lon_bin) IN (SELECT (lat_bin, lon_bin) FROM strict_p) AS kept FROM expanded_p) {_CS}) GROUP BY 1, 2""")
def _(spark, d):
    p = Products.of(spark, d)
    return PR.coverage_gain(p.tables_t["expanded"], p.tables_t["strict"])


_SENS = "overall_RMSE overall_weighted_RMSE retained_RMSE retained_weighted_RMSE gapfill_RMSE gapfill_weighted_RMSE"


@query("gapfill_sensitivity", "product_name overall_count retained_count gapfill_count diagnosis",
       _SENS + " gapfill_minus_retained_RMSE gapfill_to_retained_RMSE_ratio", """
SELECT *, gapfill_RMSE - retained_RMSE AS "gapfill_minus_retained_RMSE", gapfill_RMSE / nullif(retained_RMSE, 0) AS "gapfill_to_retained_RMSE_ratio",
  CASE WHEN retained_RMSE IS NULL OR gapfill_RMSE IS NULL THEN 'no_data'
    WHEN gapfill_RMSE > retained_RMSE * 1.10 OR gapfill_RMSE - retained_RMSE > 25 THEN 'gapfill_worse'
    WHEN gapfill_RMSE < retained_RMSE * 0.90 THEN 'gapfill_better'
    ELSE 'comparable' END AS diagnosis FROM sensitivity_p""")
def _(spark, d):
    return PR.diagnose(PR.gapfill_sensitivity(Products.of(spark, d).expanded_marked))


_GS = " UNION ALL ".join(f"SELECT *, '{k}' AS stratification, CAST({c} AS VARCHAR) AS stratum FROM bc_marked"
                         for k, c in (("lat_band_10deg", "lat_band_10deg"), ("depth_bin", "depth_bin_label")))


@query("gapfill_strata", "product_name stratification stratum retained_count gapfill_count",
       "retained_RMSE gapfill_RMSE retained_weighted_RMSE gapfill_weighted_RMSE gapfill_minus_retained_RMSE", f"""
SELECT *, gapfill_RMSE - retained_RMSE AS "gapfill_minus_retained_RMSE" FROM (SELECT product_name, stratification, stratum,
  {G.side('retained', 'is_retained_multibeam')}, {G.side('gapfill', 'NOT is_retained_multibeam')} FROM ({_GS}) GROUP BY 1, 2, 3)
WHERE retained_RMSE IS NOT NULL AND gapfill_RMSE IS NOT NULL""")
def _(spark, d):
    return PR.gapfill_strata(Products.of(spark, d).expanded_marked)


_M = ["bias", "MAE", "RMSE", "weighted_MAE", "weighted_RMSE"]


@query("strict_expanded_comparison", "product_name sampling_method strict_count expanded_count coverage_gain_count",
       "coverage_gain_fraction_vs_strict " + " ".join(f"strict_{m} expanded_{m} delta_{m}_expanded_minus_strict" for m in _M), f"""
SELECT product_name, sampling_method, s.count AS strict_count, e.count AS expanded_count, e.count - s.count AS coverage_gain_count,
  (e.count - s.count) / nullif(s.count, 0) AS coverage_gain_fraction_vs_strict,
  {', '.join(f's."{m}" AS "strict_{m}", e."{m}" AS "expanded_{m}", e."{m}" - s."{m}" AS "delta_{m}_expanded_minus_strict"' for m in _M)}
FROM (SELECT * FROM metrics_both WHERE stratification = 'overall' AND product_role = 'strict_primary_multibeam') s
JOIN (SELECT * FROM metrics_both WHERE stratification = 'overall' AND product_role = 'expanded_primary_ship') e USING (product_name, sampling_method)""")
def _(spark, d):
    overall = Products.of(spark, d).metrics.where("stratification = 'overall'")
    return PR.compare_summaries(overall, "strict_primary_multibeam", "expanded_primary_ship")


@query("product_counts_check", "product_key n_rows expected_rows deviation status", "", """
SELECT product_key, n_rows, e AS expected_rows, abs(n_rows - e) AS deviation, CASE WHEN abs(n_rows - e) <= 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'strict' AS product_key, (SELECT count(*) FROM strict_p) AS n_rows, (SELECT count(*) FROM catalog_p WHERE product_label = 'strict_primary_multibeam') AS e
  UNION ALL SELECT 'expanded', (SELECT count(*) FROM expanded_p), (SELECT count(*) FROM catalog_p WHERE product_label = 'strict_primary_multibeam')
  UNION ALL SELECT 'regional', (SELECT count(*) FROM regional_p), (SELECT count(*) FROM catalog_p WHERE product_label = 'strict_primary_multibeam'))""")
def _(spark, d):
    p = Products.of(spark, d)
    counts = p.keyed("strict", "expanded", "regional").groupBy("product_key").agg(F.count(F.lit(1)).alias("n_rows"))
    expected = counts.agg(F.max(F.when(F.col("product_key") == "strict", F.col("n_rows"))).alias("expected_rows"))
    keys = F.explode(F.array(*[F.lit(k) for k in ("strict", "expanded", "regional")])).alias("product_key")
    return K.check_counts(counts, expected.select(keys, "expected_rows", F.lit(5).alias("tolerance")))


def _counted(rows: dict[str, str], prefix: str = "") -> str:
    """One row per check: its name, the number of offending rows and the status."""
    return " UNION ALL ".join(f"SELECT '{prefix}{name}' AS check_name, n AS n_bad, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({sql}) AS c(n)"
                              for name, sql in rows.items())


def _bad(table: str, condition: str) -> str:
    return f"SELECT count(*) FILTER (WHERE {condition}) FROM {table}"


def _product_checks(s: str, x: str, f: str) -> dict[str, str]:
    regional = "branch = 'regional'"
    kept, inside = f"{regional} AND NOT exclude_from_primary", "(lat_bin, lon_bin) IN (SELECT (lat_bin, lon_bin) FROM strict_p)"
    fill, sb = "coalesce(expanded_fill, false)", "source_provider = 'track_singlebeam'"
    return {
        "disjoint_survey_multibeam": f"SELECT count(*) FROM (SELECT lat_bin, lon_bin FROM {s} WHERE source_provider = 'survey' INTERSECT SELECT lat_bin, lon_bin FROM {s} WHERE branch = 'multibeam') AS i",
        "no_regional_in_strict": _bad(s, f"{regional} OR source_provider = 'regional'"), "no_regional_in_expanded": _bad(x, f"{regional} OR source_provider = 'regional'"),
        "expanded_unique": f"SELECT count(*) - count(DISTINCT (lat_bin, lon_bin)) FROM {x}",
        "weight_ceiling_survey": _bad(s, "source_provider = 'survey' AND validation_weight > 1.0"),
        "weight_ceiling_track_multibeam": _bad(s, "source_provider = 'track_multibeam' AND validation_weight > 0.95"),
        "zero_weight": _bad(f, "validation_weight = 0"),
        "regional_excluded_share": f"SELECT CASE WHEN count(*) FILTER (WHERE {kept}) > 0.01 * count(*) FILTER (WHERE {regional}) THEN count(*) FILTER (WHERE {kept}) ELSE 0 END FROM {f}",
        "highdup_sidecar": _bad(f, "matched_rule_id = 'mb_v0_highdup_sentry_downweight' AND NOT (highdup_flag AND source_risk_class = 'highdup_survey')"),
        "gapfill_not_marked": _bad(x, f"NOT {inside} AND NOT {fill}"), "retained_marked": _bad(x, f"{inside} AND {fill}"),
        "gapfill_not_singlebeam": _bad(x, f"NOT {inside} AND NOT {sb}"), "retained_singlebeam": _bad(x, f"{inside} AND {sb}")}


_BAD_STRICT = "(SELECT * REPLACE (CASE WHEN lat_bin % 7 = 0 THEN 'regional' WHEN lat_bin % 5 = 0 THEN 'multibeam' ELSE branch END AS branch, CASE WHEN lat_bin % 3 = 0 THEN 2.0 ELSE validation_weight END AS validation_weight) FROM strict_p UNION ALL SELECT * REPLACE ('multibeam' AS branch, 'track_multibeam' AS source_provider, 0.99 AS validation_weight) FROM strict_p WHERE lat_bin % 4 = 0)"
_BAD_EXPANDED = "(SELECT * REPLACE (NOT expanded_fill AS expanded_fill, CASE WHEN lat_bin % 7 = 0 THEN 'regional' WHEN lat_bin % 2 = 0 THEN 'track_singlebeam' ELSE 'survey' END AS source_provider) FROM expanded_p UNION ALL SELECT * FROM expanded_p WHERE lat_bin % 4 = 0)"
_BAD_FLAGS = "(SELECT * REPLACE (CASE WHEN lat_bin % 4 = 0 THEN 0 ELSE validation_weight END AS validation_weight, false AS highdup_flag, false AS exclude_from_primary) FROM policy_b)"


def _all_checks(strict, expanded, flags, kept):
    survey, mb = strict.where("source_provider = 'survey'"), strict.where("branch = 'multibeam'")
    return TB.union_all([
        K.check_disjoint(survey, mb, C.CELL, "disjoint_survey_multibeam"),
        K.check_no_regional({"strict": strict, "expanded": expanded}), K.check_unique(expanded, C.CELL, "expanded_unique"),
        K.check_weights(strict, flags), K.check_membership(expanded, kept)])


def _planted(checks):
    return checks.withColumn("check_name", F.concat(F.lit("planted_"), "check_name"))


@query("product_checks", "check_name n_bad status", "", _counted(_product_checks("strict_p", "expanded_p", "policy_b")) + " UNION ALL "
       + _counted(_product_checks(_BAD_STRICT, _BAD_EXPANDED, _BAD_FLAGS), "planted_"))
def _(spark, d):
    """The checks on the products, and on copies with planted violations."""
    p = Products.of(spark, d)
    t, flags, lat = p.tables_t, p.tracks.flagged_t, F.col("lat_bin")
    strict = t["strict"].withColumns({"branch": F.when(lat % 7 == 0, "regional").when(lat % 5 == 0, "multibeam").otherwise(F.col("branch")),
                                      "validation_weight": F.when(lat % 3 == 0, 2.0).otherwise(F.col("validation_weight"))})
    strict = strict.unionByName(t["strict"].where("lat_bin % 4 = 0").withColumns({"branch": F.lit("multibeam"), "source_provider": F.lit("track_multibeam"), "validation_weight": F.lit(0.99)}))
    provider = F.when(lat % 7 == 0, "regional").when(lat % 2 == 0, "track_singlebeam").otherwise("survey")
    expanded = t["expanded"].withColumns({"expanded_fill": ~F.col("expanded_fill"), "source_provider": provider}).unionByName(t["expanded"].where("lat_bin % 4 = 0"))
    bad = flags.withColumns({"validation_weight": F.when(lat % 4 == 0, 0.0).otherwise(F.col("validation_weight")), "highdup_flag": F.lit(False), "exclude_from_primary": F.lit(False)})
    return _all_checks(t["strict"], t["expanded"], flags, t["strict"]).unionByName(_planted(_all_checks(strict, expanded, bad, t["strict"])))


ROLES = {"supplementary": "supplementary_coverage", "regional": "regional_experiment"}


def _preflight(tables: dict[str, str]) -> dict[str, str]:
    out = {}
    for name, table in tables.items():
        role = f"branch_role IS DISTINCT FROM '{ROLES[name]}'" if name in ROLES else "false"
        out |= {f"{name}_schema": f"SELECT 0 FROM (SELECT count(*) FROM {table}) AS z", f"{name}_null_depth": _bad(table, "representative_depth_m IS NULL"),
                f"{name}_nonpositive_depth": _bad(table, "representative_depth_m <= 0"), f"{name}_role": _bad(table, role)}
    return out


_GRIDS = {f"grid_{g}": f"SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM pixels WHERE product_name = '{g}'" for g in [*G.GRIDS, "grid_missing"]}
_TURNED = "(SELECT * REPLACE (CASE WHEN lat_bin % 3 = 0 THEN NULL WHEN lat_bin % 3 = 1 THEN -representative_depth_m ELSE representative_depth_m END AS representative_depth_m, CASE WHEN lat_bin % 2 = 0 THEN NULL ELSE branch_role END AS branch_role) FROM supplementary_p)"


@query("preflight_checks", "check_name n_bad status", "", _counted(_preflight({k: f"{k}_p" for k in ("strict", "supplementary", "regional")}) | _GRIDS)
       + " UNION ALL " + _counted(_preflight({"supplementary": _TURNED}), "planted_"))
def _(spark, d):
    p = Products.of(spark, d)
    chosen = {k: p.tables_t[k] for k in ("strict", "supplementary", "regional")}
    depth, lat = F.col("representative_depth_m"), F.col("lat_bin")
    turned = p.tables_t["supplementary"].withColumns({"representative_depth_m": F.when(lat % 3 == 1, -depth).when(lat % 3 == 2, depth),
                                                      "branch_role": F.when(lat % 2 != 0, F.col("branch_role"))})
    return K.preflight(chosen, ROLES, p.pixels, [g.name for g in p.grids]).unionByName(_planted(K.preflight({"supplementary": turned}, ROLES)))


def _safety(x: str, turned: str) -> dict[str, str]:
    preserved = {c: _bad(x, f"{c} IS NULL") for c in ("validation_weight", "quality_tier", "evidence_class", "matched_rule_id")}
    return {"no_regional": _bad(x, "branch = 'regional'"), **{f"{c}_preserved": q for c, q in preserved.items()},
            "singlebeam_only_as_fill": _bad(x, "(source_provider = 'track_singlebeam') <> coalesce(expanded_fill, false)"),
            "sign_error_suspected": f"SELECT count(*) FILTER (WHERE c < 0) FROM (SELECT corr({turned}, ship_elev_m) AS c FROM bc_expanded WHERE {G.E} IS NOT NULL GROUP BY product_name, sampling_method HAVING count(*) >= 2) AS k"}


# products with pixels that did not come to any row
_ERRORS = "SELECT count(*) FROM (SELECT DISTINCT product_name FROM pixels WHERE product_name NOT IN (SELECT product_name FROM bc_expanded)) AS z"
_HOLED = "(SELECT * REPLACE (CASE WHEN lat_bin % 3 = 0 THEN NULL ELSE validation_weight END AS validation_weight, NULL AS matched_rule_id, CASE WHEN lat_bin % 2 = 0 THEN 'regional' ELSE branch END AS branch, 'track_singlebeam' AS source_provider) FROM expanded_p)"


@query("safety_table", "check_name n_bad status", "", _counted(_safety("expanded_p", "model_elev_m") | {"product_errors": _ERRORS})
       + " UNION ALL " + _counted(_safety(_HOLED, "-model_elev_m") | {"product_errors": "SELECT count(DISTINCT product_name) FROM pixels"}, "planted_"))
def _(spark, d):
    """The full-run checks, and the same on cells with holes, turned grids and products marked as failed."""
    from ..operators.metrics import convention_diag
    p = Products.of(spark, d)
    cells, (by_cell, status), lat = p.tables_t["expanded"], p.expanded_run, F.col("lat_bin")
    holed = cells.withColumns({"validation_weight": F.when(lat % 3 != 0, F.col("validation_weight")), "matched_rule_id": F.lit(None).cast("string"),
                               "branch": F.when(lat % 2 == 0, "regional").otherwise(F.col("branch")), "source_provider": F.lit("track_singlebeam")})
    turned = convention_diag(by_cell.withColumn("model_elev_m", -F.col("model_elev_m")))
    failed = p.pixels.select("product_name").distinct().select("product_name", F.lit("error").alias("status"))
    return K.safety_table(cells, convention_diag(by_cell), status, expanded=True).unionByName(_planted(K.safety_table(holed, turned, failed, expanded=True)))


@query("id_set_operations", "kind n_cells", "", """
SELECT 'common' AS kind, (SELECT count(*) FROM (SELECT lat_bin, lon_bin FROM expanded_p INTERSECT SELECT lat_bin, lon_bin FROM regional_p)) AS n_cells
UNION ALL SELECT 'missing', (SELECT count(*) FROM (SELECT lat_bin, lon_bin FROM regional_p EXCEPT SELECT lat_bin, lon_bin FROM expanded_p))
UNION ALL SELECT 'kept', (SELECT count(*) FROM supplementary_p SEMI JOIN strict_p USING (lat_bin, lon_bin))
UNION ALL SELECT 'dropped', (SELECT count(*) FROM supplementary_p ANTI JOIN strict_p USING (lat_bin, lon_bin))
UNION ALL SELECT 'distinct', (SELECT count(*) FROM (SELECT DISTINCT lat_bin, lon_bin FROM catalog_p))""")
def _(spark, d):
    p = Products.of(spark, d)
    t = p.tables_t
    parts = {"common": TB.common_ids(t["expanded"], t["regional"], C.CELL), "missing": TB.missing_ids(t["regional"], t["expanded"], C.CELL),
             "kept": TB.keep_ids(t["supplementary"], t["strict"], C.CELL), "dropped": TB.drop_ids(t["supplementary"], t["strict"], C.CELL),
             "distinct": TB.distinct_by(PR.build_catalog(t), C.CELL)}
    return TB.union_all([df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n_cells")) for k, df in parts.items()])


@query("head_per_stratum", "branch depth_bin_label cell_id", "", f"""
SELECT branch, depth_bin_label, cell_id FROM (SELECT branch, {S.depth_metric('representative_depth_m')} AS depth_bin_label, cell_id,
  row_number() OVER (PARTITION BY branch, {S.depth_metric('representative_depth_m')} ORDER BY cell_id) AS rn FROM catalog_p WHERE product_membership <> 'expanded_primary_ship') WHERE rn <= 4""")
def _(spark, d):
    catalog = PR.build_catalog(Products.of(spark, d).tables_t).where("product_membership <> 'expanded_primary_ship'")
    rows = catalog.withColumn("depth_bin_label", bins.depth_bin_metric("representative_depth_m"))
    return head_per_group(rows, ["branch", "depth_bin_label"], [F.col("cell_id")], 4)


@query("stable_sample", "cell_id branch expanded_fill", "", """
SELECT cell_id, branch, expanded_fill FROM (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY h, cell_id) AS place FROM (
    SELECT *, md5(concat('expanded_primary_ship:', cell_id)) AS h, coalesce(expanded_fill, false) AS f FROM expanded_p) AS x) AS y
ORDER BY CASE WHEN place > CASE WHEN f THEN 12 ELSE 48 END THEN 1 ELSE 0 END, h, cell_id LIMIT 60""")
def _(spark, d):
    """Sixty cells in MD5 order, a fifth of them gap fills."""
    return TB.stable_sample(Products.of(spark, d).tables_t["expanded"], "cell_id", 60, "expanded_primary_ship", "expanded_fill")


@query("file_sample", "file_id archive_id", "", """
SELECT file_id, archive_id FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY md5(concat('42:', file_id)), file_id) AS rn
  FROM (SELECT DISTINCT file_id, archive_id FROM fc_a) AS f) AS x WHERE rn <= 2""")
def _(spark, d):
    """Two files of each archive in MD5 order."""
    return TB.sample_files(Products.of(spark, d).survey.files, "file_id", 2, per="archive_id")


@query("file_order", "file_id archive_id part_rank", "", """
SELECT file_id, archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY file_id) AS part_rank FROM (SELECT DISTINCT file_id, archive_id FROM fc_a) AS f""")
def _(spark, d):
    """Files written in sorted order inside each archive's partition, and read back in file order."""
    rows = Products.of(spark, d).survey.files.select("file_id", "archive_id")
    path = fresh_path(spark, "sorted-files")
    TB.sorted_output(rows.repartition("archive_id"), ["archive_id", "file_id"]).withColumn("seq", F.monotonically_increasing_id()).write.parquet(path)
    back = spark.read.parquet(path)
    return back.withColumn("part_rank", F.row_number().over(Window.partitionBy("archive_id").orderBy("seq")))


def _outcome(stage: str, scope: str, cells: str, checks: str, by_cell: str | None) -> str:
    done = f"(SELECT count(DISTINCT product_name) FROM {by_cell})" if by_cell else "CAST(NULL AS BIGINT)"
    left = f"(SELECT count(*) FROM (SELECT DISTINCT product_name FROM pixels) AS k WHERE product_name NOT IN (SELECT product_name FROM {by_cell}))" if by_cell else "0"
    enabled = ", ".join(f"('{g['name']}')" for g in GRID_CONFIG if g.get("enabled", True))
    skipped = (f"(SELECT coalesce(string_agg(concat(name, ': no pixels'), ';' ORDER BY name), '') FROM (VALUES {enabled}) AS e(name) WHERE name NOT IN (SELECT product_name FROM pixels))"
               if by_cell else "''")
    return (f"SELECT '{stage}' AS stage, '{scope}' AS product_scope, CASE WHEN safety_fail = 0 AND {left} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (SELECT sum(n) FROM ({cells}) AS c(n)) AS cells, "
            f"{done} AS completed_products, safety_pass, safety_fail, {skipped} AS skipped, '{PR.STAGE_ROLES[stage]}' AS policy_role "
            f"FROM (SELECT count(*) FILTER (WHERE status = 'PASS') AS safety_pass, count(*) FILTER (WHERE status <> 'PASS') AS safety_fail FROM ({checks}) AS k) AS t")


_STRICT = {k: v for k, v in _safety("strict_p", "model_elev_m").items() if k != "singlebeam_only_as_fill"} | {
    "no_singlebeam": _bad("strict_p", "source_provider = 'track_singlebeam'"), "product_errors": _ERRORS.replace("bc_expanded", "bc_strict")}
_STRICT["sign_error_suspected"] = _STRICT["sign_error_suspected"].replace("bc_expanded", "bc_strict")


@query("stage_outcomes", "stage product_scope status cells completed_products safety_pass safety_fail skipped policy_role", "", " UNION ALL ".join([
    _outcome("strict", "strict", "SELECT count(*) FROM strict_p", _counted(_STRICT), "bc_strict"),
    _outcome("expanded", "expanded", "SELECT count(*) FROM expanded_p", _counted(_safety("expanded_p", "model_elev_m") | {"product_errors": _ERRORS}), "bc_expanded"),
    _outcome("non_primary", "supplementary + regional", "SELECT count(*) FROM supplementary_p UNION ALL SELECT count(*) FROM regional_p",
             _counted(_preflight({k: f"{k}_p" for k in ("supplementary", "regional")})), None)]))
def _(spark, d):
    """Outcome and policy role of the validation of both primary products and of the non-primary ones."""
    from ..operators.metrics import convention_diag
    p = Products.of(spark, d)
    parts = []
    for stage, (rows, status) in (("strict", p.strict_run), ("expanded", p.expanded_run)):
        checks = K.safety_table(p.tables_t[stage], convention_diag(rows), status, expanded=stage == "expanded")
        parts.append(PR.stage_outcome(stage, stage, p.tables_t[stage], checks, status))
    others = {k: p.tables_t[k] for k in ("supplementary", "regional")}
    parts.append(PR.stage_outcome("non_primary", "supplementary + regional", TB.union_all(list(others.values())), K.preflight(others, ROLES)))
    return TB.union_all(parts)
