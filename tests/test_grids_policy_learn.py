import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.functions import geo
from leadline.operators import learn as L
from leadline.operators import policy as Q
from leadline.operators import raster as R
from leadline.operators.products import precedence_fill


def grid(spark, lats, lons, z, name="g"):
    rows = [(name, i, j, float(la), float(lo), None if np.isnan(z[i][j]) else float(z[i][j]))
            for i, la in enumerate(lats) for j, lo in enumerate(lons)]
    return spark.createDataFrame(rows, "product_name string, row_idx bigint, col_idx bigint, lat double, lon double, z double")


def cells_at(spark, points):
    rows = [(int((la + 90) * 60 // 1), int((lo + 180) * 60 // 1)) for la, lo in points]
    return spark.createDataFrame(rows, "lat_bin bigint, lon_bin bigint")


def centre(la, lo):
    return -90 + (int((la + 90) * 60) + 0.5) / 60, -180 + (int((lo + 180) * 60) + 0.5) / 60


POINTS = [(10.01, 20.01), (10.2, 20.3), (10.49, 20.02), (9.0, 20.1), (10.3, 25.0)]


@pytest.mark.parametrize("falling,turned", [(False, False), (True, False), (False, True)])
def test_nearest_and_bilinear_against_numpy(spark, falling, turned):
    lats, lons = np.arange(10.0, 10.5001, 0.07), np.arange(20.0, 20.5001, 0.06) - (60 if turned else 0)
    points = [(la, lo - (60 if turned else 0)) for la, lo in POINTS]
    rng = np.random.default_rng(5)
    z = rng.normal(-3000, 500, (len(lats), len(lons)))
    z[2, 2] = np.nan
    shown = lons % 360 if turned else lons
    px = grid(spark, lats[::-1] if falling else lats, shown, z[::-1] if falling else z)
    p = R.Product("g", lon_convention="0_360" if turned else "-180_180")
    cells = cells_at(spark, points)
    near = {(r[0], r[1]): r[2] for r in R.sample_nearest(cells, px, p).collect()}
    bil = {(r[0], r[1]): r[2] for r in R.sample_bilinear(cells, px, p).collect()}
    for la, lo in points:
        c, x = centre(la, lo)
        key = (int((la + 90) * 60), int((lo + 180) * 60))
        want = z[np.abs(lats - c).argmin(), np.abs(lons - x).argmin()]
        assert near[key] == pytest.approx(want, nan_ok=True) if not np.isnan(want) else near[key] is None
        if not (lats[0] <= c <= lats[-1] and lons[0] <= x <= lons[-1]):
            assert bil[key] is None
            continue
        i, j = np.searchsorted(lats, c) - 1, np.searchsorted(lons, x) - 1
        t, u = (c - lats[i]) / (lats[i + 1] - lats[i]), (x - lons[j]) / (lons[j + 1] - lons[j])
        want = z[i, j] * (1 - t) * (1 - u) + z[i + 1, j] * t * (1 - u) + z[i, j + 1] * (1 - t) * u + z[i + 1, j + 1] * t * u
        assert bil[key] is None if np.isnan(want) else bil[key] == pytest.approx(want)


@pytest.mark.parametrize("falling", [False, True])
def test_cell_window_edges(spark, falling):
    """Lines on both edges of a cell: the lower edge counts on a rising axis, the upper on a falling one."""
    b = 6000
    c = -90 + (b + 0.5) / 60
    lats = np.array([c - 1 / 120, c, c + 1 / 120])
    lons = np.array([-180 + (b + 0.5) / 60, -180 + (b + 9.5) / 60])
    z = np.array([[1.0, 0.0], [2.0, 0.0], [4.0, 0.0]])
    px = grid(spark, lats[::-1] if falling else lats, lons, z[::-1] if falling else z)
    cells = spark.createDataFrame([(b, b), (b, b + 4)], "lat_bin bigint, lon_bin bigint")
    got = {r["lon_bin"]: r["raw_z"] for r in R.sample_cell_agg(cells, px, R.Product("g"), "mean").collect()}
    assert got[b] == (3.0 if falling else 1.5)
    assert got[b + 4] == (3.0 if falling else 1.5)          # empty window: the nearest column


def test_reconstruct_on_unequal_grids(spark):
    lats, lons = np.linspace(0, 4, 5), np.linspace(0, 6, 4)
    raw = np.add.outer(lats * 10, lons * 3.0)
    px_raw, px_band = grid(spark, lats, lons, raw), grid(spark, lats, lons, np.ones_like(raw))
    t_lats, t_lons = np.linspace(4, 0, 9), np.linspace(-1, 6, 8)      # falling, finer, and beyond the western edge
    pred = grid(spark, t_lats, t_lons, np.zeros((9, 8)))
    got = {(r["row_idx"], r["col_idx"]): r["z"] for r in R.reconstruct_resampled(pred, px_raw, px_band).collect()}
    for i, la in enumerate(t_lats):
        for j, lo in enumerate(t_lons):
            assert got[i, j] == pytest.approx(la * 10 + lo * 3 - 1)
    same = R.reconstruct(px_band, px_raw, px_band).where("row_idx = 1 and col_idx = 1").collect()[0]["z"]
    assert same == pytest.approx(raw[1, 1])


def test_product_configuration_and_status(spark):
    with pytest.raises(ValueError):
        R.load_products([{"name": "x", "sampling_method": "center_nearest"}])
    base = {"sampling_method": "center_nearest", "z_convention": "elevation_negative_ocean", "lon_convention": "-180_180"}
    conf = [{"name": "g", **base}, {"name": "bad", **base, "sampling_method": "magic"}, {"name": "none", **base},
            {"name": "off", **base, "enabled": False}]
    px = grid(spark, [10.0, 10.1], [20.0, 20.1], np.ones((2, 2))).withColumnRenamed("z", "z_raw")
    px = px.unionByName(px.withColumn("product_name", F.lit("bad")))
    cells = geo.with_cell_geometry(cells_at(spark, POINTS[:1])).withColumns({"ship_elev_m": F.lit(3.0), "ship_depth_m": F.lit(-3.0)})
    rows, status = R.validate_products(cells, px, R.load_products(conf))
    assert {r["product_name"]: r["status"] for r in status.collect()} == {"g": "ok", "bad": "error", "none": "skipped"}
    assert rows.select("elev_error_m").collect()[0][0] == -2.0


RULE_CELL = {"branch": "singlebeam", "lat_band_10deg": 0, "depth_bin_lo": 200, "n_track_cells": 1, "n_unique_triples_total": 50,
             "duplicate_ratio_cell": 0.0, "n_cross_branch_overlap": 1, "in_cross_pair": ["mb_vs_sb"], "within_or_cross_p95": None,
             "within_branch_residual_p95": None, "cross_branch_residual_max_p95": None, "cross_branch_residual_p99": None,
             "mb_vs_regional_p95": None, "mb_vs_regional_rmse": None, "manual_review_any": True}
CASES = [
    ({}, "default_unmatched"), ({"n_cross_branch_overlap": 0}, "sb_v0_no_overlap_low"), ({"n_unique_triples_total": 9}, "any_v0_low_unique_low"),
    ({"n_track_cells": 2, "within_or_cross_p95": 199.9}, "sb_v0_lowlat_shallow_overlap_high"),
    ({"n_track_cells": 2, "within_or_cross_p95": 200.0, "cross_branch_residual_max_p95": 149.0}, "any_v0_overlap_both_high"),
    ({"n_track_cells": 2, "depth_bin_lo": 2000, "within_branch_residual_p95": 299.0}, "sb_v0_lowlat_deep_overlap_medium"),
    ({"n_track_cells": 2, "depth_bin_lo": 6000, "within_branch_residual_p95": 1.0}, "default_unmatched"),
    ({"lat_band_10deg": -60, "n_cross_branch_overlap": 0}, "sb_v0_southern_ocean_review"),
    ({"lat_band_10deg": -50, "cross_branch_residual_p99": 1001.0}, "sb_v0_southern_ocean_review"),
    ({"lat_band_10deg": 80, "cross_branch_residual_max_p95": 301.0}, "sb_v0_highlat_north_review"),
    ({"branch": "regional", "depth_bin_lo": 0}, "regional_v0_shallow_highrisk"), ({"branch": "regional"}, "regional_v0_default_sensitivity"),
    ({"branch": "regional", "lat_band_10deg": -30, "depth_bin_lo": 500, "in_cross_pair": ["mb_vs_regional"], "mb_vs_regional_rmse": 149.0,
      "mb_vs_regional_p95": 199.0}, "regional_v0_crossvalidated_medium"),
    ({"branch": "multibeam", "lat_band_10deg": -70, "depth_bin_lo": 4000, "n_track_cells": 2, "mb_vs_regional_p95": 174.0}, "mb_v0_high_overlap_lowdup"),
    ({"branch": "multibeam", "n_unique_triples_total": 100}, "mb_v0_singletrack_lowdup"),
    ({"branch": "multibeam", "n_unique_triples_total": 100, "duplicate_ratio_cell": 0.51}, "mb_v0_highdup_sentry_downweight"),
    ({"branch": "multibeam", "n_unique_triples_total": 1000, "n_track_cells": 3, "duplicate_ratio_cell": 0.1}, "any_v0_strong_unique_medium"),
    ({"branch": "multibeam", "duplicate_ratio_cell": 0.6, "n_cross_branch_overlap": 0}, "any_v0_dup_heavy_downweight")]


def test_rule_truth_table(spark):
    schema = ("branch string, lat_band_10deg bigint, depth_bin_lo bigint, n_track_cells bigint, n_unique_triples_total bigint, duplicate_ratio_cell double, "
              "n_cross_branch_overlap bigint, in_cross_pair array<string>, within_or_cross_p95 double, within_branch_residual_p95 double, "
              "cross_branch_residual_max_p95 double, cross_branch_residual_p99 double, mb_vs_regional_p95 double, mb_vs_regional_rmse double, "
              "manual_review_any boolean, i int")
    rows = [tuple({**RULE_CELL, **change}.values()) + (i,) for i, (change, _) in enumerate(CASES)]
    got = Q.apply_rules(spark.createDataFrame(rows, schema)).orderBy("i").collect()
    assert [r["matched_rule_id"] for r in got] == [want for _, want in CASES]
    assert {r["matched_rule_priority"] for r in got if r["matched_rule_id"] == "default_unmatched"} == {99}
    side = Q.policy_sidecars(Q.apply_rules(spark.createDataFrame(rows, schema))).orderBy("i").collect()
    shallow = side[10]
    assert shallow["use_for_regional_experiment"] and not shallow["use_for_primary_validation"]
    assert shallow["exclusion_or_review_reason"] == "regional_v0_shallow_highrisk:sensitivity_only"
    assert side[15]["source_risk_class"] == "highdup_survey" and side[15]["validation_weight"] == 0.55


def test_precedence_keeps_strict_and_fills_gaps(spark):
    schema = "lat_bin bigint, lon_bin bigint, source_provider string"
    strict = spark.createDataFrame([(1, 1, "survey"), (1, 2, "track_multibeam"), (1, 3, "survey")], schema)
    fill = spark.createDataFrame([(1, 1, "track_singlebeam"), (1, 2, "track_singlebeam"), (9, 9, "track_singlebeam")], schema)
    got = {(r["lat_bin"], r["lon_bin"]): (r["source_provider"], r["precedence_resolution"], r["expanded_fill"])
           for r in precedence_fill(strict, fill).collect()}
    assert got == {(1, 1): ("survey", "survey_over_sb", False), (1, 2): ("track_multibeam", "mb_over_sb", False),
                   (1, 3): ("survey", "", False), (9, 9): ("track_singlebeam", None, True)}


def test_splits_do_not_leak_and_keep_shares(spark):
    rows = [(f"c{i}", float(i % 40), float(i // 40), 4500.0 + i, "A_tier", "4000–5000", float(i % 7)) for i in range(1600)]
    df = spark.createDataFrame(rows, "cell_id string, lon_center double, lat_center double, ship_depth double, quality_tier string, depth_bin string, t double")
    df = df.withColumn("block_id", geo.block_id("lon_center", "lat_center", 4.0))
    split = L.split_blocks(df)
    assert split.groupBy("block_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert dict(split.select("block_id", "split").distinct().groupBy("split").count().collect()) == {"train": 60, "val": 20, "test": 20}
    sized = L.split_blocks(L.with_block_sizes(df, [4.0, 2.0]), within=["block_deg"])
    rows = {r["block_deg"]: r for r in L.compare_block_sizes(sized, "t").collect()}
    assert {k: r["n_blocks"] for k, r in rows.items()} == {4.0: 100, 2.0: 400}
    assert all(r["train_n"] + r["val_n"] + r["test_n"] == 1600 and r["tier_cost"] == 0 and r["depth_cost"] == 0 for r in rows.values())
    assert rows[4.0]["size_cost"] == 0 and rows[4.0]["total_cost"] == pytest.approx(rows[4.0]["residual_cost"])


def test_block_size_choice(spark):
    def chosen(*rows):
        df = spark.createDataFrame([(float(d), x, t, deep) for d, x, t, deep in rows], "block_deg double, depth_cost double, total_cost double, test_has_5000m_plus boolean")
        return [r["block_deg"] for r in L.choose_block(df).where("is_chosen").collect()]
    assert chosen((1, 1.0, 3.0, True), (0.5, 1.0, 3.0, True), (0.25, 0.9, 2.9, True)) == [0.5]
    assert chosen((1, 1.0, 3.0, True), (0.5, 1.0, 3.0, True), (0.25, 0.8, 2.9, True)) == [0.25]
    assert chosen((0.5, 0.1, 0.1, False), (0.25, 0.9, 2.9, True)) == [0.25]
    assert chosen((0.5, 1.0, 3.0, True), (0.25, 0.95, 2.3, True)) == [0.25]
    assert chosen((1, 1.0, 3.0, True), (0.25, 1.5, 2.0, True)) == [1.0]
    assert chosen((0.5, 1.0, 3.0, False), (0.25, 1.0, 3.0, False)) == [0.5]


# --- stratified split

def _cells_in_blocks(spark, blocks, seed):
    rng = random.Random(seed)
    bins_, tiers = list(L.DEPTH_KEYS), L.TIERS
    rows = []
    for b in range(blocks):
        home, tier = rng.choice(bins_), rng.choice(tiers)
        for _ in range(rng.choice([1, 3, 9, 40])):
            rows.append((f"b{b}", rng.choice([home, home, rng.choice(bins_)]), rng.choice([tier, rng.choice(tiers), None]), rng.choice([rng.gauss(b % 7, 2), None])))
    return spark.createDataFrame(rows, "block_id string, depth_bin string, quality_tier string, t double"), rows


@pytest.mark.parametrize("per_class", [16, 2])
def test_stratified_split_costs_what_its_assignment_costs(spark, per_class):
    df, rows = _cells_in_blocks(spark, 60, 3)
    out = L.stratified_split(df, "t", candidates=60, per_class=per_class).collect()
    assert sorted(r["block_id"] for r in out) == sorted({r[0] for r in rows})
    split = {r["block_id"]: r["split"] for r in out}
    total = len(rows)
    by_block = {}
    for b, _, _, t in rows:
        by_block.setdefault(b, []).append(t)
    mean = {b: (sum(x for x in ts if x is not None) / max(1, sum(x is not None for x in ts))) for b, ts in by_block.items()}
    spread = np.std([mean[r[0]] for r in rows], ddof=1)
    cost = {"depth": 0.0, "tier": 0.0, "size": 0.0, "residual": 0.0}
    for s, share in L.SHARES.items():
        own = [r for r in rows if split[r[0]] == s]
        cost["size"] += abs(len(own) / total - share)
        for kind, column, values in (("depth", 1, L.DEPTH_KEYS), ("tier", 2, L.TIERS)):
            for v in values:
                cost[kind] += abs((sum(r[column] == v for r in own) / len(own) if own else 0) - sum(r[column] == v for r in rows) / total)
        cost["residual"] += abs(np.mean([mean[r[0]] for r in own]) - np.mean([mean[r[0]] for r in rows])) / spread if own else 0
    assert {k: out[0][f"{k}_cost"] for k in cost} == pytest.approx(cost)
    assert out[0]["total_cost"] == pytest.approx(sum(L.COST[k] * v for k, v in cost.items()))


def test_stratified_split_is_no_worse_than_the_hash_split(spark):
    df, _ = _cells_in_blocks(spark, 80, 5)
    blocks = L.split_units(df, "t")
    hashed = L.split_blocks(df).select("block_id", "split").distinct().join(blocks.select("block_id", "unit"), "block_id")
    assert blocks.select("unit").distinct().count() == 80                                   # few blocks in each class: one a unit
    plain = L.candidate_costs(blocks, hashed.select(F.lit(0).cast("bigint").alias("candidate"), "unit", "split")).first()["total_cost"]
    best = L.stratified_split(df, "t", candidates=100).first()["total_cost"]
    assert best <= plain
    assert L.stratified_split(df.limit(0), "t", candidates=5).count() == 0


def test_units_are_bounded_and_greedy(spark):
    df = spark.createDataFrame([(f"b{k}", "<4000", "A_tier", 1.0) for k in range(1000)], "block_id string, depth_bin string, quality_tier string, t double")
    blocks = L.split_units(df, "t", per_class=16)
    assert blocks.select("unit").distinct().count() == 16
    sizes = [r["n"] for r in blocks.groupBy("unit").agg(F.sum("n").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    units = [(f"u{k}", n) for k, n in enumerate([60, 20, 20])]
    plain = [dict(L.assign_units(units, c)) for c in range(40)]
    assert {"u0": "train"}.items() <= max(plain, key=lambda p: sum(q == p for q in plain)).items()
    assert len({tuple(sorted(p.items())) for p in plain}) > 1
