import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.functions import geo
from leadline.operators import raster as R
from leadline.operators import tiles as T


def grid(spark, lats, lons, z, name="g", z_name="z"):
    rows = [(name, i, j, float(la), float(lo), None if np.isnan(z[i][j]) else float(z[i][j])) for i, la in enumerate(lats) for j, lo in enumerate(lons)]
    return spark.createDataFrame(rows, f"product_name string, row_idx bigint, col_idx bigint, lat double, lon double, {z_name} double")


def centre(b0, b1):
    return -90 + (b0 + 0.5) / 60, -180 + (b1 + 0.5) / 60


def plain(lats, lons, z, b0, b1, falling):
    """All methods by numpy on rising axes; `falling` says which edge of a cell belongs to it."""
    la, lo = centre(b0, b1)
    near = z[np.abs(lats - la).argmin(), np.abs(lons - lo).argmin()]
    out = {"center_nearest": near}
    if lats[0] <= la <= lats[-1] and lons[0] <= lo <= lons[-1]:
        i, j = max(0, np.searchsorted(lats, la) - 1), max(0, np.searchsorted(lons, lo) - 1)
        t, u = (la - lats[i]) / (lats[i + 1] - lats[i]), (lo - lons[j]) / (lons[j + 1] - lons[j])
        out["center_bilinear"] = z[i, j] * (1 - t) * (1 - u) + z[i + 1, j] * t * (1 - u) + z[i, j + 1] * (1 - t) * u + z[i + 1, j + 1] * t * u
    else:
        out["center_bilinear"] = np.nan
    h = 1 / 120
    rows = np.flatnonzero((lats > la - h) & (lats <= la + h) if falling else (lats >= la - h) & (lats < la + h))
    cols = np.flatnonzero((lons >= lo - h) & (lons < lo + h))
    rows = rows if len(rows) else [np.abs(lats - la).argmin()]
    cols = cols if len(cols) else [np.abs(lons - lo).argmin()]
    inside = z[np.ix_(rows, cols)].ravel()
    inside = inside[~np.isnan(inside)]
    out["cell_median"], out["cell_mean"] = (np.median(inside), np.mean(inside)) if len(inside) else (np.nan, np.nan)
    return out


@pytest.mark.parametrize(("tile", "block", "falling", "step"), [(64, 64, False, 0.005), (4, 3, True, 0.005), (8, 64, False, 0.07), (5, 2, True, 0.0161)])
def test_all_methods_from_many_tiles(spark, monkeypatch, tile, block, falling, step):
    monkeypatch.setattr(T, "TILE", tile)
    monkeypatch.setattr(T, "BLOCK", block)
    rng, pick = np.random.default_rng(1), random.Random(2)
    lats, lons = 10.0003 + step * np.arange(37), 20.0007 + step * np.arange(29)
    z = rng.normal(-3000, 500, (37, 29))
    z[rng.random(z.shape) < 0.15] = np.nan
    px = grid(spark, lats[::-1] if falling else lats, lons, z[::-1] if falling else z)
    px = px.where("z IS NOT NULL OR row_idx % 2 = 0")                                      # a pixel may be missing as a row, too
    b0, b1 = int((lats[0] + 90) * 60), int((lons[0] + 180) * 60)
    cells = {(b0 + pick.randint(-2, int(37 * step * 60) + 2), b1 + pick.randint(-2, int(29 * step * 60) + 2)) for _ in range(60)}
    store = T.write_store(px)
    assert store.tiles.count() > 1 or tile == 64
    wanted = spark.createDataFrame(sorted(cells), "lat_bin bigint, lon_bin bigint").selectExpr("'g' AS product_name", "false AS turned", "*")
    methods = ["center_nearest", "center_bilinear", "cell_median", "cell_mean"]
    got = {(r["lat_bin"], r["lon_bin"], r["method"]): r["raw_z"] for r in T.sample(wanted, store, methods).collect()}
    assert len(got) == len(cells) * len(methods)
    for a, b in cells:
        for m, want in plain(lats, lons, z, a, b, falling).items():
            value = got[a, b, m]
            assert value is None if np.isnan(want) else value == pytest.approx(want), (a, b, m)


def test_only_tiles_with_cells_are_read(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 4)
    lats, lons = 10 + 0.1 * np.arange(80), 20 + 0.1 * np.arange(3)
    store = T.write_store(grid(spark, lats, lons, np.ones((80, 3))))
    cells = spark.createDataFrame([("g", False, int(100.05 * 60), int(200.12 * 60))], "product_name string, turned boolean, lat_bin bigint, lon_bin bigint")
    out = T.sample(cells, store, ["center_nearest", "center_bilinear"])
    assert [r["raw_z"] for r in out.collect()] == [1.0, 1.0]
    plan = out._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "dynamicpruning" in text.lower()
    assert len(re.findall(r"Scan parquet .*\bz#", text.split("== Initial Plan")[0])) == 1              # one pass for both methods


def test_axes_come_from_the_axis_table(spark):
    store = T.write_store(grid(spark, [3.0, 2.0, 0.5], [10.0, 11.0], np.ones((3, 2))))
    rows = {r["axis"]: r for r in R.axis_check(store).collect()}
    assert (rows["lat"]["n_lines"], rows["lat"]["ascending"], rows["lat"]["is_monotonic"], rows["lat"]["median_step"]) == (3, False, True, -1.25)
    assert (rows["lon"]["n_lines"], rows["lon"]["ascending"], rows["lon"]["median_step"]) == (2, True, 1.0)
    assert "row_idx" not in R.axis_check(store)._jdf.queryExecution().optimizedPlan().toString()


def _ship(spark, bins):
    cells = spark.createDataFrame(bins, "lat_bin bigint, lon_bin bigint")
    return geo.with_cell_geometry(cells).withColumns({"ship_elev_m": F.lit(3.0), "ship_depth_m": F.lit(-3.0)})


def test_a_product_that_fails_while_it_runs_leaves_the_others(spark):
    base = {"sampling_method": "center_nearest", "z_convention": "elevation_negative_ocean", "lon_convention": "-180_180"}
    px = grid(spark, [10.0, 10.1], [20.0, 20.1], np.ones((2, 2)), z_name="z_raw")
    px = px.unionByName(px.withColumn("product_name", F.lit("bad"))).unionByName(px.withColumn("product_name", F.lit("late")))
    broken = F.when(F.col("product_name") == "bad", F.raise_error(F.lit("broken pixel")).cast("double")).otherwise(F.col("z_raw"))
    conf = R.load_products([{"name": n, **base} for n in ("good", "bad", "late")])
    good = px.where("product_name = 'late'").withColumn("product_name", F.lit("good"))
    cells = _ship(spark, [(6001, 12001), (6004, 12003)])
    alone, _ = R.validate_products(cells, good, conf[:1])
    rows, status = R.validate_products(cells, px.unionByName(good).withColumn("z_raw", broken), conf)
    found = {r["product_name"]: (r["status"], r["reason"]) for r in status.collect()}
    assert found["good"] == ("ok", "") and found["late"] == ("ok", "") and found["bad"][0] == "error" and "broken pixel" in found["bad"][1]
    columns = ["lat_bin", "lon_bin", "raw_z", "elev_error_m"]
    assert {tuple(r) for r in rows.where("product_name = 'good'").select(*columns).collect()} == {tuple(r) for r in alone.select(*columns).collect()}
    assert rows.select("product_name").distinct().count() == 2


def test_rows_without_a_failed_product_are_no_result(spark):
    from types import SimpleNamespace

    from leadline.plans.stages import Products
    base = {"sampling_method": "center_nearest", "z_convention": "elevation_negative_ocean", "lon_convention": "-180_180"}
    px = grid(spark, [10.0, 10.1], [20.0, 20.1], np.ones((2, 2)), name="grid_a", z_name="z_raw")
    px = px.unionByName(px.withColumn("product_name", F.lit("bad")))
    broken = F.when(F.col("product_name") == "bad", F.raise_error(F.lit("broken pixel")).cast("double")).otherwise(F.col("z_raw"))
    cells = _ship(spark, [(6001, 12001), (6004, 12003)])
    p = Products.__new__(Products)
    p.__dict__ |= {"spark": spark, "survey": SimpleNamespace(primary_t=cells), "tables_t": dict.fromkeys(("strict", "expanded"), cells.withColumn("representative_depth_m", F.col("ship_depth_m"))),
                   "grids": R.load_products([{"name": n, **base} for n in ("grid_a", "bad")]), "pixels": px.withColumn("z_raw", broken), "stores": {}}
    for name in ("survey_by_cell", "survey_by_cell_t", "strict_by_cell", "strict_by_cell_t", "expanded_by_cell", "expanded_by_cell_t", "metrics"):
        with pytest.raises(RuntimeError, match="bad.*broken pixel"):
            getattr(p, name)
    rows, status = p.strict_run                                                            # the status table goes on with the others
    assert {r["product_name"]: (r["status"], r["rows_processed"]) for r in R.product_status(rows, status).collect()} == {"grid_a": ("ok", 2), "bad": ("error", 0)}
    with pytest.raises(RuntimeError):
        p.strict_by_cell
    p.pixels = px                                                                          # a failed run is not remembered
    assert p.survey_by_cell.count() == p.strict_by_cell_t.count() == p.expanded_by_cell_t.count() == 4


def test_a_batch_is_one_job_whatever_its_experiments(spark):
    lats, lons = 10 + 0.02 * np.arange(12), 20 + 0.02 * np.arange(12)
    one = grid(spark, lats, lons, -1000 + np.add.outer(np.arange(12.0), np.arange(12.0)))
    many = one.drop("product_name").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumns({"product_name": F.concat(F.lit("e"), "k"), "z": F.col("z") - F.col("k")})
    cells = _ship(spark, [(6000 + i, 12000 + j) for i in range(2, 10) for j in range(2, 10)])
    box = {"lon_min": 19.0, "lon_max": 21.0, "lat_min": 9.0, "lat_max": 11.0}
    got = {r["experiment"]: r for r in R.validate_batch(cells, many, [f"e{k}" for k in range(200)], box).collect()}
    assert len(got) == 200 and got["e7"]["bias_m"] == pytest.approx(got["e0"]["bias_m"] + 7) and {r["n_cells"] for r in got.values()} == {64}

    def nodes(n):
        store = T.write_store(many.where(f"k < {n}"))
        wanted = cells.select(F.explode(F.array(*[F.lit(f"e{k}") for k in range(n)])).alias("product_name"), F.lit(False).alias("turned"), "lat_bin", "lon_bin")
        return T.sample(wanted, store, ["center_bilinear"])._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert nodes(2) == nodes(150)
