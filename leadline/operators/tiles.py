"""Gridded products stored as tiles of pixels with an axis table, and read where cells need them.

The store is written once. Axis lines are numbered by rising coordinate; a tile holds TILE lines each way, and a margin of the
following ones that is as wide as the widest window of a cell, so all pixels of a cell lie in one tile. Cells name their
tile, only rows of tiles that are named are read, and one pass over the tiles yields the values of all methods.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage, fresh_path
from .cells import CELL

CELL_DEG = 1.0 / 60.0
HALF_CELL = CELL_DEG / 2.0
#: Lines of a tile, each way, without its margin; a product with more lines in a cell has larger tiles.
TILE = 64
#: Cells of one tile are gathered in blocks of so many bins each way.
BLOCK = 64
_TILES = "product_name string, tile_row int, tile_col int, row0 long, col0 long, width int, z array<double>"
_KEY = ["product_name", "axis"]


@dataclass(frozen=True)
class Store:
    """tiles: product_name, tile_row, tile_col, row0, col0, width, z. axes: one row for each grid line."""
    tiles: DataFrame
    axes: DataFrame


def axis_lines(pixels: DataFrame) -> DataFrame:
    """product_name, axis, idx, coord, ord (by rising coordinate), n, ascending, step (to the line before by idx), margin.

    An axis has at most 86,400 lines at 15 arc-seconds, and one task orders each axis. `margin` is the largest number of lines
    in the length of a cell, and three more.
    """
    both = F.explode(F.array(F.struct(F.lit("lat").alias("axis"), F.col("row_idx").alias("idx"), F.col("lat").alias("coord")),
                             F.struct(F.lit("lon").alias("axis"), F.col("col_idx").alias("idx"), F.col("lon").alias("coord"))))
    lines = pixels.select("product_name", both.alias("s")).groupBy("product_name", "s.axis", "s.idx").agg(F.min("s.coord").alias("coord"))
    w = Window.partitionBy(*_KEY)
    near = F.expr(f"count(*) OVER (PARTITION BY product_name, axis ORDER BY coord RANGE BETWEEN CURRENT ROW AND {CELL_DEG!r}D FOLLOWING)")
    out = lines.withColumns({
        "ord": (F.row_number().over(w.orderBy("coord", "idx")) - 1).cast("bigint"), "n": F.count(F.lit(1)).over(w),
        "ascending": F.min_by("coord", "idx").over(w) < F.max_by("coord", "idx").over(w),
        "step": F.col("coord") - F.lag("coord").over(w.orderBy("idx")), "near": near})
    return out.withColumn("margin", (F.max("near").over(w) + 3).cast("bigint")).drop("near")


def write_store(pixels: DataFrame) -> Store:
    """Writes decoded pixels (product_name, row_idx, col_idx, lat, lon, z) of any number of products as tiles.

    Pixels that a product lacks are missing values. Tiles lie in folders by product and tile row.
    """
    spark = pixels.sparkSession
    axes = cut_lineage(axis_lines(pixels), "grid-axes")

    def side(axis: str, idx: str, prefix: str) -> DataFrame:
        return axes.where(F.col("axis") == axis).select("product_name", F.col("idx").alias(idx), F.col("ord").alias(f"{prefix}"), F.col("margin").alias(f"{prefix}_margin"))

    def tiles_of(prefix: str, name: str) -> Column:
        size = F.greatest(F.lit(TILE), F.col(f"{prefix}_margin"))
        own = F.floor(F.col(prefix) / size).cast("int")
        shared = (own > 0) & (F.col(prefix) % size < F.col(f"{prefix}_margin"))
        return F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))).alias(name)

    at = pixels.select("product_name", "row_idx", "col_idx", "z").join(side("lat", "row_idx", "r"), ["product_name", "row_idx"]).join(side("lon", "col_idx", "c"), ["product_name", "col_idx"])
    at = at.select("*", tiles_of("r", "tile_row")).select("*", tiles_of("c", "tile_col"))
    at = at.select("product_name", "tile_row", "tile_col", "r", "c", "z", (F.col("tile_row") * F.greatest(F.lit(TILE), "r_margin")).cast("bigint").alias("row0"),
                   (F.col("tile_col") * F.greatest(F.lit(TILE), "c_margin")).cast("bigint").alias("col0"))
    path = fresh_path(spark, "grid-tiles")
    at.groupBy("product_name", "tile_row", "tile_col").applyInArrow(_tile, _TILES).write.partitionBy("product_name", "tile_row").parquet(path)
    return Store(spark.read.schema(_TILES).parquet(path), axes)


def _tile(group: pa.Table) -> pa.Table:
    """One tile, at most (2 * TILE) ** 2 pixels unless a cell holds more lines than that."""
    row0, col0 = group.column("row0")[0].as_py(), group.column("col0")[0].as_py()
    r, c = group.column("r").to_numpy() - row0, group.column("c").to_numpy() - col0
    width = int(c.max()) + 1
    z = np.full((int(r.max()) + 1) * width, np.nan)
    z[r * width + c] = group.column("z").to_numpy()         # a missing value is NaN here
    values = pa.array(z, mask=np.isnan(z))
    first = group.slice(0, 1)
    return pa.table({"product_name": first.column("product_name"), "tile_row": first.column("tile_row"), "tile_col": first.column("tile_col"),
                     "row0": pa.array([row0], pa.int64()), "col0": pa.array([col0], pa.int64()), "width": pa.array([width], pa.int32()),
                     "z": pa.ListArray.from_arrays(pa.array([0, len(z)], pa.int32()), values)})


def axis_check(store: Store) -> DataFrame:
    """Both axes of every product: lines, direction, strict monotonicity and median step."""
    return store.axes.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n_lines"), F.bool_or("ascending").alias("ascending"),
        ((F.coalesce(F.min("step"), F.lit(0.0)) > 0) | (F.coalesce(F.max("step"), F.lit(0.0)) < 0)).alias("is_monotonic"), F.median("step").alias("median_step"))        # at most 86,400 lines in a group


def find_lines(cells: DataFrame, store: Store) -> DataFrame:
    """Per product, axis and cell row or column: the ordinals of all lines that any method uses there.

    cells: product_name, turned (longitudes from 0 to 360), lat_bin, lon_bin. left and right enclose the centre, clamped to the
    axis, `t` is the centre's place between them, `inside` whether it lies on the axis; near is the nearest line (the lower
    coordinate wins a tie); lo to hi are the lines inside the cell, [c-h, c+h) on a rising and (c-h, c+h] on a falling axis, or
    the nearest one if there is none; step_lo to step_hi is the older window of a fixed number of lines. Centres and edges are
    found in one sorted pass over each axis and its at most 21,600 cell rows or columns.
    """
    lon = geo.lon_center("lon_bin")
    both = F.explode(F.array(F.struct(F.lit("lat").alias("axis"), F.col("lat_bin").alias("bin"), geo.lat_center("lat_bin").alias("q")),
                             F.struct(F.lit("lon").alias("axis"), F.col("lon_bin").alias("bin"), F.when(F.col("turned"), F.pmod(lon, F.lit(360.0))).otherwise(lon).alias("q"))))
    facts = store.axes.groupBy(*_KEY).agg(F.max("n").alias("n"), F.bool_or("ascending").alias("ascending"), F.min("coord").alias("first"), F.max("coord").alias("last"),
                                          F.max("margin").alias("margin"), F.abs(F.median("step")).alias("step"))
    wanted = cells.select("product_name", both.alias("s")).select("product_name", "s.*").distinct().join(facts, _KEY)
    edge = F.when(F.col("ascending"), 0).otherwise(2)       # before or behind a line of the same coordinate
    marks = F.explode(F.array(F.struct(F.lit("mid").alias("kind"), F.col("q").alias("x"), F.lit(0).alias("side")),
                              F.struct(F.lit("from").alias("kind"), (F.col("q") - HALF_CELL).alias("x"), edge.alias("side")),
                              F.struct(F.lit("to").alias("kind"), (F.col("q") + HALF_CELL).alias("x"), edge.alias("side"))))
    searched = wanted.select(*_KEY, "bin", marks.alias("s")).select(*_KEY, "bin", "s.*", F.lit(0).alias("line"))
    lines = store.axes.select(*_KEY, F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("string").alias("kind"), F.col("coord").alias("x"), F.lit(1).alias("side"), F.lit(1).alias("line"))
    upto = Window.partitionBy(*_KEY).orderBy("x", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    smaller = searched.unionByName(lines).withColumn("smaller", F.sum("line").over(upto)).where("line = 0")
    found = smaller.groupBy(*_KEY, "bin").agg(*[F.max(F.when(F.col("kind") == k, F.col("smaller"))).alias(k) for k in ("mid", "from", "to")])
    found = wanted.join(found, [*_KEY, "bin"])
    found = found.withColumn("left", F.greatest(F.lit(0), F.least(F.col("mid") - 1, F.col("n") - 2)).cast("bigint"))
    found = found.withColumn("right", F.least(F.col("left") + 1, F.col("n") - 1))
    for place in ("left", "right"):
        found = found.join(store.axes.select(*_KEY, F.col("ord").alias(place), F.col("coord").alias(f"{place}_x")), [*_KEY, place])
    gap = F.col("right_x") - F.col("left_x")
    half = F.floor(F.greatest(F.lit(1), F.round(F.lit(CELL_DEG) / F.col("step"))) / 2).cast("bigint")
    at = F.least(F.col("mid"), F.col("n") - 1)
    found = found.withColumns({
        "inside": F.col("q").between(F.col("first"), F.col("last")), "t": F.when(gap > 0, (F.col("q") - F.col("left_x")) / gap).otherwise(F.lit(0.0)),
        "near": F.when(F.abs(F.col("q") - F.col("left_x")) <= F.abs(F.col("q") - F.col("right_x")), F.col("left")).otherwise(F.col("right")),
        "single": F.coalesce(F.round(F.lit(CELL_DEG) / F.col("step")) <= 1, F.lit(True))})
    found = found.withColumns({
        "lo": F.when(F.col("to") > F.col("from"), F.col("from")).otherwise(F.col("near")), "hi": F.when(F.col("to") > F.col("from"), F.col("to") - 1).otherwise(F.col("near")),
        "step_lo": F.coalesce(F.greatest(at - half, F.lit(0)), "near"), "step_hi": F.coalesce(F.least(at + half, F.col("n") - 1), "near")})
    low = F.least("left", "near", "lo", "step_lo")
    return found.select(*_KEY, "bin", "inside", "single", "t", "left", "right", "near", "lo", "hi", "step_lo", "step_hi",
                        F.floor(low / F.greatest(F.lit(TILE), F.col("margin"))).cast("int").alias("tile"))


def _nearest(x: Column, pixel, window) -> Column:
    return pixel(x["r"]["near"], x["c"]["near"])


def _bilinear(x: Column, pixel, window) -> Column:
    """Missing outside the grid and where a corner is missing."""
    t, u = x["r"]["t"], x["c"]["t"]
    parts = [pixel(x["r"][a], x["c"][b]) * (t if a == "right" else 1.0 - t) * (u if b == "right" else 1.0 - u) for a in ("left", "right") for b in ("left", "right")]
    return F.when(x["r"]["inside"] & x["c"]["inside"], sum(parts[1:], parts[0]))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _inside(how):
    return lambda x, pixel, window: how(window(x, "lo", "hi"))


def _steps(how):
    return lambda x, pixel, window: F.when(x["r"]["single"] & x["c"]["single"], pixel(x["r"]["near"], x["c"]["near"])).otherwise(how(window(x, "step_lo", "step_hi")))


METHODS = {"center_nearest": _nearest, "center_bilinear": _bilinear, "cell_median": _inside(_median), "cell_mean": _inside(_mean),
           "step_median": _steps(_median), "step_mean": _steps(_mean)}


def sample(cells: DataFrame, store: Store, methods: Sequence[str]) -> DataFrame:
    """product_name, lat_bin, lon_bin, method, raw_z for each cell and method, from one pass over the tiles that cells lie in.

    cells: distinct product_name, turned, lat_bin, lon_bin. The cells of a tile, in blocks of at most BLOCK bins each way, meet
    the tile in one row and pick their pixels from its array.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown sampling method {unknown[0]!r}")
    lines = find_lines(cells, store)
    kept = [c for c in lines.columns if c not in (*_KEY, "bin", "tile")]

    def side(axis: str, b: str, prefix: str) -> DataFrame:
        return lines.where(F.col("axis") == axis).select("product_name", F.col("bin").alias(b), F.struct(*kept).alias(prefix), F.col("tile").alias({"r": "tile_row", "c": "tile_col"}[prefix]))

    at = cells.select("product_name", *CELL).join(side("lat", "lat_bin", "r"), ["product_name", "lat_bin"]).join(side("lon", "lon_bin", "c"), ["product_name", "lon_bin"])
    key = ["product_name", "tile_row", "tile_col"]
    blocks = at.groupBy(*key, F.floor(F.col("lat_bin") / BLOCK).alias("b0"), F.floor(F.col("lon_bin") / BLOCK).alias("b1")).agg(F.collect_list(F.struct(*CELL, "r", "c")).alias("cells"))
    rows = F.broadcast(lines.where("axis = 'lat'").select("product_name", F.col("tile").alias("tile_row")).distinct())   # lines / TILE, at most 1,350 for each product
    met = blocks.join(store.tiles.join(rows, ["product_name", "tile_row"], "left_semi"), key, "left")

    def pixel(r: Column, c: Column) -> Column:
        return F.get("z", ((r - F.col("row0")) * F.col("width") + c - F.col("col0")).cast("int"))

    def window(x: Column, low: str, high: str) -> Column:
        r, c = x["r"], x["c"]
        n = (c[high] - c[low] + 1).cast("int")
        return F.array_compact(F.flatten(F.transform(F.sequence(r[low], r[high]), lambda i: F.slice("z", ((i - F.col("row0")) * F.col("width") + c[low] - F.col("col0") + 1).cast("int"), n))))

    def picked(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in CELL], F.array(*[F.struct(F.lit(m).alias("method"), METHODS[m](x, pixel, window).alias("raw_z")) for m in methods]).alias("values"))

    out = met.select("product_name", F.explode(F.transform("cells", picked)).alias("s")).select("product_name", "s.lat_bin", "s.lon_bin", F.explode("s.values").alias("v"))
    return out.select("product_name", *CELL, "v.*")
