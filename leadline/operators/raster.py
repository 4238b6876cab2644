"""Gridded products as pixel tables, sampled at 1-arc-minute cells.

Pixels: (product_name, row_idx, col_idx, lat, lon, z).  They are sampled from a tiled store (`tiles.py`), which is written
once per product; functions that take pixels write it, those that get a store read it.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins, geo
from ..session import cut_lineage, together
from . import tiles
from .cells import CELL
from .tables import union_all
from .tiles import Store

SENSITIVITY = "center_bilinear_sensitivity"
CELL_METHODS = {"cell_median": "median", "cell_mean": "mean"}


@dataclass(frozen=True)
class Product:
    name: str
    sampling_method: str = "center_bilinear"
    z_convention: str = "elevation_negative_ocean"
    lon_convention: str = "-180_180"
    footprint: dict | None = None
    fill_value: float | None = None
    scale: float = 1.0
    offset: float = 0.0
    enabled: bool = True
    extra: dict = field(default_factory=dict)


def load_products(conf: Sequence[dict], name: str | None = None) -> list[Product]:
    """Enabled products of a configuration, filtered by name; a missing or unknown field is an error."""
    out = []
    for row in conf:
        missing = [k for k in ("name", "sampling_method", "z_convention", "lon_convention") if k not in row]
        if missing:
            raise ValueError(f"product configuration lacks {missing}")
        box = row.get("footprint")
        if box and {"lon_min", "lon_max", "lat_min", "lat_max"} - set(box):
            raise ValueError(f"footprint of {row['name']} is incomplete")
        p = Product(**row)
        if p.enabled and (name is None or p.name == name):
            out.append(p)
    return out


def decode_pixels(pixels: DataFrame, product: Product, raw: str = "z_raw") -> DataFrame:
    """Pixels of one product with the fill value removed, then scale and offset applied."""
    z = F.col(raw)
    if product.fill_value is not None:
        z = F.nullif(z, F.lit(float(product.fill_value)))
    if product.scale != 1.0 or product.offset != 0.0:
        z = z * product.scale + product.offset
    return pixels.where(F.col("product_name") == product.name).select(
        "product_name", "row_idx", "col_idx", "lat", "lon", geo.nan_to_null(z).alias("z"))


def axis_table(pixels: DataFrame, which: str) -> DataFrame:
    """One coordinate axis: index, coordinate, ordinal by rising coordinate and length.

    An axis has at most 86,400 lines at 15 arc-seconds, so one task orders it once the pixels are combined.
    """
    idx, coord = ("row_idx", "lat") if which == "lat" else ("col_idx", "lon")
    line = pixels.groupBy(F.col(idx).alias("idx")).agg(F.min(coord).alias("coord"))
    w = Window.partitionBy(F.lit(1))
    return line.withColumns({
        "ord": (F.row_number().over(w.orderBy("coord")) - 1).cast("bigint"), "n": F.count(F.lit(1)).over(w),
        "ascending": F.min_by("coord", "idx").over(w) < F.max_by("coord", "idx").over(w)})


def axis_check(pixels: DataFrame | Store) -> DataFrame:
    """Both axes of a product: lines, direction, strict monotonicity and median step, from the axis table."""
    return tiles.axis_check(stored(pixels)).drop("product_name")


def stored(pixels: DataFrame | Store) -> Store:
    """The pixels as a tiled store, written here unless they are one."""
    return pixels if isinstance(pixels, Store) else tiles.write_store(pixels)


def bracket(axis: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (`bin`, coordinate `q`) the two axis lines around it.

    `before` counts the lines with a smaller coordinate; left and right are the two lines that
    interpolation uses, clamped to the axis, and `inside` says whether the target lies on the axis.
    One sorted pass over two short tables, then joins on the line's ordinal.
    """
    both = axis.select(F.col("coord").alias("q"), F.lit(1).alias("line"), F.lit(None).cast("bigint").alias("bin")).unionByName(
        targets.select("q", F.lit(0).alias("line"), F.col("bin").cast("bigint").alias("bin")))
    whole = Window.partitionBy(F.lit(1))
    # a target sorts before a line at the same coordinate, so the running count is of smaller lines only
    upto = whole.orderBy("q", "line").rowsBetween(Window.unboundedPreceding, 0)
    on_axis = F.when(F.col("line") == 1, F.col("q"))
    found = both.withColumns({
        "before": F.sum("line").over(upto).cast("bigint"), "n": F.sum("line").over(whole).cast("bigint"),
        "inside": F.col("q").between(F.min(on_axis).over(whole), F.max(on_axis).over(whole))}).where("line = 0").drop("line")
    left = F.greatest(F.lit(0), F.least(F.col("before") - 1, F.col("n") - 2)).cast("bigint")
    found = found.withColumn("left", left).withColumn("right", F.least(F.col("left") + 1, F.col("n") - 1))
    for side in ("left", "right"):
        lines = axis.select(F.col("ord").alias(side), F.col("idx").alias(f"{side}_idx"), F.col("coord").alias(f"{side}_x"))
        found = found.join(lines, side)
    return found


def _sample(cells: DataFrame, pixels: DataFrame | Store, product: Product, methods: Sequence[str]) -> DataFrame:
    """Cells with method and raw_z of one product; cells beside the stored grid have missing values."""
    turned = F.lit(product.lon_convention == "0_360")
    wanted = cells.select(F.lit(product.name).alias("product_name"), turned.alias("turned"), *CELL).distinct()
    return tiles.sample(wanted, stored(pixels), methods).drop("product_name")


def sample_nearest(cells: DataFrame, pixels: DataFrame | Store, product: Product) -> DataFrame:
    """z of the pixel nearest to the cell centre."""
    return _sample(cells, pixels, product, ["center_nearest"]).drop("method")


def sample_bilinear(cells: DataFrame, pixels: DataFrame | Store, product: Product) -> DataFrame:
    """Bilinear z at the cell centre; missing outside the grid and where a corner is missing."""
    return _sample(cells, pixels, product, ["center_bilinear"]).drop("method")


def sample_cell_agg(cells: DataFrame, pixels: DataFrame | Store, product: Product, how: str = "median") -> DataFrame:
    """Median or mean of the pixels inside each cell, missing pixels ignored; the nearest line where a cell holds none."""
    return _sample(cells, pixels, product, [f"cell_{how}"]).drop("method")


def sample_index_window(cells: DataFrame, pixels: DataFrame | Store, product: Product, how: str = "median") -> DataFrame:
    """The older window: a fixed number of index steps around the insertion point of the centre.

    The nearest pixel is taken where a window would be one pixel.
    """
    return _sample(cells, pixels, product, [f"step_{how}"]).drop("method")


def sample_product(cells: DataFrame, pixels: DataFrame | Store, product: Product, sensitivity: bool = True) -> DataFrame:
    """By the configured method; cell methods are also sampled bilinearly, in the same pass, as a sensitivity check."""
    m = product.sampling_method
    if m not in (*CELL_METHODS, "center_bilinear", "center_nearest"):
        raise ValueError(f"unknown sampling method {m!r}")
    extra = sensitivity and m in CELL_METHODS
    out = _sample(cells, pixels, product, [m, "center_bilinear"] if extra else [m])
    named = F.when(F.col("method") == m, m).otherwise(SENSITIVITY)
    return out.withColumn("sampling_method", named).drop("method")


def apply_z(df: DataFrame, z_convention: str, raw: str = "raw_z") -> DataFrame:
    elev = -F.col(raw) if z_convention == "depth_positive_down" else F.col(raw)
    return df.withColumn("model_elev_m", elev).withColumn("model_depth_m", -F.col("model_elev_m"))


def with_errors(df: DataFrame) -> DataFrame:
    """Model minus ship, in elevation and in depth."""
    e = F.col("model_elev_m") - F.col("ship_elev_m")
    return df.withColumns({"elev_error_m": e, "depth_error_m": F.col("model_depth_m") - F.col("ship_depth_m"),
                           "abs_elev_error_m": F.abs(e)})


def by_cell(cells: DataFrame, pixels: DataFrame | Store, product: Product, sensitivity: bool = True) -> DataFrame:
    """By-cell validation of one product inside its footprint."""
    inside = cells.where(geo.in_footprint("lon_center", "lat_center", product.footprint))
    sampled = sample_product(inside.select(*CELL).distinct(), pixels, product, sensitivity)
    out = with_errors(apply_z(inside.join(sampled, CELL), product.z_convention))
    return out.withColumns({
        "product_name": F.lit(product.name), "config_sampling_method": F.lit(product.sampling_method),
        "z_convention": F.lit(product.z_convention), "lon_convention": F.lit(product.lon_convention),
        "depth_bin_label": bins.depth_bin_metric("ship_depth_m"), "lat_band_10deg": geo.lat_band("lat_center"),
        "region_10deg": geo.region_10deg("lon_center", "lat_center")})


def validate_products(cells: DataFrame, pixels: DataFrame, products: Sequence[Product], raw: str = "z_raw", global_run: bool = False, sensitivity: bool = True,
                      stores: dict[str, Store] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Every enabled product as a stage of its own, their union, and one status row per product.

    A product without pixels is skipped, as is a regional one in a global run. One that fails, while it is planned or while it
    runs, becomes an error row; the others are not touched. The rows are those of the products that ended, so whoever reads them
    without the status takes them by `whole`. `stores` keeps tiled products for further calls.
    """
    spark, stores = cells.sparkSession, {} if stores is None else stores

    def one(p: Product) -> tuple[str, str, DataFrame | None]:
        if global_run and p.footprint:
            return "skipped", "regional footprint in a global run", None
        try:
            if p.name not in stores:
                stores[p.name] = tiles.write_store(decode_pixels(pixels, p, raw))
            if stores[p.name].axes.isEmpty():
                return "skipped", "no pixels", None
            return "ok", "", cut_lineage(by_cell(cells, stores[p.name], p, sensitivity), f"by-cell-{p.name}")
        except (ValueError, PySparkException, Py4JError) as e:
            return "error", str(e).splitlines()[0], None

    done = together(spark, *[lambda p=p: one(p) for p in products])
    table = spark.createDataFrame([(p.name, s, why) for p, (s, why, _) in zip(products, done, strict=True)], "product_name string, status string, reason string")
    parts = [rows for _, _, rows in done if rows is not None]
    return (union_all(parts) if parts else None), table


def whole(run: tuple[DataFrame | None, DataFrame]) -> DataFrame:
    """The rows of a run of validate_products in which no product failed; without the rows of one they would look like all results."""
    rows, status = run
    failed = [f"{r['product_name']}: {r['reason']}" for r in status.where("status = 'error'").collect()]
    if failed or rows is None:
        raise RuntimeError(f"products failed: {'; '.join(failed)}" if failed else "no product was validated")
    return rows


def product_status(by_cells: DataFrame, status: DataFrame) -> DataFrame:
    """Sampled, valid and missing rows of each product next to its status."""
    counts = by_cells.where(F.col("sampling_method") == F.col("config_sampling_method")).groupBy("product_name").agg(
        F.count(F.lit(1)).alias("rows_processed"), F.count("model_elev_m").alias("valid_count"),
        F.count_if(F.col("model_elev_m").isNull()).alias("nodata_count"))
    zero = F.lit(0).cast("bigint")
    return status.join(counts, "product_name", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("rows_processed", "valid_count", "nodata_count")})


def reconstruct(prediction: DataFrame, raw: DataFrame, bandpass: DataFrame) -> DataFrame:
    """Absolute depth from a band-pass prediction: prediction + (raw - bandpass), pixel by pixel."""
    key = ["row_idx", "col_idx"]
    low = raw.select(*key, F.col("z").alias("__raw")).join(bandpass.select(*key, F.col("z").alias("__band")), key)
    return prediction.join(low, key).withColumn("z", F.col("z") + (F.col("__raw") - F.col("__band"))).drop("__raw", "__band")


def reconstruct_resampled(prediction: DataFrame, raw: DataFrame, bandpass: DataFrame) -> DataFrame:
    """The same for grids of unequal shape: the low-pass grid is sampled bilinearly at the prediction's pixels.

    Grid lines are matched on the axis tables; every pixel then joins four low-pass pixels.  Beyond the
    low-pass grid the edge interval is extended, as linear interpolation without a bound does.
    """
    key = ["row_idx", "col_idx"]
    low = raw.select(*key, "lat", "lon", F.col("z").alias("__raw")).join(
        bandpass.select(*key, F.col("z").alias("__band")), key).select(
        *key, "lat", "lon", (F.col("__raw") - F.col("__band")).alias("z"))

    def sides(which: str, idx: str, prefix: str) -> DataFrame:
        target = axis_table(prediction, which).select(F.col("idx").alias("bin"), F.col("coord").alias("q"))
        f = bracket(axis_table(low, which), target)
        t = (F.col("q") - F.col("left_x")) / (F.col("right_x") - F.col("left_x"))
        return F.broadcast(f.select(F.col("bin").alias(idx), F.col("left_idx").alias(f"{prefix}0"),
                                    F.col("right_idx").alias(f"{prefix}1"), t.alias(f"{prefix}t")))

    at = prediction.join(sides("lat", "row_idx", "r"), "row_idx").join(sides("lon", "col_idx", "c"), "col_idx")
    corners = F.array(*[F.struct(
        F.col(f"r{i}").alias("lr"), F.col(f"c{j}").alias("lc"),
        ((F.col("rt") if i else 1.0 - F.col("rt")) * (F.col("ct") if j else 1.0 - F.col("ct"))).alias("w"))
        for i in (0, 1) for j in (0, 1)])
    long = at.select(*prediction.columns, F.explode(corners).alias("k")).select(*prediction.columns, "k.*")
    grid = low.select(F.col("row_idx").alias("lr"), F.col("col_idx").alias("lc"), F.col("z").alias("__low"))
    hit = long.join(grid, ["lr", "lc"], "left").groupBy(*prediction.columns).agg(
        F.sum(F.col("w") * F.col("__low")).alias("__s"), F.count("__low").alias("__n"))
    return hit.withColumn("z", F.when(F.col("__n") == 4, F.col("z") + F.col("__s"))).drop("__s", "__n")


def validate_batch(cells: DataFrame, predictions: DataFrame, experiments: Sequence[str], footprint: dict | None,
                   min_valid: int = 10) -> DataFrame:
    """Many predictions on one footprint, bilinearly; experiments with too few valid samples are left out.

    The experiment is part of every key, so axes, tiles, samples and metrics of all of them are one job each.
    """
    from .metrics import batch_metrics
    inside = cells.where(geo.in_footprint("lon_center", "lat_center", footprint))
    store = tiles.write_store(predictions.where(F.col("product_name").isin(list(experiments))).select("product_name", "row_idx", "col_idx", "lat", "lon", "z"))
    names = F.explode(F.array(*[F.lit(e) for e in experiments])).alias("product_name")
    wanted = inside.select(*CELL).distinct().select(names, F.lit(False).alias("turned"), *CELL)
    sampled = tiles.sample(wanted, store, ["center_bilinear"]).withColumnRenamed("product_name", "experiment").drop("method")
    rows = inside.join(sampled, CELL).withColumn("error_m", -F.col("raw_z") - F.col("ship_depth_m"))
    return batch_metrics(rows, min_valid)
