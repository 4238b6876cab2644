"""Positions, 1-arc-minute cells, 10-degree bands and spatial blocks as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the cell geometry.
CELLS_PER_DEGREE = 60.0
LON_BIN_SPAN = 21601          # 360 * 60 + 1, so that the inclusive upper bound packs too
KM_PER_DEGREE = 111.32


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """False for NaN, which is larger than all other values, and for infinities; missing for a missing value."""
    return F.abs(as_col(c)) < F.lit(float("inf"))


def nan_to_null(c: Column | str) -> Column:
    return F.when(finite(c), as_col(c))


def wrap_lon(c: Column | str) -> Column:
    """Wrap any longitude into [-180, 180)."""
    return F.pmod(as_col(c) + 180.0, F.lit(360.0)) - 180.0


def shift_lon(c: Column | str) -> Column:
    """Move only longitudes above 180 back by a full turn, giving (-180, 180]."""
    c = as_col(c)
    return F.when(c > 180.0, c - 360.0).otherwise(c)


def clean_lat(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c.between(-90.0, 90.0), c)


def lon_bin(lon: Column | str) -> Column:
    return F.floor((as_col(lon) + 180.0) * CELLS_PER_DEGREE).cast("bigint")


def lat_bin(lat: Column | str) -> Column:
    return F.floor((as_col(lat) + 90.0) * CELLS_PER_DEGREE).cast("bigint")


def lon_center(b: Column | str) -> Column:
    return F.lit(-180.0) + (as_col(b) + 0.5) / CELLS_PER_DEGREE


def lat_center(b: Column | str) -> Column:
    return F.lit(-90.0) + (as_col(b) + 0.5) / CELLS_PER_DEGREE


def cell_id(lat_b: Column | str, lon_b: Column | str) -> Column:
    return F.concat(F.lit("1min_"), as_col(lat_b).cast("string"), F.lit("_"), as_col(lon_b).cast("string"))


def cell_key(lat_b: Column | str, lon_b: Column | str) -> Column:
    """Both bins packed into one BIGINT."""
    return as_col(lat_b) * F.lit(LON_BIN_SPAN).cast("bigint") + as_col(lon_b)


def cell_key_lat(key: Column | str) -> Column:
    return F.floor(as_col(key) / LON_BIN_SPAN).cast("bigint")


def cell_key_lon(key: Column | str) -> Column:
    return F.pmod(as_col(key), F.lit(LON_BIN_SPAN).cast("bigint"))


def with_bins(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The two BIGINT bins that every cell-level group-by and join is keyed on."""
    return df.withColumns({"lon_bin": lon_bin(lon), "lat_bin": lat_bin(lat)})


def with_cell_geometry(df: DataFrame) -> DataFrame:
    """Derive the printable id and the centre from the bins; done after aggregation, never before."""
    return df.withColumns({
        "cell_id": cell_id("lat_bin", "lon_bin"),
        "lon_center": lon_center("lon_bin"),
        "lat_center": lat_center("lat_bin"),
    })


def lat_band(lat: Column | str) -> Column:
    """Lower edge of the 10-degree band, the pole folded into the last band."""
    c = as_col(lat)
    edge = (F.floor(c / 10.0) * 10).cast("bigint")
    return F.when(c.isNotNull(), F.greatest(F.lit(-90).cast("bigint"), F.least(F.lit(80).cast("bigint"), edge)))


def region_10deg(lon: Column | str, lat: Column | str) -> Column:
    lon, lat = as_col(lon), as_col(lat)
    label = F.format_string("lon%04d_lat%04d", F.floor(lon / 10.0) * 10, F.floor(lat / 10.0) * 10)
    return F.when(lon.isNull() | lat.isNull(), F.lit("unknown")).otherwise(label)


def block_id(lon: Column | str, lat: Column | str, degrees: float) -> Column:
    def part(c):
        return F.floor(as_col(c) / float(degrees)).cast("bigint").cast("string")
    return F.concat(F.lit(f"{degrees:g}_"), part(lon), F.lit("_"), part(lat))


def bbox_km2(lon_min, lon_max, lat_min, lat_max) -> Column:
    """Bounding-box area, longitude span corrected for latitude."""
    lon_min, lon_max, lat_min, lat_max = (as_col(c) for c in (lon_min, lon_max, lat_min, lat_max))
    mid = (lat_max + lat_min) / 2.0
    return (lon_max - lon_min) * (lat_max - lat_min) * F.cos(F.radians(mid)) * (KM_PER_DEGREE * KM_PER_DEGREE)


def in_footprint(lon: Column | str, lat: Column | str, box: dict | None) -> Column:
    if not box:
        return F.lit(True)
    return (as_col(lon).between(float(box["lon_min"]), float(box["lon_max"]))
            & as_col(lat).between(float(box["lat_min"]), float(box["lat_max"])))
