"""Point-level normalisation, checks and per-track summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stats import n_true
from .groups import null_safe_join, ranked

# Fixed values of the point checks.
DEPTH_EXTREME_M = 12000.0
DEPTH_CLIP_M = 11500.0
LAND_CUTOFF_M = 0.0
SIGN_SHARE = 0.95
JUMP_M = 1000.0
SURVEY_REASONS = ["invalid_lon", "invalid_lat", "non_positive_depth", "extreme_depth", "non_negative_elev", "nan_value"]
SURVEY_CHECKS = ["qc_valid_lon", "qc_valid_lat", "qc_depth_positive", "qc_depth_not_extreme", "qc_elev_negative",
                 "qc_no_nan"]
TRACK_CHECKS = ["valid_lon", "valid_lat", "valid_depth_pos", "valid_depth_max", "valid_core_fields"]


def survey_points(raw: DataFrame) -> DataFrame:
    """Raw positions to survey points: longitude wrapped by modulo, elevation from depth."""
    lon, lat, depth = (geo.nan_to_null(c) for c in ("lon_raw", "lat_raw", "depth_raw"))
    return raw.withColumns({"lon": geo.wrap_lon(lon), "lat": lat, "depth_m_positive_down": depth, "elev_m": -depth})


def qc_survey_points(points: DataFrame) -> DataFrame:
    """Six checks, the zero-depth flag, the pass flag and the joined failure reasons."""
    lon, lat, depth, elev = (F.col(c) for c in ("lon", "lat", "depth_m_positive_down", "elev_m"))
    checks = {
        "qc_valid_lon": (lon >= -180) & (lon < 180),
        "qc_valid_lat": lat.between(-90, 90),
        "qc_depth_positive": (depth > 0) & geo.finite(depth),
        "qc_depth_not_extreme": (depth <= DEPTH_EXTREME_M) & geo.finite(depth),
        "qc_elev_negative": (elev < 0) & geo.finite(elev),
        "qc_no_nan": geo.finite(lon) & geo.finite(lat) & geo.finite(depth) & geo.finite(elev),
        "qc_zero_depth": depth == 0,
    }
    flagged = points.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(r)) for c, r in zip(SURVEY_CHECKS, SURVEY_REASONS)]))
    passed = F.lit(True)
    for c in SURVEY_CHECKS:
        passed = passed & F.col(c)
    return flagged.withColumns({"qc_pass_basic": passed, "qc_reason": F.array_join(failed, ",")})


def check_track_points(points: DataFrame) -> DataFrame:
    """Five checks and the pass flag of source B; a missing value fails."""
    lon, lat, depth = F.col("lon"), F.col("lat"), F.col("depth_m_positive_down")
    checks = {
        "valid_lon": (lon >= -180) & (lon < 180),
        "valid_lat": lat.between(-90, 90),
        "valid_depth_pos": (depth > 0) & geo.finite(depth),
        "valid_depth_max": (depth <= DEPTH_EXTREME_M) & geo.finite(depth),
        "valid_core_fields": geo.finite(lon) & geo.finite(lat) & geo.finite(depth),
    }
    flagged = points.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    passed = F.lit(True)
    for c in TRACK_CHECKS:
        passed = passed & F.col(c)
    return flagged.withColumn("point_check_pass_basic", passed)


def passing(points: DataFrame, flag: str) -> DataFrame:
    """The points that passed the checks.

    A plain filter would be moved below the columns it is computed from and repeat their expressions, some forty times, which
    makes a method too long to be compiled. A column that depends on the row's number stays where it is, so every expression
    is computed once. Nearly all points pass, so a scan could skip next to nothing by the checks.
    """
    here = F.col(flag) & (F.monotonically_increasing_id() >= 0)
    return points.withColumn("__here", here).where("__here").drop("__here")


def qc_summary(points: DataFrame, key: str, checks: Sequence[str], pass_flag: str) -> DataFrame:
    """Rows in, rows failing each check and rows passing, per file or track."""
    fails = [n_true(~F.col(c)).alias(f"n_fail_{c}") for c in checks]
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n_points_in"), *fails,
                                   n_true(pass_flag).alias("n_points_pass"))


def depth_sign(positive: Column, negative: Column, n_finite: Column) -> Column:
    """Sign label of a track by the 95 % rule."""
    nonzero = positive + negative
    share_pos, share_neg = F.try_divide(positive, nonzero), F.try_divide(negative, nonzero)
    return (F.when(n_finite == 0, "no_depth_values").when(nonzero == 0, "all_zero")
            .when(share_pos >= SIGN_SHARE, "mostly_positive").when(share_neg >= SIGN_SHARE, "mostly_negative")
            .otherwise("mixed_sign"))


def depth_sign_strict(lowest: Column, highest: Column) -> Column:
    return F.when(highest < 0, "negative").when(lowest >= 0, "positive").when(lowest.isNotNull(), "mixed")


def track_signs(points: DataFrame, key: str = "track_id", depth: str = "depth_raw") -> DataFrame:
    d = geo.nan_to_null(depth)
    return points.groupBy(key).agg(depth_sign(n_true(d > 0), n_true(d < 0), F.count(d)).alias("depth_sign_raw"))


def normalize_depth(points: DataFrame, signs: DataFrame, key: str = "track_id") -> DataFrame:
    """Positive-down depth by the sign of the track; rows of the other sign take the absolute value.

    Tracks without a clear sign get no depth.  `sign_warning` marks the rows that were turned over
    against their track, `was_clipped` those above the upper clip; the raw depth is kept.
    """
    d = geo.nan_to_null("depth_raw")
    positive, negative = F.col("depth_sign_raw") == "mostly_positive", F.col("depth_sign_raw") == "mostly_negative"
    down = F.when(positive | negative, F.abs(d))
    warn = (positive & (d < 0)) | (negative & (d > 0)) | (~positive & ~negative)
    joined = null_safe_join(points, signs, [key])
    out = joined.withColumns({"sign_warning": F.coalesce(warn, F.lit(False)), "__down": down})
    return clip_depth(out, "__down").drop("__down")


def clip_depth(df: DataFrame, depth: str, limit: float = DEPTH_CLIP_M) -> DataFrame:
    d = geo.nan_to_null(depth)
    kept = F.when(d <= limit, d)
    return df.withColumns({"was_clipped": F.coalesce(d > limit, F.lit(False)), "depth_m_positive_down": kept,
                           "elev_m": -kept})


def decode_time(df: DataFrame, value: str = "time_value", units: str = "time_units") -> DataFrame:
    """`<number> <unit> since <epoch>` to a timestamp, microsecond precision."""
    parts = r"(?i)^\s*(day|hour|minute|second|millisecond)s?\s+since\s+(.+?)\s*$"
    unit = F.lower(F.regexp_extract(F.col(units), parts, 1))
    micros = (F.when(unit == "day", 86_400_000_000).when(unit == "hour", 3_600_000_000)
              .when(unit == "minute", 60_000_000).when(unit == "second", 1_000_000).when(unit == "millisecond", 1_000))
    since = F.regexp_extract(F.col(units), parts, 2)
    clock = F.coalesce(F.nullif(F.regexp_extract(since, r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)", 1), F.lit("")), F.lit("00:00:00"))
    # an explicit zone keeps the result independent of the session's time zone
    text = F.concat(F.regexp_extract(since, r"(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit(" "), clock, F.lit("Z"))
    epoch = text.try_cast("timestamp")
    v = geo.nan_to_null(value)
    shifted = F.unix_micros(epoch) + F.round(v * micros).cast("bigint")
    return df.withColumn("time", F.when(v.isNotNull(), F.timestamp_micros(shifted)))


def track_has_time(df: DataFrame, key: str = "track_id") -> DataFrame:
    return df.groupBy(key).agg((F.count("time") > 0).alias("has_time"))


def split_land(points: DataFrame, depth: str = "depth_raw") -> DataFrame:
    """Label every grid point as land, nodata, bathymetry or missing."""
    points = points.withColumns({c: geo.nan_to_null(c) for c in ("lon_raw", "lat_raw", depth) if c in points.columns})
    d = F.col(depth)
    label = (F.when(d.isNull(), "missing").when(d > LAND_CUTOFF_M, "land").when(d < -DEPTH_CLIP_M, "nodata")
             .otherwise("bathymetry"))
    return points.withColumn("surface", label)


def land_audit(labelled: DataFrame, key: str) -> DataFrame:
    kinds = ["land", "nodata", "bathymetry", "missing"]
    bathy = F.when(F.col("surface") == "bathymetry", F.col("depth_raw"))
    return labelled.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows_in"), *[n_true(F.col("surface") == k).alias(f"rows_{k}") for k in kinds],
        F.min("lon_raw").alias("lon_min"), F.max("lon_raw").alias("lon_max"), F.min("lat_raw").alias("lat_min"),
        F.max("lat_raw").alias("lat_max"), F.min(bathy).alias("depth_min_bathy_raw"),
        F.max(bathy).alias("depth_max_bathy_raw"))


def to_bathymetry(labelled: DataFrame, key: str, order: Sequence[Column], slice_by: Column) -> DataFrame:
    """Bathymetry rows only, positive down, with a running index per track."""
    rows = labelled.where(F.col("surface") == "bathymetry").withColumns({
        "lon": geo.shift_lon("lon_raw"), "lat": F.col("lat_raw"), "depth_m_positive_down": -F.col("depth_raw"),
        "elev_m": F.col("depth_raw")})
    return ranked(rows, [key], order, slice_by, "point_index_in_track")


def to_land(labelled: DataFrame, key: str) -> DataFrame:
    return (labelled.where(F.col("surface") == "land")
            .select(key, "lon_raw", "lat_raw", geo.shift_lon("lon_raw").alias("lon"), F.col("lat_raw").alias("lat"),
                    F.col("depth_raw").alias("elevation_m")))


def with_point_index(points: DataFrame, key: str, order: Sequence[Column], slice_by: Column,
                     out: str = "point_index") -> DataFrame:
    return ranked(points, [key], order, slice_by, out)


def depth_jumps(points: DataFrame, key: str = "track_id", index: str = "point_index", depth: str = "depth_m_positive_down",
                limit: float = JUMP_M, stretch: int = 100_000) -> DataFrame:
    """Jump candidates per track: consecutive depths that differ by more than `limit`.

    The index is dense, so a long track is cut into stretches and the last point of a stretch is repeated
    as the predecessor of the next one; no task holds more than one stretch.
    """
    i = F.col(index)
    part = F.floor(i / stretch).cast("bigint")
    last = (i + 1) % stretch == 0
    own = F.struct(part.alias("part"), F.lit(True).alias("own"))
    copy = F.struct((part + 1).alias("part"), F.lit(False).alias("own"))
    places = F.explode(F.when(last, F.array(own, copy)).otherwise(F.array(own)))
    cut = (points.select(key, i.alias("__i"), F.col(depth).alias("__d"), places.alias("__p"))
           .select(key, "__i", "__d", F.col("__p.part").alias("__part"), F.col("__p.own").alias("__own")))
    before = F.lag("__d").over(Window.partitionBy(key, "__part").orderBy("__i"))
    jump = F.col("__own") & (F.abs(F.col("__d") - before) > limit)
    return cut.withColumn("__j", jump).groupBy(key).agg(n_true("__j").alias("n_depth_jump_candidates"))


def mark_duplicates(points: DataFrame, triple: Sequence[str], point_key: Sequence[str]) -> DataFrame:
    """Mark the first occurrence of each exact triple.

    `point_key` identifies a point and orders it.  The first point of a triple is found with a combined
    minimum, then marked through its unique key, so a million copies of one triple never meet in one task.
    """
    first = points.groupBy(*triple).agg(F.min(F.struct(*point_key)).alias("__first")).select("__first.*")
    marked = first.withColumn("__hit", F.lit(True))
    return null_safe_join(points, marked, list(point_key), "left").withColumn(
        "is_first", F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")


def duplicate_counts(points: DataFrame, key: str, triple: Sequence[str] = ("lon", "lat", "depth_m_positive_down")) -> DataFrame:
    """Zero and negative depths, exact-duplicate points and distinct triples per track."""
    d = F.col("depth_m_positive_down")
    per_triple = points.groupBy(key, *triple).agg(F.count(F.lit(1)).alias("__c"))
    return per_triple.groupBy(key).agg(
        F.coalesce(F.sum(F.when(d == 0, F.col("__c"))), F.lit(0)).alias("n_depth_eq_zero"),
        F.coalesce(F.sum(F.when(d < 0, F.col("__c"))), F.lit(0)).alias("n_depth_negative_finite"),
        (F.sum("__c") - F.count(F.lit(1))).alias("n_duplicate_points"),
        F.count(F.lit(1)).alias("n_unique_triples"))


def summarize_points(points: DataFrame, key: str) -> DataFrame:
    """Rows, bounding box, time and depth ranges, warnings and clipped rows per track."""
    return points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points_out"),
        F.min("lon").alias("bbox_lon_min"), F.max("lon").alias("bbox_lon_max"),
        F.min("lat").alias("bbox_lat_min"), F.max("lat").alias("bbox_lat_max"),
        F.min("time").alias("time_min"), F.max("time").alias("time_max"),
        F.min("depth_m_positive_down").alias("depth_min"), F.max("depth_m_positive_down").alias("depth_max"),
        n_true("sign_warning").alias("n_warnings"), n_true("was_clipped").alias("n_clipped"))


def optional_fields(points: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """has_<field> per track: true when at least one value is present."""
    return points.groupBy(key).agg(*[(F.count(f) > 0).alias(f"has_{f}") for f in fields])
