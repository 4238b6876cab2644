"""Parquet tables: checked reads, partitioned branch tables, TSV mirrors, decoded tracks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.points import optional_fields
from ..operators.tables import nulls_for_nan, require_columns

BRANCH_PARTITIONS = ["branch", "lat_band_10deg"]


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """A Parquet table, or some of its columns; NaN becomes a missing value."""
    df = nulls_for_nan(require_columns(spark.read.parquet(path), required))
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_cells(df: DataFrame, path: str, partitions: Sequence[str] = BRANCH_PARTITIONS) -> None:
    """Write partitioned by branch and band.

    Rows are spread over the partitions and a hash of the cell, so that a large band is written by several tasks.
    """
    spread = F.pmod(F.xxhash64("lat_bin", "lon_bin"), F.lit(8))
    (df.repartition(*partitions, spread).sortWithinPartitions(*partitions, "lat_bin", "lon_bin")
     .write.mode("overwrite").partitionBy(*partitions).parquet(path))


def read_branch(spark: SparkSession, path: str, branch: str) -> DataFrame:
    """Cells of one branch by partition pruning; the partition names are the only source of the branch."""
    df = spark.read.parquet(path)
    require_columns(df, ["branch"])
    return nulls_for_nan(df.where(F.col("branch") == branch))


def write_tsv(df: DataFrame, path: str, limit: int | None = None, order: Sequence[str] = ()) -> None:
    """TSV mirror of a table: all rows, or the first `limit` in one small file."""
    rows = df.orderBy(*order) if order else df
    rows = rows if limit is None else rows.limit(limit).coalesce(1)
    rows.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path)


def clean_tracks(points: DataFrame, fields: Sequence[str] = ("gobs", "faa")) -> DataFrame:
    """Decoded track points: finite positions only, optional fields missing rather than NaN."""
    optional = {f: geo.nan_to_null(f) if f in points.columns else F.lit(None).cast("double") for f in fields}
    return points.withColumns({"lon_raw": geo.nan_to_null("lon_raw"), "lat_raw": geo.nan_to_null("lat_raw"),
                               "depth_raw": geo.nan_to_null("depth_raw"), **optional}).where(
        "lon_raw is not null and lat_raw is not null")


def read_track_table(spark: SparkSession, path: str, fields: Sequence[str] = ("gobs", "faa")) -> tuple[DataFrame, DataFrame]:
    """Decoded track points, and which optional fields each track really has."""
    points = clean_tracks(spark.read.parquet(path), fields)
    return points, optional_fields(points, "track_id", fields)
