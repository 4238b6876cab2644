"""Sharding by proportional stratified interleaving, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS = 40
#: Rows that one range of a sort holds on average; the number of ranges follows the number of rows.
RANGE_ROWS = 250_000


def _numbered(df: DataFrame, rows: int, by: list[str], groups: list[str], name: str) -> DataFrame:
    """Adds `__at`, the row's number from 0 within `groups`, in the order of `groups` and then `by`.

    Rows are dealt into ranges of the whole order, so a source with a third of all rows spans many tasks. Each row then
    has its place in its range; counts per range and group, summed up before the range, make that a number in the group.
    The only window without a key runs over one row per range and group.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)
    order = [F.col(c).asc_nulls_first() for c in groups + by]
    dealt = stage(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                  .withColumn("__id", F.monotonically_increasing_id())
                  .withColumn("__range", F.shiftright("__id", 33)), name)
    counts = dealt.groupBy("__range", *groups).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*groups or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.select("__range", *[F.col(c).alias(f"__g_{c}") for c in groups], "__first", "__before")
    same = F.col("__range") == F.col("__range_2")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    placed = dealt.join(starts.withColumnRenamed("__range", "__range_2"), same)
    return placed.withColumn("__at", F.col("__id") - F.col("__first") + F.col("__before")).select(*df.columns, "__at")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = "shard", id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """Deals documents to shards of equal row counts (at most one apart) in which every source has its share.

    Rows of a source are shuffled by md5(seed:id). Row r of n (r from 1) has the fractional rank (2r - 1) / 2n; all rows
    sorted by it are cut into `shards` runs of equal length, so each run has every source's rows in proportion, to within
    one row. Returns doc_id, source, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot (from 0 in the shard,
    without gaps).

    Null source: a source of its own. Null text: size 16 and the CRC of nothing. Null or repeated ids: rows that tie are
    ordered by size and CRC; rows equal in these too get neighbouring places and are interchangeable. An empty table gives
    no rows; with fewer rows than shards some shards stay empty. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    slim = stage(slim.withColumn("__mix", F.substring(shuffled, 1, 16)), "shard-rows")
    rows = slim.count()
    ranked = _numbered(slim, rows, ["__mix", "doc_id", "size", "text_crc32"], ["source"], "shard-source")
    per_source = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("source", "__source")
    share: Column = (2 * F.col("__at") + 1) / (2 * F.col("__n"))
    ranked = ranked.join(per_source, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__share", share)
    mixed = _numbered(ranked.drop("__n", "__source", "__at"), rows, ["__share", "__mix", "source", "doc_id", "size", "text_crc32"], [], "shard-mix")
    # shard s holds the places from ceil(s * rows / shards) on, so sizes differ by one at most
    shard = F.expr(f"(__at * {shards}) div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (mixed.withColumn("shard", shard).withColumn("slot", F.col("__at") - first)
            .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"))
