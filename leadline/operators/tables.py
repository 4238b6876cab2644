"""General table operators: guards, id-set joins, unions, samples."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from .groups import digest_agg, head_per_group


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating-point column become missing values, as at every read."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: geo.nan_to_null(c) for c in floats}) if floats else df


def coalesce_cols(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Fill each column from its fallback only where it is missing, then drop the fallbacks."""
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f)) for c, f in pairs.items()}).drop(*pairs.values())


def distinct_ids(ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return ids.select(*keys).distinct()


def keep_ids(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    return df.join(distinct_ids(ids, key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    return df.join(distinct_ids(ids, key), key, "left_anti")


def flag_ids(df: DataFrame, ids: DataFrame, key, name: str) -> DataFrame:
    """Membership as a column instead of a filter."""
    marked = distinct_ids(ids, key).withColumn("__hit", F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")


def common_ids(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return distinct_ids(a, key).join(distinct_ids(b, key), key, "left_semi")


def missing_ids(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return distinct_ids(a, key).join(distinct_ids(b, key), key, "left_anti")


def distinct_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys))


def enrich(df: DataFrame, dim: DataFrame, key) -> DataFrame:
    """Left join of a dimension; whether it is broadcast is left to its measured size (AQE)."""
    return df.join(dim, key, "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def join_one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails at run time when either side repeats the key, without a separate pass."""
    keys = list(key)

    def once(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in rest])
        checked = F.when(F.col("__n") == 1, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"key {keys} is not unique")).cast("boolean"))
        return held.where(checked).drop("__n")

    return once(left).join(once(right), keys, how)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def mixed(id_col: str, seed) -> Column:
    """A repeatable random order of ids: the MD5 of seed and id, which any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))


def sample_files(df: DataFrame, id_col: str, n: int, per: str | None = None, seed: int = 42) -> DataFrame:
    """A repeatable random sample: order by a seeded hash of the id, per class when `per` is given."""
    order = [mixed(id_col, seed), F.col(id_col)]
    return top_n(df, order, n) if per is None else head_per_group(df, [per], order, n)


def stable_sample(df: DataFrame, id_col: str, n: int, role: str, flag: str | None = None,
                  quota: float = 0.2, quota_from: int = 20) -> DataFrame:
    """Hash-ordered sample of n rows with a quota for flagged rows, topped up from whatever is left.

    Samples of fewer than `quota_from` rows have no quota.
    """
    hashed = df.withColumn("__h", mixed(id_col, role))
    order = [F.col("__h"), F.col(id_col)]
    if flag is None or n < quota_from:
        return top_n(hashed, order, n).drop("__h")
    flagged_n = max(1, round(n * quota))
    is_flagged = F.coalesce(F.col(flag), F.lit(False))
    # Up to n rows of each class are enough to fill any shortfall of the other class.
    both = head_per_group(hashed.withColumn("__f", is_flagged), ["__f"], order, n)
    place = F.row_number().over(Window.partitionBy("__f").orderBy(*order))      # at most 2n rows here
    ranked = both.withColumn("__p", place)
    quota_of = F.when(F.col("__f"), F.lit(flagged_n)).otherwise(F.lit(n - flagged_n))
    return (ranked.orderBy((F.col("__p") > quota_of).cast("int"), *order).limit(n).drop("__h", "__f", "__p"))


def sorted_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order inside the output files; a global order is not promised."""
    return df.sortWithinPartitions(*keys)


def describe_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum, one row per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s"))
    aggs = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max")]
    return digest_agg(long.select("s.*"), ["column_name"], aggs,
                        {"p25": ("v", 0.25), "p50": ("v", 0.5), "p75": ("v", 0.75)}, coarse=True)


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.col("n_rows").desc(), F.col(column)).limit(n)


def histogram(df: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    """Clipped histogram with n equal bins."""
    width = (hi - lo) / n
    c = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(column)))
    b = F.least(F.floor((c - lo) / width), F.lit(n - 1)).cast("bigint")
    return (df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows")))


def coarse_grid(cells: DataFrame, value: str, degrees: float = 1.0) -> DataFrame:
    def edge(c):
        return (F.floor(F.col(c) / degrees) * degrees).cast("double")
    return (cells.groupBy(edge("lon_center").alias("lon_deg"), edge("lat_center").alias("lat_deg"))
            .agg(F.avg(value).alias(f"mean_{value}")))
