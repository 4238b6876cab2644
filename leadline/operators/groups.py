"""Group-wise operators that stay distributed when one group holds a large share of all rows.

`percentile`, and a `row_number` over a group, need the whole group inside one task.  Here a group travels as a run: its
distinct values in order with their counts, built by the map tasks, merged after the one exchange, and never longer than
RUN.  Quantiles and deviations are read off it, and written as a stage.  The rows of groups whose run is full go on to
slices: equal values are collapsed, a group's values are cut by a monotone function of the value alone, counts per
slice locate the wanted ranks, and only inside their slices are values ordered.  So no task holds more than RUN values of a
group or one slice of it, and results are exact.  Where groups are known to be large they are counted first, and those of RUN
rows or more never build a run: beyond a full one each value would cost RUN steps.  Where very many groups of some dozens or hundreds
of rows are wanted, `sorted_agg` exchanges rows once and orders them; groups of ORDERED rows or more are found before and go to slices.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Slices per doubling of 1 + |value|: a few centimetres to decimetres of depth, finer near zero.
SLICES_PER_OCTAVE = 4096
#: Parts of a large group in a join with one row per group.
SALTS = 16
#: Distinct values of a group that travel in one piece; a group with more is sliced.
RUN = 4096
#: Rows of a group that `sorted_agg` orders in one task, some 10 MB; a group with more is sliced.
ORDERED = 1 << 16
#: Hash buckets in which the rows of very many groups are counted.
BUCKETS = 1 << 18

Quantiles = Mapping[str, tuple[str, float]]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key equals a missing key; the right-hand keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def value_slice(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    return F.floor(F.signum(value) * F.log2(F.lit(1.0) + F.abs(value)) * SLICES_PER_OCTAVE).cast("bigint")


def digest_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], quantiles: Quantiles, mads: Mapping[str, str] | None = None,
                 absolute: Mapping[str, str] | None = None, beyond_if: Column | None = None, beyond: Callable[[DataFrame], DataFrame] | None = None,
                 coarse: bool = False) -> DataFrame:
    """`groupBy(keys).agg(aggs + exact interpolated quantiles + median absolute deviations)`, written as a stage.

    quantiles = {alias: (column, p)}; mads = {alias: column}; absolute = {name: column}: quantiles may refer to `name` as to a
    column of |column|, which shares that column's run. Missing values and NaN are left out. Groups whose run is full, or for
    which the aggregate `beyond_if` holds, are sliced; `beyond` may give another way from their keys to the same columns.
    `coarse` says that groups grow with the input: they are counted first, and large ones go to slices without a run.
    """
    keys, mads, absolute = list(keys), dict(mads or {}), dict(absolute or {})
    if not quantiles and not mads:
        return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    if coarse and keys:
        return _digest_counted(df, keys, aggs, quantiles, mads, absolute)
    source = {c: absolute.get(c, c) for c in dict.fromkeys([*(c for c, _ in quantiles.values()), *mads.values()])}
    runs = {c: f"__run_{i}" for i, c in enumerate(dict.fromkeys(source.values()))}
    extra = [beyond_if.alias("__beyond")] if beyond_if is not None else []
    groups = df.groupBy(*keys).agg(*aggs, *[F.histogram_numeric(_number(c), F.lit(RUN)).alias(r) for c, r in runs.items()], *extra)
    full = reduce(lambda a, b: a | b, [F.coalesce(F.size(r) >= RUN, F.lit(False)) for r in runs.values()] + [F.col("__beyond") for _ in extra])
    number = {c: i for i, c in enumerate(source)}
    wanted = {c: sorted({p for k, p in quantiles.values() if k == c} | ({0.5} if c in mads.values() else set())) for c in source}
    of = {c: f"__of_{i}" for c, i in number.items()}
    at = {c: f"__at_{i}" for c, i in number.items()}
    read = groups.withColumns({of[c]: F.array_sort(_folded(F.col(runs[o]), F.lit(0.0))) if c in absolute else F.col(runs[o]) for c, o in source.items()})
    read = read.withColumns({at[c]: _read(F.col(of[c]), wanted[c]) for c in source})
    read = read.withColumns({alias: F.col(at[c])[wanted[c].index(p)] for alias, (c, p) in quantiles.items()})
    read = read.withColumns({alias: _read(F.array_sort(_folded(F.col(of[c]), F.col(at[c])[wanted[c].index(0.5)])), [0.5])[0] for alias, c in mads.items()})
    columns = [*[c for c in groups.columns if c not in runs.values() and c != "__beyond"], *quantiles, *mads]
    done = cut_lineage(read.select(*columns, full.alias("__full")), "groups")
    left = done.where("__full").select(*keys)
    done = done.where("NOT __full").select(*columns)
    if left.isEmpty():
        return done
    if beyond is None:
        rows = cut_lineage(null_safe_join(df, left, keys, "left_semi") if keys else df, "rows-of-full-runs")
        rows = rows.withColumns({name: F.abs(F.col(c)) for name, c in absolute.items()})
        rest = quantile_agg(rows, keys, aggs, dict(quantiles) | {f"__median_{i}": (c, 0.5) for i, c in enumerate(mads.values())})
        rest = with_mad(rows, keys, rest, {alias: (c, f"__median_{i}") for i, (alias, c) in enumerate(mads.items())}) if mads else rest
    else:
        rest = beyond(left)
    return done.unionByName(cut_lineage(rest.select(*columns), "groups-sliced"))


def _digest_counted(df: DataFrame, keys: list[str], aggs: Sequence[Column], quantiles: Quantiles, mads: Mapping[str, str], absolute: Mapping[str, str]) -> DataFrame:
    """`digest_agg` of groups that are counted first: runs for groups of fewer than RUN rows, slices for the others."""
    groups = cut_lineage(df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__rows")), "groups-counted")
    large = groups.where(F.col("__rows") >= RUN).select(*keys)
    some = list(dict.fromkeys(absolute.get(c, c) for c in [*(c for c, _ in quantiles.values()), *mads.values()]))
    values = df.select(*keys, *[_number(c).alias(c) for c in some if c not in keys])
    if large.isEmpty():
        found = digest_agg(values, keys, [], quantiles, mads, absolute)
    else:
        rows = cut_lineage(null_safe_join(values, large, keys, "left_semi"), "rows-of-large-groups")
        rows = rows.withColumns({name: F.abs(F.col(c)) for name, c in absolute.items()})
        found = _sliced_quantiles(rows, keys, quantiles, mads)
        if not groups.where(F.col("__rows") < RUN).isEmpty():
            rest = digest_agg(null_safe_join(values, large, keys, "left_anti"), keys, [], quantiles, mads, absolute)
            found = rest.unionByName(found)
    out = null_safe_join(groups.drop("__rows"), found, keys, "left")
    return cut_lineage(out.select(*groups.drop("__rows").columns, *quantiles, *mads), "groups")


def _sliced_quantiles(rows: DataFrame, keys: list[str], quantiles: Quantiles, mads: Mapping[str, str]) -> DataFrame:
    """Quantiles and deviations of large groups; `rows` is a stage, read once to count slices and once for those that hold ranks."""
    columns = list(dict.fromkeys([*(c for c, _ in quantiles.values()), *mads.values()]))
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__q"), _number(c).alias("__v")) for i, c in enumerate(columns)])).alias("__s"))
    long = long.select(*keys, "__s.*").where("__v IS NOT NULL")
    centre = {f"__median_{i}": (columns.index(c), 0.5) for i, c in enumerate(mads.values())}
    out = _ranked_values(long, keys, {alias: (columns.index(c), p) for alias, (c, p) in quantiles.items()} | centre)
    if not mads:
        return out
    medians = out.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("__q"), F.col(m).alias("__m")) for m, (q, _) in centre.items()])).alias("__s"))
    apart = null_safe_join(long, medians.select(*keys, "__s.*").distinct(), [*keys, "__q"]).withColumn("__v", F.abs(F.col("__v") - F.col("__m"))).drop("__m")
    spread = _ranked_values(apart.where("__v IS NOT NULL"), keys, {alias: (columns.index(c), 0.5) for alias, c in mads.items()})
    return null_safe_join(out.drop(*centre), spread, keys, "left")


def _ranked_values(long: DataFrame, keys: list[str], wanted: Mapping[str, tuple[int, float]]) -> DataFrame:
    """Exact quantiles of (keys, __q, __v), written as a stage: of all rows only counts of slices are shuffled."""
    at = [*keys, "__q", "__slice"]
    sliced = long.withColumn("__slice", value_slice(F.col("__v")))
    held = cut_lineage(_held(sliced.groupBy(*at).agg(F.count(F.lit(1)).alias("__size")), [*keys, "__q"], wanted), "slices-held")
    counted = null_safe_join(sliced, held, at, "left_semi").groupBy(*at, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ordered = counted.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*at).orderBy("__v")))
    return cut_lineage(_picked(ordered, held, keys, wanted), "quantiles")


def large_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of the groups of ORDERED rows or more, as a stage; None without any.

    Rows are counted in BUCKETS hash buckets of their keys, and groups only in buckets that could hold a large one.
    """
    rows = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__bucket"))
    counted, enough = F.count(F.lit(1)).alias("__rows"), F.col("__rows") >= ORDERED
    full = cut_lineage(rows.groupBy("__bucket").agg(counted).where(enough).select("__bucket"), "full-buckets")
    if full.isEmpty():
        return None
    sizes = rows.join(F.broadcast(full), "__bucket", "left_semi").groupBy(*keys).agg(counted)       # at most BUCKETS numbers
    large = cut_lineage(sizes.where(enough).select(*keys), "large-groups")
    return None if large.isEmpty() else large


def sorted_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], quantiles: Quantiles, distinct: Mapping[str, str] | None = None) -> DataFrame:
    """`groupBy(keys).agg(aggs + counts of distinct values + exact interpolated quantiles)`, written as a stage.

    quantiles = {alias: (column, p)}; distinct = {alias: column}. Missing values and NaN are left out. Rows are exchanged once by their
    keys and ordered by each column, so neither runs are merged nor rows multiplied for each distinct count; groups of ORDERED rows
    or more are sliced instead. `df` should be a stage: it is read twice.
    """
    keys, distinct = list(keys), dict(distinct or {})
    large = large_groups(df, keys)
    small = df if large is None else null_safe_join(df, large, keys, "left_anti")
    done = cut_lineage(_ordered_agg(small, keys, aggs, quantiles, distinct), "groups")
    if large is None:
        return done
    rows = cut_lineage(null_safe_join(df, large, keys, "left_semi"), "rows-of-large-groups")
    counts = [F.count_distinct(c).alias(alias) for alias, c in distinct.items()]
    rest = null_safe_join(rows.groupBy(*keys).agg(*aggs, *counts), _sliced_quantiles(rows, keys, quantiles, {}), keys, "left")
    return done.unionByName(cut_lineage(rest.select(*done.columns), "groups-sliced"))


def _ordered_agg(rows: DataFrame, keys: list[str], aggs: Sequence[Column], quantiles: Quantiles, distinct: Mapping[str, str]) -> DataFrame:
    """`sorted_agg` of groups that fit a task: every window has the keys, so the rows are exchanged once."""
    column = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in quantiles.values()))}
    for c, i in column.items():
        along = Window.partitionBy(*keys).orderBy(F.col(f"__v{i}").asc_nulls_last())
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn(f"__v{i}", _number(c)).withColumns({f"__r{i}": F.row_number().over(along) - 1, f"__n{i}": F.count(f"__v{i}").over(whole)})
    for i, c in enumerate(distinct.values()):
        first = F.row_number().over(Window.partitionBy(*keys, c).orderBy(c)) == 1
        rows = rows.withColumn(f"__d{i}", first & F.col(c).isNotNull())

    def quantile(i: int, p: float) -> Column:
        value, place = F.col(f"__v{i}"), (F.col(f"__n{i}") - 1) * F.lit(float(p))
        lo, hi = (F.max(F.when(F.col(f"__r{i}") == f(place), value)) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        return F.when(share == 0, lo).otherwise((1 - share) * lo + share * hi)

    return rows.groupBy(*keys).agg(*aggs, *[F.count_if(F.col(f"__d{i}")).alias(alias) for i, alias in enumerate(distinct)],
                                   *[quantile(column[c], p).alias(alias) for alias, (c, p) in quantiles.items()])


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _folded(run: Column, centre: Column) -> Column:
    """The distances of a run's values from a centre, with their counts, in no order."""
    return F.transform(run, lambda e: F.struct(F.abs(e["x"] - centre).alias("x"), e["y"].alias("y")))


def _read(run: Column, probs: Sequence[float]) -> Column:
    """The interpolated quantiles of a run in order, as an array; null for a missing run."""
    total = F.aggregate(run, F.lit(0.0), lambda s, e: s + e["y"])
    places = [(total - 1) * F.lit(float(p)) for p in probs]
    start = F.struct(F.lit(0.0).alias("c"), F.array(*[f(x) for x in places for f in (F.floor, F.ceil)]).cast("array<double>").alias("r"),
                     F.array(*[F.lit(None).cast("double")] * (2 * len(probs))).alias("v"))

    def step(s: Column, e: Column) -> Column:
        upto = s["c"] + e["y"]
        return F.struct(upto.alias("c"), s["r"].alias("r"), F.zip_with(s["r"], s["v"], lambda r, v: F.when((s["c"] <= r) & (r < upto), e["x"]).otherwise(v)).alias("v"))

    def end(s: Column) -> Column:
        share = [(s["c"] - 1) * F.lit(float(p)) for p in probs]
        share = [x - F.floor(x) for x in share]
        return F.array(*[F.when(x == 0, s["v"][2 * i]).otherwise((1 - x) * s["v"][2 * i] + x * s["v"][2 * i + 1]) for i, x in enumerate(share)])

    one = F.array(*[run[0]["x"]] * len(probs))              # a group of one value, the usual one where points are sparse
    return F.when((F.size(run) == 1), one).otherwise(F.aggregate(run, start, step, end))


def quantile_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], quantiles: Quantiles) -> DataFrame:
    """`groupBy(keys).agg(aggs + exact interpolated quantiles)`; quantiles = {alias: (column, p)}.

    One plan for groups of any size, in which nothing runs before its result is asked for: values are collapsed, sliced,
    counted, and ordered inside slices only.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in quantiles.values()))
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__q"), _number(c).alias("__v")) for i, c in enumerate(columns)])).alias("__s"))
    counted = (long.select(*keys, "__s.*").where("__v IS NOT NULL")
               .groupBy(*keys, "__q", "__v").agg(F.count(F.lit(1)).alias("__c")))
    wanted = {alias: (columns.index(c), p) for alias, (c, p) in quantiles.items()}
    picked = counted_quantiles(counted, keys, wanted)
    groups = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    return null_safe_join(groups, picked, keys, "left")


def counted_quantiles(counted: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[int, float]]) -> DataFrame:
    """Exact quantiles from (keys, __q, __v, __c): value __v of column number __q comes __c times in the group.

    wanted = {alias: (column number, p)}
    """
    group = [*keys, "__q"]
    sliced = counted.withColumn("__slice", value_slice(F.col("__v")))
    inside = Window.partitionBy(*group, "__slice").orderBy("__v")
    ordered = sliced.withColumn("__upto", F.sum("__c").over(inside))
    # one row per group and slice, at most SLICES_PER_OCTAVE for each doubling
    totals = ordered.groupBy(*group, "__slice").agg(F.sum("__c").alias("__size"))
    return _picked(ordered, _held(totals, group, wanted), keys, wanted)


def _held(totals: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[int, float]]) -> DataFrame:
    """The slices that hold wanted ranks, with the ranks and the number of values before the slice."""
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("__end", F.sum("__size").over(before)).withColumn("__n", F.sum("__size").over(Window.partitionBy(*group)))
    start = F.col("__end") - F.col("__size")
    ranks = F.lit(None).cast("array<bigint>")
    for q in sorted({q for q, _ in wanted.values()}):
        probs = sorted({p for k, p in wanted.values() if k == q})
        ranks = F.when(F.col("__q") == q, _ranks(F.col("__n"), probs)).otherwise(ranks)
    held = totals.withColumn("__ranks", F.filter(ranks, lambda r: (r >= start) & (r < F.col("__end")))).where(F.size("__ranks") > 0)
    return held.select(*group, "__slice", start.alias("__before"), "__n", "__ranks")


def _picked(ordered: DataFrame, held: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[int, float]]) -> DataFrame:
    """The wanted quantiles from values with running counts inside their slices, and the slices that hold ranks."""
    group = [*keys, "__q"]
    found = null_safe_join(ordered, held, [*group, "__slice"])
    high = F.col("__before") + F.col("__upto")
    low = high - F.col("__c")
    found = found.select(*group, "__v", "__n", F.explode(F.filter("__ranks", lambda r: (r >= low) & (r < high))).alias("__rank"))
    return found.groupBy(*keys).agg(*[_interpolated(q, p).alias(alias) for alias, (q, p) in wanted.items()])


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    places = [(n - 1) * F.lit(float(p)) for p in probs]
    return F.array_distinct(F.array(*[f(x).cast("bigint") for x in places for f in (F.floor, F.ceil)]))


def _interpolated(q: int, p: float) -> Column:
    place = (F.col("__n") - 1) * F.lit(float(p))
    own = F.col("__q") == q
    lo = F.max(F.when(own & (F.col("__rank") == F.floor(place)), F.col("__v")))
    hi = F.max(F.when(own & (F.col("__rank") == F.ceil(place)), F.col("__v")))
    share = F.max(F.when(own, place - F.floor(place)))
    return F.when(share == 0, lo).otherwise((1 - share) * lo + share * hi)


def with_mad(df: DataFrame, keys: Sequence[str], base: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Median absolute deviations about the medians in `base` (one row per key).

    wanted = {alias: (value column of df, median column of base)}.  Values are collapsed to counts before they meet the
    medians, and a group's values meet copies of its row in SALTS parts.
    """
    keys, numbers = list(keys), range(len(wanted))
    pairs = list(wanted.values())
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__q"), _number(pairs[i][0]).alias("__v"))
                                                for i in numbers])).alias("__s"))
    counted = (long.select(*keys, "__s.*").where("__v IS NOT NULL").groupBy(*keys, "__q", "__v").agg(F.count(F.lit(1)).alias("__c"))
               .withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int")))
    medians = base.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__q"), F.col(pairs[i][1]).alias("__m")) for i in numbers])).alias("__s"))
    medians = medians.select(*keys, "__s.*").withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    apart = null_safe_join(counted, medians, [*keys, "__q", "__salt"]).withColumn("__v", F.abs(F.col("__v") - F.col("__m")))
    apart = apart.where("__v IS NOT NULL").groupBy(*keys, "__q", "__v").agg(F.sum("__c").alias("__c"))
    return null_safe_join(base, counted_quantiles(apart, keys, {a: (i, 0.5) for i, a in enumerate(wanted)}), keys, "left")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: Column, out: str = "rank", total: str | None = None,
           part_by: Column | None = None) -> DataFrame:
    """0-based rank inside each group; `total` names a column for the group's size.

    `slice_by` must not decrease along `order`, nor `part_by` inside a slice, which it cuts again where one slice may be large.
    The rank is the number of rows in earlier slices, in earlier parts of the slice, and before the row in its part, so a task
    orders one part at a time, counts the parts of one slice, and the slices of one group.
    """
    keys = list(keys)
    cut = df.withColumn("__slice", slice_by).withColumn("__part", F.lit(0) if part_by is None else part_by)
    numbered = cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__slice", "__part").orderBy(*order)))

    def before(sizes: DataFrame, within: Sequence[str], along: str) -> Column:
        return F.sum("__c").over(Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")

    if part_by is None:
        sizes = numbered.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__c"))
        at = [*keys, "__slice"]
    else:
        parts = numbered.groupBy(*keys, "__slice", "__part").agg(F.count(F.lit(1)).alias("__c"))
        sizes = parts.groupBy(*keys, "__slice").agg(F.sum("__c").alias("__c"))
        parts = parts.withColumn("__in", before(parts, [*keys, "__slice"], "__part")).drop("__c")
        at = [*keys, "__slice", "__part"]
    offsets = sizes.withColumn("__off", before(sizes, keys, "__slice"))
    if total:
        offsets = offsets.withColumn(total, F.sum("__c").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("__c")
    if part_by is not None:
        offsets = null_safe_join(parts, offsets, [*keys, "__slice"]).withColumn("__off", F.col("__off") + F.col("__in")).drop("__in")
    joined = null_safe_join(numbered, offsets, at)
    return joined.withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("bigint")).drop("__slice", "__part", "__off", "__rn")


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64) -> DataFrame:
    """The first n rows of each group; a salted first pass leaves at most salts * n rows per group."""
    keys = list(keys)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))
    kept = salted.withColumn("__rn", first).where(F.col("__rn") <= n)
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return kept.withColumn("__rn", final).where(F.col("__rn") <= n).drop("__rn", "__salt")


def strata(df: DataFrame, carry: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Stack strata: one row per input row and stratification, with `stratification` and `stratum`."""
    pairs = F.array(*[F.struct(F.lit(name).alias("stratification"), F.col(c).cast("string").alias("stratum"))
                      for name, c in columns.items()])
    return df.select(*carry, F.explode(pairs).alias("__s")).select(*carry, "__s.*")
