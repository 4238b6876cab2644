"""Small helpers that several operators share: reading tables, stages, and vectorised work on a batch of texts."""
from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of text that one vectorised step handles, so that its arrays stay small beside an executor's memory.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


#: Documents in one Arrow batch: whole texts are large rows, and both sides hold a batch at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, for operators that read whole texts in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns an operator works on, under fixed names: doc_id, mark (a hash of the text) and text, a null one empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_mark(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Stands for a null id, and is larger than all others.
LAST_ID = (1 << 63) - 1


def order_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID))


def text_mark(text_col: str) -> Column:
    """A hash of the text, which tells documents of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


#: Spark's setting that a query's shuffle files go as soon as it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: it is computed once, whatever executors are lost later.

    Nothing reads the step's shuffle files again, so they are removed once it is written.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


_MEMO: dict = {}


def memo(key, make: Callable):
    """What a worker keeps from task to task, made when it is first asked for; only that of one key, and see `chunks`."""
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = make()
    return _MEMO[key]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of `column`; a single longer row makes a slice of its own.

    At the end the worker, which Spark keeps for other tasks, gives its free memory back. Work that does not `keep` the memo of
    an operator that came before drops it: one worker runs the stages of a whole pipeline.
    """
    if _MEMO and not keep:
        _MEMO.clear()
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        del batch
    give_back()


def give_back() -> None:
    """Return memory that is free inside this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column behind each other as bytes, and the n + 1 offsets of their borders."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all others (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Seen:
    """Hashes met lately, in two generations of at most `most` each and one more slice; one that is forgotten counts as new again."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.young, self.old = most, np.zeros(0, U64), np.zeros(0, U64)

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes are not held; all are from now on."""
        hashes = hashes.view(U64)
        fresh = ~(_held(self.young, hashes) | _held(self.old, hashes))
        if len(self.young) > self.most:
            self.young, self.old = np.zeros(0, U64), self.young
        self.young = np.union1d(self.young, hashes)
        return fresh


def _held(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, from prefix sums of a polynomial modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, U64), np.ones(1, U64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Rolling._powers[0]) < n:
            size = max(n, 1 << 16)
            inverse = pow(Rolling.BASE, -1, 1 << 64)
            Rolling._powers = tuple(np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, U64(b))])) for b in (Rolling.BASE, inverse))
        up, self.down = Rolling._powers
        self.sums = np.zeros(n, U64)
        np.cumsum(values * up[:n - 1], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U64))


def word_spans(data: np.ndarray, is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every maximal run of word bytes; runs never cross a border between texts.

    is_word: 256 flags. A run is cut at every border, so a text that ends in a word byte does not join its successor.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    begins[cuts] = True
    ends[cuts] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 15) -> Iterator[dict[str, np.ndarray]]:
    """Columns of about `rows` sorted rows at a time, cut only between runs of equal keys; `group` numbers the runs.

    The caller bounds the length of a run.
    """
    held: list[dict[str, np.ndarray]] = []

    def runs(at: dict[str, np.ndarray]) -> np.ndarray:
        change = np.zeros(len(at[keys[0]]), np.int64)
        for c in keys:
            change[1:] |= at[c][1:] != at[c][:-1]
        return np.cumsum(change)

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        if sum(len(h[keys[0]]) for h in held) < rows:
            continue
        at = joined()
        group = runs(at)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield {c: v[:last] for c, v in at.items()} | {"group": group[:last]}
        held = [{c: v[last:] for c, v in at.items()}]
    if held:
        at = joined()
        held = []
        yield at | {"group": runs(at)}
    give_back()


# A-Z in lower case; white space is the blank and the bytes from tab to carriage return.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_PACK = 1 << 16


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which values of a column, modulo `bits`, occur: a bitmap of fixed size, packed by the executors.

    It never misses a value; the fuller it is, the more others it lets through, so it may only save work.
    """
    def pack(group: pa.Table) -> pa.Table:
        flags = np.zeros(_PACK, bool)
        flags[group.column("bit").to_numpy() % _PACK] = True
        return pa.table({"part": group.column("part")[:1], "packed": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    bit = df.select(F.pmod(F.col(column), F.lit(bits)).alias("bit")).distinct().withColumn("part", F.shiftright("bit", 16))
    out = np.zeros(bits // 8, np.uint8)
    for row in bit.groupBy("part").applyInArrow(pack, "part long, packed binary").collect():
        out[row.part * _PACK // 8:(row.part + 1) * _PACK // 8] = np.frombuffer(row.packed, np.uint8)
    return out


def has_bit(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these unsigned hashes the bitmap lets through; its number of bits is a power of two."""
    bit = (hashes & U64(len(packed) * 8 - 1)).astype(np.int64)
    return (packed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
