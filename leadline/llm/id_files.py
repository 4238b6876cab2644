"""Token ids in files of range-coded blocks, and back."""
from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from . import range_coder
from .bpe import SPACE_RUNS, byte_symbols, has_odd_space
from .common import chunks, memo, stage, texts

#: Ids of one segment, a row of the files: whole documents, whose blocks are coded side by side.
SEGMENT = range_coder.BLOCK * range_coder.LANES
#: Words of each of the two generations whose ids a worker remembers; the words of one more slice of texts may be added.
MEMO = 500_000
END_ID = 1
#: Rows of 16 bytes that a join broadcasts at most.
BROADCAST_ROWS = 100_000
FILE_COLUMNS = "part int, segment int, doc_ids binary, counts binary, blocks binary"
NO_ID = -(1 << 63)


class WordIds:
    """Ids of whole texts by the tokenizers library, which encodes every new word once: words of letters by its model.

    The tokenizer's pieces cross neither white space nor a border between letters and other characters, and it lowers the
    case of letters one by one.  So a text's ids are those of its runs without white space behind each other, a run of
    letters that ends in commas and stops has the ids of both parts, and a word those of its lower-case form.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.visible = dict(enumerate(byte_symbols()))      # what the model sees for each byte
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts_: list[str]) -> list[bytes]:
        runs = [SPACE_RUNS.findall(t) if has_odd_space(t) else t.split() for t in texts_]
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        found = self.young
        new = set().union(*runs).difference(found)
        parts = {w: _parts(w) for w in new}
        letters = {core for core, _, plain in parts.values() if plain}
        others = {p for core, tail, plain in parts.values() for p in (() if plain else (core,)) + ((tail,) if tail else ())}
        for p in (letters | others) & self.old.keys():
            found.setdefault(p, self.old[p])
        for w in letters.difference(found):
            seen = w if w.isascii() else w.encode().decode("latin-1").translate(self.visible)
            found[w] = array("H", [t.id for t in self.model.tokenize(seen)]).tobytes()
        others = list(others.difference(found))
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else (), strict=True):
            found[w] = array("H", e.ids).tobytes()
        for w, (core, tail, _) in parts.items():
            found[w] = found[core] + found[tail] if tail else found[core]
        return [b"".join(map(found.__getitem__, run)) for run in runs]


def _parts(run: str) -> tuple[str, str, bool]:
    """The string to encode for a run, the commas and stops that follow it, and whether it is a lower-case word of letters."""
    core = run.rstrip(",.")
    if core.isalpha():
        low = core.lower()
        if core.isascii() or ("Σ" not in core and is_normalized("NFC", core) and is_normalized("NFC", low) and low.isalpha()):
            return low, run[len(core):], True
    return run, "", False


def _loaded(spec: str) -> WordIds:
    return memo((WordIds, spec), lambda: WordIds(spec))


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends `end_id`, and writes the ids to `path` in ascending order of the document id.

    The files are Parquet, whose rows are segments: whole documents (their ids and numbers of token ids) and the coded
    blocks, each with its own checksum. Rows are sorted by range, so one hot source or id range spreads over many tasks, and
    file order is id order. Spark's committer keeps the files of one attempt only, so a lost executor leaves none behind.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    parts = max(1, docs.rdd.getNumPartitions())
    ordered = texts(docs, id_col, text_col).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    end = np.array([end_id], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, segment, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), np.uint16)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([np.array([d for d, _ in held], np.int64).tobytes()], pa.binary()),
                                    pa.array([np.array([len(b) // 2 for _, b in held], np.int64).tobytes()], pa.binary()), pa.array([range_coder.compress(ids)], pa.binary())],
                                   names=["part", "segment", "doc_ids", "counts", "blocks"])

        for batch in chunks(batches, keep=True):
            docs_ = [NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()]
            for doc, ids in zip(docs_, _loaded(spec.value)(batch.column("text").to_pylist()), strict=True):
                if held and size + len(ids) // 2 + 1 > SEGMENT:
                    yield made()
                    held, size, segment = [], 0, segment + 1
                held.append((doc, ids + end))
                size += len(ids) // 2 + 1
        if held:
            yield made()

    ordered.mapInArrow(run, FILE_COLUMNS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files: doc_id, start (ids of all documents before it), ids (array), each block verified."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path)
    sizes = rows.select("part", "segment", "counts").mapInArrow(_sizes, "part int, segment int, ids long")
    # one row per segment of some four million ids
    sizes = stage(sizes, "token-segments")
    order = Window.partitionBy(F.lit(0)).orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0))).drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = range_coder.decompress(row["blocks"])
                counts = np.frombuffer(row["counts"], np.int64)
                ends = np.cumsum(counts)
                docs_ = np.frombuffer(row["doc_ids"], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                made = pa.record_batch({"doc_id": pa.array(docs_, mask=docs_ == NO_ID), "start": pa.array(row["start"] + ends - counts), "ids": lists})
                for at in range(0, made.num_rows, 1024):
                    yield made.slice(at, 1024)

    if sizes.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["part", "segment"]).mapInArrow(run, "doc_id long, start long, ids array<int>")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [int(np.frombuffer(c, np.int64).sum()) for c in batch.column("counts").to_pylist()]
        yield pa.record_batch({"part": batch.column("part"), "segment": batch.column("segment"), "ids": pa.array(ids, pa.int64())})


def ids_checksum(column: pa.Array) -> pa.Array:
    """The unsigned CRC-32 of each list of ids as little-endian unsigned 32-bit integers."""
    return pa.array([zlib.crc32(np.asarray(ids.values, np.int32).astype("<u4").tobytes()) for ids in column], pa.int64())


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, read back from files that this call writes to the shared folder.

    Null or empty text: the end id alone. Null ids come first. Rows that share an id stay rows, next to each other in any
    order. An empty table writes no segments and gives no rows. Other columns are ignored. Ids of 65,536 or more are refused.
    """
    path = fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, end_id, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.diff(lists.offsets.to_numpy())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(sizes.astype(np.int64)),
                                   "ids_crc32": ids_checksum(lists)})

    return read_ids(docs.sparkSession, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
