"""Ranked lexical search with the queries indexed and the documents streamed through the index."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, bit_filter, chunks, give_back, has_bit, joined_bytes, mixed, stage, texts, word_spans

TOP = 10
#: Bits of the filter over the items' terms, fixed whatever their number (2 MB). It only saves postings.
FILTER_BITS = 1 << 24
#: Postings (item, term) of one piece of the index, 24 bytes each; an item's terms stay together, so one long item makes a larger piece.
PIECE = 1 << 20
#: Cells of the table of scores that one step fills.
CELLS = 1 << 20
#: Terms whose document counts a task holds before it passes them on.
HELD = 1 << 20

# Terms are runs of digits, letters (in lower case by then) and non-ASCII characters.
IS_TERM = np.zeros(256, bool)
IS_TERM[0x30:0x3A] = IS_TERM[0x61:0x7B] = IS_TERM[0x80:] = True


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each text's distinct terms, sorted by text, and every text's number of terms."""
    data, offsets = joined_bytes(column)
    data = LOWER[data]
    begin, end, text = word_spans(data, IS_TERM, offsets)
    h = Rolling(data.astype(U64) + U64(1)).spans(begin, end)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return text[at], h[at], np.diff(np.concatenate([at, [len(h)]])), np.bincount(text, minlength=len(column))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and h, once for each term of an item; rows that share an id, null included, are one item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text, h, _, _ = terms_of(part.column("text"))
            yield pa.record_batch({"item_id": part.column("doc_id").take(pa.array(text)), "h": pa.array(h.view(np.int64))})

    return texts(items, id_col, text_col).mapInArrow(run, "item_id long, h long").distinct()


def _lists(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each term, in parts of at most HELD terms and one batch."""
    held_h, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        h = np.frombuffer(b"".join(batch.column("h").to_pylist()), np.int64)
        held_h, place = np.unique(np.concatenate([held_h, h]), return_inverse=True)
        held_c = np.bincount(place, np.concatenate([held_c, np.ones(len(h), np.int64)]), minlength=len(held_h)).astype(np.int64)
        if len(held_h) > HELD:
            yield pa.record_batch({"h": pa.array(held_h), "c": pa.array(held_c)})
            held_h, held_c = held_h[:0], held_c[:0]
    if len(held_h):
        yield pa.record_batch({"h": pa.array(held_h), "c": pa.array(held_c)})


class Index:
    """The inverted index of a piece of the items: for each term its weight and the items that hold it."""

    def __init__(self, item: np.ndarray, h: np.ndarray, weight: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.items, self.n = item[order], int(item.max(initial=-1)) + 1
        self.terms, self.first = np.unique(h[order], return_index=True)
        self.weights = weight[order][self.first]
        self.sizes = np.diff(np.concatenate([self.first, [len(h)]]))

    def scores(self, doc: np.ndarray, h: np.ndarray, tf: np.ndarray, m: np.ndarray, docs: int) -> np.ndarray:
        """The table (document, item) of scores; sums stay far below 2^53, so doubles hold them exactly."""
        place = np.searchsorted(self.terms, h)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == h if len(self.terms) else np.zeros(len(h), bool)
        place, doc, tf = place[known], doc[known], tf[known].astype(np.int64)
        gain = self.weights[place] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        sizes = self.sizes[place]
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[place] - begin, sizes) + np.arange(sizes.sum())
        return np.bincount(np.repeat(doc * self.n, sizes) + self.items[at], np.repeat(gain, sizes), docs * self.n).reshape(docs, self.n)


class Heaps:
    """The `top` best documents of each item so far: score, id (null ones last) and whether there is an id."""

    def __init__(self, items: int, top: int):
        self.top, self.item = top, np.zeros(0, np.int64)
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.zeros(items)

    def update(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Only scores that reach an item's last place, above zero, are looked at."""
        row, item = np.nonzero((scores >= self.least) & (scores > 0))
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item].astype(np.int64)])
        doc, null = np.concatenate([self.doc, doc[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.top
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        full = np.flatnonzero(np.arange(len(self.item)) - np.searchsorted(self.item, self.item) == self.top - 1)
        self.least[self.item[full]] = self.score[full]


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                     item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` best documents of each item among all documents with a score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))) for N documents with terms and df that hold it. A document of n
    terms, where all documents have L, has m = 10 + (90 n N) div L, and scores weight * ((10^9 tf) div (1000 tf + 8 m)) for each
    distinct term of the item that it holds tf times. Equal scores are ranked by id.

    Texts are cut into terms once, and the counts of the terms that some item may hold are kept as a table: a fixed-size
    filter decides, which never misses one. The table is counted for df, and streamed through the inverted index of the
    items, which is sent out in pieces of a bounded size; every task keeps `top` documents for each item, and these are merged.

    Null, empty texts and texts without terms are no documents and match nothing; such items have no rows. Items that share
    an id, or have none, are one item with the terms of all. Repeated documents are ranked each; null ids come last among
    equal scores. Empty tables give no rows. Other columns are ignored. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    wanted = stage(item_terms(items, item_id_col, item_text_col), "search-items")
    known = spark.sparkContext.broadcast(bit_filter(wanted, "h", FILTER_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text, h, tf, n = terms_of(part.column("text"))
            may = has_bit(known.value, h)
            text, h, tf = text[may], h[may], tf[may].astype(np.int32)
            cuts = np.searchsorted(text, np.arange(1, part.num_rows))
            packed = lambda a: pa.array([v.tobytes() for v in np.split(a, cuts)], pa.binary())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n": pa.array(n.astype(np.int64)), "h": packed(h), "tf": packed(tf)})

    counted = stage(texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n long, h binary, tf binary"), "search-terms")
    whole = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = counted.select("h").mapInArrow(_document_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("df"))
    # items are numbered inside their pieces: `piece` by the running number of postings of hashed slots, all by aggregates
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    pieces = max(1, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / PIECE))
    weighted = stage(wanted.join(df, "h").withColumn("piece", F.pmod(F.xxhash64("item_id"), F.lit(pieces)).cast("int")), "search-index")
    return _merged([_best_of(counted, weighted.where(F.col("piece") == p), whole.docs, whole.terms, top) for p in range(pieces)], top)


def _best_of(counted: DataFrame, piece: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item_id, doc_id and score of the best documents of each task for the items of one piece of the index."""
    rows = piece.select("item_id", "h", "df").toArrow()
    names, item = np.unique(rows.column("item_id").fill_null(0).to_numpy(), return_inverse=True)
    no_id = rows.column("item_id").is_null().to_numpy()
    names, item = list(names), np.where(no_id, len(names), item)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in rows.column("df").to_pylist()], np.int64)
    h = rows.column("h").to_numpy()
    sent = counted.sparkSession.sparkContext.broadcast(Index(item, h, weight))
    names_sent = [int(x) for x in names] + [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        heaps = Heaps(index.n, top)
        for whole in batches:
            step = max(1, CELLS // max(1, index.n))
            for at in range(0, whole.num_rows if index.n else 0, step):
                batch = whole.slice(at, step)
                h, tf = _lists(batch.column("h"), np.int64), _lists(batch.column("tf"), np.int32)
                doc = np.repeat(np.arange(batch.num_rows), [len(x) for x in h])
                m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()] if n_terms else [10] * batch.num_rows, np.int64)
                ids = batch.column("doc_id")
                heaps.update(index.scores(doc, np.concatenate(h), np.concatenate(tf), m, batch.num_rows),
                             ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        if len(heaps.item):
            yield pa.record_batch({"item_id": pa.array([names_sent[i] for i in heaps.item.tolist()], pa.int64()), "doc_id": pa.array(heaps.doc, mask=heaps.null),
                                   "score": pa.array(heaps.score)})
        give_back()

    return counted.mapInArrow(run, "item_id long, doc_id long, score long")


def _merged(parts: list[DataFrame], top: int, salts: int = 64) -> DataFrame:
    """The heaps of all tasks, merged in two steps so that no task sees all entries of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionAll(part)
    salted = both.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(salts)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("item_id", "rank", "doc_id", "score")
