"""Benchmark decontamination by winnowing."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, bit_filter, chunks, has_bit, joined_bytes, stage, texts, word_spans

#: A shared span of this many words is always found. GRAM + (windows of GRAM-grams) - 1 = SPAN.
SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: Words on either side of a k-gram within which a span of SPAN words around it lies.
SIDE = SPAN - GRAM
#: Bits of the filter over the benchmark's hashes, fixed whatever the benchmark's size (2 MB). It only saves rows.
FILTER_BITS = 1 << 24

# Words are runs of digits, letters (in lower case by then) and non-ASCII characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


class Words:
    """Hashes of all words of a slice of texts, with the text each belongs to."""

    def __init__(self, column: pa.Array):
        data, offsets = joined_bytes(column)
        data = LOWER[data]
        begin, end, self.text = word_spans(data, IS_WORD, offsets)
        self.hash = Rolling(data.astype(U64) + U64(1)).spans(begin, end) | U64(1)
        self.rolling = Rolling(self.hash)
        self.counts = np.bincount(self.text, minlength=len(column))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which n words of one text begin, and the hash of these words."""
        at = np.arange(max(0, len(self.text) - n + 1))
        at = at[self.text[at] == self.text[at + n - 1]] if len(at) else at
        return at, self.rolling.spans(at, at + n)

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """Winnowing: of every WINDOW neighbouring k-grams of a text, those with the smallest hash (all of them in a tie)."""
        n = len(self.text)
        at, hashes = self.grams(GRAM)
        gram = np.zeros(n, U64)
        gram[at] = hashes
        starts, _ = self.grams(SPAN)
        least = np.zeros(n, U64)
        if len(starts):
            low = gram[starts].copy()
            for k in range(1, WINDOW):
                np.minimum(low, gram[starts + k], out=low)
            least[starts] = low
        best = least.copy()
        for k in range(1, min(WINDOW, n)):
            np.maximum(best[k:], least[:-k], out=best[k:])
        chosen = at[best[at] == hashes]
        return chosen, gram[chosen]

    def around(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words from SIDE before each k-gram to SIDE after it; zero outside the text."""
        place = at[:, None] + np.arange(-SIDE, GRAM + SIDE)
        inside = (place >= 0) & (place < len(self.text))
        place = place.clip(0, max(0, len(self.text) - 1))
        return np.where(inside & (self.text[place] == self.text[at][:, None]), self.hash[place], U64(0))


def _salted(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words, apart from hashes of other lengths."""
    return hashes ^ U64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _context(words: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.view(np.int64).ravel()))


MARK = "h:bigint,n:int,place:int,words:array<bigint>"


def _fingerprints(words: Words, lengths: list[int], whole_short: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(h, n, place in the slice) of the selected k-grams (n = 0), and of short spans (n words).

    whole_short: only texts of n words exactly, as a benchmark item of fewer than SPAN words is one span; else all places.
    """
    at, hashes = words.selected()
    yield hashes, 0, at
    for n in lengths:
        at, hashes = words.grams(n)
        if whole_short:
            only = words.counts[words.text[at]] == n
            at, hashes = at[only], hashes[only]
        yield _salted(hashes, n), n, at


def item_fingerprints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, h, n, words: fingerprints of the benchmark, with the words around each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = Words(part.column("text"))
            for h, n, at in _fingerprints(words, list(range(1, SPAN)), True):
                if len(at):
                    yield pa.record_batch({"item_id": part.column("doc_id").take(pa.array(words.text[at])), "h": pa.array(h.view(np.int64)),
                                           "n": pa.array(np.full(len(at), n, np.int32)), "words": _context(words.around(at))})
    return texts(items, id_col, text_col).mapInArrow(run, "item_id long, h long, n int, words array<long>")


def find_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """Benchmark passages in documents: one row per document with row, doc_id, mark (a hash of the text), n_words,
    n_hit, spans, item_ids.

    A passage is SPAN neighbouring words of an item, or a whole item of fewer words. Both sides keep the smallest k-gram
    hash of each window; equal hashes are joined and the match extended word by word to either side. Every shared span of
    SPAN words contains a common fingerprint no more than SIDE words from its ends, so none is missed. Words are compared
    by 64-bit hashes. A fixed-size filter of the benchmark's hashes drops most of the documents' fingerprints before the
    join; the join decides. `spans` are the merged hit word ranges (begin, end exclusive) and n_hit their words; item_ids
    are sorted as strings.

    Null or empty texts, and texts without words, have no words and no hits; items without words match nothing, and items
    with a null id count as hits but are not listed. Repeated rows stay repeated (`row` tells them apart); items that share
    an id are one item. Empty tables: no rows without documents, no hits without items. Other columns are ignored.
    """
    prints = stage(item_fingerprints(items, item_id_col, item_text_col), "winnow-items")
    lengths = sorted(r.n for r in prints.where("n > 0").select("n").distinct().collect())  # nine at most
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(prints, "h", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = Words(part.column("text"))
            found = []
            for h, n, at in _fingerprints(words, lengths, False):
                hit = has_bit(known.value, h)
                found.append((h[hit], np.full(hit.sum(), n, np.int32), at[hit]))
            h, n, at = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            h, n, at = h[order], n[order], at[order]
            text = words.text[at]
            fields = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array((at - words.first[text]).astype(np.int32)), _context(words.around(at))],
                                                ["h", "n", "place", "words"])
            borders = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "mark": part.column("mark"), "n_words": pa.array(words.counts.astype(np.int64)),
                                   "marks": pa.ListArray.from_arrays(pa.array(borders), fields)})

    numbered = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    marked = stage(numbered.mapInArrow(run, f"row long, doc_id long, mark long, n_words long, marks array<struct<{MARK}>>"), "winnow-docs")
    marks = marked.where("size(marks) > 0").select("row", F.explode("marks").alias("m")).select("row", "m.*")
    both = marks.join(prints.select("item_id", "h", "n", F.col("words").alias("item_words")).distinct(), ["h", "n"])
    same = "zip_with(words, item_words, (x, y) -> x = y AND x <> 0)"
    both = both.withColumn("same", F.expr(same))
    # equal words next to the k-gram on its left and right, up to SIDE
    left = f"coalesce(array_position(reverse(slice(same, 1, {SIDE})), false) - 1, {SIDE})"
    right = f"coalesce(array_position(slice(same, {SIDE + GRAM + 1}, {SIDE}), false) - 1, {SIDE})"
    both = (both.withColumn("l", F.expr(f"CASE WHEN n = 0 THEN CASE WHEN {left} < 0 THEN {SIDE} ELSE {left} END ELSE 0 END"))
            .withColumn("r", F.expr(f"CASE WHEN n = 0 THEN CASE WHEN {right} < 0 THEN {SIDE} ELSE {right} END ELSE 0 END")))
    gram = f"forall(slice(same, {SIDE + 1}, CASE WHEN n = 0 THEN {GRAM} ELSE n END), x -> x)"
    hits = (both.where(f"{gram} AND (n > 0 OR l + r + {GRAM} >= {SPAN})")
            .select("row", "item_id", F.expr("cast(place - l as int)").alias("b"), F.expr(f"cast(place + r + CASE WHEN n = 0 THEN {GRAM} ELSE n END as int)").alias("e")))
    merged = """aggregate(ranges, cast(array() as array<struct<b:int,e:int>>), (done, x) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).e >= x.b
             THEN concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).b AS b, greatest(element_at(done, -1).e, x.e) AS e)))
             ELSE concat(done, array(x)) END)"""
    per_row = (hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("ranges"),
                                       F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
               .select("row", F.expr(merged).alias("spans"), "item_ids"))
    out = marked.select("row", "doc_id", "mark", "n_words").join(per_row, "row", "left")
    return out.select("row", "doc_id", "mark", "n_words", F.expr("coalesce(aggregate(spans, 0L, (s, x) -> s + x.e - x.b), 0L)").alias("n_hit"),
                      F.expr("coalesce(spans, cast(array() as array<struct<b:int,e:int>>))").alias("spans"),
                      F.expr("coalesce(item_ids, cast(array() as array<string>))").alias("item_ids"))
