"""Document quality by a linear-chain conditional random field over lines."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Rolling, chunks, joined_bytes, mixed, texts, word_spans

#: Labelled documents that a fit uses at most; which ones is decided by a hash of the id.
SAMPLE = 4000
#: A document's lines enter the fit in pieces of so many.
PIECE = 64
STEPS, RATE, PENALTY = 300, 0.1, 1e-3
GOOD_FROM = 0.7

_flags = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
UPPER, LOWER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("abcdefghijklmnopqrstuvwxyz")
DIGIT, MARKS, SYMBOLS = _flags("0123456789"), _flags(".,;:'-?"), _flags("!\"#$%&()*+/<=>@[\\]^_`{|}~")
CLASSES = (UPPER, LOWER, DIGIT, MARKS, SYMBOLS, np.arange(256) >= 0x80, SPACE)
N_OWN = 14


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line of a slice of texts, the line's bytes, and each text's number of lines (one at least)."""
    data, offsets = joined_bytes(column)
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    lines = np.bincount(text_of_break, minlength=n) + 1
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    size = (end - begin).astype(float)
    shares = []
    for flags in CLASSES:
        sums = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        shares.append((sums[end] - sums[begin]) / np.maximum(size, 1))
    upper, lower, digit, marks, symbols, other, space = shares

    borders = np.unique(np.concatenate([begin, [len(data)]]))
    w_begin, w_end, _ = word_spans(data, ~SPACE, borders)
    # the last of several lines that begin at one place is the one with bytes
    line = np.searchsorted(begin, w_begin, side="right") - 1
    words = np.bincount(line, minlength=len(begin)).astype(float)
    hashes = Rolling(data.astype(U64) + U64(1)).spans(w_begin, w_end)
    same_line = line[1:] == line[:-1]
    again = np.bincount(line[1:][same_line & (hashes[1:] == hashes[:-1])], minlength=len(begin)) / np.maximum(words, 1)
    keyed = np.sort(mixed(hashes) >> U64(24) | line.astype(U64) << U64(40))
    kinds = np.bincount((keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])[:len(keyed)]] >> U64(40)).astype(np.int64), minlength=len(begin))
    length = (w_end - w_begin).astype(float)
    mean = np.bincount(line, length, minlength=len(begin)) / np.maximum(words, 1)
    short = np.bincount(line[length <= 3], minlength=len(begin)) / np.maximum(words, 1)
    odd_end = np.bincount(line[SYMBOLS[data[w_end - 1]]] if len(line) else line, minlength=len(begin)) / np.maximum(words, 1)
    ratio = kinds / np.maximum(words, 1)
    own = np.stack([upper / np.maximum(upper + lower, 1e-9) * (upper > 0), digit, marks, symbols, np.minimum(1, 20 * symbols), other, space, again,
                    ratio, np.log1p(size) / 5, mean / 10, short, odd_end, size == 0], axis=1)
    return own.astype(np.float32), size, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and the line after (zero beyond the text), and a constant."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + lines - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1)


def _soft(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def forward_backward(score: np.ndarray, lines: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log odds of `good` for every line given its whole text; with `pairs` also the expected number of each transition.

    score: log odds of each line by itself. moves[a][b]: log weight of state a (0 bad, 1 good) before state b. All texts
    advance together, the longest first, so step t touches only those that have t lines.
    """
    order = np.argsort(-lines, kind="stable")
    first = (np.concatenate([[0], np.cumsum(lines)[:-1]]))[order]
    longest = int(lines.max(initial=0))
    alive = np.searchsorted(-lines[order], -np.arange(longest), side="left")
    forward, backward = score.astype(float).copy(), np.zeros(len(score))
    for t in range(1, longest):
        at = first[:alive[t]] + t
        x = forward[at - 1]
        forward[at] += np.logaddexp(x + moves[1, 1], moves[0, 1]) - np.logaddexp(x + moves[1, 0], moves[0, 0])
    for t in range(longest - 1, 0, -1):
        at = first[:alive[t]] + t
        x = score[at] + backward[at]
        backward[at - 1] = np.logaddexp(x + moves[1, 1], moves[1, 0]) - np.logaddexp(x + moves[0, 1], moves[0, 0])
    counts = None
    if pairs:
        inner = np.ones(len(score), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        log = np.stack([[moves[a, b] + a * forward[at - 1] + b * (score[at] + backward[at]) for b in (0, 1)] for a in (0, 1)])
        log -= log.max(axis=(0, 1))
        weight = np.exp(log)
        counts = (weight / weight.sum(axis=(0, 1))).sum(axis=2)
    return forward + backward, counts


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float

    def documents(self, own: np.ndarray, size: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The good share of each text by bytes (a line counts one byte more), and each line's probability of being good."""
        score = with_neighbours((own - self.centre) / self.scale, lines) @ self.weights
        odds, _ = forward_backward(score, lines, self.moves)
        good = _soft(odds)
        first = np.concatenate([[0], np.cumsum(lines)[:-1]])
        weight = size + 1
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), good

    def score(self, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return _soft(self.slope * np.log(share / (1 - share)) + self.offset)


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return x


def train(own: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray) -> Model:
    """Maximum likelihood of the labels, every line of a document carrying the document's label; then a scale for the share.

    Without documents of both labels nothing can be learnt: every score is then the only label there is, or one half.
    """
    n = own.shape[1]
    if len(np.unique(label)) < 2:
        even = {0: -20.0, 1: 20.0}.get(int(label[0]), 0.0) if len(label) else 0.0
        return Model(np.zeros(n), np.ones(n), np.zeros(3 * n + 1), np.zeros((2, 2)), 0.0, even)
    centre, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - centre) / scale, lines).astype(float)
    pieces = np.concatenate([[PIECE] * (k // PIECE) + [k % PIECE] * (k % PIECE > 0) for k in lines.tolist()]).astype(np.int64)
    y = np.repeat(label, lines).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.concatenate([[0], np.cumsum(pieces)[:-1]])] = False
    seen = np.array([[(inner & (y == b))[1:][y[:-1] == a].sum() for b in (0, 1)] for a in (0, 1)], float)

    def gradient(p: np.ndarray) -> np.ndarray:
        weights, moves = p[:-4], p[-4:].reshape(2, 2)
        odds, counts = forward_backward(x @ weights, pieces, moves, pairs=True)
        return np.concatenate([x.T @ (_soft(odds) - y), (counts - seen).ravel()]) / len(y) + PENALTY * p

    p = _adam(gradient, np.zeros(3 * n + 5), STEPS, RATE)
    model = Model(centre, scale, p[:-4], p[-4:].reshape(2, 2), 1.0, 0.0)
    share = np.clip(model.documents(own, size, lines)[0], 1e-6, 1 - 1e-6)
    odds = np.log(share / (1 - share))

    def fit(q: np.ndarray) -> np.ndarray:
        e = _soft(q[0] * odds + q[1]) - label
        return np.array([(e * odds).mean(), e.mean()]) + 1e-3 * np.array([q[0] - 1, q[1]])

    model.slope, model.offset = _adam(fit, np.array([1.0, 0.0]), 400, 0.05)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> Model:
    """Fits the field on at most `sample` labelled documents that are not held out.

    Line features are computed where the texts lie; the driver receives those of the sample (some 60 bytes a line).
    Labels other than 0 and 1, null ids and contradictory labels of an id are left out.
    """
    known = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out())
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    chosen = texts(docs, id_col, text_col).select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = {r.doc_id: r.label for r in chosen.collect()}
    picked = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            own, size, lines = line_features(part.column("text"))
            ends = np.cumsum(lines)
            cut = lambda a: [v.tobytes() for v in np.split(a, ends[:-1])]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "own": pa.array(cut(own), pa.binary()),
                                   "size": pa.array(cut(size), pa.binary())})

    rows = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    got = rows.mapInArrow(run, "doc_id long, label int, own binary, size binary").toArrow().sort_by("doc_id")
    own = np.frombuffer(b"".join(got.column("own").to_pylist()), np.float32).reshape(-1, N_OWN)
    sizes = [len(b) // 8 for b in got.column("size").to_pylist()]
    return train(own, np.frombuffer(b"".join(got.column("size").to_pylist()), np.float64), np.array(sizes, np.int64), got.column("label").to_numpy().astype(np.int64))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and bad_lines (numbers from 0) of every whole text, with the columns in `keep`.

    One pass without a shuffle; the model is a few hundred numbers. Null or empty text: one empty line, scored like any
    other. Repeated rows and null ids stay as they are. An empty table gives no rows. Other columns are left out.
    """
    names = [f"__keep_{k}" for k in range(len(keep))]
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            own, size, lines = line_features(part.column("text"))
            share, good = model.documents(own, size, lines)
            first = np.concatenate([[0], np.cumsum(lines)[:-1]])
            text = np.repeat(np.arange(len(lines)), lines)
            bad = np.flatnonzero(good < 0.5)
            borders = np.searchsorted(text[bad], np.arange(len(lines) + 1)).astype(np.int32)
            bad_lines = pa.ListArray.from_arrays(pa.array(borders), pa.array((bad - first[text[bad]]).astype(np.int32)))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(model.score(share)), "bad_lines": bad_lines}
                                  | {n: part.column(n) for n in names})

    kinds = "".join(f", {n} {slim.schema[n].dataType.simpleString()}" for n in names)
    made = slim.mapInArrow(run, "doc_id long, score double, bad_lines array<int>" + kinds)
    return made.select("doc_id", "score", "bad_lines", *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)])


def good_documents(docs: DataFrame, model: Model, least: float = GOOD_FROM, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores `least` or more; see score_quality.

    One pass without a shuffle, about a megabyte of text at a time, of which only good rows are passed on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            text = part.column(text_col).cast(pa.string()).fill_null("")
            score = model.score(model.documents(*line_features(text))[0])
            yield part.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_column(model: Model, text_col: str) -> Column:
    """The score of score_quality as a column."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.record_batch({"text": text.cast(pa.string())})
        found = [model.score(model.documents(*line_features(part.column("text")))[0]) for part in chunks(iter([batch]))]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(F.coalesce(F.col(text_col), F.lit("")))
