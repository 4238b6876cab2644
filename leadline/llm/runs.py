"""Periodic runs of words: seeds on diagonals, their extension, and texts without the repeats."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, U64, Rolling, chunks, joined_bytes, mixed, texts, word_spans

#: A run has this many words at least, and this many periods.
LEAST, TIMES = 24, 3
RUN = "start:bigint,length:bigint,period:bigint"


def levels(longest: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, gram): lags from low to high, and the number of words that every run of such a period shares with itself.

    A run of period q has max(LEAST, TIMES * q) words, so max(LEAST, TIMES * q) - q neighbouring words recur q words later.
    """
    low = 1
    while low <= longest:
        gram = min(max(LEAST, TIMES * q) - q for q in {low, max(low, LEAST // TIMES), max(low, LEAST // TIMES + 1)})
        high = max(low, gram * 3 // 4)
        yield low, high, gram
        low = high + 1


def seeds(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (text, lag, place) at which a gram recurs after a lag, level by level; every run holds one at least.

    words: their hashes. ends: where each text ends. A gram that lies in a run of smallest period q comes again q words later.
    If it came p < q words later with p + q <= gram, the run's period would be a divisor of both (Fine and Wilf); so all gaps
    between its occurrences on the way exceed gram - high, and two or three steps over next occurrences reach the lag.
    """
    rolling, at = Rolling(words), np.arange(len(words))
    counts = np.diff(np.concatenate([[0], ends]))
    for low, high, gram in levels(int(counts.max(initial=0)) // TIMES):
        own = text[at]
        at = at[(at + gram <= ends[own]) & (counts[own] >= max(LEAST, TIMES * low))]
        if not len(at):
            return
        key = rolling.spans(at, at + gram)
        key = mixed(key + text[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        again = np.zeros(len(at) + 1, bool)                 # place k has the gram of place k - 1
        again[1:-1] = key[1:] == key[:-1]
        found, k = [], np.flatnonzero(again[1:])
        step = 1
        while len(k):
            lag = at[k + step] - at[k]
            fits = (lag >= low) & (lag <= high)
            found.append(np.stack([text[at[k[fits]]], lag[fits], at[k[fits]]], axis=1))
            gap = at[k + step] - at[k + step - 1]
            k = k[(gap > gram - high) & (lag < high) & again[k + step + 1]]
            step += 1
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        follows = np.zeros(len(rows), bool)                 # the place before is a seed of this lag too
        follows[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1) & (rows[1:, 2] == rows[:-1, 2] + 1)
        yield rows[~follows]
        at = np.sort(at[again[1:] | again[:-1]])            # a longer gram recurs only where this one does


def _reach(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first place from `at` on whose word differs from that `lag` words later, or where that word lies at `end`."""
    size = 64
    while at + lag < end:
        n = min(size, end - lag - at)
        same = words[at:at + n] == words[at + lag:at + lag + n]
        if not same.all():
            return at + int(same.argmin())
        at, size = at + n, size * 2
    return at


def _back(words: np.ndarray, at: int, lag: int, begin: int) -> int:
    size = 64
    while at > begin:
        n = min(size, at - begin)
        same = words[at - n:at][::-1] == words[at - n + lag:at + lag][::-1]
        if not same.all():
            return at - int(same.argmin())
        at, size = at - n, size * 2
    return at


def _primes(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


def find_runs(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of a slice of texts, sorted; start counts from the text's first word.

    Seeds are extended along their diagonal (text and lag) to both sides; what lies before the place that a diagonal is
    covered up to is not extended again. A stretch whose period is a multiple of a smaller one is left out.
    """
    first, out = np.concatenate([[0], ends[:-1]]), []
    for rows in seeds(words, text, ends):
        covered: dict[tuple[int, int], int] = {}
        for t, lag, at in rows.tolist():
            if at < covered.get((t, lag), 0):
                continue
            begin, end = _back(words, at, lag, first[t]), _reach(words, at, lag, ends[t])
            covered[t, lag] = end
            length = end - begin + lag
            if length >= max(LEAST, TIMES * lag) and not any((words[begin:begin + lag] == words[begin + lag // p:begin + lag // p + lag]).all() for p in _primes(lag)):
                out.append((t, int(begin - first[t]), int(length), lag))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, runs, best and collapsed of every whole text.

    Words are separated by blanks and the characters from tab to carriage return, and told apart by 64-bit hashes. `runs` has
    start (from 0), length and period of each stretch of max(LEAST, TIMES * period) words or more in which words a period
    apart are equal, whose period is the smallest it has, and that neither neighbouring word prolongs; sorted by start, then
    period. `best` has the greatest length / period (ties: smallest start, then period; null without runs). `collapsed` is the
    text without the words that a run repeats, those after its first period, joined by single blanks.

    One pass without a shuffle, a text at a time; memory is some 200 bytes a word of the longest text. Null, empty and blank
    texts have no words and no runs, and an empty collapsed text. Repeated rows and null ids stay as they are. An empty table
    gives no rows. Other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, offsets = joined_bytes(part.column("text"))
            begin, end, text = word_spans(data, ~SPACE, offsets)
            hashes = Rolling(data.astype(U64) + U64(1)).spans(begin, end)
            counts = np.bincount(text, minlength=part.num_rows)
            found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
            for t, *r in find_runs(hashes, text, np.cumsum(counts)):
                found[t].append(tuple(r))
            raw, collapsed = data.tobytes(), []
            for t, runs in enumerate(found):
                kept = raw[offsets[t]:offsets[t + 1]].split()
                if runs:
                    gone = bytearray(len(kept))
                    for start, length, period in runs:
                        gone[start + period:start + length] = b"\1" * (length - period)
                    kept = [w for w, g in zip(kept, gone, strict=True) if not g]
                collapsed.append(b" ".join(kept).decode())
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            borders = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            best = [_best(r) for r in found]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "n_words": pa.array(counts.astype(np.int64)),
                                   "runs": pa.ListArray.from_arrays(pa.array(borders), fields), "best": pa.array(best, fields.type), "collapsed": pa.array(collapsed, pa.string())})

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, mark long, n_words long, runs array<struct<{RUN}>>, best struct<{RUN}>, collapsed string")


def _best(runs: list[tuple[int, int, int]]) -> dict[str, int] | None:
    best = None
    for start, length, period in runs:                      # sorted, so an equal one is never better
        if best is None or length * best["period"] > best["length"] * period:
            best = {"start": start, "length": length, "period": period}
    return best
