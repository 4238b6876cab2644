"""Line dedup: an exact set-similarity join of lines."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, LOWER, SPACE, U64, Rolling, Seen, bit_filter, chunks, has_bit, joined_bytes, mixed, order_id, stage, text_mark, whole_groups, word_spans

#: Similarity of token sets from which lines match: 4/5.
NUM, DEN = 4, 5
#: Lines of one token that are compared in one piece; larger groups are cut into tiles of two such blocks.
BLOCK = 512
#: Tokens in fewer lines, by their counter, are compared whole in the bucket of their hash.
BOUNDED = 2048
#: Counters of the token counts, fixed whatever the corpus: 4 MB on the driver and in each worker.
COUNTERS, PART = 1 << 22, 1 << 16
#: Bits of the filter of lines that have candidates, and the hot tokens that are joined by broadcast at most (16 bytes each).
FILTER_BITS = 1 << 26
BROADCAST_ROWS = 100_000
PAIRS = 1 << 18
#: Words are 46-bit hashes; with six bits for the class of their count and twelve for the line, one sort orders all sets.
TOKEN_BITS, LEVEL_BITS, SORTED_LINES = 46, 6, 1 << 12
COUNTER_SHIFT = U64(TOKEN_BITS - 22)
#: Buckets of tokens for each input split, and prefix rows that a task packs at once.
BUCKETS_PER_SPLIT, HELD_ROWS = 2, 1 << 18


class Lines:
    """Lines of a slice of texts as sets of 46-bit word hashes, each set in order of rarity.

    level: the class of the count of each counter, see _levels; without it the order is that of the hashes.
    """

    def __init__(self, column: pa.Array, level: np.ndarray | None = None):
        data, offsets = joined_bytes(column)
        data = LOWER[data]
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
        begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.text = np.repeat(np.arange(n), per_text)
        self.number = np.arange(len(begin)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.per_text = per_text
        w_begin, w_end, _ = word_spans(data, ~SPACE, np.unique(np.concatenate([begin, [len(data)]])))
        # the last of several lines that begin at one place is the one with words
        line = np.repeat(np.arange(len(begin)), np.diff(np.searchsorted(w_begin, np.append(begin, len(data)))))
        word = Rolling(np.add(data, U64(1), dtype=U64)).spans(w_begin, w_end) >> U64(64 - TOKEN_BITS)
        if level is not None:
            word |= level[word >> COUNTER_SHIFT].astype(U64) << U64(TOKEN_BITS)
        parts = []
        cuts = np.searchsorted(line, np.arange(0, len(begin) + SORTED_LINES, SORTED_LINES))
        for k, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            keyed = np.sort((line[lo:hi] - k * SORTED_LINES).astype(U64) << U64(TOKEN_BITS + LEVEL_BITS) | word[lo:hi])
            if len(keyed):
                keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
                parts.append(((keyed >> U64(TOKEN_BITS + LEVEL_BITS)).astype(np.int64) + k * SORTED_LINES, keyed & U64((1 << TOKEN_BITS + LEVEL_BITS) - 1)))
        self.line, ordered = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64))
        self.token, self.level = ordered & U64((1 << TOKEN_BITS) - 1), ordered >> U64(TOKEN_BITS)
        self.size = np.bincount(self.line, minlength=len(begin))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        sums = np.concatenate([[U64(0)], np.cumsum(mixed(self.token))])
        self.hash = mixed(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U64))

    def fresh(self, seen: Seen, known: np.ndarray | None = None) -> np.ndarray:
        """One line of each set that could match another one and is not among those seen lately (which it joins)."""
        _, once = np.unique(self.hash, return_index=True)
        # sets of n and n + 1 tokens share n at most, so below NUM tokens only equal sets match
        once = once[self.size[once] >= NUM]
        if known is not None:
            once = once[has_bit(known, self.hash[once])]
        return once[seen.new(self.hash[once])]

    def sets(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For these lines: the number of each token's line among them, and the token's place in the whole."""
        size = self.size[lines]
        row = np.repeat(np.arange(len(lines)), size)
        return row, np.arange(len(row)) + np.repeat(self.first[lines] - np.cumsum(size) + size, size)

    def bitmaps(self, lines: np.ndarray) -> np.ndarray:
        row, at = self.sets(lines)
        bits = np.zeros((len(lines), 128), bool)
        bits[row, (self.token[at] & U64(127)).astype(np.int64)] = True
        return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1, 2)


def _prefix(size: np.ndarray) -> np.ndarray:
    """So many of the rarest tokens that any match shares one of them."""
    return size - -(-NUM * size // DEN) + 1


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest overlap with which sets of these sizes match."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _mark(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__doc": order_id(id_col), "__mark": text_mark(text_col), "__text": F.coalesce(F.col(text_col), F.lit(""))})


def _read(texts: DataFrame) -> DataFrame:
    """One row per document with its lines' hashes, and rows with a part of the token counts of a task."""
    lists = pa.list_(pa.struct([("line", pa.int32()), ("h", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for part in chunks(batches, "__text"):
            lines = Lines(part.column("__text"))
            np.add.at(counts, (lines.token >> COUNTER_SHIFT).astype(np.int64), np.uint32(1))
            used = np.flatnonzero(lines.size)
            borders = np.searchsorted(lines.text[used], np.arange(part.num_rows + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(lines.number[used].astype(np.int32)), pa.array(lines.hash[used].view(np.int64))], ["line", "h"])
            yield pa.record_batch({"doc": part.column("__doc"), "mark": part.column("__mark"), "n_lines": pa.array(lines.per_text.astype(np.int64)),
                                   "lines": pa.ListArray.from_arrays(pa.array(borders), entries),
                                   "part": pa.nulls(part.num_rows, pa.int32()), "counts": pa.nulls(part.num_rows, pa.binary())})
        for p in np.flatnonzero(counts.reshape(-1, PART).any(axis=1)).tolist():
            some = zlib.compress(counts[p * PART:(p + 1) * PART].tobytes(), 1)
            yield pa.record_batch({"doc": pa.nulls(1, pa.int64()), "mark": pa.nulls(1, pa.int64()), "n_lines": pa.nulls(1, pa.int64()), "lines": pa.nulls(1, lists),
                                   "part": pa.array([p], pa.int32()), "counts": pa.array([some], pa.binary())})
    return texts.select("__doc", "__mark", "__text").mapInArrow(
        run, "doc long, mark long, n_lines long, lines array<struct<line:int,h:bigint>>, part int, counts binary")


def _levels(read: DataFrame) -> np.ndarray:
    """For every counter the class of its count over the corpus: 0 for none or one, else the number of binary digits."""
    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.uint64)
        for packed in group.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(packed), np.uint32)
        level = np.where(total > 1, np.ceil(np.log2(np.maximum(total, 1) + 1)), 0).astype(np.uint8)
        return pa.table({"part": group.column("part")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, np.uint8)
    for row in read.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, level binary").collect():
        out[row.part * PART:(row.part + 1) * PART] = np.frombuffer(row.level, np.uint8)
    return out


ROW = ("token", "h", "shape", "s0", "s1")


def _prefix_rows(batches: Iterator[pa.RecordBatch], level: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every token in the prefix of a line: token, h, shape (size and place), and a bitmap of the line's tokens.

    A task gives a line that comes again soon once; later steps take each line once. Tokens that occur once in the corpus are left out, and lines of which
    no other set can be a match. The tokens whose counters stay below BOUNDED come first, then the others.
    """
    seen = Seen()
    limit = BOUNDED.bit_length()        # classes below hold counts below BOUNDED
    for part in chunks(batches, "__text"):
        lines = Lines(part.column("__text"), level)
        once = lines.fresh(seen)
        if not len(once):
            continue
        maps = lines.bitmaps(once)
        lengths = _prefix(lines.size[once])
        row = np.repeat(np.arange(len(once)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = lines.first[once][row] + place
        level_at = lines.level[at]

        def table(kept: np.ndarray) -> np.ndarray:
            mine, its = row[kept], at[kept]
            shape = lines.size[once][mine] << 32 | place[kept]
            return np.stack([lines.token[its].view(np.int64), lines.hash[once][mine].view(np.int64), shape, maps[mine, 0], maps[mine, 1]], axis=1)

        yield table((level_at > 0) & (level_at < limit)), table(level_at >= limit)


def _prefixes(texts: DataFrame, levels, buckets: int) -> DataFrame:
    """Prefix rows, packed by bucket: of the token if it is in few lines, else of the line, since groups of the others may be of any size."""
    def packed(tables: list[np.ndarray], large: bool) -> pa.RecordBatch:
        table = np.concatenate(tables)
        bucket = (table[:, int(large)] % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        table, cuts = table[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = [np.ascontiguousarray(table[cuts[b]:cuts[b + 1]].T).tobytes() for b in used]
        return pa.record_batch({"bucket": pa.array(used.astype(np.int32)), "large": pa.array(np.full(len(used), large)), "packed": pa.array(blobs, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        for tables in _prefix_rows(batches, levels.value):
            for large, (some, table) in enumerate(zip(held, tables, strict=True)):
                some.append(table)
                if sum(map(len, some)) > HELD_ROWS:
                    yield packed(some, bool(large))
                    some.clear()
        for large, some in enumerate(held):
            if sum(map(len, some)):
                yield packed(some, bool(large))
    return texts.select("__text").mapInArrow(run, "bucket int, large boolean, packed binary")


def _tiled(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a group for the comparison: a token, or a tile of two blocks of it if it has more than BLOCK rows.

    `own` is set in the one tile in which a block is also compared with itself.
    """
    many = stage(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), name)
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    sized = rows.join(many, "token", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("h", "token"), F.col("blocks")).cast("int"))
    tiles = F.expr("""CASE WHEN blocks = 1 THEN array(struct(0 AS tile, true AS own)) ELSE
        transform(filter(sequence(0, blocks - 1), x -> x <> block), x -> struct(least(x, block) * blocks + greatest(x, block) AS tile,
            (x = block + 1 OR (block = blocks - 1 AND x = block - 1)) AS own)) END""")
    return sized.withColumn("t", F.explode(tiles)).select("token", "t.tile", "t.own", "block", *[c for c in rows.columns if c != "token"])


def _dealt(tiled: DataFrame, *order: str) -> DataFrame:
    partitions = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(partitions, "token", "tile").sortWithinPartitions("token", "tile", *order)


def candidate_pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that pass the filters; rows of a group stand together in order of size.

    Length: the smaller set has NUM / DEN of the larger one's tokens at least. Position: with the token as the first common
    one, what follows it must be enough for the overlap. Bitmap: each bit that differs stands for a token of one set only.
    """
    group, size, place = rows["group"], rows["shape"] >> 32, rows["shape"] & 0xFFFFFFFF
    n = len(group)
    end = np.searchsorted(group, group, side="right")
    alive = np.arange(n)
    d = 1
    while len(alive):
        alive = alive[alive + d < end[alive]]
        later = alive + d
        fits = size[alive] * DEN >= size[later] * NUM
        alive = alive[fits]  # the sizes that follow are larger still
        later = alive + d
        need = _need(size[alive], size[later])
        rest = np.minimum(size[alive] - place[alive], size[later] - place[later])
        apart = sum(np.bitwise_count((m[alive] ^ m[later]).view(U64)).astype(np.int64) for m in (rows["s0"], rows["s1"]))
        good = (rest >= need) & (apart <= size[alive] + size[later] - 2 * need) & (rows["h"][alive] != rows["h"][later])
        good &= (rows["block"][alive] != rows["block"][later]) | rows["own"][alive]
        if good.any():
            yield alive[good], later[good]
        d += 1


def _with_candidates(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(token, h) of lines that have a candidate in the token's group."""
    used = np.zeros(len(rows["h"]), bool)
    for a, b in candidate_pairs(rows):
        used[a] = used[b] = True
    return pa.record_batch({"token": pa.array(rows["token"][used]), "h": pa.array(rows["h"][used])})


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["token", "tile"]):
        yield _with_candidates(rows)


def _active_bucket(group: pa.Table) -> pa.Table:
    """The same for a bucket of tokens of bounded groups; of the others, the rows of each line once. A line may come from several tasks."""
    table = np.concatenate([np.frombuffer(b, np.int64).reshape(len(ROW), -1) for b in group.column("packed").to_pylist()], axis=1)
    table = table[:, np.lexsort((table[1], table[2], table[0]))]
    token, h = table[:2]
    table = table[:, np.concatenate([[True], (token[1:] != token[:-1]) | (h[1:] != h[:-1])])]
    rows = dict(zip(ROW, table, strict=True))
    if group.column("large")[0].as_py():
        return pa.table({c: pa.array(np.ascontiguousarray(v)) for c, v in rows.items()})
    n = len(rows["h"])
    change = np.concatenate([[0], rows["token"][1:] != rows["token"][:-1]])
    found = _with_candidates(rows | {"group": np.cumsum(change), "block": np.zeros(n, np.int32), "own": np.ones(n, bool)})
    return pa.Table.from_batches([found]).select(["token", "h"]).append_column("shape", nulls := pa.nulls(found.num_rows, pa.int64())).append_column(
        "s0", nulls).append_column("s1", nulls)


def _token_sets(texts: DataFrame, levels, known) -> DataFrame:
    """h and the ordered tokens of the lines that the filter knows; a task sends a line once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in chunks(batches, "__text"):
            lines = Lines(part.column("__text"), levels.value)
            once = lines.fresh(seen, known.value)
            if len(once):
                sets = [_short(lines.token[lines.first[k]:lines.first[k + 1]]) for k in once.tolist()]
                yield pa.record_batch({"h": pa.array(lines.hash[once].view(np.int64)), "tokens": pa.array(sets, pa.binary())})
    return texts.select("__text").mapInArrow(run, "h long, tokens binary")


def _short(tokens: np.ndarray) -> bytes:
    """Six bytes a token."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(short: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(short), np.uint8).reshape(-1, 6)
    tokens = np.zeros((len(raw), 8), np.uint8)
    tokens[:, :6] = raw
    return tokens.view(U64).ravel()


def _contains(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted


def _overlaps(keys: np.ndarray, values: np.ndarray, first: np.ndarray, count: np.ndarray, other: np.ndarray, vocabulary: int) -> np.ndarray:
    """For each pair: how many of `count` values from `first` on are in the set `other`. keys: set * vocabulary + value, sorted."""
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first, count)
    hit = _contains(keys, np.repeat(other * vocabulary, count) + values[at])
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[begin[1:]] - sums[begin[:-1]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every line its matches in the group (each pair only with its first common token) and the earliest of them."""
    for rows in whole_groups(batches, ["token", "tile"], rows=1 << 13):
        sets = rows["tokens"].tolist()
        sizes = np.array([len(s) // 6 for s in sets])
        first = np.concatenate([[0], np.cumsum(sizes)])
        tokens, value = np.unique(_long(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        keys = np.sort(owner * len(tokens) + value)
        where = np.flatnonzero(tokens[value] == rows["token"].view(U64)[owner])
        place = np.zeros(len(sets), np.int64)
        place[owner[where]] = where - first[owner[where]]
        bits = np.zeros((len(sets), 128), bool)
        bits[owner, (tokens[value] & U64(127)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        rows = rows | {"shape": sizes << 32 | place, "s0": maps[:, 0], "s1": maps[:, 1]}
        order = np.lexsort((rows["line"], rows["mark"], rows["doc"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        links, best = np.zeros(len(order), np.int64), np.full(len(order), len(order))
        for a, b in candidate_pairs(rows):
            for some in np.array_split(np.arange(len(a)), max(1, len(a) * int(sizes.mean() + 1) // (PAIRS * 16))):
                x, y = a[some], b[some]
                common = _overlaps(keys, value, first[x], place[x], y, len(tokens))
                x, y = x[common == 0], y[common == 0]
                match = _overlaps(keys, value, first[x], sizes[x], y, len(tokens)) >= _need(sizes[x], sizes[y])
                x, y = x[match], y[match]
                np.add.at(links, x, 1)
                np.add.at(links, y, 1)
                np.minimum.at(best, x, rank[y])
                np.minimum.at(best, y, rank[x])
        got = np.flatnonzero(links)
        if len(got):
            head = order[best[got]]
            yield pa.record_batch({"h": pa.array(rows["h"][got]), "links": pa.array(links[got]), "doc": pa.array(rows["doc"][head]),
                                   "mark": pa.array(rows["mark"][head]), "line": pa.array(rows["line"][head])})


def similar_lines(texts: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All classes of equal lines (h, first place, number), and for those with matches: links and the earliest match."""
    lines = read.where("lines IS NOT NULL").select("doc", "mark", F.explode("lines").alias("l")).select("doc", "mark", "l.line", "l.h")
    place = F.struct("doc", "mark", "line")
    classes = stage(lines.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-classes")
    spark = texts.sparkSession
    levels = spark.sparkContext.broadcast(_levels(read))
    buckets = BUCKETS_PER_SPLIT * max(1, texts.rdd.getNumPartitions())
    # one pass over the texts for both kinds of tokens: only rows of tokens in many lines have a shape left
    done = stage(_prefixes(texts, levels, buckets).groupBy("bucket", "large").applyInArrow(_active_bucket, ", ".join(f"{c} long" for c in ROW)), "line-prefixes")
    large = done.where("shape IS NOT NULL")
    found = done.where("shape IS NULL").select("token", "h").union(_dealt(_tiled(large, "line-hot"), "shape", "h").mapInArrow(_active, "token long, h long"))
    active = stage(found.distinct(), "line-active")
    known = spark.sparkContext.broadcast(bit_filter(active, "h", FILTER_BITS))
    placed = _token_sets(texts, levels, known).dropDuplicates(["h"]).join(classes.select("h", "first.*"), "h")
    # groups are cut before their lines' tokens are joined to them
    rows = stage(_tiled(active, "line-hot-sets"), "line-tiles").join(placed, "h")
    rows = _dealt(rows.withColumn("size", F.length("tokens")), "size", "h")
    matched = rows.mapInArrow(_verify, "h long, links long, doc long, mark long, line int")
    links = matched.groupBy("h").agg(F.sum("links").alias("links"), F.min(place).alias("earliest"))
    return classes, links


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, mark (a hash of its text), n_lines, n_links, removed (numbers of repeated lines, from 0).

    A line is the set of its words (runs without white space, A-Z in lower case). A line is removed if a line at an
    earlier place (document id, then line number) is similar: the sets' Jaccard similarity is 4/5 or more. Earlier lines
    count whether they are removed themselves or not. n_links: over the document's lines, the other sets each matches.

    Equal sets are one class. Words are ordered by rarity (the class of their count over the corpus, then a hash); lines
    that share one of their rarest words and pass the length, positional and bitmap filters are candidates, whose sets are
    then compared exactly, once for each pair, in the group of their first common word. Groups of any size are
    cut into tiles of two bounded blocks; pairs never leave a task, only a line's number of matches and the earliest. Words are
    compared by 46-bit hashes.

    Null text: one line without words. Lines without words are never removed. Null ids count as larger than all others; of
    rows that share an id the smaller hash of the text comes first, and rows equal in both are treated alike, each keeping
    its own lines. Empty table: no rows. Other columns are ignored.
    """
    texts = _mark(docs, id_col, text_col)
    read = stage(_read(texts), "line-read")
    classes, links = similar_lines(texts, read)
    place = F.struct("doc", "mark", "line")
    verdict = classes.join(links, "h", "left").where("n > 1 OR links IS NOT NULL")
    verdict = stage(verdict.select("h", F.least("first", "earliest").alias("least"), F.coalesce("links", F.lit(0)).alias("links")), "line-verdicts")
    lines = read.where("lines IS NOT NULL").select("doc", "mark", F.explode("lines").alias("l")).select("doc", "mark", "l.line", "l.h")
    judged = lines.join(verdict, "h").select("doc", "mark", "line", "links", (place > F.col("least")).alias("gone"))
    per_doc = judged.distinct().groupBy("doc", "mark").agg(F.sum("links").alias("n_links"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))
    rows = read.where("n_lines IS NOT NULL").select("doc", "mark", "n_lines").join(per_doc, ["doc", "mark"], "left")
    return rows.select(F.when(F.col("doc") < LAST_ID, F.col("doc")).alias("doc_id"), "mark", "n_lines", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                       F.coalesce("removed", F.expr("cast(array() AS array<int>)")).alias("removed"))


def _rest(text: pd.Series, removed: pd.Series) -> pd.Series:
    """The text without these lines; null if no word is left."""
    def cut(t: str, gone) -> str | None:
        if gone is None or not len(gone):
            return t
        gone = set(gone.tolist())
        kept = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone)
        return kept if kept.strip() else None
    return pd.Series([cut(t, gone) for t, gone in zip(text, removed, strict=True)], dtype=object)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, less their repeated lines. Documents all of whose lines go are left out.

    A document without repeated lines keeps its text as it is, a null included.
    """
    found = repeated_lines(docs, id_col, text_col).where("size(removed) > 0").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__doc"), F.col("mark").alias("__mark"),
                                                                                      F.col("removed").alias("__removed")).distinct()
    joined = _mark(docs, id_col, text_col).join(found, ["__doc", "__mark"], "left")
    rest = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.pandas_udf(_rest, "string")("__text", "__removed"))
    kept = joined.withColumn("__new", rest).where("__removed IS NULL OR __new IS NOT NULL")
    return kept.select(*[F.col("__new").alias(c) if c == text_col else F.col(c) for c in docs.columns])
