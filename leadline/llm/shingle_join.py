"""Near-duplicate documents: an exact set-similarity join of their word shingles."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, Rolling, Seen, bit_filter, chunks, has_bit, joined_bytes, mixed, order_id, stage, text_mark, whole_groups, word_spans
from .components import component_ids, star_forest
from .line_dedup import BLOCK, BOUNDED, COUNTER_SHIFT, COUNTERS, DEN, FILTER_BITS, LEVEL_BITS, NUM, PART, TOKEN_BITS, _dealt, _levels, _long, _need, _prefix, _short, candidate_pairs

#: Texts whose sets one sort orders: twelve bits beside a shingle's 46 and the six of its class.
SORTED_TEXTS = 1 << 12


class Shingles:
    """Texts as sets of 46-bit hashes of `n` neighbouring words, each set in order of rarity, see line_dedup.Lines.

    Words are runs without white space, A-Z in lower case. A text of fewer words is one shingle; one without words has none.
    """

    def __init__(self, column: pa.Array, n: int, level: np.ndarray | None = None):
        data, offsets = joined_bytes(column)
        data = LOWER[data]
        begin, end, text = word_spans(data, ~SPACE, offsets)
        words = np.bincount(text, minlength=len(column))
        wide = np.minimum(words, n)
        count = np.where(words > 0, words - wide + 1, 0)
        owner = np.repeat(np.arange(len(column)), count)
        start = np.arange(len(owner)) + np.repeat(np.cumsum(words) - words - np.cumsum(count) + count, count)
        token = Rolling(Rolling(data.astype(U64) + U64(1)).spans(begin, end)).spans(start, start + wide[owner]) >> U64(64 - TOKEN_BITS)
        if level is not None:
            token |= level[token >> COUNTER_SHIFT].astype(U64) << U64(TOKEN_BITS)
        keyed = np.sort(owner.astype(U64) << U64(TOKEN_BITS + LEVEL_BITS) | token)
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])[:len(keyed)]]
        self.owner = (keyed >> U64(TOKEN_BITS + LEVEL_BITS)).astype(np.int64)
        self.token, self.level = keyed & U64((1 << TOKEN_BITS) - 1), keyed >> U64(TOKEN_BITS) & U64((1 << LEVEL_BITS) - 1)
        self.size = np.bincount(self.owner, minlength=len(column))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        sums = np.concatenate([[U64(0)], np.cumsum(mixed(self.token))])
        self.hash = mixed(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U64)).view(np.int64)

    def fresh(self, seen: Seen) -> np.ndarray:
        """One text of each set that has shingles and is not among those seen lately (which it joins)."""
        once = np.sort(np.unique(self.hash, return_index=True)[1])
        once = once[self.size[once] > 0]
        return once[seen.new(self.hash[once])]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "__text"):
        for at in range(0, part.num_rows, SORTED_TEXTS):
            yield part.slice(at, SORTED_TEXTS)


def _read(texts: DataFrame, n: int) -> DataFrame:
    """doc, mark and h, the hash of the set, and rows with a part of the shingle counts of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for part in _slices(batches):
            sets = Shingles(part.column("__text"), n)
            place, more = np.unique((sets.token >> COUNTER_SHIFT).astype(np.int64), return_counts=True)
            counts[place] += more.astype(np.uint32)
            yield pa.record_batch({"doc": part.column("__doc"), "mark": part.column("__mark"), "h": pa.array(sets.hash),
                                   "part": pa.nulls(part.num_rows, pa.int32()), "counts": pa.nulls(part.num_rows, pa.binary())})
        for p in np.flatnonzero(counts.reshape(-1, PART).any(axis=1)).tolist():
            some = zlib.compress(counts[p * PART:(p + 1) * PART].tobytes(), 1)
            yield pa.record_batch({"doc": pa.nulls(1, pa.int64()), "mark": pa.nulls(1, pa.int64()), "h": pa.nulls(1, pa.int64()),
                                   "part": pa.array([p], pa.int32()), "counts": pa.array([some], pa.binary())})
    return texts.select("__doc", "__mark", "__text").mapInArrow(run, "doc long, mark long, h long, part int, counts binary")


def _prefixes(texts: DataFrame, n: int, levels, bounded: bool) -> DataFrame:
    """For every shingle in the prefix of a set: token, h, shape (size and place), and a bitmap of a hot one's set.

    A task gives a set that comes again soon once. Shingles that occur once are left out. bounded: those whose counters stay below BOUNDED, which
    have no bitmap, or else the others.
    """
    limit = BOUNDED.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in _slices(batches):
            sets = Shingles(part.column("__text"), n, levels.value)
            once = sets.fresh(seen)
            lengths = _prefix(sets.size[once])
            row = np.repeat(np.arange(len(once)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = sets.first[once][row] + place
            kept = (sets.level[at] > 0) & (sets.level[at] < limit) if bounded else sets.level[at] >= limit
            row, place, at = row[kept], place[kept], at[kept]
            if not len(row):
                continue
            out = {"token": sets.token[at].view(np.int64), "h": sets.hash[once][row], "shape": sets.size[once][row] << 32 | place}
            if not bounded:
                bits = np.zeros((part.num_rows, 128), bool)
                bits[sets.owner, (sets.token & U64(127)).astype(np.int64)] = True
                maps = np.packbits(bits, axis=1, bitorder="little").view(np.int64)[once][row]
                out |= {"s0": np.ascontiguousarray(maps[:, 0]), "s1": np.ascontiguousarray(maps[:, 1])}
            yield pa.record_batch({c: pa.array(v) for c, v in out.items()})
    return texts.select("__text").mapInArrow(run, "token long, h long, shape long" + ("" if bounded else ", s0 long, s1 long"))


def _pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct candidate pairs of the groups; rows of one `h` are not compared, `id` names them."""
    found, held = [], 0
    for a, b in candidate_pairs(rows):
        x, y = rows["id"][a], rows["id"][b]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        held += len(a)
        if held > 1 << 18:
            found = [np.unique(np.concatenate(found), axis=0)]
            if len(found[0]) > 1 << 17:
                yield pa.record_batch({"a": pa.array(found[0][:, 0]), "b": pa.array(found[0][:, 1])})
                found = []
            held = sum(map(len, found))
    if found:
        made = np.unique(np.concatenate(found), axis=0)
        yield pa.record_batch({"a": pa.array(made[:, 0]), "b": pa.array(made[:, 1])})


def _bounded_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["token"], rows=1 << 17):
        group = rows["group"]
        alone = np.bincount(group, minlength=group[-1] + 1)[group] < 2
        rows = {c: v[~alone] for c, v in rows.items()}
        k = len(rows["h"])
        zero = np.zeros(k, np.int64)
        yield from _pairs(rows | {"id": rows["h"], "s0": zero, "s1": zero, "block": zero, "own": np.ones(k, bool)})


def _hot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["token", "tile"]):
        yield from _pairs(rows | {"h": rows["root"], "id": rows["h"]})


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows with the tiles of two blocks in which they are compared, for rows whose `root` others in the group do not have.

    The root with most rows of a group is its main one. Its rows are compared with those of other roots only: first come the
    blocks of the others, then those of the main root, and no tile has two of the latter. A group of one root has no tiles.
    `own` is set in the one tile in which a block is also compared with itself.
    """
    each = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    many = each.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    many = many.select("token", F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("others"), F.ceil(F.col("main.n") / BLOCK).alias("mains"), F.col("main.root").alias("main"))
    sized = rows.join(stage(many.where("others > 0"), "shingle-hot-tokens"), "token").withColumn("blocks", F.col("others") + F.col("mains"))
    part = F.xxhash64("h", "token")
    sized = sized.withColumn("block", F.when(F.col("root") == F.col("main"), F.col("others") + F.pmod(part, F.col("mains"))).otherwise(F.pmod(part, F.col("others"))))
    tiles = F.expr("""transform(filter(sequence(0L, IF(root = main, others, blocks) - 1), x -> x <> block),
        x -> struct(least(x, block) * blocks + greatest(x, block) AS tile, x = block + 1 AS own))""")
    return sized.withColumn("t", F.explode(tiles)).select("token", "t.tile", "t.own", "block", "h", "root", "shape", "s0", "s1")


def _sets(texts: DataFrame, n: int, known) -> DataFrame:
    """h and the shingles of the sets that the filter knows; a task sends a set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in _slices(batches):
            sets = Shingles(part.column("__text"), n)
            once = sets.fresh(seen)
            once = once[has_bit(known.value, sets.hash[once].view(U64))]
            if len(once):
                packed = [_short(sets.token[sets.first[k]:sets.first[k + 1]]) for k in once.tolist()]
                yield pa.record_batch({"h": pa.array(sets.hash[once]), "tokens": pa.array(packed, pa.binary())})
    return texts.select("__text").mapInArrow(run, "h long, tokens binary").dropDuplicates(["h"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            common = len(np.intersect1d(_long([x]), _long([y]), assume_unique=True))
            kept.append(common >= int(_need(len(x) // 6, len(y) // 6)))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _links(texts: DataFrame, n: int, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the staged pairs whose sets have the similarity, by their whole sets."""
    active = stage(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), f"{name}-active")
    known = texts.sparkSession.sparkContext.broadcast(bit_filter(active, "h", FILTER_BITS))
    sets = stage(_sets(texts, n, known), f"{name}-sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("tokens").alias("y")), "b")
    return stage(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), f"{name}-links")


def _alike_pairs(marked: DataFrame, alike: DataFrame) -> DataFrame:
    """Pairs of sets (a, b): every set of a group with the group's smallest, for groups (`root`) of texts (`mark`)."""
    grouped = alike.select("mark", "root").distinct().join(marked.select("mark", "h").distinct(), "mark").select("root", "h").distinct()
    heads = grouped.groupBy("root").agg(F.min("h").alias("a"))
    return grouped.join(heads, "root").where("a <> h").select("a", F.col("h").alias("b"))


def similar_documents(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", alike: DataFrame | None = None, linked: bool = False) -> DataFrame:
    """Documents with their component: doc (the id, a null one the largest), mark (a hash of the text), h (a hash of the set
    of shingles) and root, the smallest h of the component.

    Documents whose sets of word shingles have Jaccard similarity of 4/5 or more are linked; a component is all that links
    reach. Equal sets are one node. The join is exact up to hash collisions (46 bits a shingle): similar sets share one of the
    rarest fifth of their shingles, so sets that meet in such a shingle and pass the length and positional filters are
    candidates, and these are compared by their whole sets. Only the order of shingles depends on the counts, not the result.

    Shingles of many sets (by their counter) are dealt to tiles of two bounded blocks. Before that each of their sets is
    compared with two sets of the group only, and sets that this has joined already need no comparison with one another: a large group of
    near copies costs a few comparisons a member. Sets that only share a common passage are still compared by tiles.

    `alike` may give groups that another operator found (mark, root). Their members are candidates too, and those that the
    comparison of whole sets confirms are joined before the large groups are dealt. It changes the work, not the result, unless
    they count as `linked`: then a component is all that the groups and the links of similar sets reach together, and the groups
    are not compared.

    Texts without words have the empty set and are one node, null texts among them. Repeated rows stay repeated. An empty
    table gives no rows.
    """
    texts = docs.select(order_id(id_col).alias("__doc"), text_mark(text_col).alias("__mark"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    read = stage(_read(texts, shingle), "shingle-read")
    marked = read.where("part IS NULL").select("doc", "mark", "h")
    levels = texts.sparkSession.sparkContext.broadcast(_levels(read))
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _prefixes(texts, shingle, levels, True).repartition(partitions, "token").sortWithinPartitions("token", "shape", "h")
    pairs = dealt.mapInArrow(_bounded_pairs, "a long, b long")

    hot = stage(_prefixes(texts, shingle, levels, False).distinct(), "shingle-hot")
    own = F.struct("h", "shape")
    heads = hot.groupBy("token").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    near = hot.join(heads, "token").select("h", "shape", F.explode(F.array("lo", "hi")).alias("head"))
    size, other = F.shiftright("shape", 32), F.shiftright("head.shape", 32)
    near = near.where((F.col("h") != F.col("head.h")) & (F.least(size, other) * DEN >= F.greatest(size, other) * NUM))
    pairs = pairs.union(near.select(F.least("h", "head.h").alias("a"), F.greatest("h", "head.h").alias("b")))
    grouped = None if alike is None else stage(_alike_pairs(marked, alike), "shingle-alike")
    pairs = stage((pairs if grouped is None or linked else pairs.union(grouped)).distinct(), "shingle-pairs")
    links = _links(texts, shingle, pairs, "shingle")
    if grouped is not None and linked:
        links = links.union(grouped)

    if not hot.isEmpty():
        joined = star_forest(links)
        label = joined.select(F.col("a").alias("h"), F.col("b").alias("root"))
        named = stage(hot.join(label, "h", "left").withColumn("root", F.coalesce("root", "h")), "shingle-hot-roots")
        far = stage(_dealt(_tiles(named), "shape", "h").mapInArrow(_hot_pairs, "a long, b long").distinct(), "shingle-hot-pairs")
        if not far.isEmpty():
            links = links.union(_links(texts, shingle, far, "shingle-hot"))

    nodes = marked.groupBy("h").agg(F.min("doc").alias("first")).withColumnRenamed("h", "node")
    reached = component_ids(nodes, links).select(F.col("node").alias("h"), "root")
    return marked.join(stage(reached, "shingle-names"), "h", "left").select("doc", "mark", "h", F.coalesce("root", "h").alias("root"))
