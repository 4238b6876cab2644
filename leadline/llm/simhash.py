"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, stage, texts, whole_groups
from .components import component_ids

SEED = 42
RADIUS = 2
#: Fingerprints that differ in at most `radius` of `parts` equal parts of their bits agree on `parts - radius` parts.
PARTS = 4
#: Members of one key that are compared in one piece; larger keys are cut into tiles of two such blocks.
BLOCK = 4096


def fingerprint(text: str, n: int) -> int:
    """The SimHash of a text's word n-grams, repeats included: a bit is set if over half the hashes set it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = min(n, len(words))
    begins = np.concatenate([[0], ends[:-1] + 1])[:len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[n - 1:].tolist(), strict=True)], U64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark and fp, the fingerprint as a signed 64-bit number. A text of fewer words is one shingle; no words give zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            prints = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], U64).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), part.column("mark"), pa.array(prints)], names=["doc_id", "mark", "fp"])
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, mark long, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 planes: bit j of word i of plane b is bit b of fingerprint 64 * i + j. The rest of the last word is zero."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, U64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(U64)


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """The planes of the sequence that begins `by` fingerprints later; lanes beyond the end are zero."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(planes)
    out[:, :planes.shape[1] - words] = planes[:, words:] >> U64(bits)
    if bits:
        out[:, :planes.shape[1] - words - 1] |= planes[:, words + 1:] << U64(64 - bits)
    return out


def close_pairs(planes: np.ndarray, later: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the lanes in which `planes` and `later` differ in at most `radius` (0 to 2) bits.

    Each word operation advances 64 distances: they are counted in two bits a lane, to which a plane's difference is added
    by carry-save steps, and `over` keeps which lanes have passed the radius (at first, those that are not valid). Words all
    of whose lanes are over are abandoned; the others go on with the next planes.
    """
    words = np.flatnonzero(valid)
    over = ~valid[words]
    low, high = np.zeros(len(words), U64), np.zeros(len(words), U64)
    full = ~U64(0)
    for b in range(64):
        differs = planes[b, words] ^ later[b, words]
        carry = low & differs
        low = low ^ differs
        high = high ^ carry
        over = over | (low & high if radius == 2 else high if radius == 1 else low)
        if b % 8 == 7:
            on = over != full
            if not on.all():
                words, over, low, high = words[on], over[on], low[on], high[on]
                if not len(words):
                    return words
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return (words[:, None] * 64 + np.arange(64))[lanes]


def links_of(prints: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of row numbers that connect the rows of each group as all their links do: a spanning forest, not every pair.

    Rows of a group stand together. Step d compares every row with the row d places on, all groups at once, until no group
    is that long.
    """
    n = len(prints)
    planes = bit_planes(prints)
    label, made, d = np.arange(n), [], 1
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))).max(initial=0))
    for d in range(1, longest):
        same = np.zeros(planes.shape[1] * 64, bool)
        same[:n - d] = group[d:] == group[:-d]
        found = close_pairs(planes, _shifted(planes, d), np.packbits(same, bitorder="little").view(U64), radius)
        found = found[label[found] != label[found + d]]
        for i in found.tolist():
            a, b = label[i], label[i + d]
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                made.append((i, i + d))
        if len(found):
            while (up := label[label] != label).any():
                label[up] = label[label[up]]
    return np.array(made, np.int64).reshape(-1, 2)


def _keys(prints: np.ndarray, radius: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every choice of `parts - radius` parts of the bits, with the fingerprints' bits in it."""
    borders = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(borders, borders[1:], strict=False)]
    for number, chosen in enumerate(combinations(masks, parts - radius)):
        yield number, prints & U64(sum(chosen))


def link_forest(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join exactly those that links of the radius join.

    By the pigeonhole principle linked fingerprints agree on at least one choice of parts, so only members of one key are
    compared. Keys of one member fall away. Keys of more than BLOCK members are cut into blocks by a hash, and each pair of
    blocks is compared as one tile, so no task holds more than two blocks of a key.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for number, key in _keys(fp.view(U64), radius, parts):
                yield pa.record_batch([pa.array(np.full(len(fp), number, np.int32)), pa.array(key.view(np.int64)), pa.array(fp)], names=["no", "key", "fp"])

    keyed = stage(prints.select("fp").mapInArrow(spread, "no int, key long, fp long"), "simhash-keys")
    many = keyed.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(many, ["no", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp", "no"), F.col("blocks")).cast("int")
    tiles = F.expr("""CASE WHEN blocks = 1 THEN array(0) ELSE
                      transform(filter(sequence(0, blocks - 1), x -> x <> own), x -> least(x, own) * blocks + greatest(x, own)) END""")
    tiled = sized.withColumn("own", own).select("no", "key", F.explode(tiles).alias("tile"), "fp")
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled.repartition(partitions, "no", "key", "tile").sortWithinPartitions("no", "key", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["no", "key", "tile"]):
            links = links_of(rows["fp"].view(U64), rows["group"], radius)
            if len(links):
                yield pa.record_batch([pa.array(rows["fp"][links[:, 0]]), pa.array(rows["fp"][links[:, 1]])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their fingerprint and component: doc_id, mark (a hash of the text), fp and root (fingerprints, signed 64
    bits; root is the smallest of the component) and component_id.

    Fingerprints at most `radius` bits apart are linked; a component is all that links reach, and its id the smallest
    doc_id in it. Equal fingerprints are one node, so any number of copies costs one comparison, and links leave a task
    only as a spanning forest. Components come from rounds of joins with each round written to the shared folder.

    Null, empty or blank texts have the fingerprint zero, linked like any other. A null doc_id is kept and counts as larger
    than all others; a component of null ids only has a null id. Repeated rows stay repeated. An empty table gives no rows.
    Other columns are ignored.
    """
    marked = stage(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    edges = stage(link_forest(nodes, radius).distinct(), "simhash-links")
    reached = component_ids(nodes.withColumnRenamed("fp", "node"), edges).withColumnRenamed("node", "fp")
    named = nodes.join(reached, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(stage(named, "simhash-names"), "fp").select("doc_id", "mark", "fp", "root", "component_id")
