"""Exact top-k inner products by a three-phase uniform threshold."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: The vector's components are dealt to this many lists; a score is the sum of a vector's entries in all lists.
LISTS = 2
#: Vectors of one block at most, and bytes of their components as 64-bit numbers: what a row of the grid of blocks holds.
CANDIDATE_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 12
CANDIDATE_BYTES, QUERY_BYTES = 1 << 23, 1 << 21
#: Queries and candidates whose scores are held at once.
PIECE = 1024, 4096
EXACT = 1 << 53


def _met(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the input: by sorting, so that neither is collected by the driver to be sent out."""
    return df.join(other.hint("merge"), on, how)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the components as integers floor(256 x); rows without an id or a finite vector are left out."""
    return (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))")
            .select("vec_id", F.expr("transform(x, e -> floor(256 * e))").alias("v")))


def _of(dims: int, most: int, size: int) -> int:
    """Vectors of a block."""
    return max(1, min(most, size // (8 * dims)))


def _narrow(part: np.ndarray) -> bytes:
    """Components in the fewest bytes that hold all of them; the first byte says how many."""
    most = int(np.abs(part).max(initial=0)) if part.min(initial=0) > np.iinfo(np.int64).min else 1 << 63
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max or k is np.int64)
    return bytes([np.dtype(kind).itemsize]) + part.astype(kind).tobytes()


def _wide(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(packed, f"i{packed[0]}", offset=1).reshape(rows, -1)


def _blocks(classes: DataFrame, dims: int, rows: int, of: int, name: str) -> tuple[DataFrame, int]:
    """One row per list and block of `of` vectors or so: list, <name>, ids, packed (the block's components in this list)."""
    count = -(-rows // of)
    borders = [dims * k // LISTS for k in range(LISTS + 1)]

    def pack(group: pa.Table) -> pa.Table:
        values = group.column("v").combine_chunks()
        matrix = np.zeros((len(values), dims), np.int64)
        sizes = np.diff(values.offsets.to_numpy())
        matrix[np.arange(dims) < sizes[:, None]] = values.flatten().to_numpy()
        ids = group.column("cls").to_numpy().tobytes()
        parts = [_narrow(matrix[:, a:b]) for a, b in zip(borders, borders[1:], strict=False)]
        return pa.table({"list": pa.array(range(LISTS), pa.int32()), name: pa.array([group.column("b")[0].as_py()] * LISTS, pa.int32()),
                         "ids": pa.array([ids] * LISTS, pa.binary()), "packed": pa.array(parts, pa.binary())})

    dealt = classes.select(F.pmod(F.xxhash64("cls"), F.lit(max(count, 1))).cast("int").alias("b"), "cls", "v")
    return stage(dealt.groupBy("b").applyInArrow(pack, f"list int, {name} int, ids binary, packed binary"), f"topk-{name}"), count


def _scores(row: dict, left: str, right: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, candidate ids and all partial scores of pieces of two blocks, exact: as floats only while these hold every sum."""
    a_ids, b_ids = (np.frombuffer(row[f"{side}ids"], np.int64) for side in (left, right))
    a, b = (_wide(row[f"{side}packed"], len(ids)) for side, ids in ((left, a_ids), (right, b_ids)))
    if a.shape[1] and float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1] < EXACT:
        kind = np.float64
    else:
        kind = np.int64
    for j in range(0, len(b), PIECE[1]):
        some = b[j:j + PIECE[1]].astype(kind).T
        for i in range(0, len(a), PIECE[0]):
            yield a_ids[i:i + PIECE[0]], b_ids[j:j + PIECE[1]], (a[i:i + PIECE[0]].astype(kind) @ some).astype(np.int64)


def _entries(query: np.ndarray, candidate: np.ndarray, part: np.ndarray, number: int) -> pa.RecordBatch:
    return pa.record_batch({"q": pa.array(query), "c": pa.array(candidate), "list": pa.array(np.full(len(query), number, np.int32)), "part": pa.array(part)})


ENTRY = "q long, c long, list int, part long"


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _local_lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The `most` highest entries of each query in each piece of a block and list."""
    for batch in batches:
        for row in _one_by_one(batch):
            for queries, candidates, scores in _scores(row, "q_", ""):
                k = min(most, len(candidates))
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                yield _entries(np.repeat(queries, k), candidates[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel(), row["list"])


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries that reach the query's cutoff: twice the entry is at least the threshold, for LISTS = 2."""
    for batch in batches:
        for row in _one_by_one(batch):
            cutoff = dict(zip(np.frombuffer(row["cut_ids"], np.int64).tolist(), np.frombuffer(row["cuts"], np.int64).tolist(), strict=True))
            for queries, candidates, scores in _scores(row, "q_", ""):
                limits = np.array([cutoff[q] for q in queries.tolist()])
                i, j = np.nonzero(scores >= limits[:, None])
                yield _entries(queries[i], candidates[j], scores[i, j], row["list"])


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the whole score of (q, c), from both vectors."""
    with_q = _met(pairs, classes.select(F.col("cls").alias("q"), F.col("v").alias("qv")), "q")
    with_c = _met(with_q, classes.select(F.col("cls").alias("c"), F.col("v").alias("cv")), "c")
    product = "aggregate(zip_with(qv, cv, (x, y) -> coalesce(x, 0L) * coalesce(y, 0L)), 0L, (s, e) -> s + e)"
    return with_c.withColumn("score", F.expr(product)).drop("qv", "cv")


def _first(df: DataFrame, key: str, order: list, most: int) -> DataFrame:
    return df.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("at") <= most)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row that satisfies `is_query` (a condition on vec_id): its k best other rows by integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Components x count as floor(256 x).

    Equal vectors are one class, of which the k + 1 smallest ids matter. Each vector's components are dealt to two lists, so
    a score is the sum of two entries. Phase 1 gathers the highest entries of each list; the exact scores of what they name
    give each query a threshold t that k + 1 classes reach. Phase 2 sends t / 2 to all blocks, since a class that reaches
    t has an entry of t / 2 or more in some list, and collects all such entries. Phase 3 sums them, drops classes whose
    missing entry (below t / 2) cannot lift them to the place k + 1, and resolves the others exactly. Query blocks meet
    candidate blocks of bounded size; no task holds more than one of each. Joins sort both sides, so that none of these is sent
    through the driver, and blocks hold components in as few bytes as they need.

    Rows with a null id, or a vector that is null or holds null or non-finite components, take no part. Vectors of different
    length are filled up with zeros; an empty vector scores zero. Of rows that share an id, the one with the smallest vector
    counts. Fewer than k other rows: all. Empty table: no rows. Sums must fit in 64 bits.
    """
    valid = stage(_valid(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-rows")
    order = Window.partitionBy("v").orderBy("vec_id")
    ranked = valid.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    members = stage(ranked.withColumn("cls", F.min("vec_id").over(Window.partitionBy("v"))).select("cls", "vec_id", "v"), "topk-members")
    classes = stage(members.where("vec_id = cls").select("cls", "v", F.size("v").alias("dims")), "topk-classes")
    asked = stage(_met(valid.where(is_query), classes, "v").select(F.col("cls").alias("q"), F.col("vec_id").alias("query_id")), "topk-queries")
    size = classes.agg(F.count(F.lit(1)).alias("rows"), F.max("dims").alias("dims")).first()
    wanted = _met(classes, asked.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi")
    n_wanted = wanted.count()
    dims = max(size["dims"] or 0, LISTS)

    left, n_left = _blocks(wanted, dims, n_wanted, _of(dims, QUERY_BLOCK, QUERY_BYTES), "qb")
    right, n_right = _blocks(classes, dims, size["rows"], _of(dims, CANDIDATE_BLOCK, CANDIDATE_BYTES), "cb")
    left = left.select("list", "qb", F.col("ids").alias("q_ids"), F.col("packed").alias("q_packed"))
    spread = left.withColumn("cb", F.explode(F.expr(f"sequence(0, {max(n_right, 1) - 1})")))
    grid = _met(spread, right, ["list", "cb"])

    local = grid.select("list", "q_ids", "q_packed", "ids", "packed").mapInArrow(lambda b: _local_lists(b, k + 1), ENTRY)
    local = local.withColumn("at", F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("part"), "c"))).where(F.col("at") <= k + 1)
    seen = _exact(local.select("q", "c").distinct(), classes)
    reached = _first(seen, "q", [F.desc("score"), "c"], k + 1).groupBy("q").agg(F.min("score").alias("t"), F.count(F.lit(1)).alias("n"))
    # fewer classes than k + 1: everything is wanted
    lowest = F.lit(-(1 << 62))
    reached = reached.select("q", F.when(F.col("n") > k, F.col("t")).otherwise(lowest).alias("t"))
    reached = stage(reached, "topk-threshold")

    # t / 2 rounded up, per query of a block
    cut = reached.withColumn("cut", F.expr("cast(ceil(t / 2.0BD) as bigint)"))
    home = F.pmod(F.xxhash64("q"), F.lit(max(n_left, 1))).cast("int")

    def pack_cuts(group: pa.Table) -> pa.Table:
        return pa.table({"qb": pa.array([group.column("qb")[0].as_py()], pa.int32()), "cut_ids": pa.array([group.column("q").to_numpy().tobytes()], pa.binary()),
                         "cuts": pa.array([group.column("cut").to_numpy().tobytes()], pa.binary())})

    cuts = cut.select(home.alias("qb"), "q", "cut").groupBy("qb").applyInArrow(pack_cuts, "qb int, cut_ids binary, cuts binary")
    asked_all = _met(left, cuts, "qb").withColumn("cb", F.explode(F.expr(f"sequence(0, {max(n_right, 1) - 1})")))
    above = (_met(asked_all, right, ["list", "cb"])
             .select("list", "q_ids", "q_packed", "cut_ids", "cuts", "ids", "packed").mapInArrow(_above, ENTRY))
    sums = _met(above.groupBy("q", "c").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("lists")), reached, "q")
    sums = stage(sums, "topk-sums")
    whole = sums.where(F.col("lists") == LISTS).select("q", "c", F.col("part").alias("score"))
    better = _first(whole, "q", [F.desc("score"), "c"], k + 1).groupBy("q").agg(F.min("score").alias("t2"), F.count(F.lit(1)).alias("n2"))
    partial = _met(sums.where(F.col("lists") < LISTS), better, "q", "left")
    open_ = partial.where(F.expr(f"n2 IS NULL OR n2 <= {k} OR cast(part as decimal(38, 1)) + t / 2.0BD > t2"))
    scored = whole.union(_exact(open_.select("q", "c"), classes).select("q", "c", "score"))
    least = _first(scored, "q", [F.desc("score")], k + 1).groupBy("q").agg(F.min("score").alias("least"))
    near = _met(scored, least, "q").where("score >= least").select("q", "score", F.col("c").alias("cls"))
    rows = _first(_met(near, members.drop("v"), "cls"), "q", [F.desc("score"), "vec_id"], k + 1).select("q", "vec_id", "score")
    mine = _met(rows, asked, "q").where("vec_id <> query_id")
    return (_first(mine, "query_id", [F.desc("score"), "vec_id"], k)
            .select("query_id", F.col("at").cast("int").alias("rank"), "vec_id", "score"))
