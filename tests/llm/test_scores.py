import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from leadline.llm import quality, queries, topk, winnow
from leadline.llm.quality import fit_quality, forward_backward, line_features, score_quality
from leadline.llm.topk import top_k
from leadline.llm.winnow import find_spans

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(cur.fetchall())


# --- decontamination

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_spans(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = Counter()
    for i, text in rows:
        w, gone, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (hit := windows.get(tuple(w[k:k + n]))) is not None:
                    gone |= set(range(k, k + n))
                    found |= hit
        out[i, len(w), len(gone), tuple(sorted(str(x) for x in found if x is not None))] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    v = [f"v{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(v, k=rng.randint(1, 40)))) for k in range(30)]
    items += [(4, "Über die große Brücke"), (None, " ".join(v[:12])), (50, None), (51, ""), (52, "..!!"), (53, " ".join(["rep"] * 15)), (30, items[3][1])]
    rows = []
    for k in range(80):
        parts = [" ".join(rng.choices(v, k=rng.randint(0, 30)))]
        if rng.random() < 0.7:
            w = rng.choice(items[:30])[1].split(" ")
            cut = rng.randint(0, max(0, len(w) - 8))
            parts.append("\n".join(w[cut:cut + rng.randint(8, 30)]).upper())
        parts.append(" ".join(rng.choices(v, k=rng.randint(0, 10))))
        rows.append((k, " , ".join(parts)))
    rows += [(100, "ÜBER die Große Brücke"), (101, "über DIE große-Brücke"), (102, "Rep " * 9), (103, "Rep " * 40), (104, " ".join(v[:12]))]
    return rows, items


def test_spans_equal_a_plain_search(spark):
    rows, items = passages(2)
    got = find_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = plain_spans(rows, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == expected
    assert sum(n > 0 for _, _, n, _ in expected) > 30
    for r in got:
        assert r.n_hit == sum(s.e - s.b for s in r.spans) and all(a.e < b.b for a, b in zip(r.spans, r.spans[1:]))


def test_spans_messy(spark, messy, messy_rows, nothing):
    items = [(k, t) for k, (_, t, *_) in enumerate(messy_rows) if k % 6 == 0]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = find_spans(messy, frame).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == plain_spans([(i, t) for i, t, *_ in messy_rows], items)
    assert find_spans(nothing, frame).count() == 0
    assert all(r.n_hit == 0 for r in find_spans(messy, frame.limit(0)).collect())


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(winnow, "FILTER_BITS", 1 << 16)
    rows, items = passages(3)
    got = find_spans(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == plain_spans(rows, items)


# --- top k

def plain_top(rows, k=5):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            best[i] = min(best.get(i, w), w)
    out = set()
    for q, a in best.items():
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in best.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("blocks", [(4096, 1024), (16, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = random.Random(8)
    rows = [(k, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for k in range(150)]
    rows += [(k, rows[10][1]) for k in range(200, 260)]                                   # a very common vector
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (305, []), (306, [0.5]), (310, [1e3] * 9),
             (315, [-1e3] * 6), (20, [9.0] * 6), (320, [0.0] * 6)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), "vec_id % 5 = 0").collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == plain_top(rows) and len(got) == len(plain_top(rows))


def test_top_k_beyond_exact_floats_and_few_rows(spark):
    rows = [(k, [2e5 * (k + 1), 3e6 + k, -2e6]) for k in range(0, 40)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 5 = 0").collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == plain_top(rows)
    few = top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), "vec_id % 5 = 0").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 1, 256 * 512)]
    assert top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>"), "vec_id % 5 = 0").count() == 0
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>, part int"), "vec_id % 5 = 0").count() == 0


def test_top_k_sends_no_side_that_grows_through_the_driver(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 5 = 0")
    assert {tuple(r) for r in got.collect()} == plain_top(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_hold_components_in_few_bytes_and_scores_come_in_pieces(monkeypatch):
    monkeypatch.setattr(topk, "PIECE", (2, 3))
    for most, width in ((1, 2), (-32767, 2), (-32768, 4), (1 << 31, 8), (-(1 << 63), 8)):
        block = np.array([[3, -2], [most, 5]], np.int64)
        packed = topk._narrow(block)
        assert len(packed) == 1 + 4 * width and (topk._wide(packed, 2) == block).all()
    a, b = np.arange(10).reshape(5, 2) - 4, np.arange(14).reshape(7, 2) - 6
    row = {"q_ids": np.arange(5).tobytes(), "q_packed": topk._narrow(a), "ids": np.arange(7).tobytes(), "packed": topk._narrow(b)}
    whole = np.zeros((5, 7), np.int64)
    for queries, candidates, scores in topk._scores(row, "q_", ""):
        assert scores.shape[0] <= 2 and scores.shape[1] <= 3
        whole[np.ix_(queries, candidates)] += scores
    assert (whole == a @ b.T).all() and topk._of(64, 1 << 14, 1 << 23) == 1 << 14 and topk._of(1024, 1 << 14, 1 << 23) == 1024


# --- quality

def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 3, 6])
    score, moves = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    odds, counts = forward_backward(score, lines, moves, pairs=True)
    at, total = 0, np.zeros((2, 2))
    for n in lines:
        weight, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in range(1 << n):
            y = [path >> k & 1 for k in range(n)]
            w = math.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weight += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        assert np.allclose(1 / (1 + np.exp(-odds[at:at + n])), good / weight)
        total += pairs / weight
        at += n
    assert np.allclose(counts, total)


def test_line_features_of_odd_texts():
    import pyarrow as pa
    own, size, lines = line_features(pa.array(["", "a\n\nB b B\n", "\n", "no no no!!"]))
    assert lines.tolist() == [1, 4, 2, 1] and own.shape == (8, quality.N_OWN) and np.isfinite(own).all()
    assert size.tolist() == [0, 1, 0, 5, 0, 0, 0, 10]
    assert own[:, 13].tolist() == [1, 0, 1, 0, 1, 1, 1, 0]
    assert own[7, 7] == pytest.approx(1 / 3)                                              # "no" after "no"; "no!!" is another word


def test_quality_query_on_held_out_rows(spark):
    rows = queries.op8_quality(spark, MORE).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MORE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_no_held_out_label_is_read(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    from pyspark.sql import functions as F
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = fit_quality(docs, labels), fit_quality(docs, wrong)
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_quality_messy(spark, messy, messy_rows, nothing):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (900, 0, 0), (901, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(messy, labels, sample=40)
    rows = score_quality(messy, model, keep=("source", "score")).collect()
    assert len(rows) == len(messy_rows) and all(0 <= r[1] <= 1 for r in rows)
    empty = {round(r[1], 9) for r in rows if r.doc_id in (900, 901)}
    assert len(empty) == 1
    assert score_quality(nothing, model).count() == 0
    none = fit_quality(nothing, labels)
    assert {r.score for r in score_quality(messy, none).collect()} == {0.5}
    kept = messy.where(quality.quality_column(model, "text") >= 0).count()
    assert kept == len(messy_rows)


def test_good_documents_are_those_that_score_enough(spark, messy, nothing):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    model = fit_quality(docs, labels)
    for rows in (docs, messy):
        kept = quality.good_documents(rows, model)
        assert kept.columns == rows.columns
        scored = score_quality(rows, model, keep=("text",)).where("score >= 0.7")
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in scored.collect())
    assert quality.good_documents(nothing, model).count() == 0


def test_hashes_seen_lately_are_bounded():
    from leadline.llm.common import Seen
    rng, seen, met = np.random.default_rng(1), Seen(1000), set()
    for _ in range(60):
        some = np.unique(rng.integers(0, 5000, 300).astype(np.uint64))
        new = set(some[seen.new(some)].tolist())
        assert set(some.tolist()) - met <= new                                           # what never came is always new
        met |= set(some.tolist())
        assert len(seen.young) <= 1300 and len(seen.old) <= 1300
    assert not seen.new(some).any()
