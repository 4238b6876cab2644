import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from leadline.llm import common, line_dedup, queries, simhash, suffix_dedup
from leadline.llm.components import component_ids
from leadline.llm.line_dedup import repeated_lines, without_repeated_lines
from leadline.llm.suffix_dedup import remove_repeats

SMALL = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# --- SimHash

def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, fingerprint); the smallest id of each fingerprint's component."""
    kinds = sorted({f for _, f in prints})
    u = Union()
    for k, a in enumerate(kinds):
        u.find(a)
        for b in kinds[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                u.join(a, b)
    least = defaultdict(lambda: None)
    for i, f in prints:
        root = u.find(f)
        least[root] = i if least[root] is None else least[root] if i is None else min(i, least[root])
    return Counter((i, f, least[u.find(f)]) for i, f in prints)


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = queries.op5_simhash(spark, SMALL).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows) == plain_components([(d.doc_id, plain_fingerprint(d.text, 3)) for d in docs])
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)


def test_simhash_messy(messy, messy_rows, nothing):
    rows = simhash.near_duplicates(messy).collect()
    expected = plain_components([(i, plain_fingerprint(t, 5)) for i, t, *_ in messy_rows])
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == expected
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links_connect_what_distances_connect(radius):
    rng = random.Random(radius)
    prints, group = [], []
    for g in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 90)):
            prints.append(centre ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 4))}))
            group.append(g)
    links = simhash.links_of(np.array(prints, np.uint64), np.array(group), radius)
    mine, plain = Union(), Union()
    for a, b in links.tolist():
        assert (prints[a] ^ prints[b]).bit_count() <= radius and group[a] == group[b]
        mine.join(a, b)
    for a in range(len(prints)):
        for b in range(a):
            if group[a] == group[b] and (prints[a] ^ prints[b]).bit_count() <= radius:
                plain.join(a, b)
    assert [mine.find(k) for k in range(len(prints))] == [plain.find(k) for k in range(len(prints))]
    assert len(links) < len(prints)


def test_hot_keys_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(4)
    prints = sorted({0x1234567890ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    u, v = Union(), Union()
    for r in simhash.link_forest(frame).collect():
        u.join(r.a % (1 << 64), r.b % (1 << 64))
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                v.join(a, b)
    assert [u.find(p) for p in prints] == [v.find(p) for p in prints]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    rows = component_ids(spark.createDataFrame([(n, n * 10) for n in nodes], "node long, first long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component_id for r in rows} == {n: 1000 if n < 200 else 5000 for n in nodes if n != 7}


# --- lines

def plain_lines(rows):
    """Counter of (doc_id, n_lines, removed, n_links) by comparing all pairs of token sets."""
    marked = [(LAST if i is None else i, t or "", k) for k, (i, t) in enumerate(rows)]
    sets = [[frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER))) for line in t.split("\n")] for _, t, _ in marked]
    kinds = sorted({s for doc in sets for s in doc if s}, key=sorted)
    partners = defaultdict(list)
    for k, a in enumerate(kinds):
        for b in kinds[k + 1:]:
            o = len(a & b)
            if o and 5 * o >= 4 * (len(a) + len(b) - o):
                partners[a].append(b)
                partners[b].append(a)
    return marked, sets, partners


def check_lines(got, rows, mark_of):
    marked, sets, partners = plain_lines(rows)
    first = {}
    for (i, t, _), lines in zip(marked, sets):
        for n, s in enumerate(lines):
            first[s] = min(first.get(s, (LAST + 1,)), (i, mark_of[t], n))
    expected = Counter()
    for (i, t, k), lines in zip(marked, sets):
        gone = tuple(n for n, s in enumerate(lines) if s and min([first[s]] + [first[p] for p in partners[s]]) < (i, mark_of[t], n))
        expected[rows[k][0], len(lines), gone, sum(len(partners[s]) for s in lines if s)] += 1
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed), r.n_links) for r in got) == expected
    return expected


def near_lines(seed, n, words=40, size=25):
    """Lines of which many are similar: a few centres with some words changed."""
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(words * 6)]
    centres = [rng.sample(vocabulary, rng.randint(4, size)) for _ in range(6)]
    out = []
    for _ in range(n):
        line = list(rng.choice(centres))
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = rng.choice(vocabulary)
        out.append(" ".join(line))
    return out


def marks(spark, frame):
    from pyspark.sql import functions as F
    return {r.t: r.m for r in frame.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("m")).collect()}


@pytest.mark.parametrize("block", [2048, 16])
def test_similar_lines_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "BOUNDED", block)
    lines = near_lines(block, 240)
    rows = [(k, "\n".join(lines[3 * k:3 * k + 3])) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = check_lines(repeated_lines(frame).collect(), rows, marks(spark, frame))
    assert sum(n for *_, n in expected) > 300


def test_texts_are_cut_into_lines_once_for_the_prefixes_of_both_kinds_of_tokens(monkeypatch):
    batch = pa.record_batch({"__text": pa.array(near_lines(3, 120), pa.string())})
    counts = Counter((line_dedup.Lines(batch.column("__text")).token >> line_dedup.COUNTER_SHIFT).tolist())
    level = np.zeros(line_dedup.COUNTERS, np.uint8)
    for c, n in counts.items():
        level[c] = n.bit_length() if n > 1 else 0
    monkeypatch.setattr(line_dedup, "BOUNDED", 16)
    made, lines = [], line_dedup.Lines
    monkeypatch.setattr(line_dedup, "Lines", lambda *a: made.append(1) or lines(*a))
    (few, many), = line_dedup._prefix_rows(iter([batch]), level)
    assert len(made) == 1 and len(few) and len(many)
    assert all(1 < counts[t >> int(line_dedup.COUNTER_SHIFT)] < 16 for t in few[:, 0].tolist())
    assert all(counts[t >> int(line_dedup.COUNTER_SHIFT)] >= 16 for t in many[:, 0].tolist())

    def bucket(table, large):                                          # the same rows from two tasks
        packed = np.ascontiguousarray(table.T).tobytes()
        return line_dedup._active_bucket(pa.table({"bucket": [0, 0], "large": [large, large], "packed": pa.array([packed, packed], pa.binary())}))
    rows = bucket(many, True)
    assert sorted(zip(*[rows.column(c).to_pylist() for c in line_dedup.ROW])) == sorted(map(tuple, many.tolist()))
    found = bucket(few, False)
    assert found.column_names == list(line_dedup.ROW) and found.num_rows and found.column("shape").null_count == found.num_rows
    assert set(zip(found.column("token").to_pylist(), found.column("h").to_pylist())) <= {(t, h) for t, h, *_ in few.tolist()}


def test_lines_messy(spark, messy, messy_rows, nothing):
    rows = [(i, t) for i, t, *_ in messy_rows]
    check_lines(repeated_lines(messy).collect(), rows, marks(spark, messy))
    assert repeated_lines(nothing).count() == 0


def test_text_without_repeated_lines(spark, messy, nothing):
    frame = spark.createDataFrame([(1, "one two three\nfour five", "x"), (2, "ONE  two three\nnew line\n", "y"), (3, "one two three", "z"), (4, None, "n"), (5, "", "e")],
                                  "doc_id long, text string, __mark string")
    got = {r.doc_id: (r.text, r["__mark"]) for r in without_repeated_lines(frame.withColumnRenamed("__mark", "h")).withColumnRenamed("h", "__mark").collect()}
    assert got == {1: ("one two three\nfour five", "x"), 2: ("new line\n", "y"), 4: (None, "n"), 5: ("", "e")}
    out = without_repeated_lines(messy)
    assert out.columns == messy.columns and without_repeated_lines(nothing).count() == 0
    assert {900, 901, 902, 908} <= {r.doc_id for r in out.collect()}


def test_line_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_lines(repeated_lines(docs).collect(), rows, marks(spark, docs))
    assert queries.op4_line_dedup(spark, SMALL).count() == len(rows)


# --- repeated bytes

def plain_repeats(rows):
    first = {}
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], i), i)
    out = Counter()
    for (doc, _), (i, b) in zip(rows, raw):
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s + 1:s + 51] = True
        spans = tuple(zip(np.flatnonzero(gone[1:] & ~gone[:-1]).tolist(), np.flatnonzero(~gone[1:] & gone[:-1]).tolist()))
        out[doc, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])] += 1
    return out


def check_repeats(frame, rows):
    got = Counter((r.doc_id, r.n_bytes, tuple((s.b, s.e) for s in r.spans), bytes(r.kept)) for r in remove_repeats(frame).collect())
    assert got == plain_repeats(rows)


def test_repeats_messy(messy, messy_rows, nothing):
    check_repeats(messy, [(i, t) for i, t, *_ in messy_rows])
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("piece", [1 << 20, 137])
def test_repeats_of_pasted_passages(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BATCH", 500)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [letters(rng.randint(45, 200)) for _ in range(12)] + ["ab" * 60, "x" * 130]
    rows = []
    for k in range(70):
        parts = [letters(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            parts += [p[cut:len(p) - rng.randint(0, len(p) // 3)], letters(rng.randint(0, 60))]
        rows.append((k if k % 9 else k // 2, "".join(parts)))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_repeats(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert queries.op9_suffix_dedup(spark, SMALL).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_levels_double():
    index = suffix_dedup.LevelIndex()
    rng = np.random.default_rng(3)
    seen = {}
    for batch in range(40):
        words = np.array([b"%03d" % x for x in rng.integers(0, 900, 50)], "S3")
        doc = np.full(50, batch)
        got = index.add(words, doc)
        for w, g in zip(words.tolist(), got.tolist()):
            assert g == seen.setdefault(w, batch)
        sizes = [len(level) for level, _ in index.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_shuffle_files_of_a_stage_go_when_it_is_written(spark):
    def files():
        names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {n for n in names if "/shuffle_" in n}

    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    docs = spark.createDataFrame([(k, f"{k % 7} " * 40) for k in range(50)], "doc_id long, text string").repartition(3, "text")
    one = common.stage(docs, "one")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and one.count() == 50 and spark.conf.get(common.CLEANUP, None) == setting
