import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadline.llm import shingle_join
from leadline.llm.simhash import near_duplicates
from tests.llm.test_duplicates import LOWER, Union

SMALL = "/root/testdata/sf0.01"


def plain_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    """rows: (doc_id, text); the smallest id of each group by brute force, all pairs compared. Also the number of links."""
    sets, u, links = [(i, plain_shingles(t)) for i, t in rows], Union(), 0
    for k, (_, x) in enumerate(sets):
        u.find(k)
        for j in range(k):
            y = sets[j][1]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and (5 * len(x & y) >= 4 * len(x | y)):
                u.join(j, k)
                links += x != y
    least = {}
    for k, (i, _) in enumerate(sets):
        least[u.find(k)] = min(least.get(u.find(k), i), i)
    return sorted(least.values()), links


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SMALL).collect())


def planted(seed, n):
    rng = random.Random(seed)
    texts = [rng.choices([f"W{k}" for k in range(2000)], k=rng.randint(1, 200)) for _ in range(n)]
    for k in range(n):                                                  # copies of all similarities about the limit
        copy = list(texts[k])
        for _ in range(rng.randint(0, 1 + len(copy) // 25)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10 ** 6)}"
        texts.append(copy)
    joined = [" ".join(t) for t in texts]
    joined += ["\n".join(t).lower() + "\t\n" for t in texts[:10]]        # wrapped anew
    rows = list(enumerate(joined)) + [(9000, None), (9001, ""), (9002, " \n "), (9003, joined[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounded", [2048, 4])
def test_stage_equals_all_pairs(spark, monkeypatch, bounded):
    monkeypatch.setattr(shingle_join, "BOUNDED", bounded)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rows = planted(bounded, 120)
    expected, links = plain_kept(rows)
    assert links > 20 and len(expected) < len(rows) - 40
    assert kept(spark, rows) == expected


def test_large_group_and_common_passage(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BOUNDED", 8)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    base, passage = [word() for _ in range(100)], [word() for _ in range(60)]
    rows = [base[:k % 97] + [word()] + base[k % 97 + 1:] for k in range(60)]            # near copies of one another
    rows += [base[:60 + k % 30] + [word() for _ in range(40 - k % 30)] for k in range(30)]  # on both sides of the limit
    rows += [passage + [word() for _ in range(rng.randint(3, 40))] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)]
    assert kept(spark, rows) == plain_kept(rows)[0]


def test_documents_of_the_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, links = plain_kept(rows)
    assert links >= 12                                                  # of similarity 4/5 to below 1
    assert kept(spark, rows) == expected


def test_common_shingles_give_no_pair_of_joined_sets(spark):
    rows = spark.range(2000).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("h"), F.when(F.col("id") < 1990, 0).otherwise(F.col("id")).alias("root"),
                                    F.lit(1 << 32).alias("shape"), F.lit(0).cast("long").alias("s0"), F.lit(0).cast("long").alias("s1"))
    assert shingle_join._tiles(rows.where("root = 0")).count() == 0
    assert shingle_join._tiles(rows).count() == 1990 + 10 * 4           # the ten others meet four blocks


def test_fingerprints_join_documents_before_the_exact_check(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(20_000)]
    apart = [f"v{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = [(k, " ".join([*words[:at], "changed", *words[at + 1:]])) for k, at in enumerate(range(0, 20_000, 2_000))]
    rows += [(20, " ".join(apart)), (21, " ".join([*apart[:150], "changed", *apart[151:]])), (30, "alone"), (31, None), (32, "")]
    assert kept(spark, rows) == plain_kept(rows)[0] == [0, 20, 30, 31]
    monkeypatch.setattr(shingle_join, "_bounded_pairs", lambda batches: iter(()))       # no candidates but those of the fingerprints
    few = kept(spark, rows)
    assert 0 in few and len([i for i in few if i < 20]) < 10 and {20, 30, 31} <= set(few)


def test_groups_that_are_not_similar_are_not_joined(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f g h i j k"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alike = docs.select(shingle_join.text_mark("text").alias("mark"), F.lit(5).cast("long").alias("root"))
    assert shingle_join.similar_documents(docs, alike=alike).select("root").distinct().count() == 4


def test_groups_of_close_fingerprints_keep_one_document_even_if_their_shingles_differ(spark):
    rng = random.Random(13)
    tails = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(10)) for _ in range(4)]
    rows = [(k, "x " * 100 + tails[k]) for k in range(3)] + [(3, tails[3]), (4, "x " * 100 + tails[0]), (5, tails[1]), (6, None)]
    assert plain_kept(rows)[0] == [0, 1, 2, 3, 5, 6]                    # by shingles alone, only the copy goes
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {frozenset(r.ids) for r in near_duplicates(docs, 5).groupBy("root").agg(F.collect_set("doc_id").alias("ids")).collect()}
    assert found == {frozenset(g) for g in ((0, 1, 2, 4), (3,), (5,), (6,))}
    assert kept(spark, rows) == [0, 3, 5, 6]
