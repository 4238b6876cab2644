import zlib
from collections import Counter

from leadline.llm import queries
from leadline.llm.sharding import interleave

SMALL = "/root/testdata/sf0.01"


def test_counts_mixture_and_slots(spark):
    rows = queries.op3_sharding(spark, SMALL).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    per_shard = Counter(r.shard for r in rows)
    assert set(per_shard) == set(range(40)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per_shard[s]))
    sources = Counter(r.source for r in rows)
    for (s, source), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - sources[source] / 40) <= 2, (s, source)
    for r in rows:
        raw = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_against_a_plain_version(spark):
    import hashlib
    rows = queries.op3_sharding(spark, SMALL).collect()
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    mix = lambda i: hashlib.md5(f"shard:{i}".encode()).hexdigest()[:16]
    by_source: dict = {}
    for t in texts:
        by_source.setdefault(t.source, []).append(t.doc_id)
    places = []
    for source, ids in by_source.items():
        for k, i in enumerate(sorted(ids, key=lambda i: (mix(i), i))):
            places.append(((2 * k + 1) / (2 * len(ids)), mix(i), source, i))
    n = len(places)
    expected = {p[3]: (at * 40 // n, at - -(-(at * 40 // n) * n // 40)) for at, p in enumerate(sorted(places))}
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == expected


def test_messy_rows_and_few_rows(spark, messy, messy_rows, nothing):
    rows = interleave(messy, shards=7).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in messy_rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    few = interleave(messy.limit(3), shards=40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert interleave(nothing).count() == 0
    again = {(r.doc_id, r.size, r.text_crc32): 0 for r in rows}
    assert set(again) == {(r.doc_id, r.size, r.text_crc32) for r in interleave(messy.repartition(5), shards=7).collect()}
