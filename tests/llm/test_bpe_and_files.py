import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leadline.llm import bpe, common, id_files, queries, range_coder
from leadline.llm.bpe import Bpe, encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_merges_equal_a_plain_rank_loop():
    bpe = Bpe(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)

    def slow(symbols):
        symbols = list(symbols)
        while True:
            pairs = [(bpe.merges[a][b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if b in bpe.merges[a]]
            if not pairs:
                return symbols
            (_, new), k = min(pairs)
            symbols[k:k + 2] = [new]

    for _ in range(300):
        word = "".join(rng.choices("aaabcdenrstth", k=rng.randint(1, 25)))
        start = [bpe.ids[c] for c in word[:-1]] + [bpe.ids[word[-1] + "</w>"]]
        assert bpe.merge(list(start)) == slow(start), word


def test_encoding_equals_the_library(spark, messy, messy_rows, library):
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encode_texts(messy, PATH).collect())
    expected = Counter()
    for doc_id, text, *_ in messy_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected[doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == expected


def test_columns_are_carried_and_an_empty_table_stays_empty(messy, nothing):
    kept = encode_texts(messy, PATH, keep=("source", "score"))
    assert kept.columns == ["doc_id", "ids", "decoded", "source", "score"]
    assert kept.count() == messy.count()
    assert encode_texts(nothing, PATH).count() == 0


def test_another_operator_drops_the_memo_of_words():
    text = open(PATH, encoding="utf-8").read()
    first = bpe.loaded(text)
    batch = pa.record_batch({"text": pa.array(["some words"])})
    assert list(common.chunks(iter([batch]), keep=True)) == [batch] and bpe.loaded(text) is first
    assert list(common.chunks(iter([batch]))) == [batch] and bpe.loaded(text) is not first


def test_query_digests(spark, library):
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for t in texts[:60]:
        ids = library.encode(t.text or "", add_special_tokens=False).ids
        r = rows[t.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("ids", [[], [5], [0] * 700, list(range(65_000, 65_536)), [1, 2, 3] * 400 + [9]])
def test_coder_round_trip(ids):
    assert range_coder.decompress(range_coder.compress(np.array(ids, np.int64))).tolist() == ids


def test_coder_round_trip_on_mixed_ids_and_learns():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 65_536, 3_000), np.minimum(rng.zipf(1.3, 30_000), 49_000), np.tile(rng.integers(0, 40_000, 50), 400)])
    packed = range_coder.compress(ids)
    assert (range_coder.decompress(packed) == ids).all()
    assert len(range_coder.compress(np.tile(rng.integers(0, 40_000, 50), 400))) < 8_000 < len(packed) < 2 * len(ids)


def test_coder_across_several_groups_of_lanes(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 3)
    monkeypatch.setattr(range_coder, "BLOCK", 64)
    monkeypatch.setattr(range_coder, "SHORT", 64)
    ids = np.random.default_rng(2).integers(0, 300, 1_001)
    assert (range_coder.decompress(range_coder.compress(ids)) == ids).all()


def test_damage_is_found_and_large_ids_are_refused():
    packed = bytearray(range_coder.compress(np.arange(500) % 77))
    packed[-20] ^= 1
    with pytest.raises(ValueError):
        range_coder.decompress(bytes(packed))
    with pytest.raises(ValueError):
        range_coder.decompress(bytes(packed[:30]))
    with pytest.raises(ValueError):
        range_coder.compress(np.array([70_000]))


def test_files_of_messy_rows(spark, messy, messy_rows, nothing, library, monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT", 2_000)
    rows = id_files.written_and_read(messy, PATH).collect()
    order = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in order] == sorted((i for i, *_ in messy_rows), key=lambda i: (i is not None, i or 0))

    def expected(text):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, *expected(t)) for i, t, *_ in messy_rows)
    assert id_files.written_and_read(nothing, PATH).count() == 0
