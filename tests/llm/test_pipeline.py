from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents after each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        step(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_and_only_take_away(spark, steps):
    before = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        assert 0 < after.count() <= before.count()
        before = after
    assert steps[-1][1].count() == before.count()


def test_rejected_documents_are_those_labelled_bad(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[0][1].collect()}
    right = sum((i in kept) == (q == 1) for i, q in labels.items())
    assert right / len(labels) > 0.95


def test_one_document_of_each_near_duplicate_group_stays(spark, steps):
    from tests.llm.test_shingle_join import plain_kept
    before, after = steps[1][1].collect(), steps[2][1].collect()
    assert sorted(r.doc_id for r in after) == plain_kept([(r.doc_id, r.text) for r in before])[0]


def test_contaminated_documents_go(spark, steps):
    from tests.llm.test_scores import plain_spans
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = steps[2][1].collect(), steps[3][1].collect()
    spans = plain_spans([(r.doc_id, r.text) for r in before], items)
    assert {r.doc_id for r in after} == {i for i, _, hit, _ in spans if not hit}


def test_run_equals_the_stages(spark, steps):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r.doc_id, tuple(r.ids)) for r in steps[-1][1].collect())
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_messy_and_empty_tables_pass_through(spark, messy, nothing, tmp_path_factory):
    for frame in (messy, nothing):
        docs = frame
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path_factory.mktemp("messy") / str(k))
            step(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() == 0) == (frame is nothing)


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
