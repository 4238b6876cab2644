"""Cleaning of the documents table: five stages, each an operator of leadline.llm applied to what the stage before kept.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` writes each stage's result to the shared folder and reads it back as the next stage's documents.

Documents are told apart by their id and a hash of their text, so repeated ids do no harm; null ids stand for one id that is
larger than all others. Rows that repeat both id and text pass or go together, except in the near-duplicate stage, which
keeps one row of each group. An empty table passes through every stage. Columns beside doc_id and text are carried along.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.llm.bpe import encode_texts
from leadline.llm.common import order_id, small_batches, stage, table, text_mark
from leadline.llm.line_dedup import without_repeated_lines
from leadline.llm.quality import fit_quality, good_documents
from leadline.llm.shingle_join import similar_documents
from leadline.llm.simhash import near_duplicates
from leadline.llm.winnow import find_spans

TOKENIZER = "word_bpe_49k.json"
SHINGLE = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more; the field learns from the labelled documents of this stage's input.

    A null or empty text is scored as one empty line.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return good_documents(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to a line at an earlier place; documents that lose all their words go.

    n_chars, where there is such a column, follows the text.
    """
    small_batches(spark)
    cut = without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Near-duplicates are documents that operator 5 puts into one group, since their SimHash fingerprints are close, and those whose
    sets of five-word shingles have similarity of 4/5 or more, which an exact join finds however far their fingerprints lie
    apart. A group is all that both kinds of links reach together.
    """
    small_batches(spark)
    found = similar_documents(docs, SHINGLE, alike=near_duplicates(docs, SHINGLE), linked=True)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"))).alias("first")).select("first.*")
    keyed = docs.withColumns({"__doc": order_id("doc_id"), "__mark": text_mark("text")})
    return keyed.join(first, ["__doc", "__mark"], "left_semi").dropDuplicates(["__doc", "__mark"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = find_spans(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hit = found.select(order_id("doc_id").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    keyed = docs.withColumns({"__doc": order_id("doc_id"), "__mark": text_mark("text")})
    return keyed.join(hit, ["__doc", "__mark"], "left_anti").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns of each document with n_tokens, ids and the SHA-256 of the decoded text."""
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "ids", "decoded", "n_tokens", "decoded_sha256"))
    made = encode_texts(docs, public_tokenizers.path(TOKENIZER), keep=others)
    return made.select("doc_id", *others, F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("simhash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", decontamination), ("bpe encoding", bpe_encoding)]

#: SQL can express neither the fitted classifier nor the 64-bit hashes of the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
