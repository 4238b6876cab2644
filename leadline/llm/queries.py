"""The registered queries of this subpackage: thin forms of the operators over the whole given tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts
from .common import table
from .id_files import written_and_read
from .language import UNDETERMINED, detect_languages, fit_languages
from .language import held_out as language_held_out
from .lexical import ranked_documents
from .line_dedup import repeated_lines
from .quality import GOOD_FROM, fit_quality, held_out, score_quality
from .runs import periodic_runs
from .secrets import scan_secrets
from .sharding import interleave
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .topk import top_k
from .winnow import find_spans

TOKENIZER = "word_bpe_49k.json"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
                       sha256(F.col("decoded")).alias("decoded_sha256"))


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "n_links",
                        F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        sha256(F.concat_ws(",", "item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), k=5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha256(F.col("base")).alias("base_sha256"),
                        "spans", "n_signed_token", "n_key_der", "n_key_ssh", "n_key_pem")


def partly_periodic(docs: DataFrame) -> DataFrame:
    """The contract's documents: where crc32(doc_id) % 10 is 0, the words from a on repeat the p words that begin at a.

    A null id leaves its text as it is.
    """
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("words")
    g = F.floor(h / 10).cast("bigint")
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")).alias("words"), g.alias("g"))
    at = split.select("*", F.when(n > 0, F.pmod("g", n)).cast("int").alias("a"))
    sized = at.select("*", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), (F.floor((n - F.col("a")) / F.col("p")) + 1).cast("int")))
    made = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, n - F.col("a"))), " ")
    return sized.select("doc_id", F.when(F.col("p").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(partly_periodic(table(spark, sf_dir, "documents")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.*",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
                        sha256(lines).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect_languages(docs, fit_languages(docs))
    return found.select("doc_id", language_held_out().alias("held_out"), F.coalesce("nearest", F.lit(UNDETERMINED)).alias("lang_pred"), "score",
                        "margin", (F.col("lang") == UNDETERMINED).alias("rejected"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_id_files, op3_sharding, op4_line_dedup, op5_simhash, op6_decontamination, op7_top_k, op8_quality, op9_suffix_dedup, op10_secret_scan,
                                   op11_periodic_runs, op12_language_id, op13_lexical_search)}

#: DuckDB statements for the queries that SQL can express.
ORACLES = {
    "op6_decontamination": r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
span AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS s
         FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
hit AS (SELECT r, i, g.n, item_id FROM (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS s
          FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM span) WHERE len(w) >= n)) g JOIN span USING (n, s)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN words USING (r) LEFT JOIN ids USING (r)""",
    "op7_top_k": """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_lexical_search": r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM doc),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM post, total GROUP BY term, n),
size AS (SELECT r, doc_id, 10 + (90 * len(t) * n) // l AS m FROM doc, total WHERE len(t) > 0),
scored AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM item JOIN weight USING (term) JOIN post USING (term) JOIN size USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
           FROM scored JOIN size USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
