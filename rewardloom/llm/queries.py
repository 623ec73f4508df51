"""Registered queries of the operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm import (
    bpe, decontaminate, hard_negatives, langid, lexical_tree, mtree, pii, quality, secret_scan, simhash, token_files, toxicity, url_rules,
)
from rewardloom.llm.common import remainder, table
from rewardloom.session import scratch_table_path

Query = Callable[[SparkSession, str], DataFrame]


END_ID = 2
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"))


def written_and_read(docs: DataFrame) -> DataFrame:
    """Writes the ids, looks every key up in the index and reads its ids back."""
    folder = scratch_table_path(docs.sparkSession, "token_files")
    files = token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return files.payloads(files.keys, wide=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes they decode to."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.encode(docs, path, pattern, decoded=True).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def train_rows(mod: int, held: int) -> Column:
    """Rows whose label may be learned from; a null id is neither trained on nor held out."""
    return F.coalesce(remainder(F.col("doc_id"), mod) != held, F.lit(False))


def held_out(mod: int, held: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = quality.fit(docs, labels, train_rows(4, 2))
    scored = docs.select("doc_id", held_out(4, 2), quality.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def languages(docs: DataFrame) -> DataFrame:
    model = langid.fit(docs, train_rows(4, 2))
    found = docs.select("doc_id", held_out(4, 2), langid.predict_column(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.margin", "found.rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = toxicity.fit(docs, labels, train_rows(5, 0))
    scored = docs.select("doc_id", held_out(5, 0), toxicity.score_column(model, F.col("text")).alias("found"))
    return scored.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("size"), "value", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 10
"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_tree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sums AS (
  SELECT sum((len(terms) > 0)::BIGINT)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), words AS (
  SELECT row_id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM (SELECT *, row_number() OVER () AS row_id FROM d)
), entries AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf FROM words
  WHERE term IN (SELECT term FROM item_terms) GROUP BY row_id, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM entries, sums GROUP BY term, docs
), scored AS (
  SELECT i.item_id, e.row_id, e.doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM item_terms i JOIN entries e USING (term) JOIN weights USING (term), sums
  WHERE e.doc_id IS NOT NULL
  GROUP BY i.item_id, e.row_id, e.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans."""
    found = pii.find(docs).withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives(table(spark, sf_dir, "embeddings"))


def negatives(vectors: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), best AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same
), windows AS (
  SELECT b.anchor_id, b.vec_id AS positive_id, b.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY b.anchor_id, b.vec_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM best b JOIN scored s ON s.anchor_id = b.anchor_id AND NOT s.same
    AND 80 * b.score <= 100 * s.score AND s.score <= b.score
  WHERE b.place <= 5
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE place <= 5
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_secret_scan": op7_secret_scan,
        "op8_top_k": op8_top_k,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_url_filters": op10_url_filters,
        "op11_ranked_search": op11_ranked_search,
        "op12_pii": op12_pii,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_top_k": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}
