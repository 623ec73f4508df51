"""A training corpus from ``documents``: filter, deduplicate, decontaminate, redact, encode.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Every stage keeps the rows it has no reason to drop, null ids and repeated rows
included, and passes on columns it doesn't know.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm import bpe, decontaminate, langid, secret_scan, simhash
from rewardloom.llm.common import saved, table
from rewardloom.llm.queries import RANKS, train_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter go too."""
    model = langid.fit(docs, train_rows(4, 2))
    return docs.where(~langid.predict_column(model, F.col("text"))["rejected"])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id.

    Rows are told apart by id and a hash of all columns. Of a group without ids, and
    of rows with the group's smallest id, the one with the smallest hash stays; of
    rows that are equal in all columns, any one.
    """
    return first_of_groups(docs, simhash.SHINGLE, simhash.MAX_BITS)


def first_of_groups(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    # Maps can't be hashed; their texts can.
    whole = F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    prints = saved(docs.select("doc_id", whole.alias("row_hash"), simhash.fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    groups = simhash.components(prints, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    # A key with several equal rows keeps one of them; the others are counted here first.
    copies = prints.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n"))
    winners = first.select(F.col("first.doc_id").alias("win_id"), F.col("first.row_hash").alias("win_hash"))
    same = F.col("win_id").eqNullSafe(F.col("doc_id")) & (F.col("win_hash") == F.col("row_hash"))
    winners = saved(winners.join(copies, same).select("win_id", "win_hash", "n"), "winners")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), whole.alias("own_hash"))
    mine = F.col("win_id").eqNullSafe(F.col("own_id")) & (F.col("win_hash") == F.col("own_hash"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    kept = rows.join(winners.where("n = 1"), mine, "left_semi").select(*columns)
    several = winners.where("n > 1")
    if several.isEmpty():
        return kept
    copied = rows.join(several, mine, "left_semi").groupBy("own_id", "own_hash").agg(F.first("row").alias("row"))
    return kept.unionAll(copied.select(*columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    leaky = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # Leaks are told by the text, so that they hold for rows without an id as well.
    found = decontaminate.leaks(leaky, table(spark, sf_dir, "benchmark"), doc_id="text_hash")
    hashes = saved(found.select(F.col("doc_id").alias("leak_hash")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("own_hash"))
    clean = rows.join(hashes, F.col("own_hash") == F.col("leak_hash"), "left_anti")
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return secret_scan.redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of the texts that are left."""
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: Compression, fingerprints, forests and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
