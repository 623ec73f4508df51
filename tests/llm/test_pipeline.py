from __future__ import annotations

from collections import Counter

import __spark_entry__ as E
import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from rewardloom.llm import bpe, decontaminate, langid, secret_scan, simhash
from rewardloom.llm.common import saved
from rewardloom.llm.queries import train_rows

from .conftest import SF, SF_MORE
from .test_simhash import plain_components, plain_fingerprint


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_bpe"]


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    told = saved(P.language_id(spark, docs, SF_MORE), "told")
    model = langid.fit(docs, train_rows(4, 2)).scorer()
    assert {r["doc_id"] for r in told.collect()} == {r["doc_id"] for r in docs.collect() if not model.score(r["text"])[3]}

    single = saved(P.simhash_near_dedup(spark, told, SF_MORE), "single")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in told.collect()]
    first = plain_components(prints, simhash.MAX_BITS)
    assert {r["doc_id"] for r in single.collect()} == {i for i, f in prints if first[f] == i}

    clean = saved(P.benchmark_decontamination(spark, single, SF_MORE), "clean")
    items = [" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{SF_MORE}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()}
    holds = {r["doc_id"] for r in single.collect() if any(f" {i} " in f" {' '.join(decontaminate.words_of(r['text']))} " for i in items)}
    assert holds and holds <= gone and len(gone) <= len(holds) + 3

    safe = saved(P.secret_scans(spark, clean, SF_MORE), "safe")
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert safe.where(F.col("text").contains(secret_scan.MARK)).count() > 0

    ids = P.byte_bpe(spark, safe, SF_MORE).collect()
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    pairs = bpe.byte_pairs(P.public_tokenizers.path(P.RANKS), P.public_tokenizers.PATTERN)
    assert len(ids) == len(texts)
    assert all(pairs.decode(bytes(r["ids"])).decode() == texts[r["doc_id"]] and len(np.frombuffer(r["ids"], "<u4")) == r["n_tokens"] for r in ids)


def test_awkward_rows_pass_all_stages(spark, awkward):
    docs = awkward
    for name, stage in P.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), name)
        assert docs.columns == awkward.columns
    assert docs.count() <= awkward.count()
    docs = awkward.limit(0)
    for name, stage in P.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_one_row_of_each_group_stays(spark, awkward):
    rows = P.simhash_near_dedup(spark, awkward, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    alone = P.simhash_near_dedup(spark, awkward.where("doc_id is null and text is not null"), SF).collect()
    assert len(alone) == 1


def test_group_winners_beside_map_columns(spark):
    rows = [(1, "one two three four five", {"a": [1]}), (2, "one two three four five", {"a": [2]}), (1, "one two three four five", {"b": [1]}), (3, "six", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, array<int>>")
    kept = P.first_of_groups(docs, simhash.SHINGLE, simhash.MAX_BITS).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3] and all((r["doc_id"], r["text"], r["tags"]) in rows for r in kept)
