from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.llm import langid, quality, toxicity
from rewardloom.llm import queries as Q

from .conftest import SF_MORE


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF_MORE}/documents.parquet"), spark.read.parquet(f"{SF_MORE}/labels.parquet")


def held(rows, key="label"):
    return [r for r in rows if r["held_out"] and r[key] is not None]


def test_language_accuracy_and_split(spark, more):
    docs, _ = more
    rows = Q.languages(docs).join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id").collect()
    assert len(rows) == docs.count()
    out = held(rows)
    assert 0.15 < len(out) / len(rows) < 0.35
    assert np.mean([r["lang_pred"] == r["label"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and (r["score"] < 0.5) == r["rejected"] for r in rows)


def test_language_awkward_rows(spark, awkward, more):
    docs, _ = more
    model = langid.fit(docs, Q.train_rows(4, 2))
    rows = awkward.select("doc_id", langid.predict_column(model, F.col("text")).alias("f")).select("doc_id", "f.*").collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] in (1, 2, 3, 6)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in by.values()) and len(by) == 4
    fox = [tuple(r) for r in rows if r["doc_id"] == 5]
    assert len(fox) == 2 and fox[0] == fox[1]
    assert {r["lang_pred"] for r in Q.languages(awkward.where("lang is null")).collect()} == {"und"}
    assert Q.languages(awkward.limit(0)).collect() == []
    one = Q.languages(docs.where("lang = 'de'")).collect()
    assert {r["lang_pred"] for r in one} <= {"de", "und"}


def test_margin_compares_compressed_sizes():
    model = langid.LangModel({"aa": langid.letters("la le li lo " * 400), "bb": langid.letters("zut zat zet " * 400)})
    scorer = model.scorer()
    lang, score, margin, rejected = scorer.score("zut zet zat zut zat zet zut zet")
    assert lang == "bb" and margin > 0 and not rejected and math.isclose(score, margin / (margin + model.min_margin))


def test_quality_held_out(spark, more):
    docs, labels = more
    rows = Q.qualities(docs, labels).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    out = held(rows)
    assert np.mean([r["predicted"] == r["label"] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    rows = Q.qualities(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = Q.qualities(awkward, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.qualities(awkward.limit(0), labels).collect() == []


def test_ftrl_separates_and_drops_rare_features():
    texts = ["good words here"] * 30 + ["bad marks ### here"] * 30
    labels = np.array([1.0] * 30 + [0.0] * 30)
    order = np.random.default_rng(1).permutation(60)
    weights, intercept = quality.train_ftrl([texts[k] for k in order], labels[order], np.ones(60))
    features = quality.Features()

    def score(text):
        places, values = features.of(text)
        return 1 / (1 + math.exp(-(weights[places] @ values + intercept)))

    assert score("good words here") > 0.8 and score("bad marks ### here") < 0.2
    assert np.count_nonzero(weights) < 60


def brute_marginals(e, trans):
    """Marginals by summing over all taggings."""
    n = len(e)
    total, by = 0.0, np.zeros(n)
    for code in range(1 << n):
        tags = [code >> k & 1 for k in range(n)]
        weight = math.exp(sum(x for x, t in zip(e, tags) if t) + sum(trans[a][b] for a, b in zip(tags, tags[1:])))
        total += weight
        by += np.array(tags) * weight
    return by / total


def test_marginals_equal_sums_over_all_taggings():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 0, 1, 8, 3])
    e, trans = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    forward, backward = toxicity.chain_odds(e, lengths, trans)
    p = forward * backward / (1 + forward * backward)
    want = np.concatenate([brute_marginals(x, trans) for x in np.split(e, np.cumsum(lengths)[:-1])])
    assert np.allclose(p, want)


def test_toxicity_held_out_and_offsets(spark, more):
    docs, labels = more
    found = Q.toxicities(docs, labels)
    rows = found.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["label"] for r in held(rows)]) > 0.9
    words = {r["text"][s["start"] : s["end"]].lower() for r in rows for s in r["spans"]}
    assert "idiot" in words and all(" " not in w for w in words)


def test_toxicity_awkward_rows(spark, awkward, more):
    _, labels = more
    rows = Q.toxicities(awkward, labels).collect()
    assert len(rows) == awkward.count() and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert Q.toxicities(awkward.limit(0), labels).collect() == []
    tagger = toxicity.Tagger(toxicity.ToxicModel(np.zeros(toxicity.DIM), -4.0, np.zeros((2, 2)), (-2.0, 0.1, 0.1)))
    scores = [s for s, _ in tagger.score([None, "", "!!!", "a b", "a b"])]
    assert scores[0] == scores[1] == scores[2] and scores[3] == scores[4]


def test_copies_of_a_toxic_text_hide_no_word():
    rng = np.random.default_rng(4)
    plain, bad = [f"w{k}" for k in range(500)], ["scum", "vermin", "filth"]

    def toxic():
        return list(rng.permutation([*rng.choice(plain, 30), *bad]))

    texts = [toxic()] * 1000 + [toxic() for _ in range(100)] + [list(rng.choice(plain, 30)) for _ in range(1000)]
    labels = np.array([1] * 1100 + [0] * 1000)
    assert toxicity.toxic_words(texts, labels) == set(bad)


def test_a_language_of_copies_is_learned(spark):
    words = {"aa": "lami lore leta lusi lano", "bb": "zutka zatpo zetmi zokra zipla"}
    rows = [("aa", f"{words['aa']} {chr(97 + k)}lo ") for k in range(5)] * 2000 + [("bb", f"{words['bb']} {k}") for k in range(100)]
    docs = spark.createDataFrame([(k, t * 9, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), rows_per_lang=20)
    assert set(model.dictionaries) == {"aa", "bb"}
    assert model.scorer().score(rows[0][1] * 5)[0] == "aa"
