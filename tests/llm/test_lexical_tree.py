from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from rewardloom.llm import lexical_tree as L
from rewardloom.llm import queries as Q

from .conftest import SF_MORE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Every score of every item, by the formula as stated."""
    terms = [(i, plain_terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = collections.Counter(w for _, t in terms for w in set(t))
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(plain_terms(t))
    out = set()
    for item, own in asked.items():
        found = []
        for i, t in terms:
            if i is None or not t:
                continue
            tf, m = collections.Counter(t), 50 + 50 * len(t) * n_docs // total
            found.append((-sum(L.weight(n_docs, df[w]) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in own if tf[w]), i))
        out |= {(item, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1) if s < 0}
    return out


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, code string, score int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string")
    return {tuple(r) for r in L.rank_documents(d, b, **how).collect()}


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(400)] + ["Été", "über", "x" * 300, "A1", "中文"]
    text = lambda: rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 40)))
    docs = [(k, text()) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(60)]  # copies, more than k
    docs += [(5, docs[5][1]), (None, text()), (900, None), (901, ""), (902, " ... \t"), (903, "w1 " * 3000)]
    return docs, [(k, text()) for k in range(6)] + [(0, text()), (6, docs[3][1]), (7, None), (8, "zzz"), (None, text()), (9, " ;")]


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"part": 16}), (3, {"block_terms": 90, "k": 5})])
def test_equals_brute_force(spark, monkeypatch, seed, how):
    docs, items = made(seed, 150)
    assert ranked(spark, docs, items, **how) == brute(docs, items, how.get("k", 50))


def test_small_pages_and_pruning():
    """Trees of one-document pages give the same, and leave branches out."""
    rng = np.random.default_rng(4)
    leaf, L.LEAF = L.LEAF, 1
    try:
        sizes = rng.integers(1, 30, 600)
        rows = [np.sort(rng.choice(400, s, replace=False, p=(w := 1 / np.arange(1, 401)) / w.sum())) for s in sizes]
        terms, tfs = np.concatenate(rows), rng.integers(1, 5, sizes.sum())
        m = rng.integers(50, 200, 600)
        tree = L.Tree(np.arange(600), m, L.offsets(sizes), terms, tfs, 400)
        asked, weights = np.array([150, 260, 300]), np.array([9000, 9500, 9900])
        best = L.Best(3)
        opened = tree.search(asked, weights, best)
    finally:
        L.LEAF = leaf
    doc = np.repeat(np.arange(600), sizes)
    scores = np.zeros(600, np.int64)
    for t, w in zip(asked, weights):
        at = terms == t
        np.add.at(scores, doc[at], w * L.score_parts(tfs[at], m[doc[at]]))
    want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s))[:3]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
    assert opened < len(tree.low) / 4


def test_long_sums_and_lengths_stay_exact():
    assert L.lengths_m(np.array([10**9]), 10**11, 10**15).tolist() == [50 + 50 * 10**20 // 10**15]
    terms = np.arange(400_000)
    tree = L.Tree(np.array([1]), np.array([50]), np.array([0, len(terms)]), terms, np.full(len(terms), 9), len(terms))
    best = L.Best(1)
    tree.search(terms, np.full(len(terms), 50_001), best)
    assert best.scores.tolist() == [400_000 * 50_001 * (9 * 10**9 // 10_000)]


def test_awkward_and_empty_tables(spark, awkward):
    items = spark.createDataFrame([(1, "The QUICK brown größe 中文"), (2, None)], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert {tuple(r) for r in L.rank_documents(awkward, items).collect()} == brute(docs, [(1, "The QUICK brown größe 中文")], 50)
    assert L.rank_documents(awkward.limit(0), items).collect() == [] == L.rank_documents(awkward, items.limit(0)).collect()


def test_query_equals_sql_and_brute_force(spark):
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_MORE}/{name}.parquet')")
        want = {tuple(r) for r in con.execute(Q.OP11_SQL).fetchall()}
        docs, items = con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert {tuple(r) for r in Q.op11_ranked_search(spark, SF_MORE).collect()} == want == brute(docs, items, 50)
