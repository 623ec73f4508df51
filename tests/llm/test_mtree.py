from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.llm import mtree
from rewardloom.llm import queries as Q

from .conftest import SF


def brute(rows, k, is_query):
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [math.floor(1024 * x) for x in v]))
    out = set()
    for q, a in {(i, tuple(v)) for i, v in fine if is_query(i)}:
        hits = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(hits[:k], 1)}
    return out


@pytest.mark.parametrize("part", [40, 4096])
def test_equals_brute_force_with_ties_and_copies(spark, part):
    rng = random.Random(part)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for k in range(400)]
    rows += [(k, [0.25] * 6) for k in range(400, 700)]  # one vector many times
    rows += [(1000, None), (1001, [None, *[0.1] * 5]), (1002, [math.nan, *[0.1] * 5]), (1003, [math.inf] * 6), (None, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 100 == 0, part=part).collect()}
    assert got == brute(rows, 10, lambda i: i % 100 == 0)


def test_blocks_of_queries_give_the_same(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 10 == 0, query_block=7, part=50).collect()}
    assert got == brute(rows, 10, lambda i: i % 10 == 0)


def test_few_none_and_odd_lengths(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, 0.5]), (7, [3.0, -1.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute(rows[:3], 10, lambda i: i % 100 == 0)
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_search_skips_pages():
    """Far pages are never opened."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 100_000
    vectors = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(4000, 8)) * 50).astype(np.int64)
    norm = float(np.sqrt((vectors.astype(float) ** 2).sum(1).max()))
    tree = mtree.Tree(mtree.build_pages(vectors, np.arange(4000), norm, 0), 8, norm)
    opened = []
    tree.pages = type("Counted", (dict,), {"__getitem__": lambda self, n: (opened.append(n), dict.__getitem__(self, n))[1]})(tree.pages)
    query = vectors[np.argmax((vectors.astype(float) ** 2).sum(1))]
    best = tree.search(-1, query, 10)
    scores = vectors @ query
    assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:10]
    assert len(opened) < len(tree.radii) / 2


def test_exact_products_beyond_doubles():
    rows = np.array([[1 << 30, 1], [(1 << 30) + 1, 0]], np.int64)
    query = np.array([(1 << 30) + 1, 3], np.int64)
    assert mtree.products(rows, query).tolist() == [sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows]


def test_query_equals_sql(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
        want = {tuple(r) for r in con.execute(Q.OP8_SQL).fetchall()}
    assert {tuple(r) for r in Q.op8_top_k(spark, SF).collect()} == want
