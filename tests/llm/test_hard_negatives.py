from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.llm import hard_negatives as H
from rewardloom.llm import queries as Q

from .conftest import SF, SF_MORE

SCHEMA = "vec_id long, label int, embedding array<double>, score string, slot int"


def brute(rows, is_anchor, positives=5, negatives=5, percent=80):
    fine = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a, own, v in {r for r in fine if is_anchor(r[0])}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in fine)
        for p, i, _ in [r for r in scored if r[2] == own and r[1] != a][:positives]:
            hits = [r for r in scored if r[2] != own and percent * -p <= 100 * -r[0] <= 100 * -p][:negatives]
            out += [(a, i, n, j, -p, -s) for n, (s, j, _) in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, **how).collect())


def made(seed, n, values):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(3), [rng.choice(values) for _ in range(4)]) for k in range(n)]
    rows += [(1000 + k, k % 2, rows[7][2]) for k in range(200)]  # one vector many times, in two labels
    return rows + [(5001, None, [0.1] * 4), (5002, 1, None), (5003, 1, [None, 0.1, 0.1, 0.1]), (5004, 1, [math.nan] * 4), (None, 1, [0.1] * 4), rows[3], (100, 1, [0.9] * 4)]


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"block": 2}), (3, {"positives": 3, "negatives": 2, "percent": 95}), (4, {"percent": 100})])
def test_equals_brute_force(spark, seed, how):
    rows = made(seed, 320, [-0.5, -0.1, 0.0, 0.1, 0.25, 0.5])
    want = brute(rows, lambda i: i % 100 == 0, **{k: v for k, v in how.items() if k != "block"})
    assert want and mined(spark, rows, **how) == want


def test_negative_scores_and_missing_partners(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 0.0]), (2, 1, [-1.0, 0.0]), (3, 0, [0.0, 1.0]), (4, 1, [0.0, 2.0]), (100, 5, [1.0, 1.0]), (8, 1, [1.0])]
    want = brute(rows[:6], lambda i: i % 100 == 0)
    assert mined(spark, rows) == want and any(r[4] == 0 for r in want) and not any(r[0] == 100 or r[4] < 0 for r in want)


def test_the_combiner_drops_all_but_the_best():
    rng = np.random.default_rng(0)
    best = H.SlotBest(4, 3)
    best.room = 50
    group, score, ids = rng.integers(0, 4, 5000), rng.integers(0, 30, 5000), rng.permutation(5000)
    for at in range(0, 5000, 37):
        best.add(group[at : at + 37], score[at : at + 37], ids[at : at + 37])
        assert best.held <= 50 + 37
    kept = list(zip(*(x.tolist() for x in best.combine())))
    rows = sorted(zip(group.tolist(), (-score).tolist(), ids.tolist()))
    assert [(g, -s, i) for g, s, i in kept] == [r for g in range(4) for r in [x for x in rows if x[0] == g][:3]]


def test_products_stay_exact():
    rows = np.array([[1 << 31, 5], [-(1 << 31), 7]], np.int64)
    assert H.score_grid(rows, rows).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in rows] for a in rows]
    small = np.array([[3, -4], [5, 6]], np.int64)
    assert H.score_grid(small, small).tolist() == (small @ small.T).tolist()


def test_refusals_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 1, [1e12]), (1, 1, [0.5])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="2\\^40"):
        H.mine(df, F.col("vec_id") == 0)
    with pytest.raises(ValueError, match="percent"):
        H.mine(df, F.col("vec_id") == 0, percent=0)
    assert H.mine(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert H.mine(df.where("vec_id = 1"), F.col("vec_id") == 0).collect() == []


def test_vectors_are_not_shuffled(spark):
    df = H._merged(spark.createDataFrame([], "anchor int, slot int, vec_id long, score long"), 2)
    assert "hashpartitioning(anchor" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("folder", [SF, SF_MORE])
def test_query_equals_sql(spark, folder):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
        want = {tuple(r) for r in con.execute(Q.OP13_SQL).fetchall()}
    assert {tuple(r) for r in Q.op13_hard_negatives(spark, folder).collect()} == want
