"""Numbers up to rounding, classes of equal results, rows moved once."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import compare as C
from rewardloom.operators.guard import GuardConfig
from rewardloom.operators.rollouts import score_sql_pairs

ROWS = "query_key string, cells array<string>"


def matched(spark, results, pairs):
    """Whether each (gold, candidate) of named results matches."""
    doubles = sorted({x for rs in results.values() for r in rs for x in r if isinstance(x, float)}) or [0.0]
    shown = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in doubles], "x double").select("x", F.col("x").cast("string")).collect()}
    rows = spark.createDataFrame([(k, [shown[x] if isinstance(x, float) else str(x) for x in r]) for k, rs in results.items() for r in rs], ROWS)
    table = spark.createDataFrame([(f"{g}/{c}", g, c) for g, c in pairs], "pair_id string, gold_key string, cand_key string")
    got = {r.pair_id: r.matched for r in C.compare_bags(table, rows, rows).collect()}
    return [got[f"{g}/{c}"] for g, c in pairs]


def places(spark, values, finer=0):
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double")
    return [r[0] for r in rows.orderBy("k").select(C.number_place(F.col("v"), finer)).collect()]


def test_places_grow_with_numbers_without_gaps(spark):
    rng = random.Random(2)
    values = sorted([rng.uniform(-1, 1) * 10 ** rng.randint(-12, 40) for _ in range(2000)] + [0.0, 100.0, -100.0, 1e3, 1e11, 1e12, 1e13, 1e300])
    got = places(spark, values)
    assert got == sorted(got)
    for edge in (100.0, 1000.0, 1e7, 1e12, 1e13, 1e22):  # one place to the next, across powers of ten
        low, high = edge * (1 - 1e-12), edge
        a, b = places(spark, [low, high])
        assert 0 <= b - a <= 1
    assert places(spark, [12.34567890123, 123456.789012, -3183256271.63, 0.0, -0.0]) == [123456789012, *places(spark, [123456.789012, -3183256271.63]), 0, 0]


@pytest.mark.parametrize("cell", ["1.10", "12345678901234567890.1", "1.5d", ".5", "1e5", "NaN", "1", "v1.2", "", "1.0E400"])
def test_other_texts_are_no_numbers(spark, cell):
    assert spark.createDataFrame([(cell,)], "c string").select(C.number(F.col("c"))).first()[0] is None


def test_sums_in_any_order_match_and_changed_digits_dont(spark):
    rng = random.Random(7)
    results, pairs, want = {}, [], []
    for k in range(150):
        terms = [rng.uniform(0, 10 ** rng.randint(1, 8)) for _ in range(200)]
        total = [sum(terms), sum(sorted(terms)), sum(reversed(terms)), math.fsum(terms)]
        for n, x in enumerate(total):
            results[f"s{k}-{n}"] = [["a", x, x / 3], ["b", -x, 1]]
        step = 10.0 ** (math.floor(math.log10(total[0])) - 10)  # one in the eleventh digit
        results[f"s{k}-x"] = [["a", total[0] + step, total[0] / 3], ["b", -total[0], 1]]
        pairs += [(f"s{k}-0", f"s{k}-{n}") for n in (1, 2, 3)] + [(f"s{k}-0", f"s{k}-x")]
        want += [True, True, True, False]
    assert matched(spark, results, pairs) == want


def test_numbers_parted_by_rounding_are_found(spark):
    """Sums just below and above the middle of two places, in many rows and columns at once."""
    middle = [1234567890.125 + 0.01 * k for k in range(60)]  # the twelfth digit is the hundredth
    low, high = ([[f"g{k % 5}", m * (1 + e), "x", 0.1 + 0.2 * (e > 0)] for k, m in enumerate(middle)] for e in (-3e-15, 3e-15))
    other = [r[:] for r in low]
    other[7][1] += 0.01
    fewer, swapped = low[1:], [[r[0], r[3], "x", r[1]] for r in low]
    for r in high:
        r[3] = 0.1
    for r in low:
        r[3] = 0.1
    results = {"low": low, "high": high[::-1], "other": other, "fewer": fewer, "swapped": swapped, "shape": [[r[0], r[1], "y", r[3]] for r in high]}
    assert places(spark, [low[0][1]]) != places(spark, [high[0][1]])
    pairs = [("low", "high"), ("high", "low"), ("low", "other"), ("low", "fewer"), ("low", "swapped"), ("low", "shape"), ("low", "low")]
    assert matched(spark, results, pairs) == [True, True, False, False, False, False, True]


def test_multiplicities_of_close_rows_count(spark):
    a, b = 1234567890.125 * (1 - 3e-15), 1234567890.125 * (1 + 3e-15)
    results = {"g": [["k", a], ["k", a], ["k", 5.5]], "same": [["k", b], ["k", a], ["k", 5.5]], "less": [["k", b], ["k", 5.5], ["k", 5.5]]}
    assert matched(spark, results, [("g", "same"), ("g", "less")]) == [True, False]


def test_classes_against_plain_comparison(spark):
    rng = random.Random(11)
    kinds = [[[rng.choice("ab"), rng.randint(0, 2), rng.choice([0.5, 1.5])] for _ in range(rng.randint(0, 4))] for _ in range(9)]
    results = {f"q{k}": rng.sample(kind := rng.choice(kinds), len(kind)) for k in range(80)}
    pairs = [(f"q{rng.randrange(90)}", f"q{rng.randrange(90)}") for _ in range(400)] + [("q0", f"q{k}") for k in range(80)]
    pairs = sorted(set(pairs))
    bag = lambda k: sorted(map(str, results.get(k, [])))
    assert matched(spark, results, pairs) == [bag(g) == bag(c) for g, c in pairs]


def test_different_rows_with_one_fingerprint_are_told_apart(spark, monkeypatch):
    weak = lambda rows: C_FINGERPRINTS(rows).withColumn("h1", F.lit(0).cast("decimal(38,0)")).withColumn("h2", F.col("h1"))
    monkeypatch.setattr(C, "fingerprints", weak)
    results = {"a": [["1"], ["2"]], "b": [["2"], ["1"]], "c": [["1"], ["1"]], "d": [["3"], ["2"]]}
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("c", "d"), ("b", "a")]
    assert matched(spark, results, pairs) == [True, False, False, False, True]


C_FINGERPRINTS = C.fingerprints


def test_rows_of_a_popular_gold_query_are_moved_once(spark):
    """Each query's rows go into the check once, however many pairs it is in."""
    rows = spark.createDataFrame([(f"q{k}", ["1", str(r)]) for k in range(40) for r in range(5)], ROWS)
    pairs = spark.createDataFrame([(f"p{k}-{j}", f"q{k}", f"q{j}") for k in range(40) for j in range(40)], "pair_id string, gold_key string, cand_key string")
    sided, side = C._sided(rows, rows)
    compared = C._compared(pairs, C.fingerprints(sided), side)
    assert C._members(compared, side).count() == 40
    assert C.bag_differences(pairs, rows, rows).isEmpty()


def test_sums_through_guarded_runs(spark):
    rng = random.Random(1)
    values = spark.createDataFrame([(k % 7, k % 3, rng.uniform(0, 1e5)) for k in range(20000)], "a int, b int, x double").repartition(8)
    texts = [
        ("whole", "SELECT sum(x) FROM t", "SELECT sum(s) FROM (SELECT sum(x) AS s FROM t GROUP BY a)"),
        ("grouped", "SELECT b, sum(x), avg(x) FROM t GROUP BY b", "SELECT b, sum(s), sum(s) / sum(n) FROM (SELECT a, b, sum(x) AS s, count(*) AS n FROM t GROUP BY a, b) GROUP BY b"),
        ("changed", "SELECT sum(x) FROM t", "SELECT sum(x) + 0.01 FROM t"),
    ]
    pairs = spark.createDataFrame([(p, "d", g, c) for p, g, c in texts], "pair_id string, db_id string, gold_sql string, candidate_sql string")
    scored, _ = score_sql_pairs(spark, pairs, lambda _: {"t": values}, guard_cfg=GuardConfig(timeout_s=300))
    assert {r.pair_id: r.reason for r in scored.collect()} == {"whole": "match", "grouped": "match", "changed": "exec_mismatch"}
