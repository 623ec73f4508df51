"""S1-S4 S6 (F8), A6 J5 J6 K3 W4, ordinals."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.operators import evaluate as EV
from rewardloom.operators.ordinal import running_totals, with_global_rank
from rewardloom.sources import io as IO

AB = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _tmp():
    return tempfile.mkdtemp(prefix="rl-test-")


def test_jsonl_roundtrip_and_line_numbers(spark):
    d = _tmp()
    p = os.path.join(d, "data.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"a": 1}\n\n   \n{"b": 2}\n')
    rows = IO.read_jsonl(spark, p, AB).orderBy("ord").collect()
    assert [(r.a, r.b, r.ord, r.line_no) for r in rows] == [(1, None, 0, 1), (None, 2, 1, 4)]
    bad = os.path.join(d, "bad.jsonl")
    with open(bad, "w", encoding="utf-8") as f:
        f.write('{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError, match="line 2"):
        IO.read_jsonl(spark, bad, AB)
    perm = IO.read_jsonl(spark, bad, AB, mode="PERMISSIVE").orderBy("ord").collect()
    assert perm[1]._corrupt_record == '{"a": '
    out = os.path.join(d, "out")
    IO.write_jsonl(spark.createDataFrame([("é", None)], "x string, y string"), out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))
    assert json.loads(text) == {"x": "é", "y": None} and "é" in text


def test_json_document_and_array(spark):
    d = _tmp()
    IO.write_json_document(spark, {"run": 1}, os.path.join(d, "meta"))
    part = [f for f in os.listdir(os.path.join(d, "meta")) if f.startswith("part-")][0]
    assert json.loads(open(os.path.join(d, "meta", part), encoding="utf-8").read()) == {"run": 1}
    arr = os.path.join(d, "arr.json")
    with open(arr, "w", encoding="utf-8") as f:
        json.dump([{"a": 3}, {"a": 1}, {"a": 2}], f)
    rows = IO.read_json_array(spark, arr, AB).orderBy("ord").collect()
    assert [(r.a, r.ord) for r in rows] == [(3, 0), (1, 1), (2, 2)]
    assert [r.a for r in IO.first_n(IO.read_json_array(spark, arr, AB), 2).collect()] == [3, 1]


def test_preference_loader_caps_before_filter(spark):
    d = _tmp()
    p = os.path.join(d, "prefs.jsonl")
    rows = [{"prompt": "p\n", "chosen": "c", "rejected": "r"}, {"prompt": "p", "chosen": " ", "rejected": "r"},
            {"prompt": "p", "chosen": "c", "rejected": "r"}]
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    kept, counts = IO.load_preferences(spark, p, max_examples=2)
    assert [r.prompt for r in kept.collect()] == ["p"]
    assert tuple(counts.first()) == (2, 1, 1)


def _results(spark):
    rows = [
        ("base", 0, True, False, "easy", "match"), ("base", 1, False, False, "hard", "exec_mismatch"),
        ("base", 2, False, True, "easy", "gold_failed"), ("sft", 0, True, False, "easy", "match"),
        ("sft", 1, True, False, "hard", "match"),
    ]
    return spark.createDataFrame(rows, "label string, example_idx long, matched boolean, gold_failed boolean, difficulty string, reason string")


def test_metrics_zero_fill_and_deltas(spark):
    r = _results(spark)
    m = {x.label: x for x in EV.metrics(r).collect()}
    assert m["base"].total == 3 and m["base"].matched == 1 and m["base"].gold_failed == 1
    assert abs(m["base"].execution_accuracy - 1 / 3) < 1e-12 and m["base"].execution_accuracy_valid == 0.5
    d = {(x.label, x.difficulty): x for x in EV.metrics_by_difficulty(r).collect()}
    assert len(d) == 8 and d[("base", "extra")].total == 0 and d[("base", "extra")].accuracy == 0.0
    deltas = {(x.label, x.scope): x.delta_accuracy for x in EV.compare_with_base(r, "base").collect()}
    assert deltas[("sft", "all")] == round(1.0 - 1 / 3, 4) and deltas[("sft", "hard")] == 1.0
    ranks = [x.label for x in EV.rank_models(r).orderBy("rank").collect()]
    assert ranks == ["sft", "base"]
    empty = EV.metrics(r.filter(F.lit(False))).collect()
    assert empty == []


def test_running_accuracy(spark):
    got = {(x.label, x.example_idx): x.running_accuracy for x in EV.running_accuracy(_results(spark)).collect()}
    assert got[("base", 0)] == 1.0 and got[("base", 1)] == 0.5 and abs(got[("base", 2)] - 1 / 3) < 1e-12


def test_global_rank_and_running_totals_across_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    ranked = with_global_rank(df, ["k"], name="r", num_partitions=7)
    assert all(r.r == r.k + 1 for r in ranked.collect())
    rt = running_totals(df, ["g"], ["k"], {"s": F.col("k")}, num_partitions=5).collect()
    for r in rt[:200]:
        ks = sorted(x for x in range(5000) if (x * 1) % 1 == 0 and _g_of(x) == r.g and x <= r.k)
        assert r._n == len(ks) and r.s == float(sum(ks))


def _g_of(k):
    # inverse of k = id * 7919 % 5000 for g = id % 3
    inv = pow(7919, -1, 5000)
    return (k * inv % 5000) % 3


def test_nested_summaries(spark):
    r = _results(spark)
    s = {x.label: x for x in EV.metrics_summary(r).collect()}
    assert s["base"].by_difficulty["extra"].total == 0 and s["base"].by_reason["gold_failed"] == 1
    c = EV.comparison_summary(r, "base").collect()
    assert len(c) == 1 and c[0].label == "sft" and c[0].delta_by_difficulty["hard"] == 1.0
    d = _tmp()
    IO.write_json_document(spark, EV.metrics_summary(r).filter("label = 'sft'"), os.path.join(d, "summary"))
    part = [f for f in os.listdir(os.path.join(d, "summary")) if f.endswith(".json")][0]
    doc = json.loads(open(os.path.join(d, "summary", part), encoding="utf-8").read())
    assert doc["by_difficulty"]["easy"]["accuracy"] == 1.0


def test_global_rank_with_coalesced_ranges(spark):
    """Default partitioning: AQE may merge adjacent ranges; ranks stay exact."""
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("k"))
    assert all(r.r == r.k + 1 for r in with_global_rank(df, ["k"], name="r").collect())


def test_throughput_and_database_exists(spark):
    """W4 examples/s rounded to 2 places (0.0 without time); S5 for catalog databases."""
    row = spark.createDataFrame([(1034, 18000.0), (5, 0.0)], "n long, s double").select(
        EV.throughput(F.col("n"), F.col("s")).alias("x")
    ).collect()
    assert [r.x for r in row] == [0.06, 0.0]
    assert IO.database_exists(spark, "default") and not IO.database_exists(spark, "no_such_db_here")


def test_ranks_by_several_keys_with_nulls_and_both_directions(spark):
    import random

    from rewardloom.operators import ordinal as O

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), rng.choice([None, "a", "b'"]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "x int, y string, z long").repartition(6)
    key = lambda r: (-r[0] if r[0] is not None else 99, r[1] is not None, r[1] or "", r[2])
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    for how in (1, 3, 16):
        got = {r.z: r.r for r in with_global_rank(df, [("x", False), "y", "z"], name="r", num_partitions=how).collect()}
        assert got == want
    bounds = O.range_bounds(df, [("x", False), "y", "z"], 8)
    assert len(bounds) == 7
    sizes = [r[0] for r in df.groupBy(O.bucket_of([("x", False), "y", "z"], bounds)).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 700 / 8


def test_positions_need_no_checkpoint_and_one_exchange_of_rows(spark):
    df = spark.range(0, 4000).select((F.col("id") * 7919 % 4000).alias("k"), (F.col("id") % 3).alias("g"), F.repeat(F.lit("t"), 50).alias("text"))
    rank = with_global_rank(df, ["k"], name="r")
    totals = running_totals(df, ["g"], ["k"], {"s": F.col("k")})
    for out in (rank, totals):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "rangepartitioning" not in plan
        assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) <= 3
    assert with_global_rank(df.limit(0), ["k"], name="r").collect() == [] == running_totals(df.limit(0), ["g"], ["k"], {"s": F.col("k")}).collect()
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, k int")
    got = {(r.g, r.k): (r._n, r.s) for r in running_totals(nulls, ["g"], ["k"], {"s": F.col("k")}, num_partitions=2).collect()}
    assert got == {(None, 1): (1, 1.0), (None, 2): (2, 3.0), ("a", 1): (1, 1.0)}
