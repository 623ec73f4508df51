"""Fixtures, properties and random rollouts against the DuckDB statements."""

from __future__ import annotations

import random

import duckdb
import pytest

from rewardloom.operators.preferences import PreferenceConfig, build_preferences, flatten_pairs
from rewardloom.plans import oracle as O

ROLLOUT_DDL = (
    "id string, db_id string, prompt string, candidate_id long, candidate_sql string, reward double, "
    "valid boolean, exec_ok boolean, matched boolean, error_type string, ord long"
)


def sample_rollouts(spark):
    """F2 (no ``matched`` values: all false)."""
    rows = [
        ("ex-001", "db1", "p1", 0, "SELECT count(*) FROM t", 1.0, True, True),
        ("ex-001", "db1", "p1", 1, "SELECT * FROM t", -0.2, True, False),
        ("ex-002", "db2", "p2", 0, "SELECT a FROM t", 1.0, True, True),
        ("ex-002", "db2", "p2", 1, "SELECT b FROM t", 0.9, True, True),
        ("ex-003", "db3", "p3", 0, "SELECT 1", 1.0, True, True),
        ("ex-003", "db3", "p3", 1, "DROP TABLE", -1.0, False, False),
    ]
    return spark.createDataFrame(
        [r + (None, None, i) for i, r in enumerate(rows)],
        ROLLOUT_DDL,
    )


def _stats(res):
    return res.stats.first().asDict()


def test_sample_rollouts_defaults_give_no_pairs(spark):
    res = build_preferences(sample_rollouts(spark), PreferenceConfig())
    assert res.pairs.count() == 0
    s = _stats(res)
    assert s["examples_skipped_chosen_not_matched"] == 2 and s["examples_skipped_no_valid"] == 1
    assert s["rollouts_read"] == 6 and s["examples_seen"] == 3


def test_sample_rollouts_without_match_requirement(spark):
    res = build_preferences(sample_rollouts(spark), PreferenceConfig(require_chosen_matched=False))
    pairs = flatten_pairs(res.pairs).collect()
    assert len(pairs) == 1
    p = pairs[0]
    assert p.id == "ex-001" and p.chosen == "SELECT count(*) FROM t<|im_end|>"
    assert p.rejected == "SELECT * FROM t<|im_end|>" and abs(p.reward_gap - 1.2) < 1e-9
    s = _stats(res)
    assert s["examples_skipped_gap"] == 1 and s["examples_skipped_no_valid"] == 1 and s["preferences_written"] == 1


def _group(spark, rows):
    return spark.createDataFrame(
        [("ex", "db", "p", cid, f"SELECT {cid}", r, True, True, m, "ok", cid) for cid, r, m in rows], ROLLOUT_DDL
    )


def test_gap_and_ties(spark):
    """F3."""
    df = _group(spark, [(0, 1.0, True), (1, 0.9, False), (2, 0.0, False)])
    pairs = flatten_pairs(build_preferences(df, PreferenceConfig(min_reward_gap=0.5)).pairs).collect()
    assert len(pairs) == 1 and pairs[0].reward_gap >= 0.5
    tie = _group(spark, [(0, 1.0, True), (1, 1.0, True)])
    pairs = flatten_pairs(build_preferences(tie, PreferenceConfig(allow_ties=True)).pairs).collect()
    assert len(pairs) == 1 and pairs[0].reward_gap == 0.0


@pytest.mark.parametrize("kw", [{"min_reward_gap": -1}, {"max_pairs_per_example": 0}, {"max_examples": 0}])
def test_invalid_options(kw):
    with pytest.raises(ValueError):
        PreferenceConfig(**kw)


# --- randomized: the DuckDB statement and stated properties -----------------
def frame(rows):
    return [(r["id"], r["db_id"], r["prompt"], r["candidate_id"], f"SELECT {r['candidate_id']}", r["reward"], r["valid"],
             r["exec_ok"], r["matched"], "ok", r["ord"]) for r in rows]


def check_against_sql(df, cfg):
    """Pairs and counters equal the statement's; returns the pairs."""
    res = build_preferences(df, cfg)
    got, stats = flatten_pairs(res.pairs).toPandas(), _stats(res)
    with duckdb.connect() as con:
        con.register("rollouts", df.toPandas())
        want = con.execute(O.preferences("rollouts", cfg)).df()
        totals = con.execute(O.preference_stats("rollouts", cfg)).df().iloc[0].to_dict()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
    assert stats == {k: int(v) for k, v in totals.items()}
    return got, stats


def check_properties(pairs, stats, rows, cfg):
    assert len(pairs) == stats["preferences_written"]
    skipped = sum(v for k, v in stats.items() if k.startswith("examples_skipped"))
    per_group = pairs.groupby(["id", "db_id", "prompt"]).size()
    assert stats["rollouts_read"] == len(rows) and stats["examples_seen"] == skipped + len(per_group)
    assert (per_group <= cfg.max_pairs_per_example).all()
    wide = (pairs["reward_gap"] >= cfg.min_reward_gap) & ((pairs["reward_gap"] > 0) | cfg.allow_ties)
    assert (wide | (cfg.allow_ties & (pairs["reward_gap"] == 0))).all()


def random_rollouts(seed, n_groups=60):
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        gid = f"ex-{rng.randint(0, n_groups):03d}"  # repeated ids with different prompts too
        prompt = rng.choice(["p", "q", ""]) if rng.random() < 0.1 else f"prompt-{g}"
        for _ in range(rng.randint(1, 7)):
            rows.append(
                {
                    "id": gid, "db_id": "db", "prompt": prompt,
                    "candidate_id": rng.randint(0, 5),
                    "reward": rng.choice([1.0, 0.9, 0.1, -0.2, -0.4, -1.0, 0.7, 0.75]),
                    "valid": rng.random() < 0.8, "exec_ok": rng.random() < 0.6, "matched": rng.random() < 0.4,
                }
            )
    for i, r in enumerate(rows):
        r["ord"] = i
    return rows


CONFIGS = [
    PreferenceConfig(),
    PreferenceConfig(require_chosen_matched=False, max_pairs_per_example=3),
    PreferenceConfig(allow_ties=True, min_reward_gap=0.2, max_pairs_per_example=2, require_chosen_matched=False),
    PreferenceConfig(allow_ties=True, min_reward_gap=0.0, max_pairs_per_example=4),
    PreferenceConfig(min_reward_gap=0.0, require_exec_ok=True, require_valid_sql=False, max_pairs_per_example=5),
    PreferenceConfig(max_examples=17, require_chosen_matched=False),
]


@pytest.mark.parametrize("ci", range(len(CONFIGS)))
def test_random_rollouts(spark, ci):
    cfg = CONFIGS[ci]
    rows = random_rollouts(100 + ci)
    pairs, stats = check_against_sql(spark.createDataFrame(frame(rows), ROLLOUT_DDL), cfg)
    check_properties(pairs, stats, rows, cfg)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_never_move_a_whole_group(spark):
    """k = 1: one map-side-combined aggregate, one exchange, no window.
    k > 1: no window over a group either."""
    one = _plan(build_preferences(sample_rollouts(spark), PreferenceConfig()).pairs)
    assert one.count("Exchange") == 1 and "Window" not in one
    many = _plan(build_preferences(sample_rollouts(spark), PreferenceConfig(max_pairs_per_example=3)).pairs)
    assert "windowspecdefinition(id#" not in many


@pytest.mark.parametrize("cfg", [PreferenceConfig(require_chosen_matched=False),
                                 PreferenceConfig(allow_ties=True, max_pairs_per_example=3, min_reward_gap=0.2)])
def test_hot_group_holding_a_third_of_rows(spark, cfg):
    """One example group holds a third of all rollouts; results equal the statement."""
    rng = random.Random(11)
    rows = []
    for i in range(30000):
        hot = i % 3 == 0
        rows.append({
            "id": "hot" if hot else f"ex-{i % 4000:05d}", "db_id": "db", "prompt": "p",
            "candidate_id": i, "reward": rng.choice([1.0, 0.9, 0.1, -0.2, -0.4, -1.0]),
            "valid": rng.random() < 0.9, "exec_ok": rng.random() < 0.7, "matched": rng.random() < 0.3, "ord": i,
        })
    df = spark.createDataFrame(frame(rows), ROLLOUT_DDL).repartition(8)
    pairs, stats = check_against_sql(df, cfg)
    check_properties(pairs, stats, rows, cfg)


@pytest.mark.parametrize("k", [2, 3, 63, 64, 200])
def test_walk_of_a_long_group(spark, k):
    """One group with 100 losing rows, from the worst: the k worst are paired, in order."""
    rows = [("e", "d", "p", 0, "SELECT 0", 1.0, True, True, True, "ok", 0)]
    rows += [("e", "d", "p", i, f"SELECT {i}", -i / 100, True, False, False, "ok", i) for i in range(1, 101)]
    res = build_preferences(spark.createDataFrame(rows, ROLLOUT_DDL), PreferenceConfig(max_pairs_per_example=k))
    got = [(r["pair_idx"], r["meta"]["rejected_candidate_id"]) for r in res.ordered_pairs.orderBy("pair_idx").collect()]
    assert got == [(n, 101 - n) for n in range(1, min(k, 100) + 1)]


def test_walks_move_neither_prompts_nor_sql_and_start_no_job(spark):
    from pyspark.sql import functions as F

    from rewardloom.operators import preferences as P

    rows = spark.range(5000).select(
        F.concat(F.lit("e"), (F.col("id") % 7 * (F.col("id") % 3)).cast("string")).alias("id"), F.lit("d").alias("db_id"),
        F.repeat(F.lit("p"), 500).alias("prompt"), (F.col("id") % 11 / 10).alias("reward"), F.col("id").alias("candidate_id"),
        F.lit(True).alias("valid"), F.lit(True).alias("exec_ok"), F.lit(True).alias("matched"), F.lit("SELECT 1").alias("candidate_sql"), F.col("id").alias("ord"),
    )
    group = "preference-planning"
    spark.sparkContext.setJobGroup(group, group)
    out = P.build_preferences(rows, P.PreferenceConfig(max_pairs_per_example=4, max_examples=3))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    whole = P.prepare_rollouts(rows).withColumn("_elig", F.lit(True)).withColumn("_key_ok", F.lit(True)).withColumn("_g1", F.xxhash64("id")).withColumn("_g2", F.xxhash64("db_id"))
    plan = P.worst_of_groups(whole, 5)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line or "WindowGroupLimit" in line]
    assert sum("Partial" in line for line in exchanged) == 2 and "prompt" not in plan.split("Range")[0] and "candidate_sql" not in plan
    worst = P.worst_of_groups(whole, 5).groupBy("_g1").agg(F.count("*").alias("n"), F.max("pair_idx").alias("top")).collect()
    assert worst and all(r.n == 5 == r.top for r in worst)
    assert out.pairs.count() == 3 * 4 and "prompt" not in out.stats._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
