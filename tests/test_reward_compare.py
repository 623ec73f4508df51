"""A1 A2 M1-M3 U2 Q5 P7 P8 A4."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rewardloom.operators.compare import compare_result_sets, result_rows
from rewardloom.operators.reward import RewardConfig, reward
from rewardloom.operators.rollouts import assemble_rollouts, gold_gate, rollout_stats, score_candidates


def test_bag_compare_is_order_insensitive_and_duplicate_sensitive(spark):
    gold = spark.createDataFrame([("k1", ["1", "a"]), ("k1", ["2", "b"]), ("k2", ["1", "a"]), ("k3", ["x"])], "query_key string, cells array<string>")
    cand = spark.createDataFrame([("k1", ["2", "b"]), ("k1", ["1", "a"]), ("k2", ["1", "a"]), ("k2", ["1", "a"]), ("k4", ["y"])], "query_key string, cells array<string>")
    got = {r.query_key: r.matched for r in compare_result_sets(gold, cand).collect()}
    assert got == {"k1": True, "k2": False, "k3": False, "k4": False}


def test_bag_compare_random_against_sorted_lists(spark):
    rng = random.Random(3)
    g_rows, c_rows, want = [], [], {}
    for k in range(200):
        rows = [[rng.choice("ab"), str(rng.randint(0, 2))] for _ in range(rng.randint(0, 5))]
        cand = list(rows)
        op = rng.randint(0, 3)
        if op == 1 and cand:
            cand.pop(rng.randrange(len(cand)))
        elif op == 2 and cand:
            cand.append(cand[0])
        elif op == 3:
            rng.shuffle(cand)
        g_rows += [(f"k{k}", r) for r in rows]
        c_rows += [(f"k{k}", r) for r in cand]
        want[f"k{k}"] = sorted(map(tuple, rows)) == sorted(map(tuple, cand))
    gold = spark.createDataFrame(g_rows, "query_key string, cells array<string>")
    cand_df = spark.createDataFrame(c_rows, "query_key string, cells array<string>")
    got = {r.query_key: r.matched for r in compare_result_sets(gold, cand_df).collect()}
    for k, v in want.items():
        assert got.get(k, True) == v, k  # keys with no rows on either side are absent


def test_row_normalization(spark):
    """A2: NULL -> 'NULL', booleans as 1/0, column names ignored."""
    df = spark.createDataFrame([("b", None, True), ("a", 1, False)], "x string, y int, z boolean")
    cells = sorted(r.cells for r in result_rows(df, "q").collect())
    assert cells == [["a", "1", "0"], ["b", "NULL", "1"]]


def test_reward_config_ignores_unknown_keys():
    cfg = RewardConfig.from_dict({"match": 1.5, "nope": 3})
    assert cfg.match == 1.5


def test_reward_map_and_penalties(spark):
    """base rewards, shaping on SELECT * FROM users (4 tokens, ok, 20 ms)."""
    cfg = RewardConfig(match=1.5, exec_mismatch=0.25, syntax_error=-0.3, unknown_error=-0.9)
    df = spark.createDataFrame(
        [("match", "SELECT 1", True, 0), ("exec_mismatch", "SELECT 1", True, 0), ("syntax_error", "SELECT", False, 0),
         ("gold_failed", "SELECT 1", True, 0)],
        "reason string, sql string, ok boolean, ms long",
    )
    got = [r[0] for r in df.select(reward("reason", "sql", "ok", "ms", cfg)).collect()]
    assert got == [1.5, 0.25, -0.3, -0.9]
    pen = RewardConfig(match=0.0, length_penalty_weight=0.1, select_star_penalty=0.5, slow_query_ms=10, slow_query_penalty=0.7)
    one = spark.createDataFrame([("match", "SELECT * FROM users", True, 20)], "reason string, sql string, ok boolean, ms long")
    val = one.select(reward("reason", "sql", "ok", "ms", pen)).first()[0]
    assert abs(val - (-1.6)) < 1e-9
    lit = RewardConfig(match=0.0, length_penalty_weight=0.1, select_star_penalty=0.5, slow_query_ms=10,
                       slow_query_penalty=0.7, star_pattern="literal")
    assert abs(one.select(reward("reason", "sql", "ok", "ms", lit)).first()[0] - (-1.1)) < 1e-9


def test_score_candidates_end_to_end(spark):
    runs = spark.createDataFrame(
        [("g1", True, "ok", "", 2, False, 5), ("c1", True, "ok", "", 2, False, 5), ("c2", True, "ok", "", 1, False, 5),
         ("c3", False, "syntax_error", "x", 0, False, 1), ("g2", False, "runtime_error", "y", 0, False, 1)],
        "query_key string, ok boolean, error_type string, error_message string, row_count long, truncated boolean, elapsed_ms long",
    )
    rows = spark.createDataFrame(
        [("g1", ["1"]), ("g1", ["2"]), ("c1", ["2"]), ("c1", ["1"]), ("c2", ["1"])], "query_key string, cells array<string>"
    )
    cands = spark.createDataFrame(
        [("p1", "g1", "c1", "SELECT a"), ("p2", "g1", "c2", "SELECT b"), ("p3", "g1", "c3", "SELEC"), ("p4", "g2", "c1", "SELECT a")],
        "pair_id string, gold_key string, cand_key string, candidate_sql string",
    )
    got = {r.pair_id: (r.reason, r.matched, r.reward) for r in score_candidates(cands, runs, rows).collect()}
    assert got == {
        "p1": ("match", True, 1.0), "p2": ("exec_mismatch", False, 0.1),
        "p3": ("syntax_error", False, -0.2), "p4": ("gold_failed", False, -0.6),
    }


def test_gold_gate_assembly_and_stats(spark):
    runs = spark.createDataFrame(
        [("g1", True, 2), ("g2", True, 0), ("g3", False, 0)], "query_key string, ok boolean, row_count long"
    )
    ex = spark.createDataFrame([("e1", "g1"), ("e2", "g2"), ("e3", "g3"), ("e4", "g9")], "id string, gold_key string")
    kept, counts = gold_gate(ex, runs)
    assert [r.id for r in kept.collect()] == ["e1"]
    c = counts.first()
    assert (c.skipped_gold_failed, c.skipped_empty_gold, c.examples_kept) == (2, 1, 1)
    kept2, _ = gold_gate(ex, runs, keep_empty_gold=True)
    assert sorted(r.id for r in kept2.collect()) == ["e1", "e2"]
    scored = spark.createDataFrame(
        [("e1", 0, "db", "p", "g", "SELECT 1", 1.0, True, True, "ok", "", 3, False, "match"),
         ("e1", 1, "db", "p", "g", "DROP", -1.0, False, False, "forbidden", "m", 0, False, "forbidden"),
         ("e2", 0, "db", "p", "g", "SELECT", -0.2, False, False, "syntax_error", "m", 0, False, "syntax_error")],
        "id string, candidate_id int, db_id string, prompt string, gold_sql string, candidate_sql string, reward double, "
        "matched boolean, exec_ok boolean, error_type string, error_message string, exec_time_ms long, truncated boolean, reason string",
    )
    roll = assemble_rollouts(scored)
    assert [r.valid for r in roll.orderBy("id", "candidate_id").collect()] == [True, False, True]
    s = rollout_stats(roll).first()
    assert (s.candidates_kept, s.matches, s.examples_done, s.examples_with_match) == (3, 1, 2, 1)
    assert abs(s.match_rate - 1 / 3) < 1e-12 and s.example_match_rate == 0.5
    empty = rollout_stats(roll.filter(F.lit(False))).first()
    assert empty.match_rate == 0.0 and empty.candidates_kept == 0


def test_eval_rows_missing_database_is_eval_error(spark):
    """M4: scoring that could not run becomes eval_error with reward 0.0."""
    from rewardloom.operators.evaluate import eval_rows

    scored = spark.createDataFrame(
        [("p1", "SELECT a FROM t", True, "match", 1.0, "ok", ""),
         ("p2", "SELECT a FROM t JOIN u ON 1=1", False, "gold_failed", -0.6, "unknown_error", "Database not found: x")],
        "pair_id string, gold_sql string, matched boolean, reason string, reward double, error_type string, error_message string",
    )
    got = {r.pair_id: r for r in eval_rows(scored, "sft").collect()}
    assert got["p1"].reason == "match" and got["p1"].difficulty == "easy" and got["p1"].label == "sft"
    p2 = got["p2"]
    assert (p2.reason, p2.reward, p2.matched, p2.gold_failed, p2.error_type) == ("eval_error", 0.0, False, False, "unknown_error")


def test_rename_and_example_ids(spark):
    """P1 and P4."""
    from rewardloom.operators.rollouts import example_id
    from rewardloom.operators.schema_text import rename_raw_examples

    raw = spark.createDataFrame([("q?", "SELECT 1", "db", 7)], "question string, query string, db_id string, ord long")
    ex = rename_raw_examples(raw)
    assert ex.columns[:3] == ["question", "sql", "db_id"]
    assert ex.select(example_id("train", "ord")).first()[0] == "train-000007"


def test_score_sql_pairs_f6(spark, users_orders):
    """F6 through real guarded runs on the F1 database."""
    from rewardloom.operators.guard import GuardConfig
    from rewardloom.operators.rollouts import score_sql_pairs

    def catalog(db_id):
        if db_id != "test_db":
            raise FileNotFoundError(db_id)
        return users_orders

    pairs = spark.createDataFrame(
        [("m", "test_db", "SELECT COUNT(*) FROM users", "SELECT COUNT(*) FROM users"),
         ("x", "test_db", "SELECT COUNT(*) FROM users", "SELECT COUNT(*) FROM orders WHERE amount > 100"),
         ("g", "test_db", "SELECT FROM missing", "SELECT COUNT(*) FROM users"),
         ("s", "test_db", "SELECT COUNT(*) FROM users", "SELECT FROM users"),
         ("n", "test_db", "SELECT COUNT(*) FROM users", None),
         ("o", "test_db", "SELECT id, name FROM users", "SELECT name, id FROM users")],
        "pair_id string, db_id string, gold_sql string, candidate_sql string",
    )
    cfg = RewardConfig(match=1.5, exec_mismatch=0.25, syntax_error=-0.3, unknown_error=-0.9)
    scored, run = score_sql_pairs(spark, pairs, catalog, cfg, GuardConfig(timeout_s=120))
    got = {r.pair_id: (r.reason, r.reward, r.matched) for r in scored.collect()}
    assert got["m"] == ("match", 1.5, True)
    assert got["x"] == ("exec_mismatch", 0.25, False)
    assert got["g"] == ("gold_failed", -0.9, False)
    assert got["s"] == ("syntax_error", -0.3, False)
    assert got["n"] == ("forbidden", -1.0, False)
    assert got["o"][0] == "exec_mismatch"  # column order matters
    assert run.runs.count() == 7  # distinct queries run once each
