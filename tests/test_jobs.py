"""E1-E3 end to end on the F1 database."""

from __future__ import annotations

import json
import os
import tempfile

from rewardloom.jobs import evaluate_job, preferences_job, rollouts_job
from rewardloom.operators.guard import GuardConfig

SCHEMA = "CREATE TABLE users (\n  id INTEGER PRIMARY KEY,\n  name TEXT NOT NULL,\n  age INTEGER\n);"


def _catalog(views):
    def resolve(db_id):
        if db_id != "test_db":
            raise FileNotFoundError(db_id)
        return views

    return resolve


def _examples(spark):
    return spark.createDataFrame(
        [(0, "How many users?", "SELECT COUNT(*) FROM users", "test_db", SCHEMA),
         (1, "Big orders?", "SELECT order_id FROM orders WHERE amount > 100", "test_db", SCHEMA),
         (2, "Broken gold", "SELECT FROM users", "test_db", SCHEMA),
         (3, "", "SELECT 1", "test_db", SCHEMA),
         (4, "Old users?", "SELECT name FROM users WHERE age > 100", "test_db", SCHEMA)],
        "ord long, question string, sql string, db_id string, schema string",
    )


def test_rollouts_then_preferences(spark, users_orders):
    out = tempfile.mkdtemp(prefix="rl-jobs-")
    gens = spark.createDataFrame(
        [(0, 0, "```sql\nSELECT count(*) FROM users\n```"), (0, 1, "SELECT * FROM users"), (0, 2, "DROP TABLE users"),
         (1, 0, "SELECT order_id FROM orders WHERE amount > 100;<|im_end|>"), (1, 1, "SELECT FROM orders"),
         (2, 0, "SELECT 1"), (4, 0, "SELECT name FROM users")],
        "ord long, candidate_id long, text string",
    )
    rollouts, stats = rollouts_job(spark, _examples(spark), gens, _catalog(users_orders), out, guard_cfg=GuardConfig(timeout_s=120))
    got = {(r.id, r.candidate_id): (r.reason, r.valid, r.reward) for r in rollouts.collect()}
    assert got == {
        ("train-000000", 0): ("match", True, 1.0),
        ("train-000000", 1): ("exec_mismatch", True, 0.1),
        ("train-000000", 2): ("forbidden", False, -1.0),
        ("train-000001", 0): ("match", True, 1.0),
        ("train-000001", 1): ("syntax_error", True, -0.2),
    }
    meta_dir = os.path.join(out, "run_meta")
    meta = json.loads(open(os.path.join(meta_dir, [f for f in os.listdir(meta_dir) if f.startswith("part-")][0])).read())
    assert (meta["candidates_kept"], meta["matches"], meta["examples_done"]) == (5, 2, 2)
    assert (meta["skipped_gold_failed"], meta["skipped_empty_gold"]) == (1, 1)
    prefs = preferences_job(spark, os.path.join(out, "rollouts"), os.path.join(out, "prefs"))
    pairs = sorted((r.id, r.meta.chosen_candidate_id, r.meta.rejected_candidate_id) for r in prefs.collect())
    assert pairs == [("train-000000", 0, 1), ("train-000001", 0, 1)]


def test_evaluate_two_models(spark, users_orders):
    out = tempfile.mkdtemp(prefix="rl-eval-")
    preds = spark.createDataFrame(
        [("base", 0, "SELECT name FROM users"), ("base", 1, "nonsense"), ("base", 2, "SELECT 1"),
         ("sft", 0, "SELECT COUNT(*) FROM users"), ("sft", 1, "SELECT order_id FROM orders WHERE amount > 100"),
         ("sft", 2, "SELECT 1")],
        "label string, ord long, text string",
    )
    results = evaluate_job(spark, _examples(spark), preds, _catalog(users_orders), out, base_label="base",
                           guard_cfg=GuardConfig(timeout_s=120))
    by = {(r.label, r.example_idx): r for r in results.collect()}
    assert by[("sft", 0)].matched and by[("sft", 1)].matched and not by[("base", 0)].matched
    assert by[("base", 1)].reason == "forbidden" and by[("sft", 2)].reason == "gold_failed"
    assert by[("sft", 1)].difficulty == "easy"
    ranking = {r.label: r.rank for r in spark.read.json(os.path.join(out, "ranking")).collect()}
    assert ranking == {"sft": 1, "base": 2}
