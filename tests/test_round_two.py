"""Typed JSONL, isolation, timeouts, positional cells, unknown tokens, whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import tokens as TK
from rewardloom.operators.compare import result_rows
from rewardloom.operators.guard import GuardConfig, QueryRunner
from rewardloom.operators.reward import RewardConfig
from rewardloom.operators.schema_text import attach_schemas
from rewardloom.plans import bindings as B
from rewardloom.sources import io as IO

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("line", ['{"a": "7"}', "123", "[1]", '{"a": 1', '{"a": {"b": 1}}'])
def test_jsonl_mistyped_lines_raise_with_their_number(spark, tmp_path, line):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n' + line + '\n{"a": 2}\n')
    with pytest.raises(ValueError, match="line 3"):
        IO.read_jsonl(spark, str(path), spark.createDataFrame([], "a long").schema)
    kept = IO.read_jsonl(spark, str(path), spark.createDataFrame([], "a long").schema, mode="PERMISSIVE").orderBy("line_no").collect()
    assert [(r["a"], r["line_no"], r["ord"], r["_corrupt_record"]) for r in kept] == [(1, 1, 0, None), (None, 3, 1, line), (2, 4, 2, None)]


def test_jsonl_ordinals_over_files_without_moving_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.jsonl").write_text("".join("\n" if i % 5 == 4 else f'{{"a": {k * 100 + i}}}\n' for i in range(100)))
    rows = IO.read_jsonl(spark, str(tmp_path), spark.createDataFrame([], "a long").schema)
    got = rows.orderBy("ord").collect()
    want = [k * 100 + i for k in range(3) for i in range(100) if i % 5 != 4]
    assert [(r["a"], r["ord"], r["line_no"]) for r in got] == [(a, n, a + 1) for n, a in enumerate(want)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_queries_stay_in_their_database(spark, users_orders):
    spark.range(2).createOrReplaceGlobalTempView("foreign_view")
    texts = {
        "SELECT a.name, b.name FROM users a JOIN users b ON a.id = b.id": "ok",
        "SELECT count(*), count(*) FROM users": "ok",
        "WITH q AS (SELECT * FROM users) SELECT name AS `x``y` FROM q": "ok",
        "SELECT * FROM global_temp.foreign_view": "runtime_error",
        "SELECT (SELECT max(id) FROM global_temp.foreign_view) FROM users": "runtime_error",
        "SELECT * FROM elsewhere": "runtime_error",
    }
    run = QueryRunner(spark, lambda _: users_orders).run(spark.createDataFrame([("d", t) for t in texts], "db_id string, sql string"))
    assert {r["sql"]: r["error_type"] for r in run.runs.collect()} == texts
    cells = {tuple(r["cells"]) for r in run.result_rows.collect()}
    assert ("3", "3") in cells and ("Alice", "Alice") in cells


def test_a_limit_that_passes_before_any_job_starts_is_a_timeout(spark, users_orders):
    sql = "SELECT count(*) FROM users a CROSS JOIN (SELECT explode(sequence(1, 20000))) b CROSS JOIN (SELECT explode(sequence(1, 20000))) c"
    run = QueryRunner(spark, lambda _: users_orders, GuardConfig(timeout_s=0.005)).run(spark.createDataFrame([("d", sql)], "db_id string, sql string"))
    assert [r["error_type"] for r in run.runs.collect()] == ["timeout"]


def test_cells_by_position_and_exact_wide_decimals(spark):
    twice = spark.sql("SELECT 1 AS a, 2 AS a")
    assert [r["cells"] for r in result_rows(twice, "k").collect()] == [["1", "2"]]
    wide = spark.sql("SELECT CAST('12345678901234567890.1' AS DECIMAL(38,1)) x, CAST('12345678901234567890.2' AS DECIMAL(38,1)) y, CAST('1.50' AS DECIMAL(38,2)) z")
    x, y, z = result_rows(wide, "k").first()["cells"]
    assert x != y and z == "1.5"


def test_unknown_tokens_keep_their_places(spark):
    vocab = spark.createDataFrame([("a", 1, 2)], "token string, id int, count long")
    rows = TK.token_ids(spark.createDataFrame([(1, "a b a c")], "id int, t string"), "id", ["t"], vocabulary=vocab)
    assert rows.first()["t_ids"] == [1, TK.UNKNOWN_ID, 1, TK.UNKNOWN_ID]


def test_examples_reach_databases_of_all_blocks(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    ex = B.examples_from_conversations(spark.read.parquet(f"{SF}/conversations.parquet"), part)
    blocks = {r[0] for r in ex.select(F.substring_index("db_id", "/", -1)).distinct().collect()}
    every = {str(r[0]) for r in part.select(F.floor(F.col("p_partkey") / 200)).distinct().collect()}
    assert len(blocks) >= len(every) - 1 > 2


def test_missing_database_raises_whatever_is_read(spark):
    ex = spark.createDataFrame([("q", "no_such")], "question string, db_id string")
    schemas = spark.createDataFrame([("d", "s")], "db_id string, schema string")
    with pytest.raises(Exception, match="no_such"):
        attach_schemas(ex, schemas).select("question").collect()
    with pytest.raises(Exception, match="no_such"):
        attach_schemas(ex, schemas).count()


def test_reward_settings_are_converted_or_refused():
    cfg = RewardConfig.from_dict({"match": "2", "slow_query_ms": 5, "something_else": 1})
    assert cfg.match == 2.0 and cfg.slow_query_ms == 5 and cfg.timeout == RewardConfig().timeout
    with pytest.raises(ValueError, match="slow_query_ms"):
        RewardConfig.from_dict({"slow_query_ms": "soon"})
