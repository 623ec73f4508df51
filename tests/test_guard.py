"""Q1-Q4 K2 (F5): guarded runs."""

from __future__ import annotations

import pytest

from rewardloom.operators.guard import GuardConfig, QueryRunner, guarded_sql


def _catalog(views):
    def resolve(db_id):
        if db_id != "test_db":
            raise FileNotFoundError(db_id)
        return views

    return resolve


def test_runs_and_error_types(spark, users_orders):
    qs = spark.createDataFrame(
        [("test_db", "SELECT name FROM users ORDER BY id"), ("test_db", "DROP TABLE users"),
         ("test_db", "SELECT FROM users"), ("test_db", "SELECT nope FROM users"),
         ("test_db", "SELECT java_method('java.lang.System', 'exit', 0)"), ("nope_db", "SELECT 1")],
        "db_id string, sql string",
    )
    res = QueryRunner(spark, _catalog(users_orders), GuardConfig(timeout_s=120)).run(qs)
    by_sql = {r.sql: r for r in res.runs.collect()}
    ok = by_sql["SELECT name FROM users ORDER BY id"]
    assert ok.ok and ok.error_type == "ok" and ok.row_count == 3 and not ok.truncated
    assert by_sql["DROP TABLE users"].error_type == "forbidden"
    assert by_sql["SELECT FROM users"].error_type == "syntax_error"
    assert by_sql["SELECT nope FROM users"].error_type == "runtime_error"
    assert by_sql["SELECT java_method('java.lang.System', 'exit', 0)"].error_type == "forbidden"
    assert by_sql["SELECT 1"].error_type == "unknown_error"
    names = sorted(r.cells[0] for r in res.result_rows.collect())
    assert names == ["Alice", "Bob", "Carol"]


def test_timeout_cancels_the_job(spark, users_orders):
    views = dict(users_orders, big=spark.range(0, 300000).toDF("x"))
    qs = spark.createDataFrame([("test_db", "SELECT count(*) FROM big a CROSS JOIN big b WHERE a.x + b.x < 0")], "db_id string, sql string")
    res = QueryRunner(spark, _catalog(views), GuardConfig(timeout_s=3)).run(qs)
    r = res.runs.first()
    assert r.error_type == "timeout" and r.elapsed_ms < 60000


def test_row_cap_is_deterministic(spark, users_orders):
    qs = spark.createDataFrame([("test_db", "SELECT name FROM users")], "db_id string, sql string")
    res = QueryRunner(spark, _catalog(users_orders), GuardConfig(max_rows=2)).run(qs)
    r = res.runs.first()
    assert r.truncated and r.row_count == 2
    assert sorted(x.cells[0] for x in res.result_rows.collect()) == ["Alice", "Bob"]


def test_guarded_sql_rejects_and_runs(spark, users_orders):
    with pytest.raises(PermissionError):
        guarded_sql(spark, users_orders, "SELECT * FROM users; DROP TABLE users")
    df = guarded_sql(spark, users_orders, "SELECT count(*) AS n FROM orders WHERE amount > 100")
    assert df.first().n == 1


def test_parquet_catalog_resolves_folders(spark, users_orders, tmp_path):
    """db_id = folder of parquet tables; a missing one is an unknown_error run."""
    from rewardloom.operators.guard import parquet_catalog

    root = tmp_path / "dbs"
    users_orders["users"].write.parquet(str(root / "test_db" / "users.parquet"))
    users_orders["orders"].write.parquet(str(root / "test_db" / "orders"))
    cat = parquet_catalog(str(root), spark)
    assert sorted(cat("test_db")) == ["orders", "users"]
    qs = spark.createDataFrame(
        [("test_db", "SELECT u.name FROM users u JOIN orders o ON o.user_id = u.id"), ("gone", "SELECT 1")],
        "db_id string, sql string",
    )
    runs = {r.db_id: r for r in QueryRunner(spark, cat, GuardConfig(timeout_s=120)).run(qs).runs.collect()}
    assert runs["test_db"].ok and runs["test_db"].row_count == 3
    assert runs["gone"].error_type == "unknown_error" and runs["gone"].error_message.startswith("Database not found")
