"""Many queries in one job; Q4: what a query may hold, told by its plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import guard
from rewardloom.operators.guard import GuardConfig, QueryRunner, guarded_sql


def runner(spark, views, **how):
    return QueryRunner(spark, lambda _: views, GuardConfig(**{"timeout_s": 300, **how}))


def table(spark, texts, db="d"):
    return spark.createDataFrame([(db, t) for t in texts], "db_id string, sql string")


def test_many_queries_in_a_handful_of_jobs(spark, users_orders):
    texts = [f"SELECT id, name FROM users WHERE id <= {k % 4} AND age > {k}" for k in range(150)]
    run = runner(spark, users_orders, batch_size=50)
    out = run.run(table(spark, texts))
    assert run.jobs == 3
    got = {r.sql: (r.ok, r.row_count) for r in out.runs.collect()}
    ages = {1: 30, 2: 25, 3: 35}
    want = {t: (True, sum(i <= k % 4 and a > k for i, a in ages.items())) for k, t in enumerate(texts)}
    assert got == want
    assert out.result_rows.count() == sum(n for _, n in want.values())


def test_a_failing_query_is_isolated_by_halves(spark, users_orders):
    good = [f"SELECT id + {k} FROM users" for k in range(31)]
    bad = "SELECT CAST(name AS INT) FROM users"
    run = runner(spark, users_orders, batch_size=32, max_workers=1)
    out = run.run(table(spark, [*good, bad]))
    got = {r.sql: r.error_type for r in out.runs.collect()}
    assert got == {**dict.fromkeys(good, "ok"), bad: "runtime_error"}
    assert run.jobs == 1 + 2 * 5  # both halves of 32, 16, 8, 4 and 2
    assert out.result_rows.count() == 3 * 31  # nothing of a batch that failed counts


def test_a_slow_query_does_not_spoil_its_batch(spark, users_orders):
    views = dict(users_orders, big=spark.range(0, 300000).toDF("x"))
    slow = "SELECT count(*) FROM big a CROSS JOIN big b WHERE a.x + b.x < 0"
    texts = ["SELECT name FROM users", "SELECT amount FROM orders", slow]
    out = runner(spark, views, timeout_s=8).run(table(spark, texts))
    assert {r.sql: r.error_type for r in out.runs.collect()} == {texts[0]: "ok", texts[1]: "ok", slow: "timeout"}
    assert out.result_rows.count() == 6


def test_batches_give_what_single_runs_give(spark, users_orders):
    texts = [
        "SELECT * FROM users", "SELECT u.name, o.amount FROM users u JOIN orders o ON u.id = o.user_id", "SELECT FROM users",
        "SELECT nope FROM users", "SELECT 1 / (id - id) FROM users", "SELECT name FROM users ORDER BY age DESC LIMIT 2", "SELECT * FROM users WHERE id < 0",
    ]
    seen = []
    for how in ({"batch_size": 1}, {}, {"max_rows": 2}, {"max_rows": 2, "batch_size": 1}):
        out = runner(spark, users_orders, **how).run(table(spark, texts))
        runs = {r.query_key: r for r in out.runs.collect()}
        rows = sorted((runs[r.query_key].sql, tuple(r.cells)) for r in out.result_rows.collect())
        seen.append(({r.sql: (r.error_type, r.row_count, r.truncated) for r in runs.values()}, rows))
    assert seen[0] == seen[1] and seen[2] == seen[3]
    assert seen[0][0][texts[4]][0] == "runtime_error" and seen[2][0][texts[0]] == ("ok", 2, True)


def test_databases_are_told_apart_and_closed(spark, users_orders):
    opened = []

    def catalog(db_id):
        opened.append(db_id)
        if db_id == "gone":
            raise FileNotFoundError(db_id)
        if db_id == "broken":
            raise RuntimeError("no access")
        return {"t": spark.createDataFrame([(db_id,)], "v string")}

    texts = [(db, "SELECT v FROM t") for db in ("a", "b", "gone", "broken")] + [("a", "SELECT count(*) FROM t"), (None, "SELECT 1")]
    run = QueryRunner(spark, catalog, GuardConfig(timeout_s=300))
    out = run.run(spark.createDataFrame(texts, "db_id string, sql string"))
    cells = {(r.db_id, r.sql): r.cells for r in out.result_rows.join(out.runs, "query_key").collect()}
    assert cells == {("a", texts[0][1]): ["a"], ("b", texts[0][1]): ["b"], ("a", "SELECT count(*) FROM t"): ["1"], (None, "SELECT 1"): ["1"]}
    assert sorted(map(str, opened)) == ["None", "a", "b", "broken", "gone"]
    errors = {r.db_id: r.error_message for r in out.runs.filter("not ok").collect()}
    assert errors["gone"].startswith("Database not found") and "no access" in errors["broken"]
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.endswith("_t")]


def test_a_null_database_is_not_the_text_of_another(spark, users_orders):
    keyed = runner(spark, users_orders).run(spark.createDataFrame([("SELECT 1", None), (None, "SELECT 1")], "db_id string, sql string"))
    assert keyed.queries.select("query_key").distinct().count() == 2


FOREIGN = [
    "SELECT * FROM IDENTIFIER('global_temp.secret_view')",
    "SELECT * FROM IDENTIFIER('global_temp' || '.secret_view')",
    "SELECT IDENTIFIER('ab' || 's')(id) FROM users",
    "SELECT * FROM users WHERE EXISTS (SELECT 1 FROM IDENTIFIER('global_temp.secret_view'))",
    "SELECT * FROM global_temp.secret_view",
    "SELECT * FROM users u JOIN LATERAL (SELECT * FROM global_temp.secret_view s WHERE s.id = u.id)",
    "WITH secret AS (SELECT * FROM stored_table) SELECT * FROM secret",
    "WITH stored_table AS (SELECT * FROM stored_table) SELECT * FROM stored_table",
    "SELECT (WITH x AS (SELECT 1) SELECT * FROM x), y.* FROM (SELECT * FROM x) y",
    "SELECT * FROM parquet.`/etc`",
    "SELECT * FROM stored_table TIMESTAMP AS OF '2020-01-01'",
    "SELECT id FROM users UNION ALL SELECT id FROM stored_table",
    "SELECT * FROM VALUES (1) t(id) WHERE id IN (SELECT id FROM default.stored_table)",
]
OWN = [
    "WITH " + ", ".join(f"q{k} AS (SELECT id + {k} AS id FROM {'users' if k == 0 else f'q{k - 1}'})" for k in range(30)) + " SELECT * FROM q29",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r",
    "WITH users AS (SELECT 7 AS id) SELECT id FROM users UNION ALL SELECT id FROM users UNION ALL SELECT 1",
    "WITH a AS (SELECT 1 AS id), b AS (WITH a AS (SELECT 2 AS id) SELECT * FROM a) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 3",
    "SELECT transform(array(id), x -> x + 1) FROM users",
    "SELECT u.id, (SELECT max(o.amount) FROM orders o WHERE o.user_id = u.id) FROM Users u",
    "SELECT * FROM range(3)",
    "SELECT id, row_number() OVER w FROM users WINDOW w AS (ORDER BY id)",
    "SELECT x FROM users LATERAL VIEW explode(array(1)) t AS x",
    "SELECT * FROM (SELECT id, age FROM users) PIVOT (sum(age) FOR id IN (1, 2)) UNION ALL SELECT 1, 2 UNION ALL SELECT 1, 2",
    "SELECT DISTINCT id FROM users INTERSECT SELECT id FROM users",
    "SELECT name FROM users |> WHERE true",
    "SELECT count(*) FROM users GROUP BY GROUPING SETS ((id), ()) HAVING count(*) = 1",
]


@pytest.fixture(scope="module")
def foreign(spark):
    spark.range(3).createOrReplaceGlobalTempView("secret_view")
    yield
    spark.catalog.dropGlobalTempView("secret_view")


def test_foreign_relations_however_named(spark, users_orders, foreign):
    out = runner(spark, users_orders).run(table(spark, FOREIGN))
    assert {r.sql: r.error_type for r in out.runs.collect()} == dict.fromkeys(FOREIGN, "runtime_error")
    assert out.result_rows.isEmpty()


def test_queries_within_their_database_run(spark, users_orders):
    out = runner(spark, users_orders).run(table(spark, OWN))
    got = {r.sql: (r.error_type, r.row_count) for r in out.runs.collect()}
    assert got == dict.fromkeys(OWN, ("ok", 3))


def test_scripts_and_computed_function_names_are_refused(spark, users_orders):
    texts = ["SELECT TRANSFORM(id) USING 'cat' FROM users", "SELECT reflect('java.lang.System', 'exit', 0)"]
    out = runner(spark, users_orders).run(table(spark, [*texts, "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'nanoTime')"]))
    assert sorted(r.error_type for r in out.runs.collect()) == ["forbidden", "forbidden", "runtime_error"]
    with pytest.raises(guard.ForeignRelation):
        guarded_sql(spark, users_orders, FOREIGN[1])


def test_the_analysed_plan_is_checked_by_itself(spark, users_orders, foreign):
    """Should a name slip through the first check, the second refuses what it led to."""
    child, shared = guard.child_session(spark, users_orders)
    try:
        for sql in ("SELECT * FROM global_temp.secret_view", "SELECT 1 FROM users WHERE id IN (SELECT id FROM global_temp.secret_view)"):
            with pytest.raises(guard.ForeignRelation):
                guard.check_analysed(child.sql(sql)._jdf.queryExecution().analyzed(), frozenset({"users", "secret_view"}))
        plan = spark.createDataFrame([(1,)], "a int").filter(F.col("a") > 0)._jdf.queryExecution().analyzed()
        with pytest.raises(guard.ForeignRelation):
            guard.check_analysed(plan, frozenset())
        guard.check_analysed(child.sql("SELECT * FROM users, orders")._jdf.queryExecution().analyzed(), frozenset({"users", "orders"}))
    finally:
        for name in shared:
            spark.catalog.dropGlobalTempView(name)


def test_bad_settings_are_refused():
    for bad in ({"batch_size": 0}, {"timeout_s": 0}, {"max_rows": 0}, {"max_workers": 0}):
        with pytest.raises(ValueError):
            GuardConfig(**bad)
