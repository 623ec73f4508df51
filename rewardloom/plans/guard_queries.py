"""Guarded runs on the driver's tables.

Each G query is plain SQL text that Spark and DuckDB read the same way; it is
validated and run in a child session that sees the driver's tables as views.
``guarded_runs`` runs a whole table of SQL texts (the G queries plus
forbidden, malformed and failing ones) through the batch runner and reports
one status row per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.evaluate import eval_rows
from rewardloom.operators.guard import GuardConfig, QueryRunner, child_session, guarded_sql, tables_catalog
from rewardloom.operators.reward import RewardConfig
from rewardloom.operators.rollouts import score_sql_pairs
from rewardloom.plans import sqltext as S
from rewardloom.plans.bindings import TABLES, sql_str

# Query surface the reference names (G1-G7); texts are valid in both engines.
G_QUERIES = {
    "g1_scan_filter": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders "
    "WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'",
    "g1_select_star": "SELECT * FROM nation WHERE n_regionkey = 1",
    "g2_join": "SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey "
    "WHERE c.c_acctbal > 5000",
    "g3_group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, "
    "max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "g4_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "g5_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "g5_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "g5_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10",
    "g6_subqueries": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN "
    "(SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))",
    "g6_from_subquery": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders "
    "GROUP BY o_custkey) t WHERE t.n >= 15",
    "g7_cte": "WITH big AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) "
    "SELECT count(*) AS n FROM lineitem l JOIN big b ON l.l_orderkey = b.o_orderkey",
}

# Inputs that must not run, or fail when they do: (sql, expected error type).
BAD_QUERIES = (
    ("DROP TABLE orders", "forbidden"),
    ("SELECT * FROM orders; DELETE FROM orders", "forbidden"),
    ("SELECT o_orderkey FROM orders -- all of them", "forbidden"),
    ("SELECT reflect('java.lang.Thread', 'sleep', 1000L)", "forbidden"),
    ("SELECT FROM orders", "syntax_error"),
    ("SELECT no_such_column FROM orders", "runtime_error"),
    ("SELECT * FROM parquet.`/etc`", "runtime_error"),
    ("SELECT * FROM IDENTIFIER('global_temp' || '.orders')", "runtime_error"),
    ("SELECT TRANSFORM (o_orderkey) USING 'cat' FROM orders", "forbidden"),
    ("SELECT raise_error('no') FROM nation", "runtime_error"),
    ("WITH orders AS (SELECT * FROM elsewhere) SELECT * FROM orders", "runtime_error"),
)


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in TABLES}


# One child session (and one set of shared views) per session and folder.
_CHILDREN: dict[tuple[str, int, str], SparkSession] = {}


def _child(spark: SparkSession, sf_dir: str) -> SparkSession:
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _CHILDREN:
        _CHILDREN[key], _ = child_session(spark, _views(spark, sf_dir))
    return _CHILDREN[key]


def _g(sql: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return guarded_sql(spark, dict.fromkeys(TABLES), sql, child=_child(spark, sf_dir))

    return q


def _batch_sql() -> list[tuple[str, str]]:
    rows = [(name, sql) for name, sql in G_QUERIES.items()]
    rows += [(f"bad_{i}", sql) for i, (sql, _) in enumerate(BAD_QUERIES)]
    return rows


def guarded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame([(n, "main", s) for n, s in _batch_sql()], "query_id string, db_id string, sql string")
    runner = QueryRunner(spark, tables_catalog(spark, sf_dir, TABLES), GuardConfig(timeout_s=300.0, max_workers=4))
    res = runner.run(queries)
    return res.queries.join(res.runs.select("query_key", "ok", "error_type", "row_count", "truncated"), "query_key").select(
        "query_id", "ok", "error_type", "row_count", "truncated"
    )


#: (pair, gold, candidate, reason): every outcome of a scored pair.
PAIRS = (
    ("same", "SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation", "match"),
    ("reordered", "SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey",
     "SELECT c_nationkey AS k, count(c_custkey) AS n FROM customer GROUP BY c_nationkey ORDER BY n", "match"),
    ("repeated_names", "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey",
     "SELECT a.n_name AS x, b.n_name AS y FROM nation b JOIN nation a ON a.n_regionkey = b.n_nationkey", "match"),
    ("sums", "SELECT l_suppkey, sum(l_extendedprice * l_discount) FROM lineitem GROUP BY l_suppkey",
     "SELECT l_suppkey, sum(l_discount * l_extendedprice) FROM lineitem GROUP BY l_suppkey", "match"),
    ("sums_in_another_order", "SELECT sum(l_extendedprice) FROM lineitem",
     "SELECT sum(s) FROM (SELECT sum(l_extendedprice) AS s FROM lineitem GROUP BY l_suppkey)", "match"),
    ("grouped_sums_in_another_order", "SELECT l_returnflag, sum(l_extendedprice), avg(l_quantity) FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, sum(s), sum(q) / sum(n) FROM (SELECT l_returnflag, sum(l_extendedprice) AS s, sum(l_quantity) AS q, "
     "count(*) AS n FROM lineitem GROUP BY l_returnflag, l_suppkey) GROUP BY l_returnflag", "match"),
    ("changed_cents", "SELECT sum(l_extendedprice) FROM lineitem", "SELECT sum(l_extendedprice) + 0.05 FROM lineitem", "exec_mismatch"),
    ("columns_swapped", "SELECT n_nationkey, n_regionkey FROM nation", "SELECT n_regionkey, n_nationkey FROM nation", "exec_mismatch"),
    ("multiplicity", "SELECT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders", "exec_mismatch"),
    ("empty_gold", "SELECT o_orderkey FROM orders WHERE o_orderkey < 0", "SELECT o_custkey FROM orders WHERE o_custkey < 0", "match"),
    ("syntax", "SELECT n_name FROM nation", "SELECT FROM nation", "syntax_error"),
    ("runtime", "SELECT n_name FROM nation", "SELECT no_such FROM nation", "runtime_error"),
    ("forbidden", "SELECT n_name FROM nation", "DELETE FROM nation", "forbidden"),
    ("gold_fails", "SELECT no_such FROM nation", "SELECT n_name FROM nation", "gold_failed"),
    ("missing_database", "SELECT n_name FROM nation", "SELECT n_name FROM nation", "gold_failed"),
)
_FAILED = {"syntax_error", "runtime_error", "forbidden"}


def _same_sql(pair: str, gold: str, candidate: str) -> str:
    """Whether DuckDB finds the same rows, sums up to rounding."""
    near = lambda *columns: " AND ".join(f"abs(g.{c} - c.{c}) <= 1e-12 * abs(g.{c})" for c in columns)
    if pair in ("sums_in_another_order", "changed_cents"):
        return f"(SELECT {near('a')} FROM ({gold}) g(a), ({candidate}) c(a))"
    if pair in ("sums", "grouped_sums_in_another_order"):
        names, checked = ("k, a", "a") if pair == "sums" else ("k, a, b", "ab")
        return (
            f"(SELECT bool_and(coalesce({near(*checked)}, FALSE)) FROM ({gold}) g({names}) FULL JOIN ({candidate}) c({names}) USING (k))"
        )
    return f"NOT EXISTS (({gold} EXCEPT ALL {_bare(candidate)}) UNION ALL ({_bare(candidate)} EXCEPT ALL {gold}))"


def _bare(sql: str) -> str:
    return f"SELECT * FROM ({sql})"


CAP = 5


def guarded_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results capped at ``max_rows``; a text given twice runs once."""
    rows = [(f"{n}-{k}", "main", s) for n, s in G_QUERIES.items() for k in (1, 2)]
    queries = spark.createDataFrame(rows, "query_id string, db_id string, sql string")
    runner = QueryRunner(spark, tables_catalog(spark, sf_dir, TABLES), GuardConfig(timeout_s=300.0, max_rows=CAP))
    res = runner.run(queries)
    sizes = res.result_rows.groupBy("query_key").agg(F.count("*").alias("stored"))
    runs = res.runs.select("query_key", "row_count", "truncated").join(sizes, "query_key", "left")
    return res.queries.join(runs, "query_key").select("query_id", "row_count", "truncated", F.coalesce("stored", F.lit(0)).alias("stored"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, "elsewhere" if p == "missing_database" else "main", g, c) for p, g, c, _ in PAIRS]
    pairs = spark.createDataFrame(rows, "pair_id string, db_id string, gold_sql string, candidate_sql string")
    scored, _ = score_sql_pairs(
        spark, pairs, tables_catalog(spark, sf_dir, TABLES), guard_cfg=GuardConfig(timeout_s=300.0, max_workers=4)
    )
    return scored


def scored_sql_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: guarded runs of gold and candidate SQL, bag comparison, reward."""
    return _scored(spark, sf_dir).select("pair_id", "matched", "reason", "reward", "exec_ok", "error_type")


def eval_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: evaluation rows from runs; what could not be scored is an ``eval_error`` of reward 0."""
    rows = eval_rows(_scored(spark, sf_dir), "model")
    return rows.select("label", "pair_id", "matched", "reason", "reward", "error_type", "gold_failed", "difficulty")


CELLS_SQL = (
    "SELECT o_orderkey, o_totalprice, o_totalprice > 150000 AS b, NULL AS b, o_orderstatus, "
    "CAST(o_totalprice AS DECIMAL(12,2)) AS d, o_orderkey FROM orders"
)


def guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the cells of a run whose columns have many types and repeated names."""
    runner = QueryRunner(spark, tables_catalog(spark, sf_dir, TABLES), GuardConfig(timeout_s=300.0))
    res = runner.run(spark.createDataFrame([("main", CELLS_SQL)], "db_id string, sql string"))
    c = [F.get("cells", F.lit(i)) for i in range(7)]
    return res.result_rows.select(
        c[0].cast("long").alias("key"), c[1].cast("double").alias("price"), c[2].alias("flag"), c[3].alias("nothing"),
        c[4].alias("status"), c[5].cast("double").alias("exact"), c[6].cast("long").alias("again"),
    )


def queries() -> dict:
    out = {f"guarded_{k}": _g(v) for k, v in G_QUERIES.items()}
    out["guarded_runs"] = guarded_runs
    out["scored_sql_pairs"] = scored_sql_pairs
    out["eval_from_runs"] = eval_from_runs
    out["guarded_cells"] = guarded_cells
    out["guarded_capped"] = guarded_capped
    return out


def oracle_sql() -> dict:
    out = {f"guarded_{k}": v for k, v in G_QUERIES.items()}
    parts = [
        f"SELECT {sql_str(n)} AS query_id, TRUE AS ok, 'ok' AS error_type, "
        f"(SELECT CAST(count(*) AS BIGINT) FROM ({s})) AS row_count, FALSE AS truncated"
        for n, s in G_QUERIES.items()
    ]
    parts += [
        f"SELECT {sql_str(f'bad_{i}')}, FALSE, {sql_str(et)}, CAST(0 AS BIGINT), FALSE"
        for i, (_, et) in enumerate(BAD_QUERIES)
    ]
    out["guarded_runs"] = " UNION ALL ".join(parts)
    capped = []
    for n, s in G_QUERIES.items():
        for k in (1, 2):
            capped.append(
                f"SELECT {sql_str(f'{n}-{k}')} AS query_id, least(c, {CAP}) AS row_count, c > {CAP} AS truncated, least(c, {CAP}) AS stored "
                f"FROM (SELECT CAST(count(*) AS BIGINT) AS c FROM ({s}))"
            )
    out["guarded_capped"] = " UNION ALL ".join(capped)
    reward = RewardConfig()
    outcomes = []
    for pair, gold, candidate, reason in PAIRS:
        failed = pair == "missing_database" or reason in _FAILED
        error = "unknown_error" if pair == "missing_database" else reason if failed else "ok"
        if reason in ("match", "exec_mismatch"):
            outcomes.append(
                f"SELECT {sql_str(pair)} AS pair_id, same AS matched, CASE WHEN same THEN 'match' ELSE 'exec_mismatch' END AS reason, "
                f"CAST(CASE WHEN same THEN {reward.match} ELSE {reward.exec_mismatch} END AS DOUBLE) AS reward, TRUE AS exec_ok, "
                f"'ok' AS error_type FROM (SELECT {_same_sql(pair, gold, candidate)} AS same)"
            )
            continue
        worth = getattr(reward, "unknown_error" if reason == "gold_failed" else reason)
        outcomes.append(
            f"SELECT {sql_str(pair)} AS pair_id, FALSE AS matched, {sql_str(reason)} AS reason, "
            f"CAST({worth} AS DOUBLE) AS reward, {not failed} AS exec_ok, {sql_str(error)} AS error_type"
        )
    out["scored_sql_pairs"] = scored_sql_pairs
    out["eval_from_runs"] = eval_from_runs
    out["guarded_cells"] = guarded_cells
    out["guarded_capped"] = guarded_capped
    return out


def oracle_sql() -> dict:
    out = {f"guarded_{k}": v for k, v in G_QUERIES.items()}
    parts = [
        f"SELECT {sql_str(n)} AS query_id, TRUE AS ok, 'ok' AS error_type, "
        f"(SELECT CAST(count(*) AS BIGINT) FROM ({s})) AS row_count, FALSE AS truncated"
        for n, s in G_QUERIES.items()
    ]
    parts += [
        f"SELECT {sql_str(f'bad_{i}')}, FALSE, {sql_str(et)}, CAST(0 AS BIGINT), FALSE"
        for i, (_, et) in enumerate(BAD_QUERIES)
    ]
    out["guarded_runs"] = " UNION ALL ".join(parts)
    capped = []
    for n, s in G_QUERIES.items():
        for k in (1, 2):
            capped.append(
                f"SELECT {sql_str(f'{n}-{k}')} AS query_id, least(c, {CAP}) AS row_count, c > {CAP} AS truncated, least(c, {CAP}) AS stored "
                f"FROM (SELECT CAST(count(*) AS BIGINT) AS c FROM ({s}))"
            )
    out["guarded_capped"] = " UNION ALL ".join(capped)
    reward = RewardConfig()
    outcomes = []
    for pair, _, _, reason in PAIRS:
        failed = pair == "missing_database" or reason in _FAILED
        error = "unknown_error" if pair == "missing_database" else reason if failed else "ok"
        worth = getattr(reward, "unknown_error" if reason == "gold_failed" else reason)
        outcomes.append(
            f"SELECT {sql_str(pair)} AS pair_id, {reason == 'match'} AS matched, {sql_str(reason)} AS reason, "
            f"CAST({worth} AS DOUBLE) AS reward, {not failed} AS exec_ok, {sql_str(error)} AS error_type"
        )
    out["scored_sql_pairs"] = " UNION ALL ".join(outcomes)
    golds = ", ".join(f"({sql_str(p)}, {sql_str(g)})" for p, g, _, _ in PAIRS)
    out["eval_from_runs"] = f"""SELECT 'model' AS label, pair_id, matched AND NOT missing AS matched,
        CASE WHEN missing THEN 'eval_error' ELSE reason END AS reason, CASE WHEN missing THEN 0.0 ELSE reward END::DOUBLE AS reward,
        error_type, NOT missing AND reason = 'gold_failed' AS gold_failed, {S.difficulty('gold_sql')} AS difficulty
        FROM (SELECT s.*, v.gold_sql, s.pair_id = 'missing_database' AS missing
              FROM ({out['scored_sql_pairs']}) s JOIN (VALUES {golds}) v(pair_id, gold_sql) USING (pair_id))"""
    out["guarded_cells"] = """SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(o_totalprice AS DOUBLE) AS price,
        CASE WHEN o_totalprice > 150000 THEN '1' WHEN o_totalprice <= 150000 THEN '0' ELSE 'NULL' END AS flag, 'NULL' AS nothing,
        o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS exact, CAST(o_orderkey AS BIGINT) AS again
        FROM orders"""
    return out
