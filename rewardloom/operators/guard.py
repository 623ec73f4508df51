"""Guarded, read-only runs of SQL text on Spark tables (SURVEY Q1-Q4, K2,
A9, S5, X6, X10).

Every distinct ``(db_id, sql)`` is validated (X6 plus Spark-only rules) and
analysed in a child session that holds its database's views, with reserved keywords
enforced and SQL-on-files disabled. The parsed plan may hold only nodes of a query, and
only relations that are views of the database or names the query defines itself; the
analysed plan is walked once more, down to the views.

The queries of one database run in batches: one job writes the tagged result rows of up
to ``batch_size`` queries, normalized to text cells (A2), straight from the executors.
A batch that fails is halved until the query at fault is alone; a batch that passes the
time limit is run query by query, for only a query by itself can be told to be
slow. Past the limit the job group is cancelled until the job ends. Nothing but the
distinct query texts and one status tuple per query passes through the driver; their
number is the benchmark's size, independent of the data volume.
"""

from __future__ import annotations

import dataclasses
import itertools
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions import text as TX
from rewardloom.operators.compare import result_rows
from rewardloom.session import scratch_table_path

# Functions that would let a SELECT call arbitrary JVM methods; rejected in
# addition to the X6 rules. (TRANSFORM ... USING, which starts a process, is a plan node.)
SPARK_FORBIDDEN = ("reflect", "java_method", "try_reflect")
#: What a parsed query may consist of, by the names of Spark's plan nodes.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Sort Join LateralJoin AsOfJoin Distinct Deduplicate Union Intersect Except GlobalLimit LocalLimit "
    "LimitAll Offset Tail Sample SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedInlineTable OneRowRelation LocalRelation "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedHint "
    "WithWindowDefinition Window Generate Pivot Unpivot Expand ResolvedInlineTable RepartitionByExpression Repartition "
    "PipeOperator PipeExpression".split()
)
#: Leaves of an analysed query that read nothing beside the views above them.
FREE_LEAVES = frozenset("OneRowRelation LocalRelation EmptyRelation Range CTERelationRef UnionLoopRef".split())
#: Seconds between attempts to cancel a query over its time.
CANCEL_EVERY_S = 0.1
#: Query texts and statuses that the driver holds at once.
HELD = 500
MISSING_DB = "Database not found"

RUN_SCHEMA = T.StructType(
    [
        T.StructField("query_key", T.StringType(), False),
        T.StructField("ok", T.BooleanType(), False),
        T.StructField("error_type", T.StringType(), False),
        T.StructField("error_message", T.StringType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("truncated", T.BooleanType(), False),
        T.StructField("elapsed_ms", T.LongType(), False),
    ]
)

_ROWS = "query_key string, cells array<string>, pos int"

Catalog = Callable[[str], Mapping[str, DataFrame]]


@dataclasses.dataclass(frozen=True)
class GuardConfig:
    timeout_s: float = 60.0  # well above Spark's per-job latency
    max_rows: int | None = None  # None: full results (default); else K2 cap
    max_workers: int = 4
    float_digits: int | None = None  # decimals kept in cells; comparison rounds by itself
    batch_size: int = 100  # queries of one job; 1 gives each query's own time

    def __post_init__(self) -> None:
        if self.timeout_s <= 0:
            raise ValueError("timeout_s must be > 0")
        if self.max_rows is not None and self.max_rows <= 0:
            raise ValueError("max_rows must be > 0")
        if self.max_workers <= 0:
            raise ValueError("max_workers must be > 0")
        if self.batch_size <= 0:
            raise ValueError("batch_size must be > 0")


@dataclasses.dataclass
class RunResult:
    queries: DataFrame  # input rows + query_key
    runs: DataFrame  # one row per distinct query (RUN_SCHEMA + db_id, sql)
    result_rows: DataFrame  # (query_key, cells)


def parquet_catalog(root: str, spark: SparkSession) -> Catalog:
    """Database ``db_id`` = folder ``{root}/{db_id}`` holding one parquet
    dataset per table (``{table}.parquet`` or a ``{table}`` folder)."""
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001

    def resolve(db_id: str) -> Mapping[str, DataFrame]:
        path = jvm_fs.Path(f"{root.rstrip('/')}/{db_id}")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(f"Database not found: {db_id}")
        views = {}
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if name.startswith((".", "_")):
                continue
            table = name[: -len(".parquet")] if name.endswith(".parquet") else name
            views[table] = spark.read.parquet(st.getPath().toString())
        return views

    return resolve


def tables_catalog(spark: SparkSession, sf_dir: str, names: tuple[str, ...], db_id: str = "main") -> Catalog:
    """One database made of parquet tables in a folder (the driver's layout)."""

    def resolve(requested: str) -> Mapping[str, DataFrame]:
        if requested != db_id:
            raise FileNotFoundError(f"Database not found: {requested}")
        return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}

    return resolve


def spark_guard_reason(sql) -> F.Column:
    """Q4: X6's reason, then the Spark-only rejections."""
    reason = TX.validation_reason(sql)
    w = TX.words(F.lower(TX.strip_ws(sql)))
    extra = None
    for kw in SPARK_FORBIDDEN:
        cond = F.array_contains(w, kw)
        msg = F.lit(TX.REASON_KEYWORD + kw)
        extra = F.when(cond, msg) if extra is None else extra.when(cond, msg)
    return F.coalesce(reason, extra)


def _query_key() -> F.Column:
    # As JSON, so that a null differs from an empty text and from the other field's value.
    return F.sha2(F.to_json(F.struct(F.col("db_id").cast("string").alias("db_id"), F.col("sql").cast("string").alias("sql"))), 256)


def _classify(exc: BaseException, cancelled: bool) -> tuple[str, str]:
    """Q3: Spark exception -> error type."""
    from pyspark.errors import AnalysisException, ParseException

    msg = str(exc).strip() or type(exc).__name__
    if cancelled:
        return "timeout", msg
    if isinstance(exc, ParseException):
        return "syntax_error", msg
    if isinstance(exc, ForbiddenQuery):
        return "forbidden", msg
    if isinstance(exc, (AnalysisException, ForeignRelation)):
        return "runtime_error", msg
    name = type(exc).__name__
    if name in ("Py4JJavaError", "SparkRuntimeException", "ArithmeticException", "NumberFormatException",
                "SparkArithmeticException", "SparkNumberFormatException", "SparkException", "IllegalArgumentException",
                "DateTimeException", "SparkDateTimeException", "SparkUpgradeException", "PythonException"):
        return "runtime_error", msg
    return "unknown_error", msg


@dataclasses.dataclass(frozen=True)
class _Database:
    """An opened database: a child session and the names of its views."""

    session: SparkSession
    shared: list[str]
    names: frozenset[str]


@dataclasses.dataclass(frozen=True)
class _Planned:
    """An analysed query: its tagged result rows, and the time it took so far."""

    key: str
    rows: DataFrame
    planned_s: float


class QueryRunner:
    """Q1/Q2: runs a table of queries; see the module docstring.

    ``elapsed_ms`` of a query that ran in a batch is its own planning time and an equal
    share of the batch's job; with ``batch_size=1`` it is the query's own.
    ``jobs`` counts the jobs that ran queries."""

    def __init__(self, spark: SparkSession, catalog: Catalog, cfg: GuardConfig = GuardConfig(), out_dir: str | None = None):
        self.spark = spark
        self.catalog = catalog
        self.cfg = cfg
        self.out_dir = out_dir or scratch_table_path(spark, "guarded-runs")
        self.jobs = 0
        self._open: dict[str, Future] = {}
        self._lock = threading.Lock()

    def _database(self, db_id: str) -> _Database:
        """The database, opened by whoever asks first."""
        with self._lock:
            first = db_id not in self._open
            opened = self._open.setdefault(db_id, Future())
        if first:
            try:
                found = self.catalog(db_id)
                opened.set_result(_Database(*child_session(self.spark, found), frozenset(n.lower() for n in found)))
            except Exception as exc:  # noqa: BLE001
                opened.set_exception(exc)
        return opened.result()

    def _release(self) -> None:
        """Drops the views of all databases opened so far."""
        with self._lock:
            for opened in self._open.values():
                if opened.exception() is None:
                    for name in opened.result().shared:
                        self.spark.catalog.dropGlobalTempView(name)
            self._open.clear()

    def _plan(self, db: _Database, key: str, sql: str, opened_s: float) -> _Planned:
        start = time.monotonic()
        df = analysed(db.session, sql, db.names)
        rows = result_rows(df, key, float_digits=self.cfg.float_digits)
        if self.cfg.max_rows is not None:
            # K2: a deterministic cap (sorted cells) keeping one extra row
            # to detect truncation; at most max_rows + 1 rows are ranked.
            top = rows.orderBy("cells").limit(self.cfg.max_rows + 1)
            rows = top.withColumn("pos", F.row_number().over(Window.orderBy("cells")))
        else:
            rows = rows.withColumn("pos", F.lit(0))
        return _Planned(key, rows, opened_s + time.monotonic() - start)

    def _run_database(self, db_id: str, queries: list[tuple[str, str]]) -> list[tuple]:
        """Statuses (RUN_SCHEMA and the batch) of some (key, sql) of one database."""
        start = time.monotonic()
        try:
            db = self._database(db_id)
        except FileNotFoundError as exc:
            msg = str(exc)
            if not msg.startswith(MISSING_DB):
                msg = f"{MISSING_DB}: {msg or db_id}"
            return [(key, False, "unknown_error", msg, 0, False, 0, "") for key, _ in queries]
        except Exception as exc:  # noqa: BLE001
            etype, msg = _classify(exc, False)
            return [(key, False, etype, msg, 0, False, 0, "") for key, _ in queries]
        opened_s, statuses, planned = time.monotonic() - start, [], []
        for key, sql in queries:
            began = time.monotonic()
            try:
                query = self._plan(db, key, sql, opened_s)
            except Exception as exc:  # noqa: BLE001
                statuses.append(self._failed(key, *_classify(exc, False), opened_s + time.monotonic() - began))
                continue
            if query.planned_s > self.cfg.timeout_s:
                statuses.append(self._failed(key, "timeout", self._late(), query.planned_s))
            else:
                planned.append(query)
        return statuses + self._run_planned(planned)

    def _late(self) -> str:
        return f"query ran beyond {self.cfg.timeout_s} s"

    @staticmethod
    def _failed(key: str, error_type: str, message: str, seconds: float) -> tuple:
        return key, False, error_type, message, 0, False, int(seconds * 1000), ""

    def _run_planned(self, planned: list[_Planned]) -> list[tuple]:
        if not planned:
            return []
        start = time.monotonic()
        batch = uuid.uuid4().hex
        cancelled = threading.Event()
        try:
            counts = self._write(planned, batch, cancelled)
            if not cancelled.is_set():
                own_s = (time.monotonic() - start) / len(planned)
                return [self._done(q, counts.get(q.key, 0), own_s, batch) for q in planned]
            error = "timeout", self._late()
        except Exception as exc:  # noqa: BLE001
            error = _classify(exc, cancelled.is_set())
        if len(planned) == 1:
            return [self._failed(planned[0].key, *error, planned[0].planned_s + time.monotonic() - start)]
        half = 1 if cancelled.is_set() else (len(planned) + 1) // 2
        return [s for at in range(0, len(planned), half) for s in self._run_planned(planned[at : at + half])]

    def _done(self, query: _Planned, n: int, own_s: float, batch: str) -> tuple:
        truncated = self.cfg.max_rows is not None and n > self.cfg.max_rows
        elapsed = int((query.planned_s + own_s) * 1000)
        return query.key, True, "ok", "", min(n, self.cfg.max_rows) if truncated else n, truncated, elapsed, batch

    def _write(self, planned: list[_Planned], batch: str, cancelled: threading.Event) -> dict[str, int]:
        """Writes the rows of some queries in one job; the number of rows of each."""
        sc = self.spark.sparkContext
        group, over = f"rewardloom-{batch}", threading.Event()
        limit = max(0.0, self.cfg.timeout_s - max(q.planned_s for q in planned))

        def watch() -> None:
            # Cancelling reaches the jobs active at that moment only, so it is repeated until the query ends.
            if not over.wait(limit):
                cancelled.set()
                while not over.wait(CANCEL_EVERY_S):
                    sc.cancelJobGroup(group)

        parts = [q.rows for q in planned]
        while len(parts) > 1:  # a flat tree of unions is analysed faster than a chain
            parts = [parts[k].unionAll(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        path = f"{self.out_dir}/rows/batch={batch}"
        watcher = threading.Thread(target=watch, daemon=True)
        try:
            sc.setJobGroup(group, f"guarded queries, {len(planned)}", interruptOnCancel=True)
            watcher.start()
            with self._lock:
                self.jobs += 1
            parts[0].write.mode("overwrite").parquet(path)
        finally:
            over.set()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if cancelled.is_set():
            return {}
        written = self.spark.read.schema(_ROWS).parquet(path)
        return {r["query_key"]: r["n"] for r in written.groupBy("query_key").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(self, queries: DataFrame) -> RunResult:
        """``queries(db_id, sql, ...)`` -> runs + result rows (A9: each
        distinct query once)."""
        keyed = queries.withColumn("query_key", _query_key())
        checked = keyed.select("query_key", "db_id", "sql").dropDuplicates(["query_key"]).withColumn(
            "_reason", spark_guard_reason("sql")
        )
        forbidden = checked.filter(F.col("_reason").isNotNull()).select(
            "query_key",
            F.lit(False).alias("ok"),
            F.lit("forbidden").alias("error_type"),
            F.col("_reason").alias("error_message"),
            F.lit(0).cast("long").alias("row_count"),
            F.lit(False).alias("truncated"),
            F.lit(0).cast("long").alias("elapsed_ms"),
            F.lit("").alias("batch"), "db_id", "sql",
        )
        # Distinct, valid query texts come to the driver some at a time, a database's together;
        # their statuses are written and their databases closed before the next.
        runs_path, rows_path = f"{self.out_dir}/runs", f"{self.out_dir}/rows"
        self.spark.createDataFrame([], f"{_ROWS}, batch string").write.partitionBy("batch").mode("append").parquet(rows_path)
        forbidden.write.mode("overwrite").parquet(runs_path)
        valid = checked.filter(F.col("_reason").isNull()).select("query_key", "db_id", "sql")
        todo = valid.orderBy("db_id", "query_key").toLocalIterator()
        text = [T.StructField(c, T.StringType()) for c in ("batch", "db_id", "sql")]
        fields = T.StructType([*RUN_SCHEMA.fields, *text])
        size = self.cfg.batch_size
        with ThreadPoolExecutor(max_workers=self.cfg.max_workers) as pool:
            while held := list(itertools.islice(todo, HELD)):
                of = {r["query_key"]: (r["db_id"], r["sql"]) for r in held}
                parts = []
                for db_id, rows in itertools.groupby(held, key=lambda r: r["db_id"]):
                    own = [(r["query_key"], r["sql"]) for r in rows]
                    parts += [(db_id, own[at : at + size]) for at in range(0, len(own), size)]
                try:
                    statuses = [s for done in pool.map(lambda part: self._run_database(*part), parts) for s in done]
                finally:
                    self._release()
                self.spark.createDataFrame([(*s, *of[s[0]]) for s in statuses], fields).write.mode("append").parquet(runs_path)
        runs = self.spark.read.schema(fields).parquet(runs_path)
        rows = self.spark.read.schema(f"{_ROWS}, batch string").parquet(rows_path)
        # A batch that failed may have left files; rows count only with their own batch.
        rows = rows.join(runs.filter("ok").select("query_key", "batch"), ["query_key", "batch"], "left_semi")
        if self.cfg.max_rows is not None:
            rows = rows.filter(F.col("pos") <= self.cfg.max_rows)
        return RunResult(queries=keyed, runs=runs.drop("batch"), result_rows=rows.select("query_key", "cells"))


def child_session(spark: SparkSession, views: Mapping[str, DataFrame]) -> tuple[SparkSession, list[str]]:
    """A child session with ``views`` under their bare names, reserved
    keywords enforced and SQL on files disabled. It still sees the shared
    catalog; ``analysed`` keeps queries to the views. The views are
    handed over through uniquely named global temp views; the caller drops
    the returned names when done."""
    child = spark.newSession()
    child.conf.set("spark.sql.ansi.enforceReservedKeywords", "true")
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    shared = []
    for name, df in views.items():
        gname = f"rl_{uuid.uuid4().hex}_{name}"
        df.createOrReplaceGlobalTempView(gname)
        shared.append(gname)
        db = spark.conf.get("spark.sql.globalTempDatabase", "global_temp")
        child.table(f"{db}.{gname}").createOrReplaceTempView(name)
    return child, shared


class ForeignRelation(Exception):
    """A query reads something outside its database."""


class ForbiddenQuery(Exception):
    """A query does something else than read tables."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _node(plan) -> str:
    return plan.getClass().getSimpleName().rstrip("$")


def check_parsed(plan, names: frozenset[str], identifier) -> None:
    """Q4: raises unless a parsed plan holds nodes of queries only and names, in every
    place, views of ``names`` or what the query has defined there.

    A name defined by ``WITH`` holds in the definitions after it and in the query below it
    (in its own definition too, where the clause is recursive), as Spark resolves it.

    :param identifier: the mark of plans with names that are computed."""
    todo = [(plan, names)]
    while todo:
        node, known = todo.pop()
        kind = _node(node)
        if kind == "ScriptTransformation":
            raise ForbiddenQuery(TX.REASON_KEYWORD + "transform")
        if kind not in QUERY_NODES:
            raise ForeignRelation(f"Not part of a query on this database: {kind}")
        if node.containsPattern(identifier):
            raise ForeignRelation("Names must be written out: IDENTIFIER")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in known:
                raise ForeignRelation(f"Table not found in this database: {'.'.join(parts)}")
        if kind == "UnresolvedWith":
            for defined in _items(node.cteRelations()):
                own = known | {defined._1().lower()}
                todo.append((defined._2(), own if node.allowRecursion() else known))
                known = own
        todo += [(child, known) for child in (*_items(node.children()), *_items(node.subqueries()))]


def check_analysed(plan, names: frozenset[str]) -> None:
    """Q4: raises unless every relation of an analysed plan is a view of ``names``."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = _node(node)
        if kind == "View":
            name = node.desc().identifier()
            if name.database().isDefined() or name.table().lower() not in names:
                raise ForeignRelation(f"Table not found in this database: {name.unquotedString()}")
            continue
        below = (*_items(node.children()), *_items(node.subqueries()))
        if not below and kind not in FREE_LEAVES:
            raise ForeignRelation(f"Not part of a query on this database: {kind}")
        todo += below


def analysed(child: SparkSession, sql: str, names: Iterable[str]) -> DataFrame:
    """The query's DataFrame, once its plans have passed both checks."""
    known = frozenset(n.lower() for n in names)
    parsed = child._jsparkSession.sessionState().sqlParser().parsePlan(sql)  # noqa: SLF001
    patterns = child._jvm.org.apache.spark.sql.catalyst.trees.TreePattern  # noqa: SLF001
    check_parsed(parsed, known, patterns.UNRESOLVED_IDENTIFIER())
    df = child.sql(sql)
    check_analysed(df._jdf.queryExecution().analyzed(), known)  # noqa: SLF001
    return df


def guarded_sql(
    spark: SparkSession, views: Mapping[str, DataFrame], sql: str, child: SparkSession | None = None
) -> DataFrame:
    """Validates one query (X6 + Spark rules) and returns its DataFrame from a
    child session (lazy; nothing runs until an action). Pass ``child`` (from
    ``child_session``) to reuse one child session, and its views, across
    many queries on the same database; of ``views`` only the names are read then."""
    reason = spark.range(1).select(spark_guard_reason(F.lit(sql)).alias("r")).first().r
    if reason is not None:
        raise PermissionError(reason)
    if child is None:
        child, _ = child_session(spark, views)
    return analysed(child, sql, views)
