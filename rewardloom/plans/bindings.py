"""Inputs for the operators, projected from the driver's parquet tables.

The driver tables hold no SQL, rollouts or model output, so each input is a
deterministic projection of a real table (SURVEY §7.2). Every projection is
written twice, as DataFrame code and as DuckDB SQL text, with identical
meaning; the registered queries in ``plans.registry`` run the operators on
the DataFrame form and the oracle runs its own SQL on the SQL form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions import text as T
from rewardloom.operators.reward import RewardConfig, reward as reward_expr

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _padded(text: Column) -> Column:
    """At least six characters, with zeros before; longer ones whole."""
    return F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))


def sql_str(s: str) -> str:
    """A DuckDB string literal holding ``s`` verbatim (raw characters)."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# Rollouts from ``events`` (E1/E2 inputs)
# ---------------------------------------------------------------------------
# event_type -> outcome of the candidate run.
EVENT_OUTCOMES = {
    # event_type: (reason, error_type, exec_ok, matched, candidate SQL head)
    "purchase": ("match", "ok", True, True, "SELECT event_id FROM events WHERE user_id = "),
    "view": ("exec_mismatch", "ok", True, False, "SELECT * FROM events WHERE user_id = "),
    "click": ("syntax_error", "syntax_error", False, False, "SELECT event_id FROM events WHERE user_id = = "),
    "error": ("runtime_error", "runtime_error", False, False, "SELECT event_id / 0 FROM events WHERE user_id = "),
    "signup": ("forbidden", "forbidden", False, False, "DROP TABLE events; SELECT event_id FROM events WHERE user_id = "),
}
EVENTS_SCHEMA_TEXT = (
    "CREATE TABLE events (\n  event_id INTEGER PRIMARY KEY,\n  ts TEXT,\n"
    "  user_id INTEGER,\n  event_type TEXT,\n  value REAL\n);"
)
GOLD_HEAD = "SELECT event_id FROM events WHERE user_id = "
ROLLOUT_REWARD = RewardConfig(
    length_penalty_weight=0.01, select_star_penalty=0.05, slow_query_ms=2000, slow_query_penalty=0.05
)


def _case(col: Column, field: int, default) -> Column:
    expr = None
    for k, v in EVENT_OUTCOMES.items():
        expr = (F.when(col == k, F.lit(v[field])) if expr is None else expr.when(col == k, F.lit(v[field])))
    return expr.otherwise(F.lit(default))


def rollouts_from_events(events: DataFrame, by_day: bool = False, cfg: RewardConfig = ROLLOUT_REWARD) -> DataFrame:
    """Rollout rows (D8 schema) + ``ord``: one candidate per event.

    Group = user (or user and day); candidate_id = event_id; the outcome
    follows event_type; the run time is ``value * 10`` ms; reward is the
    shaped execution reward of that outcome.
    """
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    uid = F.col("user_id").cast("string")
    day = F.date_format(F.col("ts"), "yyyy-MM-dd")
    ident = F.concat(F.lit("u"), _padded(uid))
    question = F.concat(F.lit("Which events did user "), uid, F.lit(" have"))
    if by_day:
        ident = F.concat(ident, F.lit("-"), day)
        question = F.concat(question, F.lit(" on "), day)
    et = F.col("event_type")
    head = _case(et, 4, "SELECT NULL FROM events WHERE user_id = ")
    out = e.select(
        ident.alias("id"),
        F.col("event_id").alias("candidate_id"),
        F.concat(F.lit("db"), (F.col("user_id") % 10).cast("string")).alias("db_id"),
        T.chatml_prompt(F.lit(EVENTS_SCHEMA_TEXT), question).alias("prompt"),
        F.concat(F.lit(GOLD_HEAD), uid).alias("gold_sql"),
        F.concat(head, uid).alias("candidate_sql"),
        _case(et, 3, False).alias("matched"),
        (_case(et, 1, "unknown_error") != "forbidden").alias("valid"),
        _case(et, 2, False).alias("exec_ok"),
        _case(et, 1, "unknown_error").alias("error_type"),
        F.lit("").alias("error_message"),
        F.floor(F.col("value") * 10).cast("long").alias("exec_time_ms"),
        F.lit(False).alias("truncated"),
        _case(et, 0, "unknown_error").alias("reason"),
        F.col("event_id").alias("ord"),
    )
    return out.withColumn("reward", reward_expr("reason", "candidate_sql", "exec_ok", "exec_time_ms", cfg))


def _sql_case(col: str, field: int, default: str) -> str:
    parts = []
    for k, v in EVENT_OUTCOMES.items():
        val = v[field]
        lit = ("TRUE" if val else "FALSE") if isinstance(val, bool) else sql_str(val)
        parts.append(f"WHEN {col} = {sql_str(k)} THEN {lit}")
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


def sql_ws() -> str:
    return sql_str(T.WS)


def sql_token_count(expr: str) -> str:
    """X8 in DuckDB: runs of characters outside the whitespace set."""
    return f"CAST(coalesce(len(regexp_extract_all({expr}, {sql_str('[^' + T.WS + ']+')})), 0) AS BIGINT)"


def sql_star(expr: str) -> str:
    """X9 (intended form) in DuckDB: a word boundary before SELECT emulated
    with a non-word character or the start of the text."""
    return (
        f"regexp_matches({expr}, {sql_str('(^|[^\\p{L}\\p{N}_])(?i:select)[' + T.WS + ']+[*]')})"
    )


def sql_reward(reason: str, sql: str, exec_ok: str, elapsed: str, cfg: RewardConfig) -> str:
    base = (
        f"CASE {reason} WHEN 'match' THEN {cfg.match!r} WHEN 'exec_mismatch' THEN {cfg.exec_mismatch!r} "
        f"WHEN 'syntax_error' THEN {cfg.syntax_error!r} WHEN 'runtime_error' THEN {cfg.runtime_error!r} "
        f"WHEN 'forbidden' THEN {cfg.forbidden!r} WHEN 'timeout' THEN {cfg.timeout!r} "
        f"ELSE {cfg.unknown_error!r} END"
    )
    p = "CAST(0.0 AS DOUBLE)"
    if cfg.length_penalty_weight != 0.0:
        p = f"({p} - CAST({cfg.length_penalty_weight!r} AS DOUBLE) * CAST({sql_token_count(sql)} AS DOUBLE))"
    if cfg.select_star_penalty != 0.0:
        p = f"(CASE WHEN {sql_star(sql)} THEN {p} - CAST({cfg.select_star_penalty!r} AS DOUBLE) ELSE {p} END)"
    if cfg.slow_query_ms > 0 and cfg.slow_query_penalty != 0.0:
        p = (
            f"(CASE WHEN coalesce({exec_ok}, FALSE) AND coalesce({elapsed}, 0) > {int(cfg.slow_query_ms)} "
            f"THEN {p} - CAST({cfg.slow_query_penalty!r} AS DOUBLE) ELSE {p} END)"
        )
    return (
        f"(CASE WHEN {reason} = 'gold_failed' THEN CAST({cfg.unknown_error!r} AS DOUBLE) "
        f"ELSE CAST({base} AS DOUBLE) + {p} END)"
    )


def sql_chatml_prompt(schema: str, question: str) -> str:
    head = f"{T.IM_START}system\n{T.SYSTEM_MESSAGE}\n{T.IM_END}\n{T.IM_START}user\n{T.USER_HEADER}"
    tail = f"\n{T.IM_END}\n{T.IM_START}assistant\n"
    return f"({sql_str(head)} || {schema} || {sql_str(T.QUESTION_HEADER)} || {question} || {sql_str(tail)})"


def sql_rollouts_from_events(by_day: bool = False, cfg: RewardConfig = ROLLOUT_REWARD) -> str:
    uid = "CAST(user_id AS VARCHAR)"
    day = "strftime(ts, '%Y-%m-%d')"
    ident = f"('u' || lpad({uid}, CAST(greatest(6, length({uid})) AS INTEGER), '0'))"
    question = f"('Which events did user ' || {uid} || ' have')"
    if by_day:
        ident = f"({ident} || '-' || {day})"
        question = f"({question} || ' on ' || {day})"
    head = _sql_case("event_type", 4, sql_str("SELECT NULL FROM events WHERE user_id = "))
    base = f"""
    SELECT {ident} AS id,
           event_id AS candidate_id,
           'db' || CAST(user_id % 10 AS VARCHAR) AS db_id,
           {sql_chatml_prompt(sql_str(EVENTS_SCHEMA_TEXT), question)} AS prompt,
           {sql_str(GOLD_HEAD)} || {uid} AS gold_sql,
           ({head}) || {uid} AS candidate_sql,
           {_sql_case('event_type', 3, 'FALSE')} AS matched,
           ({_sql_case('event_type', 1, "'unknown_error'")}) <> 'forbidden' AS valid,
           {_sql_case('event_type', 2, 'FALSE')} AS exec_ok,
           {_sql_case('event_type', 1, "'unknown_error'")} AS error_type,
           CAST(floor(value * 10) AS BIGINT) AS exec_time_ms_raw,
           {_sql_case('event_type', 0, "'unknown_error'")} AS reason,
           event_id AS ord
    FROM events"""
    return f"""(SELECT *, {sql_reward('reason', 'candidate_sql', 'exec_ok', 'exec_time_ms', cfg)} AS reward
      FROM (SELECT *, exec_time_ms_raw AS exec_time_ms FROM ({base})))"""


# ---------------------------------------------------------------------------
# Evaluation results from ``events`` (E3 input)
# ---------------------------------------------------------------------------
MODEL_LABELS = ("base", "sft", "dpo")  # by user_id % 3
GOLD_TEMPLATES = (  # by event_id % 4: easy, medium, hard, extra under X7
    "SELECT name FROM users WHERE id = ",
    "SELECT name FROM users ORDER BY age LIMIT ",
    "SELECT u.name FROM users u JOIN orders o ON o.user_id = u.id JOIN items i ON i.order_id = o.order_id WHERE u.id = ",
    "SELECT name FROM users UNION SELECT name FROM admins WHERE id = ",
)


def eval_results_from_events(events: DataFrame, cfg: RewardConfig = RewardConfig()) -> DataFrame:
    """One evaluated example per event: label = model, example_idx = event_id,
    gold SQL by event_id % 4, gold failure when event_id % 17 = 0, outcome by
    event_type; difficulty comes from the gold SQL text (X7)."""
    e = events.select("event_id", "user_id", "event_type", "value")
    uid = F.col("user_id").cast("string")
    label = F.when(F.col("user_id") % 3 == 0, F.lit(MODEL_LABELS[0])).when(
        F.col("user_id") % 3 == 1, F.lit(MODEL_LABELS[1])
    ).otherwise(F.lit(MODEL_LABELS[2]))
    gm = F.col("event_id") % 4
    gold = F.concat(
        F.when(gm == 0, F.lit(GOLD_TEMPLATES[0])).when(gm == 1, F.lit(GOLD_TEMPLATES[1]))
        .when(gm == 2, F.lit(GOLD_TEMPLATES[2])).otherwise(F.lit(GOLD_TEMPLATES[3])),
        uid,
    )
    gold_failed = F.col("event_id") % 17 == 0
    et = F.col("event_type")
    reason = F.when(gold_failed, F.lit("gold_failed")).otherwise(_case(et, 0, "unknown_error"))
    out = e.select(
        label.alias("label"),
        F.col("event_id").alias("example_idx"),
        F.concat(F.lit("Which events did user "), uid, F.lit(" have")).alias("question"),
        F.concat(F.lit("db"), (F.col("user_id") % 10).cast("string")).alias("db_id"),
        gold.alias("gold_sql"),
        F.concat(_case(et, 4, "SELECT NULL FROM events WHERE user_id = "), uid).alias("predicted_sql"),
        (~gold_failed & _case(et, 3, False)).alias("matched"),
        reason.alias("reason"),
        _case(et, 1, "unknown_error").alias("error_type"),
        _case(et, 2, False).alias("exec_ok"),
        F.floor(F.col("value") * 10).cast("long").alias("exec_time_ms"),
        gold_failed.alias("gold_failed"),
    )
    return out.withColumn(
        "reward", reward_expr("reason", "predicted_sql", "exec_ok", "exec_time_ms", cfg)
    ).withColumn("difficulty", T.difficulty("gold_sql"))


def sql_eval_results_from_events(cfg: RewardConfig = RewardConfig()) -> str:
    from rewardloom.plans import sqltext as S

    uid = "CAST(user_id AS VARCHAR)"
    gold = (
        "(CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {sql_str(t)}" for i, t in enumerate(GOLD_TEMPLATES))
        + f" END || {uid})"
    )
    head = _sql_case("event_type", 4, sql_str("SELECT NULL FROM events WHERE user_id = "))
    base = f"""
      SELECT CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS label,
             event_id AS example_idx,
             'Which events did user ' || {uid} || ' have' AS question,
             'db' || CAST(user_id % 10 AS VARCHAR) AS db_id,
             {gold} AS gold_sql,
             ({head}) || {uid} AS predicted_sql,
             (event_id % 17 <> 0) AND {_sql_case('event_type', 3, 'FALSE')} AS matched,
             CASE WHEN event_id % 17 = 0 THEN 'gold_failed' ELSE {_sql_case('event_type', 0, "'unknown_error'")} END AS reason,
             {_sql_case('event_type', 1, "'unknown_error'")} AS error_type,
             {_sql_case('event_type', 2, 'FALSE')} AS exec_ok,
             CAST(floor(value * 10) AS BIGINT) AS exec_time_ms,
             event_id % 17 = 0 AS gold_failed
      FROM events"""
    return f"""(SELECT *, {sql_reward('reason', 'predicted_sql', 'exec_ok', 'exec_time_ms', cfg)} AS reward,
                 {S.difficulty('gold_sql')} AS difficulty
          FROM ({base}))"""


# ---------------------------------------------------------------------------
# Result sets and runs from ``lineitem`` (A1, Q5 inputs)
# ---------------------------------------------------------------------------
def _li_cells(first: str, second: str) -> Column:
    return F.array(F.col(first), F.col(second), F.col("l_linenumber").cast("string"))


def _candidate_cells() -> tuple[Column, Column]:
    """A line's cells in its supplier's candidate result, and how often it stands there."""
    v, line = F.col("l_suppkey") % 4, F.col("l_linenumber")
    cells = F.when(v == 3, _li_cells("l_linestatus", "l_returnflag")).otherwise(_li_cells("l_returnflag", "l_linestatus"))
    return cells, F.when((v == 1) & (line == 1), 0).when((v == 2) & (line == 2), 2).otherwise(1)


def result_sets_from_lineitem(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold result per supplier = its (returnflag, linestatus, linenumber)
    rows. The candidate result of supplier s depends on s % 4: 0 identical,
    1 without line 1, 2 with line 2 twice, 3 first two columns swapped."""
    li = lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    key = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("query_key")
    cells, times = _candidate_cells()
    gold = li.select(key, _li_cells("l_returnflag", "l_linestatus").alias("cells"))
    return gold, li.select(key, F.explode(F.array_repeat(cells, times)).alias("cells"))


SQL_LI_GOLD = """(SELECT 's' || CAST(l_suppkey AS VARCHAR) AS query_key,
        l_returnflag || chr(31) || l_linestatus || chr(31) || CAST(l_linenumber AS VARCHAR) AS row_text
      FROM lineitem)"""
SQL_LI_CAND = """(SELECT 's' || CAST(l_suppkey AS VARCHAR) AS query_key,
        CASE WHEN l_suppkey % 4 = 3 THEN l_linestatus || chr(31) || l_returnflag
             ELSE l_returnflag || chr(31) || l_linestatus END
          || chr(31) || CAST(l_linenumber AS VARCHAR) AS row_text
      FROM lineitem WHERE NOT (l_suppkey % 4 = 1 AND l_linenumber = 1)
      UNION ALL
      SELECT 's' || CAST(l_suppkey AS VARCHAR),
        l_returnflag || chr(31) || l_linestatus || chr(31) || CAST(l_linenumber AS VARCHAR)
      FROM lineitem WHERE l_suppkey % 4 = 2 AND l_linenumber = 2)"""

# Candidate run status by supplier % 8 for the scoring input.
RUN_STATUS = ("ok", "ok", "ok", "ok", "syntax_error", "runtime_error", "timeout", "ok")
CAND_SQL_HEAD = "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_suppkey = "
STAR_SQL_HEAD = "SELECT * FROM lineitem WHERE l_suppkey = "
SCORING_REWARD = RewardConfig(length_penalty_weight=0.02, select_star_penalty=0.1, slow_query_ms=1500, slow_query_penalty=0.3)


def scoring_inputs_from_lineitem(lineitem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, runs, result_rows) for Q5. One gold and one candidate
    query per supplier; the gold run fails when supplier % 8 = 7; the
    candidate run status follows RUN_STATUS; candidate rows as in
    ``result_sets_from_lineitem``."""
    s = F.col("l_suppkey")
    skey = F.concat(F.lit("s"), s.cast("string"))
    cells, times = _candidate_cells()
    row = lambda prefix, c: F.struct(F.concat(F.lit(prefix), skey).alias("query_key"), c.alias("cells"))
    both = F.concat(F.array(row("g-", _li_cells("l_returnflag", "l_linestatus"))), F.array_repeat(row("c-", cells), times))
    rows = lineitem.select(F.explode(both).alias("r")).select("r.*")
    # One aggregate serves runs and candidates: what they need of a supplier.
    sup = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(times).alias("n_cand"))
    status = F.element_at(F.array(*[F.lit(x) for x in RUN_STATUS]), (s % 8 + 1).cast("int"))

    def run(prefix: str, ok: Column, error: Column, n: Column, elapsed: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), skey).alias("query_key"), ok.alias("ok"), error.alias("error_type"), F.lit("").alias("error_message"),
            F.lit(False).alias("truncated"), elapsed.alias("elapsed_ms"), F.when(ok, n).otherwise(0).cast("long").alias("row_count"),
        )

    gold_error = F.when(s % 8 == 7, F.lit("runtime_error")).otherwise(F.lit("ok"))
    runs = sup.select(F.explode(F.array(
        run("g-", s % 8 != 7, gold_error, F.col("n_gold"), (s * 37) % 3000),
        run("c-", status == "ok", status, F.col("n_cand"), (s * 53) % 3000),
    )).alias("r")).select("r.*")
    candidates = sup.select(
        skey.alias("pair_id"),
        F.concat(F.lit("g-"), skey).alias("gold_key"),
        F.concat(F.lit("c-"), skey).alias("cand_key"),
        F.concat(F.when(s % 3 == 0, F.lit(STAR_SQL_HEAD)).otherwise(F.lit(CAND_SQL_HEAD)), s.cast("string")).alias(
            "candidate_sql"
        ),
    )
    return candidates, runs, rows


# ---------------------------------------------------------------------------
# Generated texts (X1-X10 inputs): templates over ``orders`` plus whole
# ``documents`` and ``conversations`` texts as prose without SQL.
# ---------------------------------------------------------------------------
# (prefix, column, suffix), chosen by o_orderkey % 14.
GENERATION_TEMPLATES = (
    ("```sql\nSELECT o_orderkey FROM orders WHERE o_custkey = ", "o_custkey", "\n```"),
    ("<|im_start|>assistant\nSELECT o_totalprice FROM orders WHERE o_orderkey = ", "o_orderkey", "; <|im_end|> trailing words"),
    ("SELECT count(*) FROM orders WHERE o_orderpriority = '", "o_orderpriority", "'\n\nSELECT garbage FROM orders"),
    ("Here is the query:\n```sql\nSELECT o_orderstatus FROM orders\n```\nIt lists the status of every order; "
     "this explanation is deliberately longer than the query itself, for customer ", "o_custkey", "."),
    ("SELECT o_custkey FROM orders WHERE o_orderkey = ", "o_orderkey", " 中文 garbage"),
    ("SELECT * FROM orders WHERE o_orderstatus = '", "o_orderstatus", "'; DROP TABLE orders"),
    ("DROP TABLE orders_", "o_orderkey", ""),
    ("WITH t AS (SELECT o_orderkey FROM orders) SELECT * FROM t WHERE o_orderkey = ", "o_orderkey", ""),
    ("SELECT o_orderkey FROM orders -- comment ", "o_orderkey", ""),
    ("SELECT replace(o_orderpriority, '-', '') FROM orders WHERE o_custkey = ", "o_custkey", ""),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = ", "o_custkey", " UNION SELECT o_custkey FROM orders\nSELECT 2"),
    ("assistant\nselect o.o_orderkey from orders o join customer c on o.o_custkey = c.c_custkey "
     "join nation n on c.c_nationkey = n.n_nationkey where o.o_orderkey = ", "o_orderkey", "<quote>"),
    ("SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > ", "o_orderkey", ";;"),
    ("```\nSELECT a FROM (SELECT o_custkey AS a FROM orders WHERE o_orderkey = ", "o_orderkey",
     ") x ORDER BY a\n```\n```sql\nSELECT 1\n```"),
)


def generations_from_tables(orders: DataFrame, documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(source, gen_id, text)``: one templated generation per order, every
    document text and every conversation turn, whole."""
    n = len(GENERATION_TEMPLATES)
    m = F.col("o_orderkey") % n
    expr = None
    for i, (pre, col, suf) in enumerate(GENERATION_TEMPLATES):
        val = F.concat(F.lit(pre), F.col(col).cast("string"), F.lit(suf))
        expr = F.when(m == i, val) if expr is None else expr.when(m == i, val)
    o = orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("gen_id"), expr.alias("text"))
    d = documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("gen_id"), F.col("text"))
    c = conversations.select(
        F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("gen_id"), F.col("text")
    )
    return o.unionByName(d).unionByName(c)


def sql_generations() -> str:
    n = len(GENERATION_TEMPLATES)
    whens = " ".join(
        f"WHEN {i} THEN {sql_str(pre)} || CAST({col} AS VARCHAR) || {sql_str(suf)}"
        for i, (pre, col, suf) in enumerate(GENERATION_TEMPLATES)
    )
    return f"""(SELECT 'orders' AS source, o_orderkey AS gen_id, CASE o_orderkey % {n} {whens} END AS text FROM orders
      UNION ALL SELECT 'documents', doc_id, text FROM documents
      UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)"""


# Error log (X10 input): exception class by row, message = the whole text.
EXCEPTION_CLASSES = ("OperationalError", "ProgrammingError", "OperationalError", "DatabaseError")


def error_log_from_tables(documents: DataFrame, events: DataFrame) -> DataFrame:
    m = F.col("doc_id") % 4
    cls = F.element_at(F.array(*[F.lit(c) for c in EXCEPTION_CLASSES]), (m + 1).cast("int"))
    d = documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("log_id"), cls.alias("exception_class"), F.col("text").alias("message"))
    e = events.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("log_id"),
        F.lit("OperationalError").alias("exception_class"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("message"),
    )
    return d.unionByName(e)


def sql_error_log() -> str:
    arr = "[" + ", ".join(sql_str(c) for c in EXCEPTION_CLASSES) + "]"
    return f"""(SELECT 'd' || CAST(doc_id AS VARCHAR) AS log_id, {arr}[doc_id % 4 + 1] AS exception_class, text AS message FROM documents
      UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR), 'OperationalError', event_type || ' ' || props FROM events)"""


# ---------------------------------------------------------------------------
# Column catalog from ``part`` (A3 input) and examples from ``conversations``
# ---------------------------------------------------------------------------
# db = brand and a block of 200 part keys, table = type and a block of 50 keys,
# so every database and table stays bounded at any scale. Types by p_size % 5
# ('' and NULL print as TEXT); NOT NULL when p_size % 3 = 0; pk when
# p_partkey % 7 = 0; names starting 'sqlite_' / 'sqliteX' exercise the skip
# rule (LIKE's '_' wildcard). FKs for p_size % 4 = 0, without a target
# column when p_size % 8 = 0.
CATALOG_TYPES = ("INTEGER", "TEXT", "REAL", "")


def _catalog_base(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    size = F.col("p_size")
    ty = F.lower(F.col("p_type"))
    prefix = F.when(size % 11 == 0, F.lit("sqlite_")).when(size % 13 == 0, F.lit("sqliteX")).otherwise(F.lit(""))
    return part.select(
        F.concat(F.col("p_brand"), F.lit("/"), F.floor(k / 200).cast("string")).alias("db_id"),
        F.concat(prefix, ty, F.lit("_"), F.floor(k / 50).cast("string")).alias("table_name"),
        k.cast("long").alias("cid"),
        F.concat(F.regexp_replace(F.col("p_name"), " ", "_"), F.lit("_"), k.cast("string")).alias("column_name"),
        F.when(size % 5 == 4, F.lit(None).cast("string"))
        .otherwise(F.element_at(F.array(*[F.lit(t) for t in CATALOG_TYPES]), (size % 5 + 1).cast("int")))
        .alias("column_type"),
        (size % 3 == 0).alias("not_null"),
        F.when(k % 7 == 0, F.lit(1)).otherwise(F.lit(0)).alias("pk"),
        ty.alias("_type"),
        size.alias("_size"),
    )


def catalog_from_part(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = _catalog_base(part)
    cols = base.drop("_type", "_size")
    fks = base.filter(F.col("_size") % 4 == 0).select(
        "db_id", "table_name",
        F.col("cid").alias("fk_pos"),
        F.col("column_name").alias("from_col"),
        F.concat(F.lit("parts_"), F.col("_type")).alias("to_table"),
        F.when(F.col("_size") % 8 == 0, F.lit(None).cast("string")).otherwise(F.lit("id")).alias("to_col"),
    )
    return cols, fks


def sql_schema_text() -> str:
    types = "[" + ", ".join(sql_str(t) for t in CATALOG_TYPES) + "]"
    base = f"""(SELECT p_brand || '/' || CAST(p_partkey // 200 AS VARCHAR) AS db_id,
          (CASE WHEN p_size % 11 = 0 THEN 'sqlite_' WHEN p_size % 13 = 0 THEN 'sqliteX' ELSE '' END)
            || lower(p_type) || '_' || CAST(p_partkey // 50 AS VARCHAR) AS table_name,
          p_partkey AS cid,
          replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS column_name,
          CASE WHEN p_size % 5 = 4 THEN NULL ELSE {types}[p_size % 5 + 1] END AS column_type,
          p_size % 3 = 0 AS not_null,
          CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS pk,
          lower(p_type) AS ty, p_size AS sz
        FROM part)"""
    nl = "chr(10)"
    return f"""(WITH b AS {base},
      lines AS (
        SELECT db_id, table_name, 0 AS kind, cid AS pos,
               '  ' || column_name || ' ' || coalesce(nullif(column_type, ''), 'TEXT')
               || CASE WHEN pk <> 0 THEN ' PRIMARY KEY' ELSE '' END
               || CASE WHEN not_null AND pk = 0 THEN ' NOT NULL' ELSE '' END AS line
        FROM b WHERE lower(table_name) NOT LIKE 'sqlite_%'
        UNION ALL
        SELECT db_id, table_name, 1, cid,
               '  FOREIGN KEY (' || column_name || ') REFERENCES parts_' || ty
               || CASE WHEN sz % 8 = 0 THEN '' ELSE '(id)' END
        FROM b WHERE sz % 4 = 0 AND lower(table_name) NOT LIKE 'sqlite_%'),
      blocks AS (
        SELECT db_id, table_name,
               'CREATE TABLE ' || table_name || ' (' || {nl}
               || string_agg(line, ',' || {nl} ORDER BY kind, pos) || {nl} || ');' AS block
        FROM lines GROUP BY db_id, table_name)
      SELECT db_id, string_agg(block, {nl} || {nl} ORDER BY table_name) AS schema FROM blocks GROUP BY db_id)"""


def examples_from_conversations(conversations: DataFrame, part: DataFrame) -> DataFrame:
    """Examples (D2 without schema): a user turn is the question and the
    assistant turn right after it the target text. A conversation belongs to
    the database of part ``conv_id * 37 % (largest part key) + 1``, so that
    conversations reach the databases of all key blocks."""
    c = conversations.select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sql")
    )
    top = part.agg(F.max("p_partkey")).first()[0] or 1
    homes = part.select(
        F.col("p_partkey").alias("_part"),
        F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 200).cast("string")).alias("db_id"),
    )
    both = u.join(a, ["conv_id", "turn"]).withColumn("_part", F.col("conv_id") * 37 % F.lit(top) + 1)
    return both.join(homes, "_part").select(
        F.concat(F.lit("c"), _padded(F.col("conv_id").cast("string")), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        "question", "sql", "db_id",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )


def sql_examples() -> str:
    return """(SELECT 'c' || lpad(CAST(u.conv_id AS VARCHAR), CAST(greatest(6, length(CAST(u.conv_id AS VARCHAR))) AS INTEGER), '0') || '-' || CAST(u.turn AS VARCHAR) AS id,
          u.text AS question, a.text AS sql,
          h.p_brand || '/' || CAST(h.p_partkey // 200 AS VARCHAR) AS db_id,
          u.conv_id * 1000 + u.turn AS ord
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        JOIN part h ON h.p_partkey = u.conv_id * 37 % (SELECT max(p_partkey) FROM part) + 1
        WHERE u.role = 'user')"""


def examples_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """E2 examples: one per supplier, in supplier order; the gold query is the
    supplier's gold result (see ``scoring_inputs_from_lineitem``)."""
    sup = lineitem.select("l_suppkey").distinct()
    s = F.col("l_suppkey")
    return sup.select(
        s.alias("_order"),
        F.concat(F.lit("Which lines does supplier "), s.cast("string"), F.lit(" have?")).alias("question"),
        F.concat(F.lit(CAND_SQL_HEAD), s.cast("string")).alias("gold_sql"),
        F.concat(F.lit("db"), (s % 10).cast("string")).alias("db_id"),
        F.concat(F.lit("g-s"), s.cast("string")).alias("gold_key"),
        F.concat(F.lit("s"), s.cast("string")).alias("pair_id"),
    )
