"""DuckDB statements for rollout statistics, evaluation metrics, result-set
comparison and scoring (direct restatements of the reference's rules)."""

from __future__ import annotations

from rewardloom.plans import bindings as B
from rewardloom.plans.bindings import sql_str

DIFFS = "(VALUES ('easy'), ('medium'), ('hard'), ('extra')) AS d(difficulty)"


def rollout_stats(rollouts_sql: str) -> str:
    return f"""
    WITH r AS (SELECT * FROM {rollouts_sql}),
    t AS (SELECT CAST(count(*) AS BIGINT) AS candidates_kept,
                 CAST(count(*) FILTER (WHERE matched) AS BIGINT) AS matches,
                 CAST(count(DISTINCT id) AS BIGINT) AS examples_done,
                 CAST(count(DISTINCT id) FILTER (WHERE matched) AS BIGINT) AS examples_with_match
          FROM r)
    SELECT *, coalesce(matches / nullif(candidates_kept, 0), 0.0) AS match_rate,
              coalesce(examples_with_match / nullif(examples_done, 0), 0.0) AS example_match_rate
    FROM t"""


def _metrics(ev: str) -> str:
    return f"""
      SELECT label, CAST(count(*) AS BIGINT) AS total,
             CAST(count(*) FILTER (WHERE matched) AS BIGINT) AS matched,
             coalesce(count(*) FILTER (WHERE matched) / nullif(count(*), 0), 0.0) AS execution_accuracy,
             coalesce(count(*) FILTER (WHERE matched AND NOT gold_failed)
                      / nullif(count(*) FILTER (WHERE NOT gold_failed), 0), 0.0) AS execution_accuracy_valid,
             CAST(count(*) FILTER (WHERE gold_failed) AS BIGINT) AS gold_failed
      FROM {ev} GROUP BY label"""


def eval_metrics(ev: str) -> str:
    return _metrics(ev)


def _by_difficulty(ev: str) -> str:
    return f"""
      SELECT l.label, d.difficulty,
             CAST(coalesce(a.total, 0) AS BIGINT) AS total,
             CAST(coalesce(a.matched, 0) AS BIGINT) AS matched,
             coalesce(a.matched / nullif(a.total, 0), 0.0) AS accuracy
      FROM (SELECT DISTINCT label FROM {ev}) l CROSS JOIN {DIFFS}
      LEFT JOIN (SELECT label, difficulty, count(*) AS total, count(*) FILTER (WHERE matched) AS matched
                 FROM {ev} WHERE NOT gold_failed GROUP BY label, difficulty) a
        ON a.label = l.label AND a.difficulty = d.difficulty"""


def eval_by_difficulty(ev: str) -> str:
    return _by_difficulty(ev)


def eval_by_reason(ev: str) -> str:
    return f"""SELECT label, coalesce(reason, 'unknown') AS reason, CAST(count(*) AS BIGINT) AS count
               FROM {ev} GROUP BY 1, 2"""


def eval_vs_base(ev: str, base: str) -> str:
    return f"""
    WITH m AS ({_metrics(ev)}), d AS ({_by_difficulty(ev)}),
    acc AS (SELECT label, 'all' AS scope, execution_accuracy AS a, execution_accuracy_valid AS av FROM m
            UNION ALL SELECT label, difficulty, accuracy, accuracy FROM d)
    SELECT x.label, x.scope, round(x.a - b.a, 4) AS delta_accuracy, round(x.av - b.av, 4) AS delta_accuracy_valid
    FROM acc x JOIN acc b ON b.scope = x.scope AND b.label = {sql_str(base)}
    WHERE x.label <> {sql_str(base)}"""


def eval_model_rank(ev: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (ORDER BY execution_accuracy DESC, label ASC) AS BIGINT) AS rank
               FROM ({_metrics(ev)})"""


def eval_running_accuracy(ev: str) -> str:
    w = "OVER (PARTITION BY label ORDER BY example_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT label, example_idx, matched,
                      CAST(count(*) {w} AS BIGINT) AS examples_so_far,
                      CAST(sum(CAST(matched AS INTEGER)) {w} AS DOUBLE) / count(*) {w} AS running_accuracy
               FROM {ev}"""


def eval_running_throughput(ev: str) -> str:
    w = "OVER (PARTITION BY label ORDER BY example_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT label, example_idx, n AS examples_so_far,
                      CASE WHEN t = 0 THEN 0.0 ELSE ((200000 * n + t) // (2 * t)) / 100.0 END::DOUBLE AS examples_per_second
               FROM (SELECT label, example_idx, CAST(count(*) {w} AS BIGINT) AS n,
                            CAST(sum(coalesce(exec_time_ms, 0)) {w} AS BIGINT) AS t FROM {ev})"""


def _bags() -> str:
    return f"""
      g AS (SELECT query_key, list_sort(list(row_text)) AS l FROM {B.SQL_LI_GOLD} GROUP BY 1),
      c AS (SELECT query_key, list_sort(list(row_text)) AS l FROM {B.SQL_LI_CAND} GROUP BY 1)"""


def result_compare() -> str:
    return f"""WITH {_bags()}
    SELECT query_key, coalesce(g.l, []::VARCHAR[]) = coalesce(c.l, []::VARCHAR[]) AS matched
    FROM g FULL OUTER JOIN c USING (query_key)"""


def scored_candidates() -> str:
    status = "[" + ", ".join(sql_str(x) for x in B.RUN_STATUS) + "]"
    cfg = B.SCORING_REWARD
    return f"""WITH {_bags()},
    sup AS (SELECT DISTINCT l_suppkey AS s FROM lineitem),
    x AS (
      SELECT 's' || CAST(s AS VARCHAR) AS pair_id,
             s % 8 <> 7 AS gold_ok,
             {status}[s % 8 + 1] AS error_type,
             {status}[s % 8 + 1] = 'ok' AS exec_ok,
             CAST((s * 53) % 3000 AS BIGINT) AS exec_time_ms,
             (CASE WHEN s % 3 = 0 THEN {sql_str(B.STAR_SQL_HEAD)} ELSE {sql_str(B.CAND_SQL_HEAD)} END)
               || CAST(s AS VARCHAR) AS candidate_sql,
             coalesce(g.l, []::VARCHAR[]) = coalesce(c.l, []::VARCHAR[]) AS same
      FROM sup LEFT JOIN g ON g.query_key = 's' || CAST(s AS VARCHAR)
               LEFT JOIN c ON c.query_key = 's' || CAST(s AS VARCHAR)),
    y AS (
      SELECT *, gold_ok AND exec_ok AND same AS matched,
             CASE WHEN NOT gold_ok THEN 'gold_failed'
                  WHEN exec_ok AND same THEN 'match'
                  WHEN exec_ok THEN 'exec_mismatch'
                  WHEN error_type IN ('forbidden', 'timeout', 'syntax_error', 'runtime_error') THEN error_type
                  ELSE 'unknown_error' END AS reason
      FROM x)
    SELECT pair_id, matched, reason,
           {B.sql_reward('reason', 'candidate_sql', 'exec_ok', 'exec_time_ms', cfg)} AS reward,
           exec_ok, error_type, exec_time_ms
    FROM y"""
