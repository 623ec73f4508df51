"""DuckDB statements that restate each operator directly, for the driver's
side-by-side check. They follow the reference's rules literally (full-group
windows, per-row tests) rather than our Spark plans, so an agreement is a real
cross-check of the Spark formulation.
"""

from __future__ import annotations

from rewardloom.functions import text as T
from rewardloom.operators.preferences import PreferenceConfig
from rewardloom.plans.bindings import sql_str

K = "id, db_id, prompt"
WS = sql_str(T.WS)


def sql_ensure_im_end(expr: str) -> str:
    s = f"trim(coalesce({expr}, ''), {WS})"
    end = sql_str(T.IM_END)
    return f"(CASE WHEN {s} = '' THEN {end} WHEN ends_with({s}, {end}) THEN {s} ELSE {s} || {end} END)"


def _rows(rollouts_sql: str, cfg: PreferenceConfig) -> str:
    elig = "TRUE"
    if cfg.require_valid_sql:
        elig += " AND valid"
    if cfg.require_exec_ok:
        elig += " AND exec_ok"
    key_ok = (
        "coalesce(id IS NOT NULL AND id <> '' AND db_id IS NOT NULL AND db_id <> '' "
        "AND prompt IS NOT NULL AND prompt <> '', FALSE)"
    )
    return f"""
    raw AS (
      SELECT id, db_id, prompt, coalesce(reward, 0.0) AS reward,
             coalesce(candidate_id, 0) AS candidate_id, coalesce(valid, FALSE) AS valid,
             coalesce(exec_ok, FALSE) AS exec_ok, coalesce(matched, FALSE) AS matched,
             candidate_sql, coalesce(error_type, '') AS error_type, ord,
             {key_ok} AS key_ok
      FROM {rollouts_sql}),
    g AS (
      SELECT {K}, min(ord) AS gord, count(*) AS n_rows, bool_or(key_ok) AS key_ok
      FROM raw GROUP BY {K}),
    seen AS (
      SELECT {K} FROM g WHERE key_ok
      {"QUALIFY row_number() OVER (ORDER BY id, gord) <= " + str(cfg.max_examples) if cfg.max_examples else ""}),
    rows AS (
      SELECT raw.*, ({elig}) AS elig FROM raw JOIN seen USING ({K}))"""


def _pairs_ctes(rollouts_sql: str, cfg: PreferenceConfig) -> str:
    m = repr(float(cfg.min_reward_gap))
    ties = "TRUE" if cfg.allow_ties else "FALSE"
    need_match = "AND matched" if cfg.require_chosen_matched else ""
    return f"""WITH {_rows(rollouts_sql, cfg)},
    e AS (
      SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY reward DESC, exec_ok DESC,
                 valid DESC, candidate_id ASC, ord ASC) AS rk,
             count(*) OVER (PARTITION BY {K}) AS n_elig
      FROM rows WHERE elig),
    ch AS (SELECT * FROM e WHERE rk = 1 AND n_elig >= 2 {need_match}),
    c AS (
      SELECT e.id, e.db_id, e.prompt, e.rk, e.reward, e.candidate_id, e.candidate_sql, e.error_type,
             ch.reward AS c_reward, ch.candidate_id AS c_cid, ch.candidate_sql AS c_sql,
             ch.error_type AS c_et, ch.reward - e.reward AS gap
      FROM e JOIN ch ON e.id = ch.id AND e.db_id = ch.db_id AND e.prompt = ch.prompt
      WHERE e.rk > 1),
    s AS (
      SELECT *, max(CASE WHEN gap < {m} AND NOT ({ties} AND gap = 0) THEN 1 ELSE 0 END)
               OVER (PARTITION BY {K} ORDER BY rk DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
      FROM c),
    p AS (
      SELECT * FROM s WHERE stopped = 0 AND ({ties} OR gap > 0)
      QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY rk DESC) <= {int(cfg.max_pairs_per_example)})"""


def preferences(rollouts_sql: str, cfg: PreferenceConfig) -> str:
    return f"""{_pairs_ctes(rollouts_sql, cfg)}
    SELECT id, db_id, prompt,
           {sql_ensure_im_end('c_sql')} AS chosen,
           {sql_ensure_im_end('candidate_sql')} AS rejected,
           c_reward AS chosen_reward, reward AS rejected_reward, gap AS reward_gap,
           c_cid AS chosen_candidate_id, candidate_id AS rejected_candidate_id,
           c_et AS chosen_error_type, error_type AS rejected_error_type
    FROM p"""


def preference_stats(rollouts_sql: str, cfg: PreferenceConfig) -> str:
    need_match = "TRUE" if cfg.require_chosen_matched else "FALSE"
    return f"""{_pairs_ctes(rollouts_sql, cfg)},
    np AS (SELECT {K}, count(*) AS n_pairs FROM p GROUP BY {K}),
    gs AS (
      SELECT {K}, count(*) AS n_rows, count(*) FILTER (WHERE elig) AS n_elig,
             coalesce(bool_or(elig AND matched), FALSE) AS any_m
      FROM rows GROUP BY {K}),
    o AS (
      SELECT gs.*, coalesce(np.n_pairs, 0) AS n_pairs,
             CASE WHEN n_rows < 2 THEN 'small_group'
                  WHEN coalesce(np.n_pairs, 0) > 0 THEN 'written'
                  WHEN n_elig < 2 THEN 'no_valid'
                  WHEN {need_match} AND NOT any_m THEN 'chosen_not_matched'
                  ELSE 'gap' END AS outcome
      FROM gs LEFT JOIN np USING ({K}))
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM raw) AS rollouts_read,
           CAST(count(*) AS BIGINT) AS examples_seen,
           CAST(count(*) FILTER (WHERE outcome = 'small_group') AS BIGINT) AS examples_skipped_small_group,
           CAST(count(*) FILTER (WHERE outcome = 'gap') AS BIGINT) AS examples_skipped_gap,
           CAST(count(*) FILTER (WHERE outcome = 'no_valid') AS BIGINT) AS examples_skipped_no_valid,
           CAST(coalesce(sum(n_pairs), 0) AS BIGINT) AS preferences_written,
           CAST(count(*) FILTER (WHERE outcome = 'chosen_not_matched') AS BIGINT) AS examples_skipped_chosen_not_matched
    FROM o"""


def preference_file_rows(rollouts_sql: str, cfg: PreferenceConfig, max_examples: int | None) -> str:
    """Pairs in file order (groups by id then first appearance, pairs in walk
    order), first ``max_examples`` records, fields trimmed, incomplete dropped."""
    trimmed = ", ".join(f"trim(coalesce({c}, ''), {WS}) AS {c}" for c in ("prompt", "chosen", "rejected"))
    return f"""{_pairs_ctes(rollouts_sql, cfg)},
    out AS (
      SELECT p.id, p.db_id, p.prompt, {sql_ensure_im_end('p.c_sql')} AS chosen,
             {sql_ensure_im_end('p.candidate_sql')} AS rejected,
             row_number() OVER (ORDER BY p.id, g.gord, p.rk DESC) - 1 AS ord
      FROM p JOIN g ON g.id = p.id AND g.db_id = p.db_id AND g.prompt = p.prompt),
    capped AS (SELECT CAST(ord AS BIGINT) AS ord, {trimmed} FROM out{'' if max_examples is None else f' WHERE ord < {int(max_examples)}'})
    SELECT * FROM capped WHERE prompt <> '' AND chosen <> '' AND rejected <> ''"""
