"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the
driver's tables, paired with a DuckDB statement over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rewardloom.operators import evaluate as EV
from rewardloom.operators.compare import compare_result_sets
from rewardloom.operators.preferences import PreferenceConfig, build_preferences, flatten_pairs
from rewardloom.operators.rollouts import rollout_stats, score_candidates
from rewardloom.plans import bindings as B
from rewardloom.plans import oracle as O
from rewardloom.plans import oracle_more as O2
from rewardloom.plans import sqltext as S
from rewardloom.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]

PREF_DEFAULT = PreferenceConfig()
PREF_TIES = PreferenceConfig(
    min_reward_gap=0.5, allow_ties=True, max_pairs_per_example=3, require_chosen_matched=False
)
PREF_CAPPED = PreferenceConfig(max_examples=1000)


def _rollouts(spark: SparkSession, sf_dir: str, by_day: bool) -> DataFrame:
    return B.rollouts_from_events(B.table(spark, sf_dir, "events"), by_day=by_day)


def _prefs(by_day: bool, cfg: PreferenceConfig) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_pairs(build_preferences(_rollouts(spark, sf_dir, by_day), cfg).pairs)

    return q


def _pref_stats(by_day: bool, cfg: PreferenceConfig) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build_preferences(_rollouts(spark, sf_dir, by_day), cfg).stats

    return q


def _eval(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(B.eval_results_from_events(B.table(spark, sf_dir, "events")))

    return q


def _rollout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout_stats(_rollouts(spark, sf_dir, True))


def _result_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, cand = B.result_sets_from_lineitem(B.table(spark, sf_dir, "lineitem"))
    return compare_result_sets(gold, cand)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands, runs, rows = B.scoring_inputs_from_lineitem(B.table(spark, sf_dir, "lineitem"))
    return score_candidates(cands, runs, rows, B.SCORING_REWARD).select(
        "pair_id", "matched", "reason", "reward", "exec_ok", "error_type", "exec_time_ms"
    )


def _gens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.generations_from_tables(
        B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "conversations")
    )


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gens(spark, sf_dir).select("source", "gen_id", T.extract_sql("text").alias("sql"))


def _fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gens(spark, sf_dir).select("source", "gen_id", T.strip_code_fences("text").alias("stripped"))


def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gens(spark, sf_dir).withColumn("sql", T.extract_sql("text"))
    g = T.add_validation(g, "text", "text_reason", "text_valid")
    g = T.add_validation(g, "sql", "sql_reason", "sql_valid")
    return g.select("source", "gen_id", "text_valid", "text_reason", "sql_valid", "sql_reason")


def _difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gens(spark, sf_dir).withColumn("sql", T.extract_sql("text"))
    g = T.add_difficulty(T.add_difficulty(g, "text", "text_difficulty"), "sql", "sql_difficulty")
    return g.select("source", "gen_id", "text_difficulty", "sql_difficulty")


def _tokens_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gens(spark, sf_dir).select(
        "source", "gen_id",
        T.sql_token_count("text").alias("n_tokens"),
        T.uses_select_star("text").alias("select_star"),
        T.uses_select_star("text", "literal").alias("select_star_literal"),
    )


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.error_log_from_tables(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "events"))
    return log.select("log_id", "exception_class", T.classify_error("exception_class", "message").alias("error_type"))


def queries() -> dict[str, Query]:
    from rewardloom.plans import file_queries as FQ
    from rewardloom.plans import guard_queries as GQ
    from rewardloom.plans import rollout_queries as RQ
    from rewardloom.plans import token_queries as TQ

    return {
        "preferences_by_user": _prefs(False, PREF_DEFAULT),
        "preferences_by_user_day_ties": _prefs(True, PREF_TIES),
        "preference_stats_by_user_day": _pref_stats(True, PREF_DEFAULT),
        "preference_stats_by_user_day_ties": _pref_stats(True, PREF_TIES),
        "preference_stats_capped": _pref_stats(True, PREF_CAPPED),
        "extract_sql": _extract,
        "strip_code_fences": _fences,
        "validate_sql": _validate,
        "sql_difficulty": _difficulty,
        "sql_tokens_star": _tokens_star,
        "classify_error": _errors,
        "rollout_stats": _rollout_stats,
        "eval_metrics": _eval(EV.metrics),
        "eval_by_difficulty": _eval(EV.metrics_by_difficulty),
        "eval_by_reason": _eval(EV.metrics_by_reason),
        "eval_vs_base": _eval(lambda r: EV.compare_with_base(r, "base")),
        "eval_model_rank": _eval(EV.rank_models),
        "eval_running_accuracy": _eval(EV.running_accuracy),
        "eval_running_throughput": _eval(EV.running_throughput),
        "result_compare": _result_compare,
        "scored_candidates": _scored,
        **RQ.queries(),
        **TQ.queries(),
        **FQ.queries(),
        **GQ.queries(),
    }


def oracle_sql() -> dict[str, str]:
    r_user = B.sql_rollouts_from_events(by_day=False)
    r_day = B.sql_rollouts_from_events(by_day=True)
    ev = B.sql_eval_results_from_events()
    from rewardloom.plans import token_queries as TQ

    gens = B.sql_generations()
    ex = S.extract_sql_staged(gens)
    from rewardloom.plans import file_queries as FQ
    from rewardloom.plans import guard_queries as GQ
    from rewardloom.plans import rollout_queries as RQ

    return {
        **FQ.oracle_sql(),
        **TQ.oracle_sql(),
        **GQ.oracle_sql(),
        **RQ.oracle_sql(),
        "extract_sql": f"SELECT source, gen_id, sql FROM {ex}",
        "strip_code_fences": f"SELECT source, gen_id, {S.strip_code_fences('text')} AS stripped FROM {gens}",
        "validate_sql": f"""SELECT source, gen_id,
               {S.validation_reason('text')} IS NULL AS text_valid, {S.validation_reason('text')} AS text_reason,
               {S.validation_reason('sql')} IS NULL AS sql_valid, {S.validation_reason('sql')} AS sql_reason
            FROM {ex}""",
        "sql_difficulty": f"""SELECT source, gen_id, {S.difficulty('text')} AS text_difficulty,
               {S.difficulty('sql')} AS sql_difficulty FROM {ex}""",
        "sql_tokens_star": f"""SELECT source, gen_id, {S.token_count('text')} AS n_tokens,
               {S.star('text')} AS select_star, {S.star('text', literal=True)} AS select_star_literal FROM {gens}""",
        "classify_error": f"""SELECT log_id, exception_class,
               CASE WHEN exception_class = 'OperationalError' THEN
                      CASE WHEN contains(lower(coalesce(message, '')), 'interrupted') THEN 'timeout'
                           WHEN contains(lower(coalesce(message, '')), 'syntax error')
                             OR contains(lower(coalesce(message, '')), 'near') THEN 'syntax_error'
                           ELSE 'runtime_error' END
                    WHEN exception_class = 'ProgrammingError' THEN 'forbidden'
                    ELSE 'unknown_error' END AS error_type
            FROM {B.sql_error_log()}""",
        "rollout_stats": O2.rollout_stats(r_day),
        "eval_metrics": O2.eval_metrics(ev),
        "eval_by_difficulty": O2.eval_by_difficulty(ev),
        "eval_by_reason": O2.eval_by_reason(ev),
        "eval_vs_base": O2.eval_vs_base(ev, "base"),
        "eval_model_rank": O2.eval_model_rank(ev),
        "eval_running_accuracy": O2.eval_running_accuracy(ev),
        "eval_running_throughput": O2.eval_running_throughput(ev),
        "result_compare": O2.result_compare(),
        "scored_candidates": O2.scored_candidates(),
        "preferences_by_user": O.preferences(r_user, PREF_DEFAULT),
        "preferences_by_user_day_ties": O.preferences(r_day, PREF_TIES),
        "preference_stats_by_user_day": O.preference_stats(r_day, PREF_DEFAULT),
        "preference_stats_by_user_day_ties": O.preference_stats(r_day, PREF_TIES),
        "preference_stats_capped": O.preference_stats(r_day, PREF_CAPPED),
    }
