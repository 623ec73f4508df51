"""Scoring candidates and assembling rollouts (SURVEY Q5, J2, M3, M4, P4, P7,
P8, A4).

Inputs are tables, not single queries: ``runs(query_key, ok, error_type,
error_message, row_count, truncated, elapsed_ms)`` and ``result_rows(query_key,
cells)`` as written by the guarded runner (``operators.guard``), one row per
*distinct* query, so a gold query shared by many candidates runs once (A9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.operators.compare import bag_differences
from rewardloom.operators.reward import RewardConfig, error_reason, reward

ROLLOUT_COLUMNS = (
    "id", "candidate_id", "db_id", "prompt", "gold_sql", "candidate_sql", "reward", "matched",
    "valid", "exec_ok", "error_type", "error_message", "exec_time_ms", "truncated", "reason",
)


def example_id(split: str, idx) -> Column:
    """``"{split}-{idx:06d}"`` from the position before filtering."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.format_string("%s-%06d", F.lit(split), i.cast("long"))


def gold_gate(examples: DataFrame, runs: DataFrame, keep_empty_gold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keep examples whose gold query ran and (unless ``keep_empty_gold``)
    returned at least one row. Returns (kept examples, one-row counts)."""
    gr = runs.select(
        F.col("query_key").alias("gold_key"),
        F.col("ok").alias("_gold_ok"),
        F.col("row_count").alias("_gold_rows"),
    )
    j = examples.join(gr, "gold_key", "left").withColumn("_gold_ok", F.coalesce("_gold_ok", F.lit(False)))
    nonempty = F.coalesce(F.col("_gold_rows"), F.lit(0)) > 0
    keep = F.col("_gold_ok") & (F.lit(keep_empty_gold) | nonempty)
    kept = j.filter(keep).drop("_gold_ok", "_gold_rows")
    counts = j.agg(
        F.count(F.lit(1)).alias("examples_read"),
        F.count_if(~F.col("_gold_ok")).alias("skipped_gold_failed"),
        F.count_if(F.col("_gold_ok") & ~nonempty & F.lit(not keep_empty_gold)).alias("skipped_empty_gold"),
        F.count_if(keep).alias("examples_kept"),
    )
    return kept, counts


def score_candidates(
    candidates: DataFrame,
    runs: DataFrame,
    result_rows: DataFrame,
    cfg: RewardConfig = RewardConfig(),
    strict_gold: bool = False,
) -> DataFrame:
    """``candidates(pair_id, gold_key, cand_key, candidate_sql, ...)``
    (unique pair_id)
    -> + exec_ok, error_type, error_message, exec_time_ms, truncated,
    matched, reason, reward.

    A candidate whose gold run failed is ``gold_failed`` with the flat
    unknown_error reward (M3); with ``strict_gold`` such a row fails the job.
    A missing run row counts as an unknown_error run (M4's missing database).
    """
    gr = runs.select(
        F.col("query_key").alias("gold_key"),
        F.col("ok").alias("gold_ok"),
        F.col("error_type").alias("gold_error_type"),
    )
    cr = runs.select(
        F.col("query_key").alias("cand_key"),
        F.col("ok").alias("exec_ok"),
        F.col("error_type"),
        F.col("error_message"),
        F.col("elapsed_ms").alias("exec_time_ms"),
        F.col("truncated"),
    )
    j = (
        candidates.join(gr, "gold_key", "left")
        .join(cr, "cand_key", "left")
        .withColumn("gold_ok", F.coalesce("gold_ok", F.lit(False)))
        .withColumn("exec_ok", F.coalesce("exec_ok", F.lit(False)))
        .withColumn("error_type", F.coalesce("error_type", F.lit("unknown_error")))
        .withColumn("error_message", F.coalesce("error_message", F.lit("")))
        .withColumn("exec_time_ms", F.coalesce("exec_time_ms", F.lit(0)).cast("long"))
        .withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    )
    if strict_gold:
        # Fails the job (inside the same pass) on the first failed gold run.
        j = j.withColumn(
            "gold_ok",
            F.when(
                ~F.col("gold_ok"),
                F.raise_error(F.concat(F.lit("Gold SQL failed for "), F.col("pair_id"), F.lit(": "), F.col("gold_key"))),
            ).otherwise(F.col("gold_ok")),
        )
    both = j.filter(F.col("gold_ok") & F.col("exec_ok")).select("pair_id", "gold_key", "cand_key")
    differs = bag_differences(both, result_rows, result_rows).withColumn("_differs", F.lit(True))
    out = j.join(differs, "pair_id", "left")
    matched = F.col("gold_ok") & F.col("exec_ok") & F.col("_differs").isNull()
    reason = (
        F.when(~F.col("gold_ok"), F.lit("gold_failed"))
        .when(matched, F.lit("match"))
        .when(F.col("exec_ok"), F.lit("exec_mismatch"))
        .otherwise(error_reason(F.col("error_type")))
    )
    return (
        out.withColumn("matched", matched)
        .withColumn("reason", reason)
        .withColumn("reward", reward("reason", "candidate_sql", "exec_ok", "exec_time_ms", cfg))
        .drop("_differs", "gold_error_type")
    )


def assemble_rollouts(scored: DataFrame) -> DataFrame:
    """The rollout record. Syntax and runtime errors stay valid; only
    forbidden candidates are invalid."""
    return scored.select(
        "id",
        F.col("candidate_id").cast("long").alias("candidate_id"),
        "db_id", "prompt", "gold_sql", "candidate_sql",
        F.col("reward").cast("double").alias("reward"),
        F.col("matched").cast("boolean").alias("matched"),
        (F.col("error_type") != "forbidden").alias("valid"),
        F.col("exec_ok").cast("boolean").alias("exec_ok"),
        "error_type", "error_message",
        F.col("exec_time_ms").cast("long").alias("exec_time_ms"),
        F.col("truncated").cast("boolean").alias("truncated"),
        "reason",
    )


def rollout_stats(rollouts: DataFrame, example_col: str = "id") -> DataFrame:
    """A4: candidates, matches, match rate; examples done / with a match.
    Rates are 0.0 on empty input (M5)."""
    per_example = rollouts.groupBy(example_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("matched")).alias("_m"),
    )
    totals = per_example.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("candidates_kept"),
        F.coalesce(F.sum("_m"), F.lit(0)).cast("long").alias("matches"),
        F.count(F.lit(1)).cast("long").alias("examples_done"),
        F.count_if(F.col("_m") > 0).cast("long").alias("examples_with_match"),
    )
    return totals.select(
        "*",
        F.coalesce(F.try_divide(F.col("matches"), F.col("candidates_kept")), F.lit(0.0)).cast("double").alias("match_rate"),
        F.coalesce(F.try_divide(F.col("examples_with_match"), F.col("examples_done")), F.lit(0.0))
        .cast("double")
        .alias("example_match_rate"),
    )


def score_sql_pairs(
    spark,
    pairs: DataFrame,
    catalog,
    reward_cfg: RewardConfig = RewardConfig(),
    guard_cfg=None,
    strict_gold: bool = False,
    out_dir: str | None = None,
):
    """Q5 end to end: ``pairs(pair_id, db_id, gold_sql, candidate_sql, ...)``
    -> guarded runs of every distinct gold and candidate query (Q1, A9) ->
    scored pairs (J2, A1, M1-M3). Returns ``(scored, run_result)``."""
    from rewardloom.operators.guard import GuardConfig, QueryRunner

    queries = pairs.select("db_id", F.col("gold_sql").alias("sql")).unionByName(
        pairs.select("db_id", F.col("candidate_sql").alias("sql"))
    )
    run = QueryRunner(spark, catalog, guard_cfg or GuardConfig(), out_dir=out_dir).run(queries)
    keys = run.queries.select(
        F.col("db_id").alias("_db"), F.col("sql").alias("_sql"), "query_key"
    ).dropDuplicates(["query_key"])

    def attach(df: DataFrame, sql_col: str, out: str) -> DataFrame:
        on = F.col("db_id").eqNullSafe(F.col("_db")) & F.col(sql_col).eqNullSafe(F.col("_sql"))
        return df.join(keys, on, "left").drop("_db", "_sql").withColumnRenamed("query_key", out)

    p = attach(attach(pairs, "gold_sql", "gold_key"), "candidate_sql", "cand_key")
    return score_candidates(p, run.runs, run.result_rows, reward_cfg, strict_gold), run
