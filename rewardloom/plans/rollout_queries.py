"""E2 end to end on the driver's tables: examples -> example ids (P4) ->
gold gate (P7) -> scored candidates (Q5) -> rollout records (P8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions import text as T
from rewardloom.operators.ordinal import with_global_rank
from rewardloom.operators.rollouts import assemble_rollouts, example_id, gold_gate, score_candidates
from rewardloom.plans import bindings as B
from rewardloom.plans.bindings import sql_str

SPLIT = "train"


def rollouts_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    cands, runs, rows = B.scoring_inputs_from_lineitem(li)
    ex = with_global_rank(B.examples_from_lineitem(li), ["_order"], name="_idx")
    ex = ex.withColumn("id", example_id(SPLIT, F.col("_idx") - 1))
    kept, _ = gold_gate(ex, runs)
    prompts = kept.withColumn("prompt", T.chatml_prompt(F.lit(B.EVENTS_SCHEMA_TEXT), F.col("question")))
    scored = score_candidates(
        cands.join(prompts.select("pair_id", "id", "db_id", "prompt", "gold_sql"), "pair_id").withColumn(
            "candidate_id", F.lit(0)
        ),
        runs,
        rows,
        B.SCORING_REWARD,
        strict_gold=True,
    )
    return assemble_rollouts(scored).select(
        "id", "candidate_id", "db_id", "reward", "matched", "valid", "exec_ok", "error_type", "exec_time_ms", "reason"
    )


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    _, runs, _ = B.scoring_inputs_from_lineitem(li)
    _, counts = gold_gate(B.examples_from_lineitem(li), runs)
    return counts.select(*[F.col(c).cast("long") for c in counts.columns])


def queries() -> dict:
    return {"rollouts_from_runs": rollouts_from_runs, "gold_gate_counts": gate_counts}


def oracle_sql() -> dict:
    from rewardloom.plans.oracle_more import scored_candidates

    ex = f"""(SELECT l_suppkey AS s,
             printf('%s-%06d', {sql_str(SPLIT)}, row_number() OVER (ORDER BY l_suppkey) - 1) AS id,
             'db' || CAST(l_suppkey % 10 AS VARCHAR) AS db_id,
             l_suppkey % 8 <> 7 AS gold_ok,
             (SELECT count(*) FROM lineitem x WHERE x.l_suppkey = d.l_suppkey) AS gold_rows
          FROM (SELECT DISTINCT l_suppkey FROM lineitem) d)"""
    rollouts = f"""SELECT e.id, CAST(0 AS BIGINT) AS candidate_id, e.db_id, c.reward, c.matched,
             c.error_type <> 'forbidden' AS valid, c.exec_ok, c.error_type, c.exec_time_ms, c.reason
          FROM {ex} e JOIN ({scored_candidates()}) c ON c.pair_id = 's' || CAST(e.s AS VARCHAR)
          WHERE e.gold_ok AND e.gold_rows > 0"""
    counts = f"""SELECT CAST(count(*) AS BIGINT) AS examples_read,
             CAST(count(*) FILTER (WHERE NOT gold_ok) AS BIGINT) AS skipped_gold_failed,
             CAST(count(*) FILTER (WHERE gold_ok AND gold_rows = 0) AS BIGINT) AS skipped_empty_gold,
             CAST(count(*) FILTER (WHERE gold_ok AND gold_rows > 0) AS BIGINT) AS examples_kept
          FROM {ex}"""
    return {"rollouts_from_runs": rollouts, "gold_gate_counts": counts}
