"""The three end-to-end jobs, composed from the
operators, with file sinks. Each returns the DataFrames it wrote so callers
can inspect them; nothing is collected except the one-row stats documents.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions import text as TX
from rewardloom.operators import evaluate as EV
from rewardloom.operators.guard import Catalog, GuardConfig, QueryRunner
from rewardloom.operators.preferences import PreferenceConfig, build_preferences
from rewardloom.operators.reward import RewardConfig
from rewardloom.operators.rollouts import (
    assemble_rollouts,
    example_id,
    gold_gate,
    rollout_stats,
    score_candidates,
    score_sql_pairs,
)
from rewardloom.operators.schema_text import require_fields
from rewardloom.sources import io as IO

ROLLOUT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("candidate_id", T.LongType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("gold_sql", T.StringType()),
        T.StructField("candidate_sql", T.StringType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("matched", T.BooleanType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("exec_ok", T.BooleanType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("exec_time_ms", T.LongType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)


def preferences_job(spark: SparkSession, rollouts_path: str, out_dir: str, cfg: PreferenceConfig = PreferenceConfig()) -> DataFrame:
    """Rollouts JSONL -> preferences JSONL (groups by id, pairs in walk
    order) + ``run_meta`` document with config and the seven counters."""
    rollouts = IO.read_jsonl(spark, rollouts_path, ROLLOUT_SCHEMA)
    res = build_preferences(rollouts, cfg)
    IO.write_jsonl(res.ordered_pairs, f"{out_dir}/preferences", order_by=["id", "group_ord", "pair_idx"])
    stats = res.stats.first().asDict()
    IO.write_json_document(
        spark, {"input_rollouts": rollouts_path, "config": dataclasses.asdict(cfg), "stats": stats}, f"{out_dir}/run_meta"
    )
    return spark.read.schema(res.ordered_pairs.schema).json(f"{out_dir}/preferences")


def _gold_and_candidate_queries(examples: DataFrame, candidates: DataFrame) -> DataFrame:
    gold = examples.select("db_id", F.col("sql").alias("sql"))
    cand = candidates.select("db_id", F.col("candidate_sql").alias("sql"))
    return gold.unionByName(cand)


def rollouts_job(
    spark: SparkSession,
    examples: DataFrame,
    generations: DataFrame,
    catalog: Catalog,
    out_dir: str,
    split: str = "train",
    reward_cfg: RewardConfig = RewardConfig(),
    guard_cfg: GuardConfig = GuardConfig(),
    keep_empty_gold: bool = False,
    max_examples: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Examples ``(question, sql, db_id, schema, ord)`` + generations
    ``(ord, candidate_id, text)`` -> rollouts + stats.

    Example ids come from the position before filtering (P4); examples with
    an empty field are skipped (P2); the gold query must run and (unless
    ``keep_empty_gold``) return rows (P7); each distinct query runs once."""
    ex = IO.first_n(examples, max_examples).withColumn("id", example_id(split, "ord"))
    ex, _ = require_fields(ex, ["question", "schema", "sql", "db_id"])
    ex = ex.withColumn("prompt", TX.chatml_prompt("schema", "question"))
    cands = generations.join(ex.select("ord", "id", "db_id", "prompt", F.col("sql").alias("gold_sql")), "ord").withColumn(
        "candidate_sql", F.coalesce(TX.extract_sql("text"), F.lit(""))
    )
    runner = QueryRunner(spark, catalog, guard_cfg, out_dir=f"{out_dir}/runs")
    run = runner.run(_gold_and_candidate_queries(ex, cands))
    keys = run.queries.select("db_id", "sql", "query_key").dropDuplicates(["query_key"])
    ex_k = ex.join(keys.withColumnRenamed("sql", "_s"), (ex.db_id == keys.db_id) & (ex.sql == F.col("_s"))).select(
        ex["*"], F.col("query_key").alias("gold_key")
    )
    kept, gate = gold_gate(ex_k, run.runs, keep_empty_gold)
    c_k = cands.join(keys.withColumnRenamed("sql", "_s"), (cands.db_id == keys.db_id) & (cands.candidate_sql == F.col("_s"))).select(
        cands["*"], F.col("query_key").alias("cand_key")
    )
    c_k = c_k.join(kept.select("id", "gold_key"), "id").withColumn(
        "pair_id", F.concat_ws("#", F.col("id"), F.col("candidate_id").cast("string"))
    )
    scored = score_candidates(c_k, run.runs, run.result_rows, reward_cfg, strict_gold=True)
    rollouts = assemble_rollouts(scored)
    IO.write_jsonl(rollouts, f"{out_dir}/rollouts", order_by=["id", "candidate_id"])
    written = spark.read.schema(ROLLOUT_SCHEMA).json(f"{out_dir}/rollouts")
    stats = rollout_stats(written)
    # ``candidates`` counts them before the gold gate, ``candidates_kept`` after it.
    totals = {"candidates": cands.count(), **stats.first().asDict(), **gate.first().asDict()}
    IO.write_json_document(spark, totals, f"{out_dir}/run_meta")
    return written, stats


def evaluate_job(
    spark: SparkSession,
    examples: DataFrame,
    predictions: DataFrame,
    catalog: Catalog,
    out_dir: str,
    base_label: str | None = None,
    reward_cfg: RewardConfig = RewardConfig(),
    guard_cfg: GuardConfig = GuardConfig(),
    max_examples: int | None = None,
) -> DataFrame:
    """Examples ``(ord, question, sql, db_id)`` + predictions ``(label,
    ord, text)`` -> per-example eval rows (D11), metrics per label, deltas vs
    ``base_label`` and a summary document. All models in one job."""
    ex, _ = require_fields(IO.first_n(examples, max_examples), ["question", "sql", "db_id"])
    preds = predictions.join(ex.select("ord", "question", "db_id", F.col("sql").alias("gold_sql")), "ord").withColumn(
        "candidate_sql", F.coalesce(TX.extract_sql("text"), F.lit(""))
    )
    pairs = preds.withColumn("pair_id", F.concat_ws("#", F.col("label"), F.col("ord").cast("string")))
    scored, _ = score_sql_pairs(spark, pairs, catalog, reward_cfg, guard_cfg, strict_gold=False, out_dir=f"{out_dir}/runs")
    rows = EV.eval_rows(scored.withColumnRenamed("candidate_sql", "predicted_sql"), F.col("label")).withColumnRenamed(
        "ord", "example_idx"
    )
    rows = rows.select("label", "example_idx", "question", "db_id", "gold_sql", "predicted_sql", "matched", "reward",
                       "reason", "error_type", "difficulty", "gold_failed")
    IO.write_jsonl(rows, f"{out_dir}/eval_results", order_by=["label", "example_idx"])
    results = spark.read.schema(rows.schema).json(f"{out_dir}/eval_results")
    EV.metrics_summary(results).coalesce(1).write.mode("overwrite").json(f"{out_dir}/metrics")
    if base_label is not None:
        EV.comparison_summary(results, base_label).coalesce(1).write.mode("overwrite").json(f"{out_dir}/comparison")
    ranked = EV.rank_models(results)
    ranked.write.mode("overwrite").json(f"{out_dir}/ranking")
    return results


__all__ = ["preferences_job", "rollouts_job", "evaluate_job"]
