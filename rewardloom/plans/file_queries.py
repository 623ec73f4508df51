"""Files end to end (S2, S3, S6, P3) on data Spark derives from the tables:
preference pairs are written as ordered JSON lines into the shared
checkpoint folder and loaded back with the preference loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rewardloom.operators.preferences import build_preferences
from rewardloom.plans import bindings as B
from rewardloom.plans import oracle as O
from rewardloom.session import scratch_table_path
from rewardloom.sources import io as IO

LOAD_CAP = 2000


def written_pairs(spark: SparkSession, sf_dir: str) -> str:
    from rewardloom.plans.registry import PREF_TIES, _rollouts

    res = build_preferences(_rollouts(spark, sf_dir, True), PREF_TIES)
    path = scratch_table_path(spark, "preferences-jsonl")
    IO.write_jsonl(
        res.ordered_pairs.drop("meta"),
        path,
        order_by=["id", "group_ord", "pair_idx"],
    )
    return path


def preference_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = IO.load_preferences(spark, written_pairs(spark, sf_dir))
    return kept


def preference_file_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader's ``max_examples``."""
    kept, _ = IO.load_preferences(spark, written_pairs(spark, sf_dir), max_examples=LOAD_CAP)
    return kept


def queries() -> dict:
    return {"preference_file_rows": preference_file_rows, "preference_file_first": preference_file_first}


def oracle_sql() -> dict:
    from rewardloom.plans.registry import PREF_TIES

    rollouts = B.sql_rollouts_from_events(by_day=True)
    return {
        "preference_file_rows": O.preference_file_rows(rollouts, PREF_TIES, None),
        "preference_file_first": O.preference_file_rows(rollouts, PREF_TIES, LOAD_CAP),
    }
