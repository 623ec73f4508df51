"""Evaluation metrics across models.

``eval_results`` holds every model's rows with a ``label`` column, so all
models are measured in one job: group by label (and difficulty / reason).
Per-difficulty figures use only rows whose gold query ran (``gold_failed``
false); the by-reason counts use all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions.text import DIFFICULTIES, difficulty
from rewardloom.operators.ordinal import running_totals

OVERALL = "all"


def _ratio(a: str, b: str) -> Column:
    """M5: safe ratio, 0.0 when the denominator is 0."""
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def score_eval_rows(results: DataFrame, gold_sql_col: str = "gold_sql") -> DataFrame:
    """Adds ``difficulty`` (X7) and ``gold_failed`` where missing."""
    out = results
    if "difficulty" not in out.columns:
        out = out.withColumn("difficulty", difficulty(gold_sql_col))
    if "gold_failed" not in out.columns:
        out = out.withColumn("gold_failed", F.col("reason") == "gold_failed")
    return out


def metrics(results: DataFrame) -> DataFrame:
    """A6 overall per label: total, matched, execution_accuracy,
    execution_accuracy_valid, gold_failed."""
    g = results.groupBy("label").agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if(F.col("matched")).cast("long").alias("matched"),
        F.count_if(~F.col("gold_failed")).cast("long").alias("_valid_total"),
        F.count_if(F.col("matched") & ~F.col("gold_failed")).cast("long").alias("_valid_matched"),
    )
    return g.select(
        "label", "total", "matched",
        _ratio("matched", "total").alias("execution_accuracy"),
        _ratio("_valid_matched", "_valid_total").alias("execution_accuracy_valid"),
        (F.col("total") - F.col("_valid_total")).alias("gold_failed"),
    )


def _scope_counts(results: DataFrame) -> DataFrame:
    """One row per label: counts of valid rows, and of matches among them, for
    every difficulty, beside the overall counts. One pass over the rows."""
    valid = ~F.col("gold_failed")
    counts = {"total": F.lit(True), "matched": F.col("matched"), "_valid_total": valid, "_valid_matched": F.col("matched") & valid}
    for i, d in enumerate(DIFFICULTIES):
        own = valid & F.coalesce(F.col("difficulty") == d, F.lit(False))
        counts |= {f"_n{i}": own, f"_m{i}": own & F.col("matched")}
    return results.groupBy("label").agg(*[F.count_if(c).cast("long").alias(n) for n, c in counts.items()])


def metrics_by_difficulty(results: DataFrame) -> DataFrame:
    """A6 + J6: per label and difficulty (valid rows only), all four
    difficulties present with zeros where a bucket is empty."""
    buckets = F.array(*[
        F.struct(F.lit(d).alias("difficulty"), F.col(f"_n{i}").alias("total"), F.col(f"_m{i}").alias("matched"))
        for i, d in enumerate(DIFFICULTIES)
    ])
    return (
        _scope_counts(results).select("label", F.explode(buckets).alias("b")).select("label", "b.*")
        .withColumn("accuracy", _ratio("matched", "total"))
    )


def metrics_by_reason(results: DataFrame) -> DataFrame:
    """Outcome counts per label over all rows."""
    return results.groupBy("label", F.coalesce(F.col("reason"), F.lit("unknown")).alias("reason")).agg(
        F.count(F.lit(1)).cast("long").alias("count")
    )


def accuracy_table(results: DataFrame) -> DataFrame:
    """Overall and per-difficulty accuracy in one long table
    ``(label, scope, accuracy, accuracy_valid)``; scope 'all' is overall."""
    scopes = [(OVERALL, "matched", "total", "_valid_matched", "_valid_total")]
    scopes += [(d, f"_m{i}", f"_n{i}", f"_m{i}", f"_n{i}") for i, d in enumerate(DIFFICULTIES)]
    rows = F.array(*[
        F.struct(F.lit(s).alias("scope"), _ratio(m, n).alias("execution_accuracy"), _ratio(vm, vn).alias("execution_accuracy_valid"))
        for s, m, n, vm, vn in scopes
    ])
    return _scope_counts(results).select("label", F.explode(rows).alias("r")).select("label", "r.*")


def compare_with_base(results: DataFrame, base_label: str) -> DataFrame:
    """J5 + M6: per other label and scope, accuracy minus the base model's,
    rounded to 4 places. One pass over the rows; a scope has a row a model."""
    own_base = F.col("label") == base_label
    scope = Window.partitionBy("scope")
    acc = accuracy_table(results).select(
        "*",
        F.max(F.when(own_base, F.col("execution_accuracy"))).over(scope).alias("_b"),
        F.max(F.when(own_base, F.col("execution_accuracy_valid"))).over(scope).alias("_bv"),
    )
    return acc.filter(~own_base & F.col("_b").isNotNull()).select(
        "label", "scope",
        F.round(F.col("execution_accuracy") - F.col("_b"), 4).alias("delta_accuracy"),
        F.round(F.col("execution_accuracy_valid") - F.col("_bv"), 4).alias("delta_accuracy_valid"),
    )


def rank_models(results: DataFrame) -> DataFrame:
    """K3: models by accuracy, best first (label breaks ties); rank 1..n."""
    # One row a model, so one task may rank them.
    best = Window.orderBy(F.col("execution_accuracy").desc(), F.col("label").asc())
    return metrics(results).withColumn("rank", F.row_number().over(best).cast("long"))


def running_accuracy(results: DataFrame, order_col: str = "example_idx") -> DataFrame:
    """Per label, accuracy over the examples evaluated so far."""
    rt = running_totals(
        results.select("label", order_col, "matched"),
        ["label"],
        [order_col],
        {"_m": F.col("matched").cast("int")},
    )
    return rt.select(
        "label", order_col, "matched",
        F.col("_n").cast("long").alias("examples_so_far"),
        (F.col("_m") / F.col("_n")).alias("running_accuracy"),
    )


def throughput(n_examples: Column, elapsed_s: Column) -> Column:
    """W4 + M6: examples per second rounded to 2 places (0.0 on no time)."""
    return F.round(F.coalesce(F.try_divide(n_examples.cast("double"), elapsed_s.cast("double")), F.lit(0.0)), 2)


def running_throughput(results: DataFrame, order_col: str = "example_idx", time_ms: str = "exec_time_ms") -> DataFrame:
    """Per label, examples per second over the examples evaluated so far."""
    own = results.select("label", order_col, F.coalesce(F.col(time_ms), F.lit(0)).alias("_t"))
    rt = running_totals(own, ["label"], [order_col], {"_t": F.col("_t")})
    # One division of whole numbers, so that the second decimal is rounded from the exact quotient.
    rate = throughput(F.col("_n") * 1000, F.col("_t"))
    return rt.select("label", order_col, F.col("_n").cast("long").alias("examples_so_far"), rate.alias("examples_per_second"))


def eval_rows(scored: DataFrame, label: str | Column) -> DataFrame:
    """D11 rows from scored candidates (one prediction per example), with the
    M4 fallback: a row whose runs name a missing database could not be
    scored and becomes ``eval_error`` with reward 0.0."""
    lab = F.lit(label) if isinstance(label, str) else label
    missing = F.coalesce(F.col("error_message").startswith("Database not found"), F.lit(False))
    out = scored.withColumn("label", lab).withColumn("_m4", missing)
    out = (
        out.withColumn("matched", F.when(F.col("_m4"), F.lit(False)).otherwise(F.col("matched")))
        .withColumn("reward", F.when(F.col("_m4"), F.lit(0.0)).otherwise(F.col("reward")))
        .withColumn("reason", F.when(F.col("_m4"), F.lit("eval_error")).otherwise(F.col("reason")))
        .withColumn("error_type", F.when(F.col("_m4"), F.lit("unknown_error")).otherwise(F.col("error_type")))
        .withColumn("gold_failed", ~F.col("_m4") & (F.col("reason") == "gold_failed"))
        .drop("_m4")
    )
    if "difficulty" not in out.columns and "gold_sql" in out.columns:
        out = out.withColumn("difficulty", difficulty("gold_sql"))
    return out


def metrics_summary(results: DataFrame) -> DataFrame:
    """D12 for the one-document JSON sink (S4): one row per label with the
    overall figures, ``by_difficulty`` map<difficulty, struct<total, matched,
    accuracy>> and ``by_reason`` map<reason, count>. Each map holds at most
    4 / 9 entries, whatever the data size."""
    by_diff = metrics_by_difficulty(results).groupBy("label").agg(
        F.map_from_entries(
            F.collect_list(F.struct("difficulty", F.struct("total", "matched", "accuracy")))
        ).alias("by_difficulty")
    )
    by_reason = metrics_by_reason(results).groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("reason", "count"))).alias("by_reason")
    )
    return metrics(results).join(by_diff, "label").join(by_reason, "label")


def comparison_summary(results: DataFrame, base_label: str) -> DataFrame:
    """Per non-base label, overall deltas and ``delta_by_difficulty``."""
    d = compare_with_base(results, base_label)
    overall = d.filter(F.col("scope") == OVERALL).select("label", "delta_accuracy", "delta_accuracy_valid")
    per_diff = d.filter(F.col("scope") != OVERALL).groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("scope", "delta_accuracy"))).alias("delta_by_difficulty")
    )
    return overall.join(per_diff, "label")
