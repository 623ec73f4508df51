"""Preference pairs from rollouts.

Semantics (per example group ``(id, db_id, prompt)``):

* eligible rows: ``valid`` and/or ``exec_ok`` as configured (missing = false);
* rank: reward desc, exec_ok desc, valid desc, candidate_id asc, input order;
  the chosen row is the best eligible row;
* walk the other eligible rows from worst to best, stop at the first one whose
  gap to the chosen row is below the minimum (unless ties are allowed and the
  gap is 0), skip non-positive gaps unless ties are allowed, keep at most
  ``max_pairs_per_example``.

Plan. Reward is the first rank key, so along the walk the gap never grows:
the rows that get emitted always form a *prefix* of the walk. Hence the
first k emitted rows are found among the k worst eligible rows, and whether a
zero-gap row is blocked depends only on rows before it, which are in that same
prefix. So each group needs only:

1. one aggregate (chosen row as ``max(struct)``, counts, "any eligible row
   matched"), which Spark combines map-side, and
2. for k > 1, the k + 1 worst eligible rows, in two stages: first of each (group, salt),
   then of each group. Spark limits both before their exchange, and the last task of a
   group gets at most ``SALTS`` * (k + 1) rows, however many the group or the map tasks.

Groups are told by a 128-bit hash of their key, so that neither prompts nor SQL texts are in
these exchanges; texts are attached by ``ord`` to the rows of pairs alone. For the
default of one pair an example, texts ride in the aggregate instead (the rejected row
is its ``min(struct)``): one scan, one exchange of partial aggregates, no join. Counters
never read texts beyond the hash.

Neither step ever moves a whole group into one task, so a group holding a
third of all rows costs the same as any other, and nothing runs while a plan is built.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions import text as T

KEY = ["id", "db_id", "prompt"]
#: The 128-bit hash of a group's key.
GROUP = ["_g1", "_g2"]
#: Shares that a group's rows are dealt into before its worst rows are taken.
SALTS = 32

# Skip-reason names and the stats counters' names.
SKIP_REASONS = ("small_group", "no_valid", "chosen_not_matched", "gap")
STATS_COLUMNS = (
    "rollouts_read",
    "examples_seen",
    "examples_skipped_small_group",
    "examples_skipped_gap",
    "examples_skipped_no_valid",
    "preferences_written",
    "examples_skipped_chosen_not_matched",
)


@dataclasses.dataclass(frozen=True)
class PreferenceConfig:
    min_reward_gap: float = 0.3
    require_valid_sql: bool = True
    require_exec_ok: bool = False
    allow_ties: bool = False
    max_pairs_per_example: int = 1
    require_chosen_matched: bool = True
    max_examples: int | None = None

    def __post_init__(self) -> None:
        if self.min_reward_gap < 0:
            raise ValueError("min_reward_gap must be >= 0")
        if self.max_pairs_per_example <= 0:
            raise ValueError("max_pairs_per_example must be > 0")
        if self.max_examples is not None and self.max_examples <= 0:
            raise ValueError("max_examples must be > 0 when provided")


@dataclasses.dataclass
class PreferenceResult:
    """Lazily planned outputs. Each is computed on its own when an action runs."""

    pairs: DataFrame  # P9 rows: id, db_id, prompt, chosen, rejected, meta
    ordered_pairs: DataFrame  # pairs + (group_ord, pair_idx) for ordered sinks
    group_outcomes: DataFrame  # one row per group: counts and skip reason
    stats: DataFrame  # one row, the seven counters (D10)


def _opt(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def prepare_rollouts(rollouts: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Fills the reference's defaults for missing fields and keeps only the
    columns the builder reads. ``ord`` (unique, input order) is required."""
    r = rollouts
    return r.select(
        F.col("id").cast("string").alias("id"),
        F.col("db_id").cast("string").alias("db_id"),
        F.col("prompt").cast("string").alias("prompt"),
        _opt(r, "reward", F.lit(0.0)).cast("double").alias("reward"),
        _opt(r, "candidate_id", F.lit(0)).cast("long").alias("candidate_id"),
        _opt(r, "valid", F.lit(False)).cast("boolean").alias("valid"),
        _opt(r, "exec_ok", F.lit(False)).cast("boolean").alias("exec_ok"),
        _opt(r, "matched", F.lit(False)).cast("boolean").alias("matched"),
        (F.col("candidate_sql") if "candidate_sql" in r.columns else F.lit(None)).cast("string").alias("candidate_sql"),
        _opt(r, "error_type", F.lit("")).cast("string").alias("error_type"),
        F.col(ord_col).cast("long").alias("ord"),
    )


def _eligible(cfg: PreferenceConfig) -> Column:
    cond = F.lit(True)
    if cfg.require_valid_sql:
        cond = cond & F.col("valid")
    if cfg.require_exec_ok:
        cond = cond & F.col("exec_ok")
    return cond


def _key_ok() -> Column:
    return F.coalesce(
        F.col("id").isNotNull() & (F.col("id") != "")
        & F.col("db_id").isNotNull() & (F.col("db_id") != "")
        & F.col("prompt").isNotNull() & (F.col("prompt") != ""),
        F.lit(False),
    )


def worst_of_groups(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` worst eligible rows of each group, ``pair_idx`` = place in the walk from 1."""
    order = [F.col("reward").asc(), F.col("exec_ok").asc(), F.col("valid").asc(), F.col("candidate_id").desc(), F.col("ord").desc()]
    narrow = rows.filter(F.col("_elig") & F.col("_key_ok")).select(*GROUP, "reward", "exec_ok", "valid", "candidate_id", "ord")
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)))
    of_salt = salted.withColumn("pair_idx", F.row_number().over(Window.partitionBy(*GROUP, "_salt").orderBy(*order))).filter(F.col("pair_idx") <= k)
    of_group = of_salt.withColumn("pair_idx", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order)))
    return of_group.filter(F.col("pair_idx") <= k).drop("_salt")


def _grouped(rows: DataFrame, keys: list[str], texts: bool, k: int) -> DataFrame:
    """One aggregate per group, over all rows (rows with an empty key form
    their own groups and only count towards rollouts_read)."""
    rank_struct = F.struct(
        F.col("reward"), F.col("exec_ok"), F.col("valid"),
        (-F.col("candidate_id")).alias("neg_cid"), (-F.col("ord")).alias("neg_ord"),
        F.col("candidate_id"), F.col("ord"), F.col("matched"),
        *([F.col("candidate_sql"), F.col("error_type")] if texts else []),
    )
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_elig")).alias("n_eligible"),
        F.coalesce(F.bool_or(F.col("_elig") & F.col("matched")), F.lit(False)).alias("any_eligible_matched"),
        F.max(F.when(F.col("_elig"), rank_struct)).alias("chosen"),
        F.min("ord").alias("group_ord"),
        F.bool_or("_key_ok").alias("_key_ok"),
    ]
    if k == 1:
        # The walk starts at the worst eligible row: the minimum of the same
        # rank struct. It can only be the chosen row when fewer than two rows
        # are eligible, and then the group yields no pair anyway.
        aggs.append(F.min(F.when(F.col("_elig"), rank_struct)).alias("worst"))
    return rows.groupBy(*keys).agg(*aggs)


def _with_seen(groups: DataFrame, rows: DataFrame, cfg: PreferenceConfig) -> DataFrame:
    """K1: marks the first ``max_examples`` groups by id text (stable on first appearance)."""
    if cfg.max_examples is None:
        return groups.withColumn("_seen", F.col("_key_ok"))
    first = rows.filter("_key_ok").groupBy(*GROUP).agg(F.min("id").alias("id"), F.min("ord").alias("_first"))
    seen = first.orderBy("id", "_first").limit(cfg.max_examples).select("_first", F.lit(True).alias("_in"))
    marked = groups.join(seen, F.col("group_ord") == F.col("_first"), "left")
    return marked.withColumn("_seen", F.col("_key_ok") & F.coalesce("_in", F.lit(False))).drop("_first", "_in")


def _picked(groups: DataFrame, rows: DataFrame, cfg: PreferenceConfig) -> DataFrame:
    """The emitted rows: the group's columns with the rejected row's, ``pair_idx`` and ``reward_gap``."""
    k = int(cfg.max_pairs_per_example)
    pairable = groups.filter(
        F.col("_seen") & (F.col("n_rows") >= 2) & (F.col("n_eligible") >= 2)
        & (F.lit(not cfg.require_chosen_matched) | F.col("chosen.matched"))
    )
    m = float(cfg.min_reward_gap)
    if k == 1:
        # Single pass: the one candidate is the worst row from the aggregate.
        cand = pairable.select("*", F.lit(1).alias("pair_idx"), "worst.reward", "worst.candidate_id", "worst.ord")
    else:
        # The k + 1 worst eligible rows per group, in walk order. The chosen row is the last
        # of the walk: dropping it leaves rows 1..k.
        cand = pairable.join(worst_of_groups(rows, k + 1), GROUP).filter((F.col("ord") != F.col("chosen.ord")) & (F.col("pair_idx") <= k))
    cand = cand.withColumn("reward_gap", F.col("chosen.reward") - F.col("reward"))
    gap = F.col("reward_gap")
    if cfg.allow_ties and k == 1:
        emitted = (gap >= F.lit(m)) | (gap == 0)
    elif cfg.allow_ties:
        # A zero gap is emitted unless some row before it stopped the walk; such a row has
        # 0 < gap < min and lies in the same prefix, of at most k rows a group.
        blocking = F.when((gap > 0) & (gap < F.lit(m)), 1).otherwise(0)
        cand = cand.withColumn("_blocked", F.max(blocking).over(Window.partitionBy(*GROUP)) == 1)
        emitted = (gap >= F.lit(m)) | ((gap == 0) & ~F.col("_blocked"))
    else:
        emitted = (gap >= F.lit(m)) & (gap > 0)
    return cand.filter(emitted)


def build_preferences(rollouts: DataFrame, cfg: PreferenceConfig = PreferenceConfig(), ord_col: str = "ord") -> PreferenceResult:
    """Rollouts -> preference pairs + per-group outcomes + stats."""
    k = int(cfg.max_pairs_per_example)
    rows = prepare_rollouts(rollouts, ord_col).withColumn("_elig", _eligible(cfg)).withColumn("_key_ok", _key_ok())
    rows = rows.withColumn("_g1", F.xxhash64(*KEY)).withColumn("_g2", F.xxhash64(F.lit("second"), *KEY))
    groups = _with_seen(_grouped(rows, GROUP, False, k), rows, cfg)
    picked_ords = _picked(groups, rows, cfg)
    if k == 1:
        picked = _picked(_with_seen(_grouped(rows, KEY, True, k), rows, cfg), rows, cfg)
        picked = picked.withColumn("candidate_sql", F.col("worst.candidate_sql")).withColumn("error_type", F.col("worst.error_type"))
    else:
        texts = ["candidate_sql", "error_type"]
        best = rows.select(F.col("ord").alias("_chosen_ord"), *KEY, F.struct(*texts).alias("_chosen_texts"))
        picked = picked_ords.join(best, F.col("chosen.ord") == F.col("_chosen_ord")).join(rows.select("ord", *texts), "ord")
        picked = picked.withColumn("chosen", F.struct("chosen.*", "_chosen_texts.*"))

    chosen_sql = T.ensure_im_end(F.col("chosen.candidate_sql"))
    ordered = picked.select(
        *KEY,
        chosen_sql.alias("chosen"),
        T.ensure_im_end(F.col("candidate_sql")).alias("rejected"),
        F.struct(
            F.col("chosen.reward").alias("chosen_reward"),
            F.col("reward").alias("rejected_reward"),
            F.col("reward_gap").alias("reward_gap"),
            F.col("chosen.candidate_id").alias("chosen_candidate_id"),
            F.col("candidate_id").alias("rejected_candidate_id"),
            F.col("chosen.error_type").alias("chosen_error_type"),
            F.col("error_type").alias("rejected_error_type"),
        ).alias("meta"),
        F.col("group_ord"),
        F.col("pair_idx"),
    )
    pairs = ordered.drop("group_ord", "pair_idx")

    # A5: skip reason per group, in the reference's order of tests. A group's first position identifies it.
    written = picked_ords.groupBy("group_ord").agg(F.count(F.lit(1)).alias("n_pairs"))
    outcomes = (
        groups.join(written, "group_ord", "left")
        .withColumn("n_pairs", F.coalesce(F.col("n_pairs"), F.lit(0)))
        .withColumn(
            "outcome",
            F.when(~F.col("_seen"), F.lit(None))
            .when(F.col("n_rows") < 2, F.lit("small_group"))
            .when(F.col("n_pairs") > 0, F.lit("written"))
            .when(F.col("n_eligible") < 2, F.lit("no_valid"))
            .when(F.lit(cfg.require_chosen_matched) & ~F.col("any_eligible_matched"), F.lit("chosen_not_matched"))
            .otherwise(F.lit("gap")),
        )
    )
    stats = outcomes.agg(
        F.sum("n_rows").cast("long").alias("rollouts_read"),
        F.count_if(F.col("_seen")).cast("long").alias("examples_seen"),
        F.count_if(F.col("outcome") == "small_group").cast("long").alias("examples_skipped_small_group"),
        F.count_if(F.col("outcome") == "gap").cast("long").alias("examples_skipped_gap"),
        F.count_if(F.col("outcome") == "no_valid").cast("long").alias("examples_skipped_no_valid"),
        F.coalesce(F.sum(F.when(F.col("_seen"), F.col("n_pairs"))), F.lit(0)).cast("long").alias("preferences_written"),
        F.count_if(F.col("outcome") == "chosen_not_matched").cast("long").alias("examples_skipped_chosen_not_matched"),
    )
    names = rows.select(F.col("ord").alias("group_ord"), *KEY)
    group_outcomes = outcomes.filter("_key_ok").join(names, "group_ord").select(
        *KEY, "group_ord", "n_rows", "n_eligible", "any_eligible_matched", "n_pairs", "outcome"
    )
    return PreferenceResult(pairs=pairs, ordered_pairs=ordered, group_outcomes=group_outcomes, stats=stats)


def flatten_pairs(pairs: DataFrame) -> DataFrame:
    """P9 rows with ``meta`` flattened into top-level columns."""
    return pairs.select(*KEY, "chosen", "rejected", "meta.*")
