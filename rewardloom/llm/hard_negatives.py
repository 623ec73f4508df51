"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

An anchor's positives are its best rows of the same label. A positive of score p asks for
the best rows of another label that score from ``percent`` % of p to p; the windows of
one anchor overlap. So the positives' scores, the windows' upper limits, split an anchor's
scores into disjoint slots: slot j reaches from the j-th highest limit, itself included,
down to the next. A combiner in each task keeps the ``negatives`` best rows a slot and drops
the rest; what the tasks keep is merged by (anchor, slot). A window's rows are those of
its own slot and the lower ones, so merging slots in descending order from each
slot on answers every window: the first ``negatives`` rows of such a suffix, down to the
window's lower limit.

Anchors meet the table in blocks of at most about ``BLOCK``: a block is broadcast, both passes
read the table where it lies, the block's results are written, and the block is released.
Vectors are never shuffled; a task sends on at most (anchors x slots x ``negatives``) rows.
Scores are exact integer products.

Cases: a row with a null id or label, a null vector, or a null or non-finite component
takes no part; so does one whose length differs from ``dim``, if that is given, or else from the
most common length (a tie takes the longer); rows that repeat an id are rows of their own, and
no row of an anchor's own id is its positive; each distinct (id, label, vector)
that is an anchor is one by itself; equal scores go to the smaller id; an anchor without
positives, and a positive without rows in its window, give no rows; empty tables give
none; components beyond 2^40 in size after scaling raise; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import saved
from rewardloom.llm.mtree import scaled
from rewardloom.session import scratch_table_path

#: Anchors broadcast at once; scores that a task computes at once.
BLOCK, CELLS = 4096, 1 << 20
_LARGEST = 1 << 40
_LEAST = np.iinfo(np.int64).min
_HITS = "anchor int, slot int, vec_id long, score long"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def score_grid(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows and anchors, as longs."""
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if largest < 1 << 63:
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        return (rows.astype(kind) @ anchors.astype(kind).T).astype(np.int64)
    exact = rows.astype(object) @ anchors.astype(object).T
    return exact.astype(np.int64)  # raises where a product is beyond a long


class SlotBest:
    """The ``k`` best (score, id) of each group seen so far; ties go to the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k, self.room = k, 4 * groups * k + CELLS // 4
        self.worst = np.full(groups, _LEAST)  # the k-th best, once there are k
        self.worst_id = np.full(groups, np.iinfo(np.int64).max)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worst = self.worst[group]
        better = (score > worst) | ((score == worst) & (ids < self.worst_id[group]))
        if better.any():
            self.parts.append((group[better], score[better], ids[better]))
            self.held += int(better.sum())
            if self.held > self.room:
                self.combine()

    def combine(self) -> tuple[np.ndarray, ...]:
        """Drops what is not among the best; (group, score, id) of the rest, best first."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        group, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, ~score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        last = place == self.k - 1
        self.worst[group[last]], self.worst_id[group[last]] = score[last], ids[last]
        kept = place < self.k
        self.parts = [(group[kept], score[kept], ids[kept])]
        self.held = int(kept.sum())
        return self.parts[0]


@dataclass(frozen=True)
class Anchors:
    """One block of anchors, as the tasks get it."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: The distinct scores of each anchor's positives, highest first, filled up with the least
    #: long; None while positives are sought.
    limits: np.ndarray | None = None
    #: The lowest score that any window of the anchor holds.
    floor: np.ndarray | None = None

    def slots(self) -> int:
        return 1 if self.limits is None else self.limits.shape[1]

    def offer(self, best: SlotBest, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Gives some rows to the combiner."""
        grid = score_grid(vectors, self.vectors)
        if self.limits is None:
            fits = (labels[:, None] == self.labels) & (ids[:, None] != self.ids) & (grid >= best.worst)
            row, anchor = np.nonzero(fits)
            best.add(anchor, grid[row, anchor], ids[row])
            return
        fits = (labels[:, None] != self.labels) & (grid <= self.limits[:, 0]) & (grid >= self.floor)
        row, anchor = np.nonzero(fits)
        score = grid[row, anchor]
        slot = (self.limits[anchor] >= score[:, None]).sum(1) - 1
        best.add(anchor * self.slots() + slot, score, ids[row])


def _combiner(held, k: int, dim: int):
    """A task's pass over its rows: (anchor, slot, vec_id, score) of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = held.value
        best = SlotBest(len(anchors.ids) * anchors.slots(), k)
        step = max(1, CELLS // len(anchors.ids))
        for batch in batches:
            vectors = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for at in range(0, len(ids), step):
                anchors.offer(best, ids[at : at + step], labels[at : at + step], vectors[at : at + step])
        group, score, ids = best.combine()
        anchor, slot = np.divmod(group, anchors.slots())
        columns = [pa.array(anchor, pa.int32()), pa.array(slot, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "vec_id", "score"])

    return run


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """The best of what the tasks kept, with their place in the slot."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _limits(positives: list, n: int, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Limits and floors of the block's anchors."""
    limits = np.full((n, k), _LEAST)
    floor = np.full(n, np.iinfo(np.int64).max)
    scores: dict[int, set[int]] = {}
    for r in positives:
        scores.setdefault(r["anchor"], set()).add(r["score"])
    for anchor, own in scores.items():
        limits[anchor, : len(own)] = sorted(own, reverse=True)
        # Below zero, percent % of a score is above it: such windows are empty.
        if able := [s for s in own if s >= 0]:
            floor[anchor] = -(-percent * min(able) // 100)
    return limits, floor


def _answers(positives: DataFrame, slots: DataFrame, k: int, percent: int) -> DataFrame:
    """Each window's rows, from its slot and the lower ones."""
    distinct = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("score"))) - 1
    windows = positives.select("anchor", F.col("place").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), distinct.alias("own_slot"))
    rows = slots.select(F.col("anchor").alias("of"), "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    suffix = windows.join(rows, (F.col("anchor") == F.col("of")) & (F.col("slot") >= F.col("own_slot")))
    merge = Window.partitionBy("anchor", "window").orderBy("slot", F.desc("negative_score"), "negative_id")
    low = F.lit(percent) * F.col("positive_score") <= F.lit(100) * F.col("negative_score")
    return suffix.withColumn("rank", F.row_number().over(merge)).where((F.col("rank") <= k) & low)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, vec_id: str = "vec_id",
    embedding: str = "embedding", label: Column | str = "label", factor: int = 256, block: int = BLOCK, dim: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    :param anchors: condition on column ``vec_id`` that makes a row an anchor.
    :param percent: a window's lower limit, as a share of its positive's score, from 1 to 100.
    :param label: a column of whole numbers.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = vectors.sparkSession
    own_label = F.col(label) if isinstance(label, str) else label
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), own_label.cast("long").alias("label"), scaled(F.col(embedding), factor).alias("v"))
    whole = saved(whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()), "vectors")
    sizes = whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).first() if dim is None else sizes.where(F.col("dim") == dim).first()
    if top is None or not top["dim"]:
        return spark.createDataFrame([], _OUT)
    if top["top"] >= _LARGEST:
        raise ValueError("a component is beyond 2^40 after scaling")
    dim = top["dim"]
    whole = whole.where(F.size("v") == dim)
    asked = whole.where(anchors)
    n_asked = asked.count()
    blocks = -(-2 * n_asked // block) if n_asked > block else 1  # blocks dealt by hash are uneven
    out = scratch_table_path(spark, "hard-negatives")
    spark.createDataFrame([], _OUT).write.parquet(out)
    for number in range(blocks):
        of_block = asked.where(F.pmod(F.xxhash64(F.lit(13), "vec_id", "label", "v"), F.lit(blocks)) == number)
        rows = sorted(of_block.distinct().collect())  # one block
        if not rows:
            continue
        ids, labels, values = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label", "v"))
        held = spark.sparkContext.broadcast(Anchors(ids, labels, values))
        best = saved(_merged(whole.mapInArrow(_combiner(held, positives, dim), _HITS), positives), "positives")
        held.unpersist()
        held = spark.sparkContext.broadcast(Anchors(ids, labels, values, *_limits(best.collect(), len(ids), positives, percent)))  # positives of one block
        slots = _merged(whole.mapInArrow(_combiner(held, negatives, dim), _HITS), negatives)
        names = spark.createDataFrame([(k, r["vec_id"]) for k, r in enumerate(rows)], "of_anchor int, anchor_id long")
        found = _answers(best, slots, negatives, percent).join(names, F.col("anchor") == F.col("of_anchor"))
        found.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        held.unpersist()
    return spark.read.schema(_OUT).parquet(out)
