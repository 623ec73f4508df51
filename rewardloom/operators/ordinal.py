"""Global positions without a single-partition window.

Rows are dealt into ranges of their order keys by bounds that are literals of the plan:
a row's bucket is a function of the row. So a count per bucket and a row's place in its
bucket agree whenever and wherever they are computed, and neither a checkpoint nor a range
exchange is needed; a lost task is simply run again.

The bounds come from a sketch, the only job that runs while the plan is built: the
``SKETCH_ROWS`` keys of the smallest hashes, a uniform sample of a fixed size. Bounds
only steer how even the buckets are; positions are exact whatever they are.

``with_global_rank`` numbers rows 1..n: a count per bucket, summed up over the buckets (a
table of at most ``num_partitions`` rows, which is what makes its broadcast safe), plus the
row's place in its bucket. ``running_totals`` is the same idea for per-group prefix sums
(W4): buckets by (group, order), subtotals per (bucket, group), sums of the earlier
buckets, then a running sum inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_rl_bucket"
_OFF = "_rl_off"
_CNT = "_rl_cnt"
#: Keys of the sketch, and buckets at most (each bound is a comparison in the plan).
SKETCH_ROWS, MAX_BUCKETS = 20_000, 256

#: A column of the order: a name (ascending), or a name and whether it ascends.
Key = str | tuple[str, bool]


def _keys(order_cols: Sequence[Key]) -> list[tuple[str, bool]]:
    return [(k, True) if isinstance(k, str) else k for k in order_cols]


def _sorted_by(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).asc() if up else F.col(name).desc() for name, up in keys]


def _after(keys: list[tuple[str, bool]], bound: Sequence) -> Column:
    """Whether a row comes after ``bound``; nulls come first where the order ascends, else last."""
    (name, up), value = keys[0], bound[0]
    column = F.col(name)
    if value is None:
        later, same = (column.isNotNull() if up else F.lit(False)), column.isNull()
    else:
        later = F.coalesce(column > F.lit(value), F.lit(False)) if up else F.coalesce(column < F.lit(value), F.lit(True))
        same = F.coalesce(column == F.lit(value), F.lit(False))
    return later if len(keys) == 1 else later | (same & _after(keys[1:], bound[1:]))


def range_bounds(df: DataFrame, order_cols: Sequence[Key], buckets: int, sketch_rows: int = SKETCH_ROWS) -> list[tuple]:
    """At most ``buckets - 1`` keys, in order, that part the rows evenly. Runs the sketch."""
    keys = _keys(order_cols)
    names = [name for name, _ in keys]
    sketch = df.select(*names).orderBy(F.xxhash64(*names)).limit(sketch_rows).orderBy(*_sorted_by(keys)).collect()  # sketch_rows keys
    places = sorted({len(sketch) * k // buckets for k in range(1, buckets)})
    return list(dict.fromkeys(tuple(sketch[p]) for p in places if p < len(sketch)))


def bucket_of(order_cols: Sequence[Key], bounds: Sequence[tuple]) -> Column:
    """The number of bounds that a row comes after, by halving."""
    keys = _keys(order_cols)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_after(keys, bounds[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(bounds))


def _bucketed(df: DataFrame, order_cols: Sequence[Key], num_partitions: int | None) -> DataFrame:
    buckets = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, order_cols, min(buckets, MAX_BUCKETS))
    return df.withColumn(_BUCKET, bucket_of(order_cols, bounds))


def with_global_rank(
    df: DataFrame,
    order_cols: Sequence[Key],
    name: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Adds ``name`` = 1-based position in ``order_cols`` order.

    The order keys must be unique (append a unique tie-breaker), so that
    positions don't depend on the run."""
    dealt = _bucketed(df, order_cols, num_partitions)
    counts = dealt.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias(_CNT))
    # One row a bucket.
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(_BUCKET).alias("_rl_of"), F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF))
    place = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*_sorted_by(_keys(order_cols))))
    return (
        dealt.withColumn(name, place)
        .join(F.broadcast(offsets), F.col(_BUCKET) == F.col("_rl_of"))
        .withColumn(name, F.col(_OFF) + F.col(name))
        .drop(_BUCKET, _OFF, "_rl_of")
    )


def running_totals(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Key],
    value_cols: dict[str, Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """Adds, per group and in order, the running sum of each value column
    (current row included) and ``_n`` = running row count.

    Order keys must be unique within a group. A group larger than a
    bucket is split across several; the rows are exchanged once."""
    vals = list(value_cols)
    base = df.withColumns({name: expr.cast("double") for name, expr in value_cols.items()})
    dealt = _bucketed(base, [*group_cols, *order_cols], num_partitions)
    # Subtotals per (bucket, group): at most as many as buckets and groups together.
    sub = dealt.groupBy(_BUCKET, *group_cols).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(v) for v in vals])
    # Everything the same group holds in earlier buckets; a group is in few buckets, so each
    # window partition here is small.
    earlier = Window.partitionBy(*group_cols).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sub.select(
        F.col(_BUCKET).alias("_rl_of"),
        *[F.col(c).alias(f"_rl_{c}") for c in group_cols],
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in ["_n", *vals]],
    )
    inside = Window.partitionBy(_BUCKET, *group_cols).orderBy(*_sorted_by(_keys(order_cols))).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = dealt.withColumns({"_n": F.count(F.lit(1)).over(inside), **{v: F.sum(v).over(inside) for v in vals}})
    same = F.col(_BUCKET) == F.col("_rl_of")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_rl_{c}"))
    out = local.join(offsets, same).withColumns({c: F.col(c) + F.col(f"_off_{c}") for c in ["_n", *vals]})
    return out.drop(_BUCKET, "_rl_of", *[f"_rl_{c}" for c in group_cols], *[f"_off_{c}" for c in ["_n", *vals]])
