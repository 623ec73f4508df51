"""Token tables.

The default tokenizer (ours; it replaces the model's) splits text on
whitespace and numbers tokens by a vocabulary built from the corpus:
id 0 is padding, then 1, 2, ... by descending frequency (ties by token text).

Token ids are attached with a join rather than a lookup map, so the
vocabulary never has to fit in one place: every token occurrence is exploded
with its position, joined to the vocabulary (AQE broadcasts the vocabulary
when it is small at run time and splits hot tokens otherwise), and regrouped
per row. All requested text columns go through one explode, one join and
one regroup.

A user tokenizer (U1) is any ``Column -> Column`` function returning
``array<int>``, e.g. an Arrow ``pandas_udf`` wrapping a model tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions import text as T
from rewardloom.operators.ordinal import with_global_rank

PAD_ID = 0
#: Id of a token that the vocabulary lacks, unless the caller names one; no vocabulary has it.
UNKNOWN_ID = -1
IGNORE_INDEX = -100
_BLANKS = " " * len(T.WS)

Tokenizer = Callable[[Column], Column]


def whitespace_tokens(text) -> Column:
    """T1 default split: runs of non-whitespace, in order. Whitespace is
    first mapped to blanks (a per-character table lookup), so the regex tests
    a single character."""
    c = F.col(text) if isinstance(text, str) else text
    blanked = F.translate(c, T.WS, _BLANKS)
    return F.coalesce(F.regexp_extract_all(blanked, F.lit("[^ ]+"), 0), F.array().cast("array<string>"))


def build_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(token, id, count)`` over the given text columns."""
    tokens = df.select(F.explode(F.flatten(F.array(*[whitespace_tokens(c) for c in cols]))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    ranked = with_global_rank(counts, [("count", False), "token"], name="id")
    return ranked.select("token", (F.col("id") + F.lit(PAD_ID)).cast("int").alias("id"), F.col("count").cast("long"))


def _tag(field: int):
    def tag(t: Column, i: Column) -> Column:
        return F.struct(F.lit(field).alias("f"), (i + 1).alias("pos"), t.alias("token"))

    return tag


def token_ids(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    vocabulary: DataFrame | None = None,
    tokenizer: Tokenizer | None = None,
    suffix: str = "_ids",
    unknown_id: int = UNKNOWN_ID,
) -> DataFrame:
    """Adds ``{col}{suffix}`` = array<int> for each text column.

    With ``tokenizer`` the function is applied column-wise (U1). Otherwise
    ids come from ``vocabulary`` (built from these columns when omitted);
    a token missing from it becomes ``unknown_id``, so positions and lengths
    hold. ``key`` must identify rows."""
    if tokenizer is not None:
        out = df
        for c in cols:
            out = out.withColumn(f"{c}{suffix}", tokenizer(F.col(c)).cast("array<int>"))
        return out
    vocab = vocabulary if vocabulary is not None else build_vocabulary(df, cols)
    tagged = [F.transform(whitespace_tokens(c), _tag(f)) for f, c in enumerate(cols)]
    occ = df.select(key, F.explode(F.concat(*tagged)).alias("o")).select(key, "o.f", "o.pos", "o.token")
    ided = occ.join(vocab.select("token", F.col("id").alias("_vid")), "token", "left").withColumn(
        "_vid", F.coalesce("_vid", F.lit(unknown_id))
    )
    back = ided.groupBy(key).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("f") == f, F.struct("pos", "_vid")))).alias(f"_s{f}")
            for f in range(len(cols))
        ]
    )
    out = df.join(back, key, "left")
    for f, c in enumerate(cols):
        out = out.withColumn(
            f"{c}{suffix}",
            F.coalesce(F.transform(F.col(f"_s{f}"), lambda x: x["_vid"]), F.array().cast("array<int>")),
        ).drop(f"_s{f}")
    return out


def sft_rows(prompt_ids: str = "prompt_ids", completion_ids: str = "completion_ids") -> list[Column]:
    """input_ids = prompt ++ completion; attention all 1; labels mask the
    prompt with -100."""
    p, c = F.col(prompt_ids), F.col(completion_ids)
    ids = F.concat(p, c)
    return [
        ids.alias("input_ids"),
        F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(p)), c).alias("labels"),
    ]


def filter_max_length(df: DataFrame, max_length: int, col: str = "input_ids") -> tuple[DataFrame, DataFrame]:
    """P10: drop rows longer than ``max_length`` (equal is kept); returns
    (kept, one-row counts rows_before / rows_kept / rows_dropped)."""
    fits = F.size(F.col(col)) <= max_length
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(fits).alias("rows_kept"),
        F.count_if(~fits).alias("rows_dropped"),
    )
    return df.filter(fits), counts


def pad_to(arr, length, value: int) -> Column:
    """T5: right-pad an array to ``length`` with ``value`` (no truncation)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = length if isinstance(length, Column) else F.lit(int(length))
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0))))


def fixed_length_rows(joint_ids: str, prompt_ids: str, max_length: int, pad_id: int = PAD_ID) -> list[Column]:
    """T4: joint text ids truncated and padded to ``max_length``; labels mask
    the prompt (its own tokenization, truncated) and the padding."""
    real = F.slice(F.col(joint_ids), 1, max_length)
    n = F.size(real)
    ids = pad_to(real, max_length, pad_id)
    plen = F.least(F.size(F.col(prompt_ids)), F.lit(max_length))
    return [
        ids.alias("input_ids"),
        F.transform(ids, lambda x, i: F.when(i < n, F.lit(1)).otherwise(F.lit(0))).alias("attention_mask"),
        F.transform(ids, lambda x, i: F.when((i < plen) | (i >= n), F.lit(IGNORE_INDEX)).otherwise(x)).alias("labels"),
    ]


def batch_padding(df: DataFrame, ord_col: str, ids_col: str, batch_size: int, multiple: int = 8) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows (by 0-based ``ord_col``),
    each padded to its longest row rounded up to ``multiple``. A batch has at
    most ``batch_size`` rows, so the per-batch window is bounded."""
    b = df.withColumn("batch_id", F.floor(F.col(ord_col) / F.lit(batch_size)).cast("long"))
    longest = F.max(F.size(F.col(ids_col))).over(Window.partitionBy("batch_id"))
    padded_len = (F.ceil(longest / F.lit(multiple)) * F.lit(multiple)).cast("int")
    return b.withColumn("padded_length", padded_len).withColumn(
        f"{ids_col}_padded", pad_to(ids_col, F.col("padded_length"), PAD_ID)
    )


def token_budgets(
    df: DataFrame,
    prompt_len: str,
    chosen_len: str,
    rejected_len: str,
    max_prompt_length: int | None,
    max_length: int | None,
) -> DataFrame:
    """Rows whose prompt exceeds ``max_prompt_length``; rows whose
    prompt + longer completion exceeds ``max_length`` (strict; None = off)."""
    p = F.col(prompt_len)
    total = p + F.greatest(F.col(chosen_len), F.col(rejected_len))
    over_p = F.count_if(p > F.lit(max_prompt_length)) if max_prompt_length is not None else F.lit(0)
    over_t = F.count_if(total > F.lit(max_length)) if max_length is not None else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        over_p.cast("long").alias("over_max_prompt_length"),
        over_t.cast("long").alias("over_max_length"),
    )
