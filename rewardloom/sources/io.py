"""Readers and writers.

JSONL is read as text so that every line keeps its line number: lines are
numbered within their split (file, block start), and a count of each split's
lines gives where it begins; no text moves. Blank lines are skipped; a malformed
or mistyped line fails the read with its line number (FAILFAST) or
comes back in ``_corrupt_record`` (PERMISSIVE). ``with_line_numbers=False``
uses Spark's JSON reader directly (no ordinals, no line numbers).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions.text import strip_ws
from rewardloom.operators.schema_text import require_fields
from rewardloom.session import written_table

ORD = "ord"


_SPLIT = ["_file", "_block"]


def _first_of_splits(rows: DataFrame, mid: str, name: str) -> DataFrame:
    """(file, block, first id of the split, rows of all splits before it).

    One row a split of the input, of which the driver already holds the list."""
    sizes = rows.groupBy(*_SPLIT).agg(F.min(mid).alias(f"_{name}_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn(f"_{name}_before", F.coalesce(before, F.lit(0))).drop("_n")


def read_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    mode: str = "FAILFAST",
    with_line_numbers: bool = True,
) -> DataFrame:
    """JSONL with an explicit schema. Adds ``ord`` (0-based record
    position, blank lines not counted) and ``line_no`` (1-based file line).

    A line is bad if it isn't one JSON object or a value doesn't have its
    field's type."""
    if not with_line_numbers:
        return spark.read.schema(schema).option("mode", mode).json(path)
    lines = spark.read.text(path).select(
        F.col("value").alias("_line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line_id"),
    )
    # Ids number a task's rows in order, so a row's place in its split is its id less the split's first.
    records = lines.filter(strip_ws("_line") != "").withColumn("_record_id", F.monotonically_increasing_id())
    starts = _first_of_splits(lines, "_line_id", "line").join(_first_of_splits(records, "_record_id", "record"), _SPLIT)
    parsed = F.from_json(
        "_line", T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    placed = (
        records.join(F.broadcast(starts), _SPLIT)  # a row a split
        .withColumn("line_no", F.col("_line_before") + F.col("_line_id") - F.col("_line_first") + 1)
        .withColumn(ORD, F.col("_record_before") + F.col("_record_id") - F.col("_record_first"))
        .withColumn("_r", parsed)
    )
    # Anything but an object parses to nothing.
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull() | ~F.substring(strip_ws("_line"), 1, 1).eqNullSafe("{")
    if mode.upper() == "FAILFAST":
        first = placed.agg(F.min(F.when(bad, F.col("line_no")))).first()[0]
        if first is not None:
            raise ValueError(f"Invalid JSON at line {first}")
        return placed.select(*[F.col(f"_r.{_quoted(f.name)}").alias(f.name) for f in schema.fields], "line_no", ORD)
    return placed.select(
        *[F.when(~bad, F.col(f"_r.{_quoted(f.name)}")).alias(f.name) for f in schema.fields],
        "line_no", F.when(bad, F.col("_line")).alias("_corrupt_record"), ORD,
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _summed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name`` = the sum of ``value`` over the file's pieces before each.

    A row a split is written first; a split is numbered in one task."""
    sums = rows.groupBy(*_SPLIT).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = written_table(sums.select(*_SPLIT, F.coalesce(before, F.lit(0)).alias("_start")), "split-sums")
    own = F.sum(value).over(Window.partitionBy(*_SPLIT).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn(name, F.coalesce(own, F.lit(0))).join(F.broadcast(starts), _SPLIT)
    return placed.withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_start")


def _array_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A file's text cut at each ``}``, with what a piece says about strings and nesting.

    ``_after`` is the nesting after the piece and its ``}``, ``_object`` the number of objects of
    the file that have ended before it."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").alias("_piece"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_id"),
    )
    # No escape spans a cut, for a } is never escaped. Strings begin and end at the quotes left.
    bare = F.regexp_replace("_piece", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    told = _summed(pieces.withColumn("_quotes", quotes), "_quotes", "_quotes_before")
    inside = F.col("_quotes_before") % 2 == 1
    rest = F.when(inside, F.regexp_replace(bare, '^[^"]*(?:"|$)', "")).otherwise(bare)
    told = told.withColumn("_outside", F.regexp_replace(rest, '"[^"]*(?:"|$)', ""))
    closes = F.when((F.col("_quotes_before") + F.col("_quotes")) % 2 == 0, 1).otherwise(0)
    opens = F.length("_outside") - F.length(F.replace(F.col("_outside"), F.lit("{"), F.lit("")))
    told = told.withColumn("_closes", closes).withColumn("_delta", opens - F.col("_closes"))
    nested = _summed(told, "_delta", "_before").withColumn("_after", F.col("_before") + F.col("_delta"))
    ends = F.when((F.col("_closes") == 1) & (F.col("_after") == 0), 1).otherwise(0)
    return _summed(nested.withColumn("_ends", ends), "_ends", "_object")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files holding one JSON array of objects each; adds ``ord`` (0-based
    position in file order).

    A file is read by as many tasks as it has splits: its text is cut at each ``}``, running
    sums over the pieces tell which of them lie in strings, how deep they nest and which
    object they belong to, and each object is put together from its own pieces. A file that
    isn't such an array raises, and so does an object with a field of another type."""
    pieces = _array_pieces(spark, path)
    # What follows the last object is a piece without a }, so it counts as one level below the file's.
    tail = F.col("_after") < 0
    fine = F.when(F.col("_object") == 0, F.col("_outside").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("_outside").rlike(r"^\s*\]\s*$"))
    files = pieces.groupBy("_file").agg(
        F.count_if(tail).alias("tails"), F.count_if(tail & ~fine).alias("bad"), F.min("_size").alias("size"),
        (F.sum(F.octet_length("_piece")) + F.count(F.lit(1)) - 1).alias("read"), F.sum("_ends").alias("objects"),
    )
    files = written_table(files, "array-files")
    bad = files.filter("tails <> 1 or bad > 0 or read <> size").select("_file").first()
    if bad is not None:
        raise ValueError(f"Not one JSON array of objects: {bad[0]}")
    before = F.sum("objects").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    first = files.select("_file", F.coalesce(before, F.lit(0)).alias("_first"))  # a row a file
    whole = pieces.filter(~tail).groupBy("_file", "_object").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_id", "_piece"))).alias("_parts")
    )
    text = F.array_join(F.transform("_parts", lambda x: F.concat(x["_piece"], F.lit("}"))), "")
    whole = whole.select("_file", "_object", text.alias("_text")).join(F.broadcast(first), "_file")
    opening = F.when(F.col("_object") == 0, r"^\s*\[\s*$").otherwise(r"^\s*,\s*$")
    apart = F.regexp_extract("_text", r"^[^{]*", 0)
    checked = F.when(F.regexp_like(apart, opening), F.substring("_text", F.length(apart) + 1, F.length("_text"))).otherwise(
        F.raise_error(F.concat(F.lit("Not one JSON array of objects: "), F.col("_file")))
    )
    rows = whole.select((F.col("_first") + F.col("_object")).cast("long").alias(ORD), F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("_r"))
    # In file order, as files are read; Spark leaves the sort out where what follows doesn't keep it.
    return rows.select(*[F.col(f"_r.{_quoted(f.name)}").alias(f.name) for f in schema.fields], ORD).orderBy(ORD)


def write_jsonl(df: DataFrame, path: str, order_by: list | None = None, mode: str = "errorifexists") -> None:
    """S3: JSON lines, UTF-8, non-ASCII kept, nulls written as null.
    ``order_by`` sorts globally first (range partitioned), so part files
    concatenate in order."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_document(spark: SparkSession, obj: Mapping[str, Any] | DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document (run metadata, a summary). A DataFrame must hold
    exactly one row (e.g. a stats row)."""
    if isinstance(obj, DataFrame):
        obj.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)
        return
    text = json.dumps(obj, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def first_n(df: DataFrame, n: int | None, ord_col: str = ORD) -> DataFrame:
    """The first ``n`` records in input order (0-based ``ord``); a plain
    filter on the ordinal, no sort and no single-task limit."""
    if n is None:
        return df
    if n <= 0:
        raise ValueError("max_examples must be > 0 when provided")
    return df.filter(F.col(ord_col) < n)


PREFERENCE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", T.StringType()),
        T.StructField("rejected", T.StringType()),
    ]
)


def load_preferences(spark: SparkSession, path: str, max_examples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JSONL -> cap (before the filter) -> trim prompt/chosen/rejected ->
    drop rows with an empty field -> (prompt, chosen, rejected) + stats (A7)."""
    df = first_n(read_jsonl(spark, path, PREFERENCE_SCHEMA), max_examples)
    trimmed = df.select(ORD, *[strip_ws(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("prompt", "chosen", "rejected")])
    kept, counts = require_fields(trimmed, ["prompt", "chosen", "rejected"])
    return kept.select(ORD, "prompt", "chosen", "rejected"), counts


def database_exists(spark: SparkSession, db_id: str) -> bool:
    """S5 for catalog databases."""
    return spark.catalog.databaseExists(db_id)
