"""Schema text from a column catalog, and attaching it to examples
(SURVEY A3, J1, X1, X2, T6, P1, P2).

Catalog tables (D3):
``catalog_columns(db_id, table_name, cid, column_name, column_type, not_null, pk)``
``catalog_fks(db_id, table_name, fk_pos, from_col, to_table, to_col)``

Text rules: one ``CREATE TABLE`` block per table, tables by name, columns by
cid, then one FOREIGN KEY line per key column; an empty type prints TEXT;
PRIMARY KEY on every pk column; NOT NULL only when not pk; tables whose name
is LIKE 'sqlite_%' (``_`` is a wildcard; SQLite's LIKE ignores ASCII case) are
skipped. A key without a target column prints no parentheses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import text as T

# The DDL text pieces.
BLOCK_OPEN = "CREATE TABLE "
LINE_SEP = ",\n"
BLOCK_SEP = "\n\n"


def _keep_table() -> F.Column:
    return ~F.lower(F.col("table_name")).like("sqlite_%")


def schema_text(catalog_columns: DataFrame, catalog_fks: DataFrame | None = None) -> DataFrame:
    """A3: ``(db_id, schema)``. Two aggregation levels (lines per table, then
    blocks per database), each sorting only its own group's items."""
    c = catalog_columns.filter(_keep_table()).select(
        "db_id", "table_name",
        F.lit(0).alias("kind"), F.col("cid").cast("long").alias("pos"),
        F.concat(
            F.lit("  "), F.col("column_name"), F.lit(" "),
            F.coalesce(F.nullif(F.col("column_type"), F.lit("")), F.lit("TEXT")),
            F.when(F.coalesce(F.col("pk"), F.lit(0)) != 0, F.lit(" PRIMARY KEY")).otherwise(F.lit("")),
            F.when(F.coalesce(F.col("not_null"), F.lit(False)) & (F.coalesce(F.col("pk"), F.lit(0)) == 0), F.lit(" NOT NULL"))
            .otherwise(F.lit("")),
        ).alias("line"),
    )
    lines = c
    if catalog_fks is not None:
        target = F.when(F.col("to_col").isNull(), F.col("to_table")).otherwise(
            F.concat(F.col("to_table"), F.lit("("), F.col("to_col"), F.lit(")"))
        )
        fk = catalog_fks.filter(_keep_table()).select(
            "db_id", "table_name",
            F.lit(1).alias("kind"), F.col("fk_pos").cast("long").alias("pos"),
            F.concat(F.lit("  FOREIGN KEY ("), F.col("from_col"), F.lit(") REFERENCES "), target).alias("line"),
        )
        lines = c.unionByName(fk)
    blocks = lines.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "line"))).alias("_l")
    ).select(
        "db_id", "table_name",
        F.concat(
            F.lit(BLOCK_OPEN), F.col("table_name"), F.lit(" (\n"),
            F.array_join(F.transform("_l", lambda x: x["line"]), LINE_SEP),
            F.lit("\n);"),
        ).alias("block"),
    )
    return blocks.groupBy("db_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("table_name", "block"))), lambda x: x["block"]),
            BLOCK_SEP,
        ).alias("schema")
    )


def rename_raw_examples(raw: DataFrame) -> DataFrame:
    """Source field ``query`` becomes ``sql``."""
    return raw.select("question", F.col("query").alias("sql"), "db_id", *[c for c in raw.columns if c not in ("question", "query", "db_id")])


def attach_schemas(examples: DataFrame, schemas: DataFrame, on_missing: str = "raise") -> DataFrame:
    """Examples + ``schema`` by db_id. ``on_missing='raise'`` fails the
    job on the first example whose database has no schema, naming it (the
    check runs inside the same job, no extra pass); ``'null'`` keeps such
    examples with a null schema. The join itself is left to Spark/AQE
    (broadcast when the schema table is small at run time, sort-merge
    otherwise)."""
    joined = examples.join(
        schemas.select("db_id", "schema", F.lit(True).alias("_known")), "db_id", "left"
    )
    if on_missing == "raise":
        # A filter, so that the check stays when nobody reads the schema.
        missing = F.raise_error(F.concat(F.lit("Database not found: "), F.coalesce(F.col("db_id"), F.lit("NULL"))))
        joined = joined.filter(F.when(F.col("_known").isNull(), missing.cast("boolean")).otherwise(F.lit(True)))
    return joined.drop("_known")


def require_fields(df: DataFrame, fields: list[str], trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keep rows whose fields are non-empty (``trim`` = after stripping).
    Returns (kept, one-row counts rows_read / rows_kept / rows_dropped_missing)."""
    def ok(c: str) -> F.Column:
        v = F.col(c).cast("string")
        v = T.strip_ws(v) if trim else v
        return F.coalesce(v != "", F.lit(False))

    cond = F.lit(True)
    for f in fields:
        cond = cond & ok(f)
    flagged = df.withColumn("_keep", cond)
    counts = flagged.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if("_keep").alias("rows_kept"),
        F.count_if(~F.col("_keep")).alias("rows_dropped_missing"),
    )
    return flagged.filter("_keep").drop("_keep"), counts


def sft_text(examples: DataFrame) -> DataFrame:
    """``(prompt, completion)`` from (schema, question, sql); other
    columns except the key are dropped."""
    keep = [c for c in ("id", "ord") if c in examples.columns]
    return examples.select(
        *keep,
        T.chatml_prompt("schema", "question").alias("prompt"),
        T.completion("sql").alias("completion"),
    )
