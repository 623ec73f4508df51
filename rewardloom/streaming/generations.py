"""Per-row SQL extraction and checks over a stream of generation files.

The reference has no streaming operator (SURVEY §2.13); this module only runs
the same stateless per-row rules (X5 extraction, X6 validation, X7
difficulty, X8 token count) with Structured Streaming when generations
arrive as JSONL files over time. The query keeps no state, so it needs no
watermark; its progress lives in a checkpoint under the shared folder the
session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rewardloom.functions import text as TX

GENERATION_SCHEMA = T.StructType(
    [
        T.StructField("gen_id", T.StringType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def checked_generations(df: DataFrame) -> DataFrame:
    """The per-row rules; works on batch and streaming DataFrames alike."""
    out = df.withColumn("sql", TX.extract_sql("text"))
    out = TX.add_validation(out, "sql", "reason", "valid")
    out = TX.add_difficulty(out, "sql", "difficulty")
    return out.withColumn("n_tokens", TX.sql_token_count("sql"))


def start(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint: str | None = None,
    available_now: bool = False,
    trigger_interval: str = "1 minute",
    max_files_per_trigger: int = 100,
) -> StreamingQuery:
    """Starts the stream: JSONL files in ``source_dir`` -> parquet in ``sink_dir``."""
    src = (
        spark.readStream.schema(GENERATION_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(source_dir)
    )
    # Beside the sink's files, where a restart finds it again; readers pass over names that begin with "_".
    ckpt = checkpoint or f"{sink_dir.rstrip('/')}/_generations_checkpoint"
    writer = (
        checked_generations(src)
        .withColumn("checked_at", F.current_timestamp())
        .writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", ckpt)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger_interval)
    return writer.start()
