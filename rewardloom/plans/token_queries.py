"""Registered queries for schema text, SFT text and token tables, with
their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions import text as T
from rewardloom.operators import schema_text as SC
from rewardloom.operators import tokens as TK
from rewardloom.operators.preferences import build_preferences
from rewardloom.plans import bindings as B
from rewardloom.plans import sqltext as S
from rewardloom.plans.bindings import sql_str

SFT_MAX_LENGTH = 1024
FIXED_MAX_LENGTH = 128
BATCH_SIZE = 8
BUDGET_PROMPT = 60
BUDGET_TOTAL = 72
TOKEN_RE = sql_str("[^" + T.WS + "]+")


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols, fks = B.catalog_from_part(B.table(spark, sf_dir, "part"))
    return SC.schema_text(cols, fks)


def sft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = B.examples_from_conversations(B.table(spark, sf_dir, "conversations"), B.table(spark, sf_dir, "part"))
    kept, _ = SC.require_fields(ex, ["question", "sql", "db_id"])
    with_schema = SC.attach_schemas(kept, schemas(spark, sf_dir), on_missing="raise")
    kept2, _ = SC.require_fields(with_schema, ["schema"])
    return SC.sft_text(kept2).select("id", "prompt", "completion")


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source examples whose field ``query`` becomes ``sql``."""
    ex = B.examples_from_conversations(B.table(spark, sf_dir, "conversations"), B.table(spark, sf_dir, "part"))
    return SC.rename_raw_examples(ex.withColumnRenamed("sql", "query")).select("id", "question", "sql", "db_id")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.build_vocabulary(sft_text(spark, sf_dir), ["prompt", "completion"])


def _sft_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = sft_text(spark, sf_dir)
    return TK.token_ids(st, "id", ["prompt", "completion"])


def _checksum(arr: str) -> F.Column:
    return F.aggregate(F.transform(F.col(arr), lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _sft_ids(spark, sf_dir).select("id", "prompt_ids", "completion_ids", *TK.sft_rows())
    return ids.select(
        "id",
        F.size("prompt_ids").cast("long").alias("n_prompt"),
        F.size("completion_ids").cast("long").alias("n_completion"),
        F.size("input_ids").cast("long").alias("n_input"),
        F.size(F.filter("labels", lambda x: x == TK.IGNORE_INDEX)).cast("long").alias("n_masked"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_attended"),
        _checksum("input_ids").alias("ids_checksum"),
        _checksum("labels").alias("labels_checksum"),
    )


def sft_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _sft_ids(spark, sf_dir).select(*TK.sft_rows())
    _, counts = TK.filter_max_length(ids, SFT_MAX_LENGTH)
    return counts.select(*[F.col(c).cast("long") for c in counts.columns])


def fixed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = sft_text(spark, sf_dir).withColumn("joint", F.concat("prompt", "completion"))
    vocab = TK.build_vocabulary(st, ["prompt", "completion"])
    ids = TK.token_ids(st, "id", ["joint", "prompt"], vocabulary=vocab)
    rows = ids.select("id", *TK.fixed_length_rows("joint_ids", "prompt_ids", FIXED_MAX_LENGTH))
    return rows.select(
        "id",
        F.size("input_ids").cast("long").alias("n_input"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_real"),
        F.size(F.filter("labels", lambda x: x != TK.IGNORE_INDEX)).cast("long").alias("n_labels"),
        _checksum("input_ids").alias("ids_checksum"),
        _checksum("labels").alias("labels_checksum"),
    )


def eval_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardloom.operators.ordinal import with_global_rank

    # Input order: by conversation and turn, as numbers.
    number = lambda pattern: F.regexp_extract("id", pattern, 1).cast("long")
    ids = _sft_ids(spark, sf_dir).select("id", "prompt_ids", number("^c([0-9]+)-").alias("_conv"), number("-([0-9]+)$").alias("_turn"))
    ordered = with_global_rank(ids, ["_conv", "_turn"], name="_pos")
    b = TK.batch_padding(ordered.withColumn("_pos", F.col("_pos") - 1), "_pos", "prompt_ids", BATCH_SIZE)
    return b.select(
        "id", "batch_id",
        F.col("padded_length").cast("long").alias("padded_length"),
        F.size("prompt_ids_padded").cast("long").alias("n_padded"),
    )


def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardloom.plans.registry import PREF_TIES, _rollouts

    pairs = build_preferences(_rollouts(spark, sf_dir, True), PREF_TIES).pairs
    lens = pairs.select(
        F.size(TK.whitespace_tokens("prompt")).alias("p"),
        F.size(TK.whitespace_tokens("chosen")).alias("c"),
        F.size(TK.whitespace_tokens("rejected")).alias("r"),
    )
    return TK.token_budgets(lens, "p", "c", "r", BUDGET_PROMPT, BUDGET_TOTAL)


def preference_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader's counts on the written pairs."""
    from rewardloom.plans.file_queries import written_pairs
    from rewardloom.sources.io import load_preferences

    _, counts = load_preferences(spark, written_pairs(spark, sf_dir))
    return counts.select(*[F.col(c).cast("long") for c in counts.columns])


def queries() -> dict:
    return {
        "schema_text": schemas,
        "sft_text": sft_text,
        "raw_examples": raw_examples,
        "vocabulary": vocabulary,
        "sft_rows": sft_rows,
        "sft_length_filter": sft_length_filter,
        "fixed_length_rows": fixed_length,
        "eval_batches": eval_batches,
        "token_budgets": token_budgets,
        "preference_load": preference_load,
    }


# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------
def _sql_sft_text() -> str:
    ex = B.sql_examples()
    return f"""(SELECT e.id, {B.sql_chatml_prompt('s.schema', 'e.question')} AS prompt,
               {S.completion('e.sql')} AS completion
        FROM {ex} e JOIN {B.sql_schema_text()} s ON s.db_id = e.db_id
        WHERE coalesce(e.question, '') <> '' AND coalesce(e.sql, '') <> '' AND coalesce(e.db_id, '') <> ''
          AND coalesce(s.schema, '') <> '')"""


def _sql_vocab(src: str) -> str:
    return f"""(SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token ASC) AS INTEGER) AS id,
               CAST(count(*) AS BIGINT) AS count
        FROM (SELECT unnest(regexp_extract_all(prompt, {TOKEN_RE})) AS token FROM {src}
              UNION ALL SELECT unnest(regexp_extract_all(completion, {TOKEN_RE})) FROM {src})
        GROUP BY token)"""


def _sql_occurrences(src: str, fields: list[tuple[str, int]]) -> str:
    parts = [
        f"SELECT id, {f} AS f, unnest(regexp_extract_all({col}, {TOKEN_RE})) AS token, "
        f"generate_subscripts(regexp_extract_all({col}, {TOKEN_RE}), 1) AS pos FROM {src}"
        for col, f in fields
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def oracle_sql() -> dict:
    st = _sql_sft_text()
    voc = _sql_vocab(st)
    occ = _sql_occurrences(st, [("prompt", 0), ("completion", 1)])
    ids = f"""(SELECT o.id, o.f, o.pos, v.id AS vid FROM {occ} o JOIN {voc} v ON v.token = o.token)"""
    per_row = f"""(SELECT s.id,
            CAST(count(i.vid) FILTER (WHERE i.f = 0) AS BIGINT) AS n_prompt,
            CAST(count(i.vid) FILTER (WHERE i.f = 1) AS BIGINT) AS n_completion
          FROM {st} s LEFT JOIN {ids} i ON i.id = s.id GROUP BY s.id)"""
    checks = f"""(SELECT r.id, r.n_prompt, r.n_completion,
            CAST(coalesce(sum(i.vid * CASE WHEN i.f = 0 THEN i.pos ELSE r.n_prompt + i.pos END), 0) AS BIGINT) AS ids_checksum,
            CAST(coalesce(sum(CASE WHEN i.f = 0 THEN -100 * i.pos ELSE i.vid * (r.n_prompt + i.pos) END), 0) AS BIGINT) AS labels_checksum
          FROM {per_row} r LEFT JOIN {ids} i ON i.id = r.id GROUP BY r.id, r.n_prompt, r.n_completion)"""
    sft_rows_sql = f"""SELECT id, n_prompt, n_completion, n_prompt + n_completion AS n_input, n_prompt AS n_masked,
            n_prompt + n_completion AS n_attended, ids_checksum, labels_checksum FROM {checks}"""
    length = f"""SELECT CAST(count(*) AS BIGINT) AS rows_before,
            CAST(count(*) FILTER (WHERE n_prompt + n_completion <= {SFT_MAX_LENGTH}) AS BIGINT) AS rows_kept,
            CAST(count(*) FILTER (WHERE n_prompt + n_completion > {SFT_MAX_LENGTH}) AS BIGINT) AS rows_dropped
          FROM {per_row}"""
    # Fixed-length rows: joint text and prompt, ids from the prompt+completion vocabulary.
    st_j = f"(SELECT id, prompt, completion, prompt || completion AS joint FROM {st})"
    occ_j = _sql_occurrences(st_j, [("joint", 0), ("prompt", 1)])
    ids_j = f"""(SELECT o.id, o.f, o.pos, v.id AS vid FROM {occ_j} o JOIN {voc} v ON v.token = o.token)"""
    L = FIXED_MAX_LENGTH
    fixed = f"""WITH j AS (SELECT s.id,
              least(count(i.vid) FILTER (WHERE i.f = 0), {L}) AS n_real,
              least(count(i.vid) FILTER (WHERE i.f = 1), {L}) AS plen
            FROM {st_j} s LEFT JOIN {ids_j} i ON i.id = s.id GROUP BY s.id),
          k AS (SELECT j.id, j.n_real, j.plen,
              coalesce(sum(i.vid * i.rank) FILTER (WHERE i.rank <= {L}), 0) AS real_sum,
              coalesce(sum(i.vid * i.rank) FILTER (WHERE i.rank <= {L} AND i.rank > j.plen), 0) AS label_sum
            FROM j LEFT JOIN (SELECT id, vid, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank
                              FROM {ids_j} WHERE f = 0) i ON i.id = j.id
            GROUP BY j.id, j.n_real, j.plen)
        SELECT id, CAST({L} AS BIGINT) AS n_input, CAST(n_real AS BIGINT) AS n_real,
               CAST(greatest(n_real - plen, 0) AS BIGINT) AS n_labels,
               CAST(real_sum AS BIGINT) AS ids_checksum,
               CAST(label_sum + (-100) * (
                   ({L} * ({L} + 1)) // 2 - (n_real * (n_real + 1)) // 2
                   + (least(plen, n_real) * (least(plen, n_real) + 1)) // 2) AS BIGINT) AS labels_checksum
        FROM k"""
    batches = f"""WITH r AS (SELECT id, n_prompt, row_number() OVER (ORDER BY CAST(regexp_extract(id, '^c([0-9]+)-', 1) AS BIGINT), CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT)) - 1 AS pos FROM {per_row}),
          b AS (SELECT id, n_prompt, pos // {BATCH_SIZE} AS batch_id FROM r)
        SELECT id, CAST(batch_id AS BIGINT) AS batch_id,
               CAST(ceil(max(n_prompt) OVER (PARTITION BY batch_id) / 8) * 8 AS BIGINT) AS padded_length,
               CAST(greatest(ceil(max(n_prompt) OVER (PARTITION BY batch_id) / 8) * 8, n_prompt) AS BIGINT) AS n_padded
        FROM b"""
    from rewardloom.plans import oracle as O
    from rewardloom.plans.registry import PREF_TIES

    pairs = O.preferences(B.sql_rollouts_from_events(by_day=True), PREF_TIES)
    tc = lambda c: f"len(regexp_extract_all({c}, {TOKEN_RE}))"
    budgets = f"""SELECT CAST(count(*) AS BIGINT) AS rows,
            CAST(count(*) FILTER (WHERE {tc('prompt')} > {BUDGET_PROMPT}) AS BIGINT) AS over_max_prompt_length,
            CAST(count(*) FILTER (WHERE {tc('prompt')} + greatest({tc('chosen')}, {tc('rejected')}) > {BUDGET_TOTAL}) AS BIGINT) AS over_max_length
          FROM ({pairs})"""
    ok = " AND ".join(f"{S.strip(c)} <> ''" for c in ("prompt", "chosen", "rejected"))
    load = f"""SELECT CAST(count(*) AS BIGINT) AS rows_read,
            CAST(count(*) FILTER (WHERE {ok}) AS BIGINT) AS rows_kept,
            CAST(count(*) FILTER (WHERE NOT ({ok})) AS BIGINT) AS rows_dropped_missing
          FROM ({pairs})"""
    return {
        "schema_text": f"SELECT * FROM {B.sql_schema_text()}",
        "sft_text": f"SELECT * FROM {st}",
        "raw_examples": f"SELECT id, question, sql, db_id FROM {B.sql_examples()}",
        "vocabulary": f"SELECT * FROM {voc}",
        "sft_rows": sft_rows_sql,
        "sft_length_filter": length,
        "fixed_length_rows": fixed,
        "eval_batches": batches,
        "token_budgets": budgets,
        "preference_load": load,
    }
