"""A3 J1 (F1), T1-T6 P10 A8 W6 U1."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.operators import tokens as TK
from rewardloom.operators.schema_text import attach_schemas, schema_text

F1_SCHEMA = """CREATE TABLE orders (
  order_id INTEGER PRIMARY KEY,
  user_id INTEGER,
  amount REAL,
  FOREIGN KEY (user_id) REFERENCES users(id)
);

CREATE TABLE users (
  id INTEGER PRIMARY KEY,
  name TEXT NOT NULL,
  age INTEGER
);"""


def _catalog(spark):
    cols = spark.createDataFrame(
        [("test_db", "orders", 0, "order_id", "INTEGER", False, 1), ("test_db", "orders", 1, "user_id", "INTEGER", False, 0),
         ("test_db", "orders", 2, "amount", "REAL", False, 0), ("test_db", "users", 0, "id", "INTEGER", False, 1),
         ("test_db", "users", 1, "name", "TEXT", True, 0), ("test_db", "users", 2, "age", "INTEGER", False, 0),
         ("test_db", "sqlite_sequence", 0, "name", "", False, 0), ("test_db", "sqliteXstat", 0, "tbl", None, False, 0)],
        "db_id string, table_name string, cid int, column_name string, column_type string, not_null boolean, pk int",
    )
    fks = spark.createDataFrame(
        [("test_db", "orders", 0, "user_id", "users", "id")],
        "db_id string, table_name string, fk_pos int, from_col string, to_table string, to_col string",
    )
    return cols, fks


def test_schema_text_f1(spark):
    cols, fks = _catalog(spark)
    got = schema_text(cols, fks).first()
    assert got.db_id == "test_db" and got.schema == F1_SCHEMA


def test_schema_text_rules(spark):
    cols = spark.createDataFrame(
        [("d", "t", 1, "b", "", True, 0), ("d", "t", 0, "a", None, True, 1), ("d", "t", 2, "c", "INT", True, 2)],
        "db_id string, table_name string, cid int, column_name string, column_type string, not_null boolean, pk int",
    )
    fks = spark.createDataFrame([("d", "t", 0, "b", "u", None)], "db_id string, table_name string, fk_pos int, from_col string, to_table string, to_col string")
    got = schema_text(cols, fks).first().schema
    assert got == "CREATE TABLE t (\n  a TEXT PRIMARY KEY,\n  b TEXT NOT NULL,\n  c INT PRIMARY KEY,\n  FOREIGN KEY (b) REFERENCES u\n);"


def test_attach_schemas_missing_raises(spark):
    cols, fks = _catalog(spark)
    ex = spark.createDataFrame([("q", "SELECT 1", "test_db"), ("q", "SELECT 1", "missing_db")], "question string, sql string, db_id string")
    with pytest.raises(Exception, match="Database not found: missing_db"):
        attach_schemas(ex, schema_text(cols, fks)).collect()
    kept = attach_schemas(ex, schema_text(cols, fks), on_missing="null").orderBy("db_id").collect()
    assert kept[0].schema is None and kept[1].schema == F1_SCHEMA


def test_sft_rows_and_length_filter(spark):
    df = spark.createDataFrame([("a", "x y z", "w x"), ("b", "x", "y y y y y")], "id string, prompt string, completion string")
    vocab = TK.build_vocabulary(df, ["prompt", "completion"])
    v = {r.token: r.id for r in vocab.collect()}
    assert v["y"] == 1 and v["x"] == 2  # by frequency, then text
    ids = TK.token_ids(df, "id", ["prompt", "completion"], vocabulary=vocab).select("id", *TK.sft_rows())
    rows = {r.id: r for r in ids.collect()}
    assert rows["a"].input_ids == [v["x"], v["y"], v["z"], v["w"], v["x"]]
    assert rows["a"].labels == [-100, -100, -100, v["w"], v["x"]]
    assert rows["a"].attention_mask == [1] * 5
    kept, counts = TK.filter_max_length(ids, 5)
    assert [r.id for r in kept.collect()] == ["a"]
    assert tuple(counts.first()) == (2, 1, 1)


def test_fixed_length_label_masking(spark):
    """pad id 0, max_length 20, labels -100 where attention is 0, some kept."""
    df = spark.createDataFrame([("a", "one two three", "four five"), ("b", " ".join(["w"] * 30), "end")], "id string, prompt string, completion string")
    st = df.withColumn("joint", F.concat_ws(" ", "prompt", "completion"))
    ids = TK.token_ids(st, "id", ["joint", "prompt"])
    rows = {r.id: r for r in ids.select("id", *TK.fixed_length_rows("joint_ids", "prompt_ids", 20)).collect()}
    a = rows["a"]
    assert len(a.input_ids) == 20 and a.attention_mask == [1] * 5 + [0] * 15
    assert all(lab == -100 for lab, m in zip(a.labels, a.attention_mask) if m == 0)
    assert a.labels[:3] == [-100] * 3 and a.labels[3:5] == a.input_ids[3:5]
    assert all(lab == -100 for lab in rows["b"].labels)  # prompt longer than max_length


def test_user_tokenizer_plugin(spark):
    """Any Column -> array<int> function, e.g. an Arrow pandas UDF."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def char_codes(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [ord(c) for c in t])

    df = spark.createDataFrame([("a", "hi")], "id string, prompt string")
    assert TK.token_ids(df, "id", ["prompt"], tokenizer=char_codes).first().prompt_ids == [104, 105]


def test_batches_and_budgets(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1)) for i in range(10)], "ord long, ids array<int>")
    b = {r.ord: r for r in TK.batch_padding(df, "ord", "ids", 4).collect()}
    assert b[0].batch_id == 0 and b[0].padded_length == 8 and len(b[0].ids_padded) == 8
    assert b[9].batch_id == 2 and b[9].padded_length == 16
    lens = spark.createDataFrame([(10, 3, 5), (4, 1, 1), (8, 9, 0)], "p int, c int, r int")
    r = TK.token_budgets(lens, "p", "c", "r", 8, 15).first()
    assert (r.rows, r.over_max_prompt_length, r.over_max_length) == (3, 1, 1)  # 10 + 5 = 15 is not over
    r2 = TK.token_budgets(lens, "p", "c", "r", None, None).first()
    assert (r2.over_max_prompt_length, r2.over_max_length) == (0, 0)
