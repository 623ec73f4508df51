"""Array files read by splits."""

from __future__ import annotations

import json
import random

import pytest

from rewardloom.sources import io as IO

SCHEMA = "a long, s string, n struct<x:array<struct<y:string>>>"


def read(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return [r.asDict(recursive=True) for r in IO.read_json_array(spark, str(path), schema).orderBy("ord").collect()]


def made(seed, n):
    rng = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "中", "\U0001f600", "\\\"", "}}", "a", " ", "\t", "\\u007d"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
    rows = []
    for k in range(n):
        row = {"a": rng.choice([k, None]), "s": text(), "n": rng.choice([None, {"x": [{"y": text()} for _ in range(rng.randint(0, 3))]}])}
        rows.append(row)
    return rows


@pytest.mark.parametrize(("seed", "indent", "plain"), [(1, None, True), (2, 2, False), (3, 1, True)])
def test_files_of_many_splits_and_odd_strings(spark, tmp_path, seed, indent, plain):
    rows = made(seed, 150)
    (tmp_path / "x.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=plain), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read(spark, tmp_path / "x.json")
            assert got == [{**r, "ord": k} for k, r in enumerate(rows)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_several_files_empty_arrays_and_missing_fields(spark, tmp_path):
    texts = {"a.json": '[{"a": 1}, {"s": "x"}]\n', "b.json": " [ ] ", "c.json": '\n[\n{}\n,{"a": 3, "more": {"z": "}"}}]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = [(r["a"], r["s"], r["ord"]) for r in read(spark, tmp_path)]
    assert got == [(1, None, 0), (None, "x", 1), (None, None, 2), (3, None, 3)]


@pytest.mark.parametrize("text", [
    '{"a": 1}', '[{"a": 1}', '[{"a": 1}]]', '[{"a": 1}]}', '[{"a": 1} {"a": 2}]', '[{"a": 1}, 2]', "[1]", '[[{"a": 1}]]', '{"a": 1}]', '[{"a": "x]', '[{"a": 1},]', '[{"a": true}]', '[,{"a": 1}]',
])
def test_other_files_raise(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="(?i)not one json array|malformed|cannot parse|FAILFAST"):
        read(spark, tmp_path / "x.json")
