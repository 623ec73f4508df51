"""Every registered query against its DuckDB statement on the smallest
driver tables: same columns, same types, same multiset of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from rewardloom.plans import registry
from rewardloom.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    d_cols, d_types = rel.columns, dict(zip(rel.columns, [str(t) for t in rel.types]))
    d_rows = rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    for col, st in df.dtypes:
        assert d_types[col] == DUCK_TYPES.get(st, st.upper()), (col, st, d_types[col])
    assert _bag(s_cols, s_rows) == _bag(d_cols, d_rows)
