"""Driver contract: entry() runs; queries() and oracle_sql() line up."""

from __future__ import annotations

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"id", "chosen", "rejected", "reward_gap"}


def test_every_query_has_an_oracle_except_none():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
