from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rewardloom.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def users_orders(spark):
    """the two-table database."""
    users = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Carol", 35)], "id int, name string, age int")
    orders = spark.createDataFrame([(1, 1, 99.99), (2, 1, 49.50), (3, 2, 200.00)], "order_id int, user_id int, amount double")
    return {"users": users, "orders": orders}
