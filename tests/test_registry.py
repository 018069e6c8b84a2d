"""Every registered query of the library proper against its SQL."""

import pytest

from tarnbeck.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import SMALL, connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_whole_joins_hold_every_row(spark):
    """The joins over whole tables lose no row of either side, and have rows without a partner on both."""
    customers, orders = (spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("customer", "orders"))
    rows = QUERIES["join_whole_full"](spark, SMALL).collect()
    assert len({r.c_custkey for r in rows if r.c_custkey is not None}) == customers
    assert len({r.o_orderkey for r in rows if r.o_orderkey is not None}) == orders
    assert any(r.o_orderkey is None for r in rows) and any(r.c_custkey is None for r in rows)
    assert QUERIES["join_whole_right"](spark, SMALL).count() == orders
    assert QUERIES["join_whole_semi"](spark, SMALL).count() + QUERIES["join_whole_anti"](spark, SMALL).count() == customers
