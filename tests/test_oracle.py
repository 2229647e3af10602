"""Every query with SQL must equal it on the small tables; the shorter ones of the others must return rows."""
import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and not n.startswith("op")])
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(spark, duck, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# Boosted trees at full size; test_models.py runs these queries with few rounds.
LONG = ("M4_", "M7_", "M12_", "G1_", "G2_")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and not n.startswith(("op", *LONG)) and n != "pipeline"])
def test_query_without_sql_returns_rows(spark, duck, name):
    ok, note = compare(spark, duck, QUERIES[name], None, SF)
    assert ok, note
