import pytest

from ambergrid.plans import catalogue, round_trips
from oracle import assert_same, tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


QUERIES, SQL = catalogue.queries() | round_trips.queries(), catalogue.oracle_sql() | round_trips.oracle_sql()
#: What finds nothing by design, and what finds nothing in the smallest tables.
EMPTY = {"bql_ts_last_day_is_empty", "bql_ts_equals_is_empty", "bql_ts_index_vs_scan"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    found = QUERIES[name](spark, sf_dir)
    assert_same(found, con, SQL[name])
    assert name in EMPTY or not found.isEmpty()
