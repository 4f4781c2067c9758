"""Every query of movements, traces, days and texts against its SQL, at the smallest scale."""

import pytest

from tests.parity import compare
from waymark.plans import cohort_queries, flight_queries, movement_queries, other_queries

PARTS = (movement_queries, other_queries, flight_queries, cohort_queries)
ALL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_parity(spark, name):
    assert compare(spark, name, QUERIES[name], ALL[name], "/root/testdata/sf0.001") is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
