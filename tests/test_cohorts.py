"""Statistics over cohorts: empty sets, norms in two passes."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import cohort, norm
from waymark.plans import cohort_queries, movement_queries


def test_known_missing_without_absent_days(spark):
    none = spark.createDataFrame([], "day string")
    some = spark.createDataFrame([("1994-05-02",)], "day string")
    assert cohort.known_missing(none, ["1994-05-01"]).head()["days"] is None  # as list() of no rows in SQL
    assert cohort.known_missing(some, ["1994-05-01"]).head()["days"] == []
    assert cohort.known_missing(some, ["1994-05-02"]).head()["days"] == ["1994-05-02"]


def _scans(df):
    """How often the plan reads the items, and whether it deals them out by bin and type."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("l_orderkey#") and sum("Relation [" in line and "l_orderkey#" in line for line in plan.splitlines())


@pytest.mark.parametrize("name, most", [("q_norm_airport", 2), ("q_month_rank", 2), ("q_annual", 2), ("q_role_pivot", 2), ("q_phase_attrib", 2), ("q_export", 3)])
def test_items_are_read_for_the_norms_and_once_more(spark, name, most):
    df = (movement_queries.QUERIES | cohort_queries.QUERIES)[name](spark, "/root/testdata/sf0.001")
    assert 0 < _scans(df) <= most


def test_medians_count_null_values_but_leave_them_out(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 2.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["mid"]) for r in norm.counted_medians(rows, ["k"], "v", "mid").collect()}
    assert got == {"a": (3, 2.0), "b": (1, None), None: (1, 2.0)}


def test_worst_quarter(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 3.0), (None, 4.0), ("z", None)], "day string, d double")
    r = cohort.worst_quarter(rows, "d", F.coalesce("d", F.lit(0.0))).head()
    assert (r["days"], r["a"], r["w"]) == (3, 10.0, 4.0)  # the quartile is 3.25
    assert cohort.worst_quarter(rows.where("d > 9"), "d", F.col("d")).head()["days"] == 0
