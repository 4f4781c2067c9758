"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import norm, track
from waymark.sources import tables

POINT = "event_id long, aircraft long, t double, lat double, lon double, alt double, new_leg boolean"


def points(spark, times, flags=None, lats=None):
    return spark.createDataFrame([(i, 1, float(t), float(lats[i]) if lats else 0.0, 0.0, 0.0, bool(flags and flags[i])) for i, t in enumerate(times)], POINT)


def test_legs_split_after_a_longer_gap_only(spark):
    got = [r["leg"] for r in track.legs(points(spark, [0, 60, 1860, 3661])).orderBy("t").collect()]
    assert got == [0, 0, 0, 1]


def test_flag_on_the_first_point_does_not_split(spark):
    assert [r["leg"] for r in track.legs(points(spark, [0, 10, 20], [1, 0, 1])).orderBy("t").collect()] == [0, 0, 1]


def test_thinning_keeps_ends(spark):
    assert sorted(r["t"] for r in track.thinned(points(spark, [0, 4, 9, 10, 15, 21])).collect()) == [0, 10, 21]


def test_cleaning_compares_with_the_last_kept_point(spark):
    assert sorted(r["t"] for r in track.cleaned(points(spark, [0, 10, 20], lats=[0, 50, 0.01])).collect()) == [0, 20]


def test_bins_are_closed_on_the_right(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 200.0, 200.1, 99999.0, 100000.0, None)], "x double").select(geo.right_closed(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["nan", "(0, 200]", "(200, 300]", "(3000, 99999]", "nan", "nan"]


def test_a_small_cell_takes_the_bin(spark):
    rows = spark.createDataFrame([("A", 100.0, 1.0), ("A", 100.0, 3.0), ("B", 100.0, 8.0)], "typecode string, gc_km double, total double")
    got = {(r["typecode"], r["total"]): r["d"] for r in norm.deviations(rows, {"d": "total"}, 2).collect()}
    assert got == {("A", 1.0): -1.0, ("A", 3.0): 1.0, ("B", 8.0): 5.0}


def test_steps_are_split_at_the_cut_and_points_go_whole(spark):
    steps = spark.createDataFrame([(1, 0.4, 0.6, 10.0), (1, 0.0, 0.0, 3.0), (1, 1.0, 1.0, 2.0)], "k long, u0 double, u1 double, burn double")
    r = track.apportioned(steps, ["k"], [("a", 0.0, 0.5), ("b", 0.5, 1.0)]).head()
    assert (round(r["a"], 9), round(r["b"], 9)) == (8.0, 7.0)


def test_nearest_is_strictly_inside_the_radius(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 50.0), (3, 80.0, 179.0)], "event_id long, lat double, lon double")
    places = spark.createDataFrame([("x", 8.0 / 110.57, 0.0), ("y", 0.0, 50.01), ("z", 80.0, 179.2)], "place string, plat double, plon double")
    assert {r["event_id"]: r["place"] for r in track.nearest(p, places).collect()} == {1: None, 2: "y", 3: "z"}


def test_left_join_refuses_equal_keys(spark):
    a = spark.createDataFrame([(1, 2)], "k long, v long")
    with pytest.raises(ValueError):
        norm.checked_left(a, a.union(a), ["k"])


def test_strict_loading(spark):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert tables.strict(df, df.schema).head()["b"] is None
    with pytest.raises(ValueError):
        tables.strict(df, df.drop("b").schema)


def test_movements_add_up(spark):
    r = tables.movements(spark, "/root/testdata/sf0.001").select(F.max(F.abs(F.col("lateral") + F.col("vertical") - F.col("total"))).alias("x")).head()
    assert r["x"] < 1e-9


def test_stream_has_the_batch_result(spark, tmp_path):
    from waymark.streaming.sessions import sessions

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 21600.0).writeStream.format("memory").queryName("got").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("got")) == key(sessions(events, 21600.0))
