import json

import pytest

from waymark.sources import days


def test_days_are_replaced_whole_and_unsound_ones_named(spark, tmp_path):
    path = "file://" + str(tmp_path / "flights")
    flights = days.numbered(spark.createDataFrame([("2026-01-01", "a", 2.0), ("2026-01-01", "b", 1.0), ("2026-01-02", "c", 3.0)], "day string, icao string, t double"), "t", "icao")
    days.write_days(flights, flights.schema, path)
    again = days.numbered(spark.createDataFrame([("2026-01-02", "d", 5.0)], "day string, icao string, t double"), "t", "icao")
    days.write_days(again, again.schema, path)
    (tmp_path / "flights" / "day=2026-01-03").mkdir()
    (tmp_path / "flights" / "day=2026-01-03" / "part-0.parquet").write_bytes(b"broken")
    df, bad = days.read_days(spark, path)
    assert sorted((r["day"], r["icao"], r["flight_id"]) for r in df.collect()) == [("2026-01-01", "a", 2), ("2026-01-01", "b", 1), ("2026-01-02", "d", 1)]
    assert bad == ["2026-01-03"]
    with pytest.raises(ValueError):
        days.write_days(again.withColumn("more", again["t"]), again.schema, path)


def test_coverage_document(spark):
    d = spark.createDataFrame([("2", "ok", 5, [1]), ("1", "ok", 4, None)], "day string, status string, flights long, missing_hours array<int>")
    r = json.loads(days.coverage_document(d, d.where("day = '1'").select("day")).head()["document"])
    assert r["n_flights"] == 9 and [x["included_in_release"] for x in r["days"]] == [True, False]
