"""Flights, winds, phases and ground on cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import flights, ground, performance as perf, phase, track, wind

BOX = (35.0, 72.0, -12.0, 40.0)
POINT = "aircraft long, event_id long, t double, lat double, lon double, alt double, new_leg boolean, gs double, ias double, typecode string"


def flight(aircraft, start=0.0, lat=40.0, n=200, top=34000.0, end_alt=None):
    rows = []
    for i in range(n):
        alt = min(i * 1000.0, top, (n - 1 - i) * 900.0)
        rows.append((aircraft, i, start + i * 20.0, lat + i * 0.04, 9.0, end_alt if end_alt is not None and i == n - 1 else alt, False, 440.0, None, "A320"))
    return rows


@pytest.fixture(scope="module")
def points(spark):
    rows = flight(1) + flight(2, end_alt=9000.0) + flight(3, top=9000.0) + flight(4, lat=10.0) + flight(5, n=20)
    rows[57] = (1, 57, 57 * 20.0, 80.0, 80.0, 34000.0, False, 440.0, None, "A320")
    rows[60] = (*rows[60][:7], 900.0, None, "A320")
    return spark.createDataFrame(rows, POINT)


def test_only_whole_flights_in_the_box_pass_the_gate(points):
    found, clean = flights.flights_of(points, BOX)
    assert [(r["aircraft"], r["leg"], r["n"]) for r in found.collect()] == [(1, 0, 199)]
    assert clean.count() == 199 and clean.where("gs is null").count() == 1 and "typecode" in clean.columns


def test_an_unknown_altitude_at_an_end_fails(spark):
    rows = flight(1)
    rows[-1] = (*rows[-1][:5], None, *rows[-1][6:])
    assert flights.flights_of(spark.createDataFrame(rows, POINT), BOX)[0].count() == 0


def test_stored_figures(points):
    clean = flights.flights_of(points, BOX)[1]
    kept, q = flights.processed(clean, ["aircraft", "leg"], 60.0)
    r = q.head()
    assert r["n_pts_native"] == 199 and r["n_pts_stored"] == kept.count() and 66 <= r["n_pts_stored"] <= 68
    assert r["duration_s"] == 199 * 20 and r["max_gap_s"] == 40 and r["hole_time_s"] == 0 and r["coverage_frac"] == 1 and r["flown_ge_09gc"]
    assert abs(r["gc_km"] - 199 * 0.04 * math.pi / 180 * 6371.0088) < 1e-6 and abs(r["detour_pct"]) < 1e-6


def test_selected_altitude(spark):
    rows = [(1, 0, 0.0, None, 0.0), (1, 1, 1.0, 5049.0, 900.0), (1, 2, 2.0, 6050.0, 100.0), (1, 3, 3.0, 6150.0, None), (1, 4, 4.0, 0.0, 0.0), (2, 5, 0.0, None, 0.0)]
    got = {r["k"]: r[1:] for r in flights.selected_altitude(spark.createDataFrame(rows, "k long, event_id long, t double, mcp double, vs double"), ["k"]).collect()}
    assert got == {1: (3, 1, 5000.0, 6200.0), 2: (0, 0, None, None)}


def test_touching_a_box_takes_edges(spark):
    df = spark.createDataFrame([(1, [(36.0, -9.0)]), (2, [(35.9, 0.0), (None, None)]), (3, [])], "k long, p array<struct<lat:double,lon:double>>")
    got = {r["k"]: r["x"] for r in df.select("k", flights.touches_box(F.col("p"), (36.0, 40.0, -9.0, 9.0)).alias("x")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_days_that_are_lacking_raise(spark):
    rows, days = spark.createDataFrame([("a", 1), ("b", 2)], "day string, x long"), lambda *d: spark.createDataFrame([(x,) for x in d], "day string")
    assert flights.on_days(rows, days("a", "b")).count() == 2 and flights.on_days(rows, days("a"), exact=False).count() == 1
    for bad in (days("a"), days("a", "b", "c")):
        with pytest.raises(ValueError):
            flights.on_days(rows, bad)


def test_walks_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for a in range(7):
        t = 0.0
        for _ in range(int(rng.integers(1, 300))):
            t += float(rng.choice([0.0, 1.0, 3.0, 11.0]))
            rows.append((a if a else None, k, t, float(rng.normal(40, 0.02 if rng.random() < 0.9 else 9)), 9.0, 0.0))
            k += 1
    df = spark.createDataFrame(rows, "aircraft long, event_id long, t double, lat double, lon double, alt double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        clean = {r["event_id"] for r in track.cleaned(df, 1400.0).collect()}
        thin = {r["event_id"] for r in track.thinned(df, 10.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_clean, want_thin = set(), set()
    for a in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == a), key=lambda r: (r[2], r[1]))
        last = spaced = None
        for r in mine:
            if last is None or r[2] > last[2] and perf.haversine(last[3], last[4], r[3], r[4]) / 1.852 / ((r[2] - last[2]) / 3600) <= 1400:
                want_clean.add(r[1])
                last = r
            if spaced is None or r[2] - spaced >= 10:
                want_thin.add(r[1])
                spaced = r[2]
        want_thin.add(mine[-1][1])
    assert clean == want_clean and thin == want_thin


def grid(spark, u, v):
    rows = [(float(t), p, la, lo, u(t, p, la, lo), v(t, p, la, lo)) for t in (0, 100_000) for p in (200.0, 400.0, 1000.0) for la in (30.0, 50.0, 70.0) for lo in (-20.0, 0.0, 30.0)]
    return spark.createDataFrame(rows, "valid_time double, level double, lat double, lon double, u double, v double")


def test_interpolation_is_exact_for_linear_fields_clamps_places_and_extends_time(spark):
    g = grid(spark, lambda t, p, la, lo: 1e-4 * t + 0.01 * p + 2 * la - lo, lambda t, p, la, lo: 5.0)
    p = spark.createDataFrame([("in", 50_000.0, 44.0, 10.0, 20000.0), ("late", 150_000.0, 44.0, 10.0, 20000.0), ("north", 0.0, 80.0, 10.0, 20000.0), ("high", 0.0, 44.0, 10.0, 60000.0), ("none", 0.0, None, 10.0, 2000.0)], "k string, t double, lat double, lon double, alt double")
    got = {r["k"]: (r["u"], r["v"]) for r in wind.interpolated(p, g, "k").collect()}
    hpa = float(perf.air(20000.0)[2]) / 100
    want = {"in": 5 + 0.01 * hpa + 88 - 10, "late": 15 + 0.01 * hpa + 88 - 10, "north": 0.01 * hpa + 140 - 10, "high": 2 + 88 - 10}
    for k, u in want.items():
        assert got[k][0] == pytest.approx(u, rel=1e-5) and got[k][1] == pytest.approx(5.0)
    assert got["none"] == (None, None)


def test_resampling_is_by_length(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.1, 0.0), (1, 2, 2.0, 0.1, 0.0), (1, 3, 3.0, 1.0, 0.0), (1, 4, 4.0, 1.0, 0.0), (2, 5, 0.0, 7.0, 7.0), (3, 6, 0.0, 5.0, 5.0), (3, 7, 1.0, 5.0, 5.0)], "k long, event_id long, t double, lat double, lon double")
    got = sorted((r["k"], r["j"], round(r["lat"], 9)) for r in wind.resampled(p, ["k"], 5).collect())
    assert got == [(1, 0, 0.0), (1, 1, 0.25), (1, 2, 0.5), (1, 3, 0.75), (1, 4, 1.0), (2, 0, 7.0), (3, 0, 5.0)]


def test_winds_of_paths(spark):
    g = grid(spark, lambda *x: 0.0, lambda *x: 20.0)
    f = spark.createDataFrame([(1, 0.0, 7200.0, 34000.0, 40.0, 9.0, 48.0, 9.0, 230.0)], "aircraft long, dep_ts double, duration_s double, alt double, o_lat double, o_lon double, d_lat double, d_lon double, tas_ms double")
    p = spark.createDataFrame(flight(1), POINT)
    assert wind.track_wind(p, f.select("aircraft", "dep_ts", "duration_s", "alt"), g, ["aircraft"]).head()["wind_ms"] == pytest.approx(20.0, abs=1e-6)
    assert wind.great_circle_wind(f, g, ["aircraft"]).head()["wind_ms"] == pytest.approx(20.0, abs=1e-6)


def arrays(rows):
    return [np.array([np.nan if r[i] is None else r[i] for r in rows], float) for i in (2, 3, 4, 5, 7, 8)]


def test_each_baseline_has_its_own_wind():
    """A flight due north, then due east: the great circle and the flown path meet one wind differently."""
    rows = [(1, i, i * 20.0, 40 + min(i, 100) * 0.04, 9 + max(i - 100, 0) * 0.05, min(i * 1000.0, 34000.0, (199 - i) * 900.0), False, 440.0, None, "A320") for i in range(200)]
    t, lat, lon, alt, gs, ias = arrays(rows)
    model = perf.PerfModel()
    east = lambda la, lo, at, h: (np.full(len(la), 30.0), np.zeros(len(la)))
    still, blown = perf.split(model, t, lat, lon, alt, gs, ias), perf.split(model, t, lat, lon, alt, gs, ias, east)
    a, o = perf.equal_arcs(lat, lon, 24)
    parts = 30 * np.sin(np.radians(perf.bearings(a, o)))
    want = len(parts) / (1 / (230 + parts)).sum() - 230
    assert blown["wind_track_ms"] == pytest.approx(want) and blown["wind_gc_ms"] != pytest.approx(want, abs=0.5) and still["wind_gc_ms"] == 0
    hybrid, ideal = perf.ideal_kg(model, blown["flown_km"], blown["cruise_alt_ft"], blown["wind_track_ms"]), perf.ideal_kg(model, blown["gc_km"], blown["cruise_alt_ft"], blown["wind_gc_ms"])
    assert blown["lateral"] == pytest.approx((hybrid - ideal) / ideal * 100) and abs(blown["lateral"] - still["lateral"]) > 0.1


def test_cruise_state_keeps_an_altitude_without_airspeed():
    alt, vs = np.full(30, 35000.0), np.zeros(30)
    assert perf.cruise_state(alt, np.full(30, np.nan), vs)[0] == 35000 and math.isnan(perf.cruise_state(alt, np.full(30, np.nan), vs)[1])
    ias = np.full(30, 260.0)
    ias[0] = np.nan
    assert perf.cruise_state(alt, ias, vs)[1] == pytest.approx(float(perf.cas_to_tas_kt(260.0, 35000.0)))
    assert perf.cruise_state(alt, ias, np.full(30, 400.0)) is None


def test_vectors_burn_as_steps_do():
    model, s = perf.PerfModel(), perf.profile(perf.PerfModel(), 800.0, 34000.0)
    assert perf.burned(model, s, passes=20).sum() == pytest.approx(perf.burned_one_by_one(model, s, passes=20), rel=1e-6)
    assert perf.burned(model, s).sum() == pytest.approx(perf.burned_one_by_one(model, s), rel=1e-3)


def test_phases_and_places_add_up(spark, points):
    clean = flights.flights_of(points, BOX)[1].withColumn("gs", F.lit(440.0))
    split = perf.decomposed(clean, ["aircraft", "leg"], {"A320": perf.PerfModel()})
    frozen = split.select("aircraft", "leg", "real_kg", "ideal_kg", "hybrid_kg", "flown_km", "cruise_alt_ft", F.col("wind_track_ms").alias("wind_ms"), "vertical")
    parts = phase.phase_split(clean, frozen, ["aircraft", "leg"], {"A320": perf.PerfModel()}).drop("real_kg", "hybrid_kg").join(frozen, ["aircraft", "leg"])
    r = parts.head()
    assert abs(r["residual"]) < 1e-9 and r["vert_climb"] + r["vert_cruise"] + r["vert_desc"] == pytest.approx(r["vertical"]) and r["vert_dep"] + r["vert_enr"] + r["vert_arr"] == pytest.approx(r["vertical"])
    assert 0 < r["tma_dep"] < r["tma_arr"] < 1 and 0 < r["nom_climb"] <= r["nom_desc"] < 1
    grounded = parts.withColumns({"ground_dep": F.lit(0.4), "ground_arr": F.lit(0.2), "vertical": F.col("vertical") - 0.6})
    assert phase.checked(phase.without_ground(grounded)).count() == 1
    with pytest.raises(ValueError):
        phase.checked(grounded)


def test_ground_share_and_steps(spark, points):
    one = points.where("aircraft = 1 and event_id <> 57").withColumn("leg", F.lit(0))
    steps = perf.step_table(one, ["aircraft", "leg"], {"A320": perf.PerfModel()})
    r = ground.ground_share(steps, ["aircraft", "leg"]).head()
    assert r["n_steps"] == steps.count() and r["fuel_kg"] == pytest.approx(steps.agg(F.sum("burn")).head()[0])
    assert r["n_suolo"] == 1 and r["n_a3000t70"] == 0 and r["share_suolo"] == pytest.approx(r["fuel_suolo_kg"] / r["fuel_kg"])
    assert r["fuel_suolo_dep_kg"] == r["fuel_suolo_kg"] and r["fuel_suolo_arr_kg"] == 0


def test_taxi_is_unknown_where_an_end_is_not_seen(spark):
    pts = [(1, i, i * 100.0, 0.0 if i < 5 else 5000.0, 2.0 if i < 2 else 20.0) for i in range(12)] + [(1, 99, 9999.0, None, None)]
    f = spark.createDataFrame([(1,), (2,)], "k long")
    got = {r["k"]: r for r in ground.taxi(spark.createDataFrame(pts, "k long, event_id long, t double, alt double, gs double"), f, ["k"]).collect()}
    assert got[1]["dep_ok"] and not got[1]["arr_ok"] and got[1]["n_ground"] == 5
    assert (got[1]["taxi_dep_span_s"], got[1]["taxi_dep_seen_s"], got[1]["taxi_dep_moving_s"], got[1]["taxi_arr_span_s"]) == (500.0, 400.0, 300.0, None)
    assert not got[2]["dep_ok"] and got[2]["n_ground"] == 0


def test_places_within_a_radius_cross_the_date_line_and_the_pole(spark):
    a = spark.createDataFrame([("line", 0.0, 179.9), ("pole", 89.5, 0.0), ("mid", 45.0, 10.0)], "k string, lat double, lon double")
    r = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.5, 180.0), (3, 45.0, 12.0), (4, 45.0, 13.0)], "r long, rlat double, rlon double")
    assert sorted((x["k"], x["r"]) for x in track.within(a, r, 200.0).collect()) == [("line", 1), ("mid", 3), ("pole", 2)]


def test_ideals_by_table_and_in_the_wind(spark):
    models = {"A320": perf.PerfModel(), "E170": perf.PerfModel(oew=21_000, mtow=38_000, wing_m2=72.0, ceiling_ft=37_000)}
    got = {(r["typecode"], r["bucket_km"]): r["alt_ft"] for r in perf.altitude_table(spark, models, range(200, 1001, 400)).collect()}
    assert got == {(t, b): perf.best_altitude(m, float(b)) for t, m in models.items() for b in (200, 600, 1000)}
    ends, tail = (40.0, 9.0, 50.0, 9.0), lambda la, lo, t, h: (np.zeros(len(la)), np.full(len(la), 25.0))
    assert perf.wind_aware_ideal_co2(models["A320"], ends, 0.0, tail) < perf.wind_aware_ideal_co2(models["A320"], ends, 0.0)
    assert perf.airspeed([260.0, 30.0, np.nan], [30000.0] * 3, [400.0] * 3).tolist()[1:] == [400.0, 400.0] and perf.airspeed([260.0], [30000.0], [400.0], "gs").tolist() == [400.0]
    t, lat, lon, alt, gs, ias = arrays(flight(1))
    x = perf.excess_without_wind(models["A320"], t, lat, lon, alt, gs, ias)
    assert abs(x["detour_pct"]) < 1e-6 and x["excess_pct"] == pytest.approx((x["real_co2_kg"] / x["ideal_co2_kg"] - 1) * 100)
