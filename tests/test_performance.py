"""Trace documents end to end, and the invariants of the split."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import performance as perf
from waymark.operators import track
from waymark.sources import traces


def document():
    rows, lat = [], 40.0
    for i in range(420):
        alt = min(i * 1000, 34000, (419 - i) * 900)
        rows.append([i * 20.0, round(lat, 5), 9.0, "ground" if alt == 0 else alt, 440.0, 0, 2 if i == 0 else 0, None, {"flight": "DLH2AB "} if i == 0 else None])
        lat += 0.04
    rows.insert(200, [199 * 20.0 + 1, 60.0, 60.0, 34000, 440.0, 0, 0])
    return {"icao": "abc123", "t": "A320", "r": "X", "timestamp": 1.7e9, "trace": rows}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump")
    with tarfile.open(path / "day.tar", "w") as tar:
        for name, data in (("trace_full_a.json", gzip.compress(json.dumps(document()).encode())), ("trace_full_b.json", b"\x1f\x8bbroken"), ("other.json", b"{}")):
            info = tarfile.TarInfo(f"traces/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return traces.members(spark, str(path))


def test_damaged_members_are_named(raw):
    assert [r["member"].split("!")[1] for r in traces.damaged(raw).collect()] == ["traces/trace_full_b.json"]


def test_trace_to_split(raw, spark):
    p = traces.points(raw)
    assert p.count() == 421 and p.orderBy("t").head()["alt"] == 0.0
    assert p.where("callsign is not null").select(traces.operator(p["callsign"]).alias("o")).head()["o"] == "DLH"
    ready = p.selectExpr("icao as aircraft", "cast(i as long) as event_id", "t", "lat", "lon", "alt", "new_leg")
    clean = track.cleaned(track.legs(ready), 1400.0, ["aircraft", "leg"])
    assert clean.count() == 420
    full = clean.selectExpr("aircraft", "leg", "t", "lat", "lon", "alt", "440.0d as gs", "cast(null as double) as ias", "'A320' as typecode")
    r = perf.decomposed(full, ["aircraft", "leg"], {"A320": perf.PerfModel()}).head()
    assert abs(r["lateral"] + r["vertical"] - r["total"]) < 1e-9 and abs(r["lateral"]) < 0.5
    assert r["vert_alt"] is not None and r["vert_speed"] is None and r["vert_rest"] is None  # no airspeed was reported
    fast = perf.decomposed(full.withColumn("ias", F.lit(260.0)), ["aircraft", "leg"], {"A320": perf.PerfModel()}).head()
    assert abs(fast["vert_alt"] + fast["vert_speed"] + fast["vert_rest"] - fast["vertical"]) < 1e-9
    assert perf.decomposed(full, ["aircraft", "leg"], {"B77W": perf.PerfModel()}).count() == 0


def test_effective_wind_is_harmonic():
    assert perf.effective_wind(np.array([-30.0, 70.0]), 230.0) == pytest.approx(10.0)
    assert perf.effective_wind(np.array([np.nan]), 230.0) == 0.0
    assert perf.effective_wind(np.array([-230.0, 30.0]), 230.0) == pytest.approx(-100.0)


def test_longer_flights_burn_more_and_short_ones_stay_low():
    m = perf.PerfModel()
    assert perf.ideal_kg(m, 900, 34000) < perf.ideal_kg(m, 1000, 34000)
    assert perf.ideal_kg(m, 1500, 34000, 20) < perf.ideal_kg(m, 1500, 34000) < perf.ideal_kg(m, 1500, 34000, -20)
    assert perf.best_altitude(m, 200) <= perf.best_altitude(m, 2000)
