"""Consumption along a track: a parametric performance model, ideal profiles, and the split of an excess into lateral and vertical parts.

The model is a strategy: anything with its fields and flow() will do. The default is a drag polar with a thrust-specific consumption
that falls with altitude; its figures are relative. Kernels are numpy on one flight's arrays, run by applyInPandas on points grouped
by flight; filter flights before, as no filter is pushed below a grouped map.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units, and the constants of loads, profiles and terminal areas.
KT, FT, CO2, PAX_KG, LOAD, RESERVE_KG = 0.514444, 0.3048, 3.16, 100.0, 0.82, 2000.0
STEP_S, CLIMB_FPM, DESCENT_FPM, LOW_KT, MAX_CAS_KT, TMA_KM, EARTH_KM = 20.0, 2000.0, 1800.0, 250.0, 310.0, 74.08, 6371.0088


def air(alt_ft):
    """Density and speed of sound of the standard atmosphere."""
    h = np.asarray(alt_ft, float) * FT
    t = np.maximum(288.15 - 0.0065 * h, 216.65)
    p = np.where(h < 11000, 101325 * (np.maximum(1 - 0.0065 * h / 288.15, 0.1)) ** 5.25588, 22632.06 * np.exp(-9.80665 * (h - 11000) / (287.05287 * 216.65)))
    return p / (287.05287 * t), np.sqrt(1.4 * 287.05287 * t), p


def cas_to_tas_kt(cas_kt, alt_ft):
    rho, sound, p = air(alt_ft)
    impact = 101325 * ((1 + 0.2 * (np.asarray(cas_kt) * KT / 340.294) ** 2) ** 3.5 - 1)
    return np.sqrt(5 * ((1 + impact / p) ** (2 / 7) - 1)) * sound / KT


@dataclass(frozen=True)
class PerfModel:
    oew: float = 42_600.0
    mtow: float = 78_000.0
    pax_max: int = 180
    cruise_mach: float = 0.78
    ceiling_ft: float = 39_000.0
    wing_m2: float = 122.6
    cd0: float = 0.021
    k: float = 0.039
    tsfc: float = 1.6e-5

    def flow(self, mass, tas_kt, alt_ft, vs_fpm):
        """kg a second: drag plus the climb's share of weight, times a specific consumption; at least idle."""
        rho, sound, _ = air(alt_ft)
        v = np.maximum(np.asarray(tas_kt, float) * KT, 50.0)
        q = 0.5 * rho * v * v * self.wing_m2
        lift = mass * 9.80665
        thrust = q * self.cd0 + self.k * lift**2 / q + lift * np.asarray(vs_fpm, float) * FT / 60 / v
        return np.maximum(thrust * self.tsfc * (1 - 0.004 * np.minimum(np.asarray(alt_ft) / 1000, 36)) * (1 + 0.1 * v / sound), 0.08)


def haversine(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    s = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(s, 0, 1)))


def steps(t, alt, tas, km) -> dict[str, np.ndarray] | None:
    """Usable steps between points: up to 600 s, with a known positive airspeed; None below ten."""
    dt, alt = np.diff(t), np.nan_to_num(np.asarray(alt, float))
    vs = np.diff(alt) / np.where(dt > 0, dt, 1) * 60
    ok = (dt > 0) & (dt <= 600) & np.isfinite(tas[:-1]) & (np.nan_to_num(tas[:-1]) > 0)
    return {"dt": dt[ok], "alt": alt[:-1][ok], "vs": vs[ok], "tas": np.asarray(tas)[:-1][ok], "km": np.asarray(km)[ok], "ok": ok, "t": np.asarray(t)[:-1][ok]} if ok.sum() >= 10 else None


def burned(model, s: dict[str, np.ndarray], load: float = LOAD, reserve: float = RESERVE_KG, passes: int = 4) -> np.ndarray:
    """kg of each step: the start's mass holds the trip's fuel, so some passes settle both."""
    empty = model.oew + load * model.pax_max * PAX_KG + reserve
    trip, before = 0.25 * (model.mtow - model.oew), np.zeros_like(s["dt"])
    for _ in range(passes):
        mass = np.maximum(min(empty + trip, model.mtow) - before, model.oew)
        rate = model.flow(mass, s["tas"], s["alt"], s["vs"])
        burn = np.where(np.isfinite(rate) & (rate > 0), rate, 0) * s["dt"]
        before = np.cumsum(burn) - burn
        trip = burn.sum()
    return burn


def cruise_tas(model, alt_ft: float) -> float:
    return min(model.cruise_mach * float(air(alt_ft)[1]) / KT, float(cas_to_tas_kt(MAX_CAS_KT, alt_ft)))


def profile(model, km: float, alt_ft: float, wind_ms: float = 0.0, tas_kt: float | None = None) -> dict[str, np.ndarray]:
    """Steps of an ideal flight: climb, cruise whose clock the wind moves, descent, in whole steps of STEP_S, one each at least."""
    tas = cruise_tas(model, alt_ft) if tas_kt is None else tas_kt
    up, down = alt_ft / CLIMB_FPM * 60, alt_ft / DESCENT_FPM * 60
    slow_km = (LOW_KT + tas) / 2 * 1.852 / 3600
    level_s = max(km - slow_km * (up + down), 0) * 1000 / max(tas * KT + wind_ms, 50)
    n = [max(int(x / STEP_S), 1) for x in (up, level_s, down)]
    ramp = lambda k: np.arange(k) / k
    alt = np.concatenate([ramp(n[0]) * alt_ft, np.full(n[1], alt_ft), (1 - ramp(n[2])) * alt_ft, [0.0]])
    speed = np.concatenate([LOW_KT + ramp(n[0]) * (tas - LOW_KT), np.full(n[1], tas), tas - ramp(n[2]) * (tas - LOW_KT), [LOW_KT]])
    return steps(np.arange(len(alt)) * STEP_S, alt, speed, speed[:-1] * 1.852 * STEP_S / 3600)


def ideal_kg(model, km: float, alt_ft: float, wind_ms: float = 0.0, tas_kt: float | None = None) -> float:
    s = profile(model, km, alt_ft, wind_ms, tas_kt)
    return float(burned(model, s).sum()) if s else math.inf


def best_altitude(model, km: float) -> float:
    """The altitude of the least consumption, in steps of 2000 ft from 16000 ft; the lowest of equal ones. Evaluated at the centre of the
    50 km bucket, so it doesn't depend on which flight asks first."""
    centre = max(round(km / 50) * 50, 25)
    levels = np.arange(16000, model.ceiling_ft + 1, 2000)
    return float(levels[int(np.argmin([ideal_kg(model, centre, a) for a in levels]))])


def effective_wind(along_ms: np.ndarray, tas_ms: float) -> float:
    """The wind that gives the right time: the harmonic mean of ground speeds less the airspeed; the plain mean where a ground speed is absurd."""
    w = along_ms[np.isfinite(along_ms)]
    if not len(w):
        return 0.0
    ground = tas_ms + w
    return float(w.mean()) if (ground <= 1).any() else float(len(w) / (1 / ground).sum() - tas_ms)


#: Fixed values of the cruise: share of the top, climb in ft a minute, points.
NEAR_TOP, LEVEL_FPM, LEVEL_POINTS = 0.85, 300.0, 10


def cruise_state(alt, ias, vs) -> tuple[float, float] | None:
    """Median altitude of the level points near the top, and the true airspeed of their median indicated one at that altitude (NaN where
    none has one); None below ten points."""
    alt, ias = np.asarray(alt, float), np.asarray(ias, float)
    if not np.isfinite(alt).any():
        return None
    level = (alt >= NEAR_TOP * np.nanmax(alt)) & (np.abs(vs) < LEVEL_FPM)
    if level.sum() < LEVEL_POINTS:
        return None
    top, known = float(np.median(alt[level])), ias[level][np.isfinite(ias[level])]
    return top, float(cas_to_tas_kt(np.median(known), top)) if len(known) else math.nan


def enroute(lat, lon) -> tuple[float, float]:
    """Flown over great-circle length between the terminal areas, and the flown length; NaN with fewer than three points outside."""
    out = np.flatnonzero((haversine(lat[0], lon[0], lat, lon) > TMA_KM) & (haversine(lat[-1], lon[-1], lat, lon) > TMA_KM))
    if len(out) < 3:
        return math.nan, math.nan
    a, b = out[0], out[-1] + 1
    flown = float(haversine(lat[a : b - 1], lon[a : b - 1], lat[a + 1 : b], lon[a + 1 : b]).sum())
    gc = float(haversine(lat[a], lon[a], lat[b - 1], lon[b - 1]))
    return (flown / gc, flown) if gc > 0 else (math.nan, math.nan)


COLUMNS = "gc_km double, flown_km double, real_kg double, hybrid_kg double, ideal_kg double, total double, lateral double, vertical double, vert_alt double, vert_speed double, vert_rest double, ratio_enroute double, cruise_alt_ft double, wind_gc_ms double, wind_track_ms double"


def gc_places(lat1: float, lon1: float, lat2: float, lon2: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n places on the great circle, both ends included."""
    p1, l1, p2, l2 = np.radians([lat1, lon1, lat2, lon2])
    d = float(haversine(lat1, lon1, lat2, lon2)) / EARTH_KM
    if d < 1e-12:
        return np.array([lat1]), np.array([lon1])
    f = np.linspace(0, 1, n)
    a, b = np.sin((1 - f) * d) / np.sin(d), np.sin(f * d) / np.sin(d)
    x, y, z = a * np.cos(p1) * np.cos(l1) + b * np.cos(p2) * np.cos(l2), a * np.cos(p1) * np.sin(l1) + b * np.cos(p2) * np.sin(l2), a * np.sin(p1) + b * np.sin(p2)
    return np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x))


def equal_arcs(lat, lon, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n places at equal arc length along a path; its first place where it has no length."""
    s = np.concatenate([[0.0], np.cumsum(haversine(lat[:-1], lon[:-1], lat[1:], lon[1:]))])
    if s[-1] <= 0:
        return np.asarray(lat)[:1], np.asarray(lon)[:1]
    at = np.linspace(0, s[-1], n)
    return np.interp(at, s, lat), np.interp(at, s, lon)


def bearings(lat, lon) -> np.ndarray:
    p, q, d = np.radians(lat[:-1]), np.radians(lat[1:]), np.radians(np.diff(lon))
    return np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))) % 360


#: Samples of a path's wind, and the airspeed (m/s) that weighs the parts of a flown path.
WIND_SAMPLES, REFERENCE_MS = 24, 230.0


def _component(wind, lat, lon, t, alt_ft, bearing) -> np.ndarray:
    u, v = wind(lat, lon, t, np.full(len(lat), alt_ft))
    b = np.radians(bearing)
    return np.asarray(u, float) * np.sin(b) + np.asarray(v, float) * np.cos(b)


def wind_on_great_circle(wind, model, ends, start: float, km: float, alt_ft: float) -> float:
    """The effective wind (m/s) at WIND_SAMPLES places of the great circle, weighed by the cruise airspeed."""
    lat, lon = gc_places(*ends, WIND_SAMPLES)
    if len(lat) < 2:
        return 0.0
    b = bearings(lat, lon)
    tas = cruise_tas(model, alt_ft)
    t = start + np.linspace(0, 1, len(lat)) * km / (tas * 1.852) * 3600
    return effective_wind(_component(wind, lat, lon, t, alt_ft, np.append(b, b[-1])), tas * KT)


def wind_on_track(wind, lat, lon, start: float, seconds: float, alt_ft: float) -> float:
    """The effective wind (m/s) at the middles of equal arcs of the flown path: by length, not by time, as slow parts have more points."""
    a, o = equal_arcs(lat, lon, WIND_SAMPLES)
    if len(a) < 2:
        return 0.0
    part = (np.arange(len(a) - 1) + 0.5) / (len(a) - 1)
    return effective_wind(_component(wind, (a[:-1] + a[1:]) / 2, (o[:-1] + o[1:]) / 2, start + part * seconds, alt_ft, bearings(a, o)), REFERENCE_MS)


def split(model, t, lat, lon, alt, gs, ias, wind=None) -> dict[str, float] | None:
    """One flight's excess: ideal on the great circle in its wind, hybrid on the flown length at the same altitude in the flown path's wind, real;
    and the vertical part by altitude, speed and rest. wind(lat, lon, t, alt_ft) gives arrays u and v in m/s."""
    km = haversine(lat[:-1], lon[:-1], lat[1:], lon[1:])
    tas = np.where(np.nan_to_num(ias) > 40, cas_to_tas_kt(np.nan_to_num(ias), np.nan_to_num(alt)), gs)
    s, gc, flown = steps(t, alt, tas, km), float(haversine(lat[0], lon[0], lat[-1], lon[-1])), float(km.sum())
    if s is None or gc <= 0:
        return None
    real, level = float(burned(model, s).sum()), best_altitude(model, gc)
    ends = (lat[0], lon[0], lat[-1], lon[-1])
    straight = wind_on_great_circle(wind, model, ends, t[0], gc, level) if wind else 0.0
    flown_in = (lambda a: wind_on_track(wind, lat, lon, t[0], t[-1] - t[0], a)) if wind else (lambda a: 0.0)
    bent = flown_in(level)
    ideal, hybrid = ideal_kg(model, gc, level, straight), ideal_kg(model, flown, level, bent)
    if not 0 < ideal < math.inf:
        return None
    out = {"gc_km": gc, "flown_km": flown, "real_kg": real, "hybrid_kg": hybrid, "ideal_kg": ideal, "total": (real - ideal) / ideal * 100, "lateral": (hybrid - ideal) / ideal * 100, "vertical": (real - hybrid) / ideal * 100, "cruise_alt_ft": level, "wind_gc_ms": straight, "wind_track_ms": bent}
    vs = np.gradient(np.nan_to_num(alt), t) * 60
    if state := cruise_state(alt, ias, vs):
        out["vert_alt"] = (ideal_kg(model, flown, state[0], flown_in(state[0])) - hybrid) / ideal * 100
        if state[1] > 50:
            mach = state[1] / float(air(state[0])[1])
            out["vert_speed"] = (ideal_kg(model, flown, level, bent, mach * float(air(level)[1])) - hybrid) / ideal * 100
            out["vert_rest"] = out["vertical"] - out["vert_alt"] - out["vert_speed"]
    out["ratio_enroute"] = enroute(lat, lon)[0]
    return out


def decomposed(points: DataFrame, keys: list[str], models: dict[str, PerfModel] | None = None, wind=None) -> DataFrame:
    """keys, typecode and COLUMNS for each flight of points (t, lat, lon, alt, gs, ias, typecode); types without a model go. NaN becomes null."""
    models = models or {"": PerfModel()}
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t"], kind="stable")
        found = split(models[frame["typecode"].iloc[0] if "" not in models else ""], *(frame[c].to_numpy(float) for c in ("t", "lat", "lon", "alt", "gs", "ias")), wind) if len(frame) > 1 else None
        head = {k: frame[k].iloc[0] for k in [*keys, "typecode"]}
        return pd.DataFrame([head | {n: found.get(n, math.nan) for n in names}] if found else [], columns=[*keys, "typecode", *names])

    known = points if "" in models else points.where(F.col("typecode").isin(list(models)))
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in [*keys, "typecode"])
    out = known.groupBy(*keys).applyInPandas(run, f"{kinds}, {COLUMNS}")
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


STEP_COLUMNS = "i int, t double, dt double, alt double, vs double, tas double, km double, burn double"


def airspeed(ias, alt, gs, mode: str = "ias") -> np.ndarray:
    """True airspeed in kt: from the indicated one where it is over 40 (mode "ias"), else the ground speed."""
    ias, gs = np.nan_to_num(np.asarray(ias, float)), np.asarray(gs, float)
    return gs if mode == "gs" else np.where(ias > 40, cas_to_tas_kt(ias, np.nan_to_num(alt)), gs)


def wind_aware_ideal_co2(model, ends: tuple[float, float, float, float], start: float, wind=None) -> float:
    """kg of CO2 of the ideal flight between two places (lat, lon, lat, lon) that leaves at start, in the wind of its great circle."""
    km = float(haversine(*ends))
    level = best_altitude(model, km)
    return ideal_kg(model, km, level, wind_on_great_circle(wind, model, ends, start, km, level) if wind else 0.0) * CO2


def altitude_table(spark, models: dict[str, PerfModel], buckets: range = range(50, 6001, 50)) -> DataFrame:
    """typecode, bucket_km, alt_ft: the best altitude by type and distance bucket, a table to join by (typecode, bucket); computed by tasks."""
    rows = spark.createDataFrame([(t, b) for t in models for b in buckets], "typecode string, bucket_km int").repartition(max(len(models), 1), "bucket_km")

    def run(batches):
        for batch in batches:
            yield batch.assign(alt_ft=[best_altitude(models[t], float(b)) for t, b in zip(batch["typecode"], batch["bucket_km"], strict=True)])

    return rows.mapInPandas(run, "typecode string, bucket_km int, alt_ft double")


def step_table(points: DataFrame, keys: list[str], models: dict[str, PerfModel] | None = None, load: float = LOAD, reserve: float = RESERVE_KG, tas_mode: str = "ias") -> DataFrame:
    """keys, typecode and each usable step of each flight with its consumption, in order (i). Flights with fewer than ten such steps, or of types without a model, go."""
    models = models or {"": PerfModel()}
    names = [c.split()[0] for c in STEP_COLUMNS.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t"], kind="stable")
        t, lat, lon, alt, gs, ias = (frame[c].to_numpy(float) for c in ("t", "lat", "lon", "alt", "gs", "ias"))
        tas = airspeed(ias, alt, gs, tas_mode)
        s = steps(t, alt, tas, haversine(lat[:-1], lon[:-1], lat[1:], lon[1:])) if len(t) > 10 else None
        if s is None:
            return pd.DataFrame(columns=[*keys, "typecode", *names])
        burn = burned(models[frame["typecode"].iloc[0] if "" not in models else ""], s, load, reserve)
        out = pd.DataFrame({"i": np.arange(len(burn), dtype=np.int32), "t": s["t"], "dt": s["dt"], "alt": s["alt"], "vs": s["vs"], "tas": s["tas"], "km": s["km"], "burn": burn})
        for k in ("typecode", *keys[::-1]):
            out.insert(0, k, frame[k].iloc[0])
        return out[[*keys, "typecode", *names]]

    known = points if "" in models else points.where(F.col("typecode").isin(list(models)))
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in [*keys, "typecode"])
    return known.groupBy(*keys).applyInPandas(run, f"{kinds}, {STEP_COLUMNS}")


def excess_without_wind(model, t, lat, lon, alt, gs, ias) -> dict[str, float] | None:
    """A flight's excess over the still-air ideal, and its detour, in percent."""
    km = haversine(lat[:-1], lon[:-1], lat[1:], lon[1:])
    tas = np.where(np.nan_to_num(ias) > 40, cas_to_tas_kt(np.nan_to_num(ias), np.nan_to_num(alt)), gs)
    s, gc = steps(t, alt, tas, km), float(haversine(lat[0], lon[0], lat[-1], lon[-1]))
    if s is None or gc <= 0:
        return None
    real, ideal = float(burned(model, s).sum()), ideal_kg(model, gc, best_altitude(model, gc))
    return {"real_co2_kg": real * CO2, "ideal_co2_kg": ideal * CO2, "excess_pct": (real - ideal) / ideal * 100, "detour_pct": (float(km.sum()) - gc) / gc * 100}


def burned_one_by_one(model, s: dict[str, np.ndarray], load: float = LOAD, reserve: float = RESERVE_KG, passes: int = 3) -> float:
    """The integrator step by step, with the mass of the moment: what burned() is checked against."""
    start, total = model.oew + load * model.pax_max * PAX_KG + reserve, 0.25 * (model.mtow - model.oew)
    for _ in range(passes):
        mass, used = min(start + total, model.mtow), 0.0
        for dt, alt, vs, tas in zip(s["dt"], s["alt"], s["vs"], s["tas"], strict=True):
            rate = float(model.flow(max(mass - used, model.oew), tas, alt, vs))
            used += rate * dt if math.isfinite(rate) and rate > 0 else 0.0
        total = used
    return total
