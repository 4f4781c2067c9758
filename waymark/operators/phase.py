"""Where along a flight the vertical excess arises: by phase (the ideal profile's climb, cruise and descent) and by place (terminal areas)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import performance as perf

#: The terminal area's radius in km, the share of the top that counts as reached, and what parts may miss of their sum.
TMA_KM, NEAR_TOP, RESIDUAL = 74.08, 0.95, 1e-6
PARTS = ("climb", "cruise", "desc", "dep", "enr", "arr")
COLUMNS = ", ".join([*(f"vert_{p} double" for p in PARTS), "nom_climb double, nom_desc double, tma_dep double, tma_arr double, toc double, tod double, real_kg double, hybrid_kg double, residual double"])


def phase_of(alt: Column, vs: Column) -> Column:
    """ground, climb, descent, cruise, or unknown without an altitude."""
    return F.when(alt.isNull() | F.isnan(alt), "unknown").when(alt < 1000, "ground").when(vs > 350, "climb").when(vs < -350, "descent").otherwise("cruise")


def marks(points: DataFrame, keys: list[str], tma_km: float = TMA_KM) -> DataFrame:
    """keys, n_outside, exit_i, entry_i (first and last point outside both terminal areas; null below three), toc_i, tod_i (first and last near the
    top), by places from 0 in order of time."""
    order, whole = Window.partitionBy(*keys).orderBy("t", "event_id"), Window.partitionBy(*keys)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"i": F.row_number().over(order) - 1, "top": F.max("alt").over(whole), **{f"{n}_{c}": f(c).over(full) for n, f in (("o", F.first), ("d", F.last)) for c in ("lat", "lon")}})
    far = lambda n: geo.haversine_km(F.col(f"{n}_lat"), F.col(f"{n}_lon"), F.col("lat"), F.col("lon")) > tma_km
    outside, high = far("o") & far("d"), (F.col("alt") >= NEAR_TOP * F.col("top")) & (F.col("top") > 0)
    out = p.groupBy(*keys).agg(F.count(F.when(outside, 1)).alias("n_outside"), F.min(F.when(outside, F.col("i"))).alias("e0"), F.max(F.when(outside, F.col("i"))).alias("e1"), F.min(F.when(high, F.col("i"))).alias("toc_i"), F.max(F.when(high, F.col("i"))).alias("tod_i"))
    enough = F.col("n_outside") >= 3
    return out.select(*keys, "n_outside", F.when(enough, F.col("e0")).alias("exit_i"), F.when(enough, F.col("e1")).alias("entry_i"), "toc_i", "tod_i")


def _fractions(km: np.ndarray) -> np.ndarray | None:
    total = km.sum()
    return np.concatenate([[0.0], np.cumsum(km)]) / total if np.isfinite(total) and total > 0 else None


def _shares(u: np.ndarray, burn: np.ndarray, cuts: list[float]) -> list[float]:
    """The burn of steps with edges u that falls between cuts, the last part open at its end; a step without width goes whole to the part that holds it."""
    edges, out = [0.0, *cuts, math.inf], []
    a, b = u[:-1], u[1:]
    wide = b > a
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = np.clip(np.minimum(b, hi) - np.maximum(a, lo), 0, None)
        share = np.where(wide, np.clip(part / np.where(wide, b - a, 1), 0, 1), ((a >= lo) & (a < hi)).astype(float))
        out.append(float((burn * share).sum()))
    return out


def _ideal_cuts(vs: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """Where the built ideal profile ends its climb and begins its descent; one place where the two cross."""
    up, down = np.flatnonzero(vs > 1), np.flatnonzero(vs < -1)
    a, b = (u[up[-1] + 1] if len(up) else 0.0), (u[down[0]] if len(down) else 1.0)
    return (float(a), float(b)) if a <= b else ((a + b) / 2, (a + b) / 2)


def parted(model, frozen: dict[str, float], t, lat, lon, alt, gs, ias) -> dict[str, float] | None:
    """One flight's vertical excess by phase and by place, in points of the ideal. frozen: real_kg, ideal_kg, hybrid_kg, flown_km, cruise_alt_ft,
    wind_ms of its split; the points give the shares, frozen the level."""
    if not frozen["ideal_kg"] > 0:
        return None
    nominal = perf.profile(model, frozen["flown_km"], frozen["cruise_alt_ft"], frozen["wind_ms"])
    km = perf.haversine(lat[:-1], lon[:-1], lat[1:], lon[1:])
    tas = np.where(np.nan_to_num(ias) > 40, perf.cas_to_tas_kt(np.nan_to_num(ias), np.nan_to_num(alt)), gs)
    real = perf.steps(t, alt, tas, km)
    if nominal is None or real is None:
        return None
    nom_burn, real_burn = perf.burned(model, nominal), perf.burned(model, real)
    nom_u, real_u = _fractions(nominal["km"]), _fractions(real["km"])
    at = _fractions(np.where(real["ok"], km, 0.0))
    if nom_u is None or real_u is None or at is None or real_burn.sum() <= 0:
        return None
    scale, ideal = frozen["real_kg"] / real_burn.sum(), frozen["ideal_kg"]
    excess = lambda cuts: [(r * scale - n) / ideal * 100 for r, n in zip(_shares(real_u, real_burn, cuts), _shares(nom_u, nom_burn, cuts), strict=True)]
    a, b = _ideal_cuts(nominal["vs"], nom_u)
    out = dict(zip(("vert_climb", "vert_cruise", "vert_desc"), excess([a, b]), strict=True)) | {"nom_climb": a, "nom_desc": b, "real_kg": float(real_burn.sum()), "hybrid_kg": float(nom_burn.sum())}
    away = np.flatnonzero((perf.haversine(lat[0], lon[0], lat, lon) > TMA_KM) & (perf.haversine(lat[-1], lon[-1], lat, lon) > TMA_KM))
    if len(away) >= 3:
        c, d = float(at[away[0]]), float(at[away[-1]])
        out |= dict(zip(("vert_dep", "vert_enr", "vert_arr"), excess([c, d]), strict=True)) | {"tma_dep": c, "tma_arr": d}
    high = np.flatnonzero(alt >= NEAR_TOP * np.nanmax(alt)) if np.isfinite(alt).any() and np.nanmax(alt) > 0 else []
    if len(high):
        out |= {"toc": float(at[high[0]]), "tod": float(at[high[-1]])}
    vertical = (frozen["real_kg"] - frozen["hybrid_kg"]) / ideal * 100
    return out | {"residual": vertical - out["vert_climb"] - out["vert_cruise"] - out["vert_desc"]}


def phase_split(points: DataFrame, frozen: DataFrame, keys: list[str], models: dict[str, perf.PerfModel] | None = None) -> DataFrame:
    """keys, typecode and COLUMNS of each flight of points that frozen (keys and parted()'s columns) has. NaN becomes null."""
    models = models or {"": perf.PerfModel()}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    given = ["real_kg", "ideal_kg", "hybrid_kg", "flown_km", "cruise_alt_ft", "wind_ms"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t"], kind="stable")
        head = frame.iloc[0]
        arrays = (frame[c].to_numpy(float) for c in ("t", "lat", "lon", "alt", "gs", "ias"))
        found = parted(models[head["typecode"] if "" not in models else ""], {c: float(head[f"f_{c}"]) for c in given}, *arrays) if len(frame) > 10 else None
        return pd.DataFrame([{k: head[k] for k in [*keys, "typecode"]} | {n: found.get(n, math.nan) for n in names}] if found else [], columns=[*keys, "typecode", *names])

    known = points if "" in models else points.where(F.col("typecode").isin(list(models)))
    joined = known.join(frozen.select(*keys, *(F.col(c).cast("double").alias(f"f_{c}") for c in given)), keys)
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in [*keys, "typecode"])
    out = joined.groupBy(*keys).applyInPandas(run, f"{kinds}, {COLUMNS}")
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def without_ground(rows: DataFrame) -> DataFrame:
    """rows (vert_* by phase and by place, from gate to gate; ground_dep, ground_arr in the same points; vertical without the ground) whose parts are
    without the ground too: it lies in the departure's and the arrival's part, and in climb and descent."""
    less = lambda c, g: F.col(c) - F.coalesce(F.col(g), F.lit(0.0))
    return rows.withColumns({"vert_dep": less("vert_dep", "ground_dep"), "vert_arr": less("vert_arr", "ground_arr"), "vert_climb": less("vert_climb", "ground_dep"), "vert_desc": less("vert_desc", "ground_arr")})


def residuals(rows: DataFrame) -> DataFrame:
    """phase, place: the largest amount by which complete parts miss the vertical excess."""
    gap = lambda names: F.max(F.abs(sum((F.col(f"vert_{p}") for p in names[1:]), F.col(f"vert_{names[0]}")) - F.col("vertical")))
    return rows.agg(gap(PARTS[:3]).alias("phase"), gap(PARTS[3:]).alias("place"))


def checked(rows: DataFrame, most: float = RESIDUAL) -> DataFrame:
    """rows, if their parts add up to the vertical excess; otherwise numerators and denominators stand on different bases, which raises."""
    r = residuals(rows).head()
    if max(r["phase"] or 0.0, r["place"] or 0.0) > most:
        raise ValueError(f"parts don't add up to the vertical excess: {r.asDict()}")
    return rows


def same_days(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same days."""
    x, y = a.select("day").distinct(), b.select("day").distinct()
    return not x.exceptAll(y).head(1) and not y.exceptAll(x).head(1)
