"""Ordered operators over positions: legs, greedy cleaning and thinning, gaps, path lengths, buckets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo


def _by_time():
    return Window.partitionBy("aircraft").orderBy("t", "event_id")


def legs(points: DataFrame, gap_s: float = 1800.0) -> DataFrame:
    """points with leg: a new one at the flag or after a gap longer than gap_s; never at an aircraft's first point."""
    before = F.lag("t").over(_by_time())
    starts = before.isNotNull() & (F.col("new_leg") | (F.col("t") - before > gap_s))
    flagged = points.withColumn("__new", starts.cast("int"))
    return flagged.withColumn("leg", F.sum("__new").over(_by_time().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def _new_groups(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; nulls are equal to nulls."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        x = batch.column(k)
        if len(x) > 1:
            null = x.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    new[0] = last is None or last != tuple(batch.column(k)[0].as_py() for k in keys)
    return new


def _walked(points: DataFrame, keys: list[str], columns: list[str], keep, ends: bool) -> DataFrame:
    """The points that keep() chooses, group by group in order of time. keep(state, t, lat, lon) gives a mask for a run of a group's points and the
    state that its next run starts from (None at the first). With ends, each group's last point is kept as well.

    Points come sorted, in batches; a task holds one batch and a state, however long a group is, and does one step a point."""
    names = [*keys, "t", "event_id", *columns]
    df = points.select(*names).repartition(*keys).sortWithinPartitions(*keys, "t", "event_id")

    def run(batches):
        last, state, pending = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "lat", "lon"))
            new = _new_groups(batch, keys, last)
            starts = np.flatnonzero(new | (np.arange(batch.num_rows) == 0))
            mask = np.zeros(batch.num_rows, bool)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if new[a]:
                    if pending is not None and a == 0:
                        yield pending
                    elif ends and a:
                        mask[a - 1] = True
                    state, pending = None, None
                mask[a:b], state = keep(state, t[a:b], lat[a:b], lon[a:b])
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            pending = batch.slice(batch.num_rows - 1) if ends and not mask[-1] else None
            yield batch.filter(pa.array(mask))
        if pending is not None:
            yield pending

    return df.mapInArrow(run, df.schema)


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(max(s, 0.0), 1.0)))


def cleaned(points: DataFrame, max_kt: float = 1400.0, keys: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Points later than the last kept one that it could reach at max_kt: keys, t, event_id, lat, lon, alt, and the columns of keep. A point without
    a place goes, unless it is the first."""

    def reachable(state, t, lat, lon):
        mask = np.zeros(len(t), bool)
        for i, p in enumerate(zip(t.tolist(), lat.tolist(), lon.tolist(), strict=True)):
            if state is None or p[0] > state[0] and _km(state[1], state[2], p[1], p[2]) / 1.852 / ((p[0] - state[0]) / 3600) <= max_kt:
                mask[i], state = True, p
        return mask, state

    return _walked(points, keys or ["aircraft"], ["lat", "lon", "alt", *(keep or [])], reachable, False)


def thinned(points: DataFrame, spacing_s: float = 10.0, keys: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The first and last points, and those at least spacing_s after the last kept one."""

    def spaced(state, t, lat, lon):
        mask, i = np.zeros(len(t), bool), 0
        if state is not None:
            i = int(np.searchsorted(t - state, spacing_s))
        while i < len(t):
            mask[i], state = True, t[i]
            i += 1 + int(np.searchsorted(t[i + 1 : i + 65] - state, spacing_s))
            while 0 < i < len(t) and t[i] - state < spacing_s:
                i += int(np.searchsorted(t[i : i + 64] - state, spacing_s))
        return mask, state

    return _walked(points, keys or ["aircraft"], ["lat", "lon", "alt", *(keep or [])], spaced, True)


def quality(points: DataFrame, keys: list[str], long_gap_s: float = 120.0) -> DataFrame:
    """keys, n, path_km, max_gap_s, hole_s, coverage of each group of points."""
    order = Window.partitionBy(*keys).orderBy("t", "event_id")
    gap = F.col("t") - F.lag("t").over(order)
    step = geo.haversine_km(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    steps = points.withColumns({"__gap": gap, "__km": step})
    hole = F.coalesce(F.sum(F.when(F.col("__gap") > long_gap_s, F.col("__gap"))), F.lit(0.0))
    took = F.max("t") - F.min("t")
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__km"), F.lit(0.0)).alias("path_km"), F.coalesce(F.max("__gap"), F.lit(0.0)).alias("max_gap_s"), hole.alias("hole_s"), F.when(took > 0, 1 - hole / took).alias("coverage"))


def apportioned(steps: DataFrame, keys: list[str], buckets: list[tuple[str, float, float]]) -> DataFrame:
    """keys and a column for each bucket (name, from, to): the burn of steps (u0, u1, burn) inside it. A step is split by overlap; one
    without width goes whole to the bucket that holds it; the last bucket holds its end."""
    out = []
    for i, (name, lo, hi) in enumerate(buckets):
        width = F.col("u1") - F.col("u0")
        share = F.greatest(F.least(F.col("u1"), F.lit(hi)) - F.greatest(F.col("u0"), F.lit(lo)), F.lit(0.0)) / width
        inside = (F.col("u0") >= lo) & ((F.col("u0") <= hi) if i == len(buckets) - 1 else (F.col("u0") < hi))
        out.append(F.sum(F.col("burn") * F.when(width > 0, F.least(share, F.lit(1.0))).otherwise(inside.cast("double"))).alias(name))
    return steps.groupBy(*keys).agg(*out)


def arc_steps(points: DataFrame, keys: list[str], burn: Column) -> DataFrame:
    """Steps between neighbouring points: keys, u0, u1 (fractions of the path), burn, km. Groups without length go."""
    order = Window.partitionBy(*keys).orderBy("t", "event_id")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lead("lat").over(order), F.lead("lon").over(order))
    steps = points.withColumns({"km": km, "burn": burn}).where("km is not null")
    total = F.sum("km").over(Window.partitionBy(*keys))
    done = F.sum("km").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumns({"u0": (done - F.col("km")) / total, "u1": done / total, "__total": total}).where("__total > 0").drop("__total")


def nearest(points: DataFrame, places: DataFrame, radius_km: float = 8.0, cell_deg: float = 0.5) -> DataFrame:
    """points with place and km: the nearest of places (place, plat, plon) strictly within radius_km, the least name on ties, else null.

    Places are copied to the grid cells that their radius can touch (more of them in longitude towards the poles), and points join on
    their own cell, so the join is an equality whatever the number of places."""
    lat_halo = F.ceil(F.lit(radius_km / 110.57 / cell_deg)).cast("int")
    lon_halo = F.ceil(radius_km / (111.32 * F.greatest(F.cos(F.radians(F.abs(F.col("plat")) + radius_km / 110.57)), F.lit(0.01))) / cell_deg).cast("int")
    cell = lambda x: F.floor(x / cell_deg).cast("int")
    spread = places.withColumn("cy", F.explode(F.sequence(cell(F.col("plat")) - lat_halo, cell(F.col("plat")) + lat_halo))).withColumn("cx", F.explode(F.sequence(cell(F.col("plon")) - lon_halo, cell(F.col("plon")) + lon_halo)))
    placed = points.withColumns({"cy": cell(F.col("lat")), "cx": cell(F.col("lon"))})
    met = placed.join(spread, ["cy", "cx"]).withColumn("km", geo.flat_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("km") < radius_km)
    best = met.groupBy("event_id").agg(F.min(F.struct("km", "place")).alias("m")).select("event_id", "m.place", "m.km")
    return points.join(best, "event_id", "left")


def within(places: DataFrame, receivers: DataFrame, radius_km: float, cell_deg: float = 2.0) -> DataFrame:
    """Pairs of places (lat, lon) and receivers (rlat, rlon) at most radius_km apart. Places are copied to the cells that the radius can touch, all
    longitudes where it holds a pole, and receivers join on their own cell."""
    degrees = math.degrees(radius_km / geo.EARTH_KM)
    cell = lambda x: F.floor(x / cell_deg).cast("int")
    turn = round(360 / cell_deg)
    reach = F.sin(F.lit(math.radians(min(degrees, 90)))) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9))
    polar = (F.abs(F.col("lat")) + degrees >= 90) | (reach >= 1)
    halo = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))))
    rows = F.sequence(cell(F.col("lat") - degrees), cell(F.col("lat") + degrees))
    around = F.array_distinct(F.transform(F.sequence(cell(F.col("lon") - halo), cell(F.col("lon") + halo)), lambda c: F.pmod(c, F.lit(turn))))
    spread = places.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(around))
    met = spread.join(receivers.withColumns({"cy": cell(F.col("rlat")), "cx": F.pmod(cell(F.col("rlon")), F.lit(turn))}), ["cy", "cx"]).drop("cy", "cx")
    return met.where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")) <= radius_km)
