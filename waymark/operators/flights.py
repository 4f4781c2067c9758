"""Flights out of positions: gates on complete legs, the stored flight's figures, the selected altitude's summary, and named cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import track

#: Fixed values of the gates: feet, seconds, points, km, shares.
GROUND_FT, CRUISE_FT, SHORTEST_S, LONGEST_S, LEAST_POINTS = 3000.0, 15000.0, 1200.0, 21600.0, 30
LEAST_COVERAGE, LEAST_KM, LEAST_FLOWN, MAX_GS_KT = 0.85, 150.0, 0.9, 700.0


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a place is in the box (south, north, west, east), its edges included."""
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def touches_box(points: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether any of an array of points (structs with lat and lon) is in the box: what decides if a trace is worth cutting into legs."""
    return F.exists(points, lambda p: F.coalesce(in_box(p["lat"], p["lon"], box), F.lit(False)))


def ends(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, t0, t1, max_alt, and the first and last points' lat, lon and alt: by time, and the points' own order on ties."""
    at = F.struct("t", "event_id")
    first, last = F.min_by(F.struct("lat", "lon", "alt"), at), F.max_by(F.struct("lat", "lon", "alt"), at)
    out = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("alt").alias("max_alt"), first.alias("a"), last.alias("b"))
    return out.select(*keys, "n", "t0", "t1", "max_alt", *(F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("a", "o"), ("b", "d")) for c in ("lat", "lon", "alt")))


def complete(flights: DataFrame, box: tuple[float, float, float, float], ground_ft: float = GROUND_FT, cruise_ft: float = CRUISE_FT, shortest_s: float = SHORTEST_S, longest_s: float = LONGEST_S, least_points: int = LEAST_POINTS) -> DataFrame:
    """Of ends(): the legs seen from ground to ground inside the box. An unknown altitude at an end fails."""
    low = lambda c: F.coalesce(F.col(c), F.lit(99999.0)) <= ground_ft
    inside = in_box(F.col("o_lat"), F.col("o_lon"), box) & in_box(F.col("d_lat"), F.col("d_lon"), box)
    return flights.where((F.col("n") >= least_points) & inside & low("o_alt") & low("d_alt") & (F.col("max_alt") >= cruise_ft) & (F.col("t1") - F.col("t0")).between(shortest_s, longest_s))


def flights_of(points: DataFrame, box: tuple[float, float, float, float], max_kt: float = 1400.0, gap_s: float = 1800.0, **gates) -> tuple[DataFrame, DataFrame]:
    """Complete flights of positions (aircraft, event_id, t, lat, lon, alt, new_leg, and any others): their ends, and their clean points.

    Legs are cut, cleaned against the last kept point, then gated; ground speeds beyond MAX_GS_KT become null. A flight's key is
    (aircraft, leg)."""
    keys = ["aircraft", "leg"]
    clean = track.cleaned(track.legs(points, gap_s), max_kt, keys, keep=[c for c in points.columns if c not in ("aircraft", "event_id", "t", "lat", "lon", "alt", "new_leg")])
    if "gs" in clean.columns:
        clean = clean.withColumn("gs", F.when(F.col("gs") <= MAX_GS_KT, F.col("gs")))
    found = complete(ends(clean, keys), box, **gates)
    return found, clean.join(found.select(*keys), keys, "left_semi")


def processed(points: DataFrame, keys: list[str], spacing_s: float = 10.0, long_gap_s: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """The points to store (thinned), and each flight's figures from its native ones: duration, great circle, flown length, detour, points, coverage,
    gaps, and whether the flown length is LEAST_FLOWN of the great circle at least."""
    kept = track.thinned(points, spacing_s, keys)
    q, e = track.quality(points, keys, long_gap_s), ends(points, keys)
    gc = geo.haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))
    stored = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pts_stored"))
    rows = e.withColumn("gc_km", gc).drop("n").join(q, keys).join(stored, keys)
    made = rows.withColumns({
        "duration_s": F.col("t1") - F.col("t0"), "detour_pct": F.when(F.col("gc_km") > 0, (F.col("path_km") - F.col("gc_km")) / F.col("gc_km") * 100),
        "flown_ge_09gc": (F.col("gc_km") > 0) & (F.col("path_km") >= LEAST_FLOWN * F.col("gc_km")), "coverage_frac": F.coalesce("coverage", F.lit(0.0)),
    })
    return kept, made.select(*keys, "duration_s", "gc_km", F.col("path_km").alias("flown_km"), "detour_pct", F.col("n").alias("n_pts_native"), "n_pts_stored", "coverage_frac", "max_gap_s", F.col("hole_s").alias("hole_time_s"), "flown_ge_09gc", "max_alt", "o_lat", "o_lon", "d_lat", "d_lon")


def selected_altitude(points: DataFrame, keys: list[str], level_fpm: float = 300.0) -> DataFrame:
    """keys, mcp_n_pts, mcp_n_levels, mcp_first_ft, mcp_max_ft: the altitude dialled in (mcp, over 0), to the nearest 100 ft, halves to the even
    one. Levels are counted where the reported climb (vs) is slow; flights without any have zeros and nulls."""
    seen = F.col("mcp") > 0
    level = geo.bucket(F.col("mcp"), 100.0)
    held = seen & (F.abs(F.col("vs")) < level_fpm)
    return points.groupBy(*keys).agg(
        F.count(F.when(seen, 1)).alias("mcp_n_pts"), F.count_distinct(F.when(held, level)).alias("mcp_n_levels"),
        F.min_by(F.when(seen, level), F.when(seen, F.struct("t", "event_id"))).alias("mcp_first_ft"), F.max(F.when(seen, level)).alias("mcp_max_ft"),
    )


def modelled(flights: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """flights with model: the performance model of the type, upper-cased, in aliases (type to model); types without one go."""
    names = flights.sparkSession.createDataFrame([(k.upper(), v) for k, v in aliases.items()] or [("", "")], "__type string, model string")
    return flights.join(F.broadcast(names), F.upper("typecode") == F.col("__type")).drop("__type")  # as many rows as aliases


def sound(rows: DataFrame, coverage: float = LEAST_COVERAGE, km: float = LEAST_KM) -> DataFrame:
    """Rows to compare with others: both ends known, enough flown, seen and far."""
    return rows.where(F.col("origin").isNotNull() & F.col("dest").isNotNull() & F.col("flown_ok") & (F.col("coverage") >= coverage) & (F.col("gc_km") >= km))


def for_calibration(rows: DataFrame, coverage: float = 0.9, km: float = LEAST_KM) -> DataFrame:
    """Rows that calibrate a type's cruise flow."""
    return rows.where((F.col("coverage") >= coverage) & (F.col("gc_km") >= km) & (F.col("cruise_ff") > 0))


def floor_cohort(rows: DataFrame, ratio: float = 1.02, hours: tuple[int, ...] = (1, 2, 3, 4), km: float = 1000.0) -> DataFrame:
    """Long, nearly straight flights that leave in quiet hours (UTC): what is left of the excess without traffic."""
    return rows.where((F.col("dist_ratio") < ratio) & F.hour("dep").isin(*hours) & (F.col("gc_km") > km))


def in_perimeter(rows: DataFrame, low_km: float = 370.4, high_km: float = 2778.0) -> DataFrame:
    """Flights of the distances that official figures cover (200 to 1500 NM, both included)."""
    return rows.where(F.col("gc_km").between(low_km, high_km))


def degenerate_shift(rows: DataFrame, below: float = -50.0) -> DataFrame:
    """n, n_degenerate, and the total excess with and without rows whose excess is absurd, and their difference."""
    ok = ~F.coalesce(F.col("total") < below, F.lit(False))
    ratio = lambda c: (F.sum(F.when(c, F.col("real"))) - F.sum(F.when(c, F.col("ideal")))) / F.nullif(F.sum(F.when(c, F.col("ideal"))), F.lit(0.0)) * 100
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~ok, 1)).alias("n_degenerate"), ratio(F.lit(True)).alias("every"), ratio(ok).alias("without"))
    return out.withColumn("shift", F.col("every") - F.col("without"))


def named_ends(rows: DataFrame, route: str = "route") -> DataFrame:
    """Rows whose route has no unnamed end (a tilde stands for a place by coordinates)."""
    return rows.where(~F.col(route).contains("~"))


def on_days(rows: DataFrame, days: DataFrame, exact: bool = True) -> DataFrame:
    """rows of days (day); raises where a day has no row, or, with exact, where rows have a day that days lacks."""
    have = rows.select("day").distinct()
    lacking = [r["day"] for r in days.select("day").distinct().join(have, "day", "left_anti").orderBy("day").limit(20).collect()]
    more = [r["day"] for r in have.join(days, "day", "left_anti").orderBy("day").limit(20).collect()] if exact else []
    if lacking or more:
        raise ValueError(f"days without rows: {lacking}; rows of other days: {more}")
    return rows.join(days.select("day"), "day", "left_semi")


def searched(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that have text in any of the columns, letters in either case; an empty text finds all."""
    return rows.where(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).contains(text.strip().lower()))


def longest_by_type(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of each type and route the longest flight, then of each type the first by length; types in the given order, others after by name."""
    first = rows.groupBy("typecode", "route").agg(F.max("gc_km").alias("gc_km"))
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("typecode").orderBy(F.desc("gc_km"), "route"))).where("r = 1").drop("r")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("typecode")), F.lit(0)), F.lit(len(order) + 1)).cast("int")
    return top.withColumn("place", place).orderBy("place", "typecode")
