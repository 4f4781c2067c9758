"""Wind along paths: a grid as a table, its completeness, interpolation in four dimensions, resampled paths, and the wind that gives the right time.

The grid is a table (valid_time in seconds, level in hPa, lat, lon, u, v), one row a node. Axes are small tables of their own: a
position meets its two neighbours on each axis by the axis's place, and its 16 nodes by an equi-join on four places, so no grid
is held whole by a task. Axes need not be evenly spaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, isa

#: Hours and levels of a complete day; samples of a path; the airspeed that weighs segments, m/s.
LEAST_HOURS, LEVELS, SAMPLES, REFERENCE_MS = 20, 11, 24, 230.0
AXES = ("valid_time", "level", "lat", "lon")


def complete_days(grid: DataFrame, hours: int = LEAST_HOURS, levels: int = LEVELS) -> DataFrame:
    """day of each day whose grid has enough hours, exactly so many levels, and both components."""
    day = F.date_format(F.timestamp_seconds("valid_time"), "yyyy-MM-dd")
    found = grid.groupBy(day.alias("day")).agg(F.count_distinct("valid_time").alias("hours"), F.count_distinct("level").alias("levels"), F.count("u").alias("nu"), F.count("v").alias("nv"))
    return found.where((F.col("hours") >= hours) & (F.col("levels") == levels) & (F.col("nu") > 0) & (F.col("nv") > 0)).select("day")


def slice_share(grid: DataFrame, value: str, level: float, valid_time: float, above: float) -> DataFrame:
    """median and share above a threshold of one level of one hour."""
    return grid.where((F.col("level") == level) & (F.col("valid_time") == valid_time)).agg(F.percentile(value, 0.5).alias("median"), F.avg((F.col(value) > above).cast("double")).alias("share"))


def _axis(grid: DataFrame, name: str) -> list[float]:
    """The axis's values in order. An axis has at most some thousand values, whatever the corpus: days are interpolated one grid at a time."""
    return [r[0] for r in grid.select(F.col(name).cast("double")).distinct().orderBy(name).collect()]


def _cell(x: Column, axis: list[float], clamp: bool) -> tuple[Column, Column, Column]:
    """Places of the two neighbours of x on the axis, and the upper one's weight. Beyond the ends: the end (clamp), or a straight line on."""
    values = F.array(*map(F.lit, axis))
    if len(axis) == 1:
        return F.lit(0), F.lit(0), F.when(x.isNotNull(), F.lit(0.0))
    x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(axis[0])), F.lit(axis[-1]))) if clamp else x  # greatest() passes over nulls
    step = (axis[-1] - axis[0]) / (len(axis) - 1)
    even = all(abs(b - a - step) < 1e-9 * max(abs(step), 1) for a, b in zip(axis, axis[1:], strict=False))
    low = F.floor((x - axis[0]) / step) if even else F.size(F.filter(values, lambda v: v <= x)) - 1
    low = F.when(x.isNotNull(), F.least(F.greatest(low.cast("int"), F.lit(0)), F.lit(len(axis) - 2)))
    a, b = F.get(values, low), F.get(values, low + 1)
    return low, low + 1, (x - a) / (b - a)


def interpolated(points: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """points (key, t, lat, lon, alt; key is unique) with u and v: linear in time, pressure, latitude and longitude. Pressure and place are clamped to the
    grid, time goes on beyond it. A point without a place, or next to a node that the grid lacks, gets null."""
    axes = {name: _axis(grid, name) for name in AXES}
    at = {"valid_time": F.col("t"), "level": isa.pressure_pa(F.col("alt")) / 100, "lat": F.col("lat"), "lon": F.col("lon")}
    sides = {name: _cell(at[name], axes[name], name != "valid_time") for name in AXES}
    corner = lambda name: F.array(F.struct(sides[name][0].alias("i"), (1 - sides[name][2]).alias("w")), F.struct(sides[name][1].alias("i"), sides[name][2].alias("w")))
    rows = points.select(key, *(corner(name).alias(f"c_{name}") for name in AXES))
    for name in AXES:
        rows = rows.withColumn(f"x_{name}", F.explode(f"c_{name}")).drop(f"c_{name}")
    weight = F.col("x_valid_time.w") * F.col("x_level.w") * F.col("x_lat.w") * F.col("x_lon.w")
    rows = rows.select(key, weight.alias("w"), *(F.col(f"x_{name}.i").alias(f"i_{name}") for name in AXES)).where("w <> 0 or w is null")
    place = lambda name: (F.array_position(F.array(*map(F.lit, axes[name])), F.col(name).cast("double")) - 1).cast("int").alias(f"i_{name}")
    nodes = grid.select(*(place(name) for name in AXES), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    met = rows.join(nodes, [f"i_{name}" for name in AXES], "left").groupBy(key).agg(
        *(F.when(F.count(F.col("w") * F.col(c)) == F.count(F.lit(1)), F.sum(F.col("w") * F.col(c))).alias(c) for c in ("u", "v"))
    )
    return points.join(met, key, "left")


def along(u: Column, v: Column, bearing: Column) -> Column:
    """The wind's part along a bearing, from behind."""
    return u * F.sin(F.radians(bearing)) + v * F.cos(F.radians(bearing))


def effective(part: Column, airspeed_ms: Column | float = REFERENCE_MS) -> Column:
    """Aggregate: the wind that gives the right time over equal lengths (harmonic mean of ground speeds less the airspeed); the plain mean where a
    ground speed is 1 m/s or less; 0 without any."""
    part = F.when(~F.isnan(part), part)
    speed = F.lit(airspeed_ms) if isinstance(airspeed_ms, float) else F.max(airspeed_ms)
    ground = part + (F.lit(airspeed_ms) if isinstance(airspeed_ms, float) else airspeed_ms)
    return F.when(F.count(part) == 0, F.lit(0.0)).when(F.min(ground) <= 1, F.avg(part)).otherwise(F.count(part) / F.sum(1 / ground) - speed)


def resampled(points: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys, j (0 to n - 1), lat, lon: n places at equal arc length along each path (t, event_id, lat, lon). A path without length is its first point.

    Each segment gives the samples that fall in it, so the work is one window over the points and n rows a path."""
    order = Window.partitionBy(*keys).orderBy("t", "event_id")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
    seg = points.withColumns({"la": F.lead("lat").over(order), "lo": F.lead("lon").over(order), "i": F.row_number().over(order)}).withColumn("km", km)
    whole = Window.partitionBy(*keys)
    seg = seg.withColumns({"total": F.sum("km").over(whole), "s1": F.sum("km").over(order.rowsBetween(Window.unboundedPreceding, 0)), "segs": F.max("i").over(whole) - 1})
    step = F.col("total") / (n - 1)
    s0 = F.col("s1") - F.col("km")
    last = F.when(F.col("i") == F.col("segs"), F.lit(n - 1)).otherwise(F.least(F.floor(F.col("s1") / step), F.lit(n - 1)))
    first = F.when(F.col("i") == 1, F.lit(0)).otherwise(F.least(F.floor(s0 / step), F.lit(n - 1)) + 1)
    inside = seg.where("km is not null and total > 0").withColumns({"a": first.cast("int"), "b": last.cast("int")}).where("a <= b")
    rows = inside.withColumn("j", F.explode(F.sequence("a", "b")))
    part = F.when(F.col("km") > 0, F.least(F.greatest((F.col("j") * step - s0) / F.col("km"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    lin = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * part
    moved = rows.select(*keys, "j", lin("lat", "la").alias("lat"), lin("lon", "lo").alias("lon"))
    still = seg.where("i = 1 and coalesce(total, 0) <= 0").select(*keys, F.lit(0).alias("j"), "lat", "lon")
    return moved.unionByName(still)


def _mean(legs: DataFrame, keys: list[str], grid: DataFrame, airspeed_ms: Column | float = REFERENCE_MS) -> DataFrame:
    """keys and wind_ms of segments (keys, j, t, lat, lon, alt, bearing)."""
    numbered = legs.withColumn("__k", F.struct(*keys, "j"))
    return interpolated(numbered, grid, "__k").groupBy(*keys).agg(effective(along(F.col("u"), F.col("v"), F.col("bearing")), airspeed_ms).alias("wind_ms"))


def track_wind(points: DataFrame, flights: DataFrame, grid: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys, wind_ms: over the flown path, at the middle of each of n - 1 equal parts, when the ideal flight would pass it. flights: keys, dep_ts,
    duration_s, alt (the cruise level)."""
    order = Window.partitionBy(*keys).orderBy("j")
    p = resampled(points, keys, n).withColumns({"la": F.lead("lat").over(order), "lo": F.lead("lon").over(order)}).where("la is not null").join(flights, keys)
    t = F.col("dep_ts") + (F.col("j") + 0.5) / (n - 1) * F.col("duration_s")
    legs = p.select(*keys, "j", t.alias("t"), ((F.col("lat") + F.col("la")) / 2).alias("lat"), ((F.col("lon") + F.col("lo")) / 2).alias("lon"), "alt", geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")).alias("bearing"))
    return _mean(legs, keys, grid)


def great_circle_wind(flights: DataFrame, grid: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys, wind_ms: over the great circle, at n places, both ends included. flights: keys, o_lat, o_lon, d_lat, d_lon, dep_ts, duration_s, alt,
    tas_ms (the cruise airspeed, which weighs the places)."""
    f = F.col("j") / (n - 1)
    ends = [F.col(c) for c in ("o_lat", "o_lon", "d_lat", "d_lon")]
    lat, lon = geo.gc_point(*ends, f)
    p = flights.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"lat": lat, "lon": lon})
    ahead = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    back = geo.bearing_deg(F.col("d_lat"), F.col("d_lon"), F.col("o_lat"), F.col("o_lon"))
    bearing = F.when(F.col("j") == n - 1, F.pmod(back + 180, F.lit(360.0))).otherwise(ahead)
    return _mean(p.select(*keys, "j", (F.col("dep_ts") + f * F.col("duration_s")).alias("t"), "lat", "lon", "alt", "tas_ms", bearing.alias("bearing")), keys, grid, F.col("tas_ms"))
