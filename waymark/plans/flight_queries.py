"""Queries over legs, winds, ground and phases, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, isa, text
from waymark.operators import flights, ground, phase, track, wind
from waymark.plans.other_queries import GAP, LEGS, TR, _hav
from waymark.sources.tables import table, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = (36.0, 71.0, -9.5, 24.5)
KEYS = ["aircraft", "leg"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.legs(traces(spark, sf_dir), GAP)


_ENDS = f"""{LEGS}, ends AS (SELECT aircraft, leg, count(*) AS n, min(t) AS t0, max(t) AS t1, max(alt) AS max_alt, arg_min(lat, t) AS o_lat, arg_min(lon, t) AS o_lon, arg_min(alt, t) AS o_alt, arg_max(lat, t) AS d_lat, arg_max(lon, t) AS d_lon, arg_max(alt, t) AS d_alt FROM legs GROUP BY aircraft, leg)"""


@query(f"WITH {_ENDS} SELECT aircraft, leg, n, round(o_alt, 4) AS o_alt, round(d_alt, 4) AS d_alt, round(max_alt, 4) AS max_alt FROM ends WHERE n >= 4 AND o_lat BETWEEN 36 AND 71 AND d_lat BETWEEN 36 AND 71 AND o_lon BETWEEN -9.5 AND 24.5 AND d_lon BETWEEN -9.5 AND 24.5 AND o_alt <= 6000 AND d_alt <= 6000 AND max_alt >= 5000 AND t1 - t0 BETWEEN 3600 AND 72000")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs from low to low inside the box, high and long enough."""
    out = flights.complete(flights.ends(_legs(spark, sf_dir), KEYS), BOX, 6000.0, 5000.0, 3600.0, 72000.0, 4)
    return out.select(*KEYS, "n", *(F.round(c, 4).alias(c) for c in ("o_alt", "d_alt", "max_alt")))


@query(f"WITH {TR} SELECT aircraft, bool_or(lat BETWEEN 36 AND 40 AND lon BETWEEN -9.5 AND -8) AS touches, count(*) FILTER (WHERE lat BETWEEN 36 AND 40 AND lon BETWEEN -9.5 AND -8) AS inside FROM tr GROUP BY aircraft")
def q_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft with a point in a box, and how many."""
    box = (36.0, 40.0, -9.5, -8.0)
    p = traces(spark, sf_dir).groupBy("aircraft").agg(F.collect_list(F.struct("lat", "lon")).alias("p"), F.count(F.when(flights.in_box(F.col("lat"), F.col("lon"), box), 1)).alias("inside"))
    return p.select("aircraft", flights.touches_box(F.col("p"), box).alias("touches"), "inside")


_FIG = f"""{_ENDS}, g AS (SELECT aircraft, leg, t - lag(t) OVER w AS gap, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM legs WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id)),
q AS (SELECT aircraft, leg, coalesce(sum(km), 0) AS flown, coalesce(max(gap), 0) AS max_gap, coalesce(sum(gap) FILTER (WHERE gap > 7200), 0) AS hole FROM g GROUP BY aircraft, leg), e AS (SELECT *, {_hav('o_lat', 'o_lon', 'd_lat', 'd_lon')} AS gc FROM ends JOIN q USING (aircraft, leg))"""
_STORED = """o AS (SELECT aircraft, leg, t, event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY aircraft, leg) AS total FROM legs WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id)),
w AS (SELECT aircraft, leg, rn, total, t AS kt, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.aircraft, o.leg, o.rn, o.total, CASE WHEN o.t - w.kt >= 7000 THEN o.t ELSE w.kt END, o.t - w.kt >= 7000 FROM w JOIN o ON o.aircraft = w.aircraft AND o.leg = w.leg AND o.rn = w.rn + 1),
s AS (SELECT aircraft, leg, count(*) AS n_pts_stored FROM w WHERE kept OR rn = total GROUP BY aircraft, leg)"""


@query(f"""WITH RECURSIVE {_FIG}, {_STORED} SELECT aircraft, leg, round(t1 - t0, 3) AS duration_s, round(gc, 4) AS gc_km, round(flown, 4) AS flown_km, CASE WHEN gc > 0 THEN round((flown - gc) / gc * 100, 4) END AS detour_pct, n AS n_pts_native, n_pts_stored, round(CASE WHEN t1 > t0 THEN 1 - hole / (t1 - t0) ELSE 0 END, 6) AS coverage_frac,
round(max_gap, 3) AS max_gap_s, round(hole, 3) AS hole_time_s, gc > 0 AND flown >= 0.9 * gc AS flown_ge_09gc FROM e JOIN s USING (aircraft, leg)""")
def q_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that are stored with each leg, and how many points are."""
    out = flights.processed(_legs(spark, sf_dir), KEYS, 7000.0, 7200.0)[1]
    return out.select(*KEYS, F.round("duration_s", 3).alias("duration_s"), *(F.round(c, 4).alias(c) for c in ("gc_km", "flown_km", "detour_pct")), "n_pts_native", "n_pts_stored", F.round("coverage_frac", 6).alias("coverage_frac"), F.round("max_gap_s", 3).alias("max_gap_s"), F.round("hole_time_s", 3).alias("hole_time_s"), "flown_ge_09gc")


@query(f"""WITH {LEGS}, m AS (SELECT *, CASE WHEN event_type = 'view' THEN 0 WHEN event_type <> 'click' THEN round_even(alt / 100, 0) * 100 END AS level, alt / 8 AS vs FROM legs), v AS (SELECT *, CASE WHEN level > 0 OR (event_type NOT IN ('view', 'click') AND alt > 0) THEN 1 END AS seen FROM m)
SELECT aircraft, leg, count(seen) AS mcp_n_pts, count(DISTINCT CASE WHEN seen = 1 AND abs(vs) < 300 THEN level END) AS mcp_n_levels, arg_min(level, t) FILTER (WHERE seen = 1) AS mcp_first_ft, max(CASE WHEN seen = 1 THEN level END) AS mcp_max_ft FROM v GROUP BY aircraft, leg""")
def q_selected_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialled altitude of each leg: how often seen, levels held, the first and the highest."""
    dialled = F.when(F.col("event_type") == "view", F.lit(0.0)).when(F.col("event_type") != "click", F.col("alt"))
    return flights.selected_altitude(_legs(spark, sf_dir).withColumns({"mcp": dialled, "vs": F.col("alt") / 8}), KEYS)


@query(f"""WITH {LEGS}, p AS (SELECT *, row_number() OVER w - 1 AS i, max(alt) OVER (PARTITION BY aircraft, leg) AS top, first_value(lat) OVER x AS o_lat, first_value(lon) OVER x AS o_lon, last_value(lat) OVER x AS d_lat, last_value(lon) OVER x AS d_lon FROM legs WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id), x AS (PARTITION BY aircraft, leg ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
far AS (SELECT *, {_hav('o_lat', 'o_lon', 'lat', 'lon')} > 500 AND {_hav('d_lat', 'd_lon', 'lat', 'lon')} > 500 AS outside, alt >= 0.95 * top AND top > 0 AS high FROM p), g AS (SELECT aircraft, leg, count(*) FILTER (WHERE outside) AS n_outside, min(i) FILTER (WHERE outside) AS e0, max(i) FILTER (WHERE outside) AS e1, min(i) FILTER (WHERE high) AS toc, max(i) FILTER (WHERE high) AS tod FROM far GROUP BY aircraft, leg)
SELECT aircraft, leg, n_outside, CASE WHEN n_outside >= 3 THEN e0 END AS exit_i, CASE WHEN n_outside >= 3 THEN e1 END AS entry_i, toc AS toc_i, tod AS tod_i FROM g""")
def q_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where legs leave and enter the ends' surroundings, and reach and leave their top."""
    return phase.marks(_legs(spark, sf_dir), KEYS, 500.0).select(*KEYS, "n_outside", *(F.col(c).cast("long").alias(c) for c in ("exit_i", "entry_i", "toc_i", "tod_i")))


@query(f"""WITH {LEGS}, p AS (SELECT aircraft, leg, t, event_id, lat, lon, lead(lat) OVER w AS la, lead(lon) OVER w AS lo, row_number() OVER w AS i FROM legs WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id)), k AS (SELECT *, {_hav('lat', 'lon', 'la', 'lo')} AS km FROM p WHERE la IS NOT NULL),
s AS (SELECT *, sum(km) OVER (PARTITION BY aircraft, leg ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s1, sum(km) OVER (PARTITION BY aircraft, leg) AS total, max(i) OVER (PARTITION BY aircraft, leg) AS segs FROM k), r AS (SELECT s.*, j, j * total / 8.0::DOUBLE AS target FROM s, range(0, 9) AS r(j) WHERE total > 0),
x AS (SELECT *, row_number() OVER (PARTITION BY aircraft, leg, j ORDER BY i) AS pick FROM r WHERE km > 0 AND (target <= s1 + 1e-9 OR i = segs))
SELECT aircraft, leg, CAST(j AS BIGINT) AS j, round(lat + (la - lat) * least(greatest((target - (s1 - km)) / km, 0), 1), 5) AS lat, round(lon + (lo - lon) * least(greatest((target - (s1 - km)) / km, 0), 1), 5) AS lon FROM x WHERE pick = 1""")
def q_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine places at equal arc length along each leg that has a length."""
    out = wind.resampled(_legs(spark, sf_dir), KEYS, 9)
    moving = out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).where("__n = 9")
    return moving.select(*KEYS, F.col("j").cast("long").alias("j"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


_T0 = 1704067200.0
_GRID_SQL = f"""grid AS (SELECT {_T0}::DOUBLE + a * 864000.0::DOUBLE AS valid_time, CASE b WHEN 0 THEN 300.0 WHEN 1 THEN 500.0 ELSE 850.0 END::DOUBLE AS level, 35 + c * 8.0::DOUBLE AS lat, -10 + d * 7.0::DOUBLE AS lon, 20 * sin(a + b * 0.7::DOUBLE + c * 0.3::DOUBLE) + d AS u, 10 * cos(a * 0.5::DOUBLE + c + d * 0.2::DOUBLE) - b AS v FROM range(0, 3) AS ra(a), range(0, 3) AS rb(b), range(0, 5) AS rc(c), range(0, 6) AS rd(d))"""


def _grid(spark: SparkSession) -> DataFrame:
    """A wind grid by formula: 3 times, 3 levels, 5 latitudes, 6 longitudes."""
    k = spark.range(3 * 3 * 5 * 6).select((F.col("id") % 3).alias("a"), (F.floor(F.col("id") / 3) % 3).alias("b"), (F.floor(F.col("id") / 9) % 5).alias("c"), F.floor(F.col("id") / 45).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    level = F.when(b == 0, 300.0).when(b == 1, 500.0).otherwise(850.0)
    return k.select((_T0 + a * 864000.0).alias("valid_time"), level.alias("level"), (35 + c * 8.0).alias("lat"), (-10 + d * 7.0).alias("lon"), (20 * F.sin(a + b * 0.7 + c * 0.3) + d).alias("u"), (10 * F.cos(a * 0.5 + c + d * 0.2) - b).alias("v"))


_P = "CASE WHEN alt * 5 * 0.3048::DOUBLE < 11000 THEN 101325.0::DOUBLE * pow(1 - 0.0065::DOUBLE * alt * 5 * 0.3048::DOUBLE / 288.15::DOUBLE, 9.80665::DOUBLE / (287.05287::DOUBLE * 0.0065::DOUBLE)) ELSE 22632.06::DOUBLE * exp(-9.80665::DOUBLE * (alt * 5 * 0.3048::DOUBLE - 11000) / (287.05287::DOUBLE * 216.65::DOUBLE)) END"
_UV = f"""{_GRID_SQL}, q AS (SELECT event_id, aircraft, t, least(greatest({_P} / 100, 300), 850) AS p, least(greatest(lat, 35), 67) AS y, least(greatest(lon, -10), 25) AS x FROM tr),
c AS (SELECT *, CASE WHEN t < {_T0 + 864000}::DOUBLE THEN 0 ELSE 1 END AS it, CASE WHEN p < 500 THEN 0 ELSE 1 END AS ip, least(CAST(floor((y - 35) / 8) AS INTEGER), 3) AS iy, least(CAST(floor((x + 10) / 7) AS INTEGER), 4) AS ix FROM q),
w AS (SELECT *, (t - {_T0}::DOUBLE - it * 864000.0::DOUBLE) / 864000.0::DOUBLE AS wt, CASE WHEN ip = 0 THEN (p - 300) / 200 ELSE (p - 500) / 350 END AS wp, (y - 35 - iy * 8.0::DOUBLE) / 8 AS wy, (x + 10 - ix * 7.0::DOUBLE) / 7 AS wx FROM c),
k AS (SELECT event_id, {_T0}::DOUBLE + (it + a) * 864000.0::DOUBLE AS valid_time, CASE ip + b WHEN 0 THEN 300.0 WHEN 1 THEN 500.0 ELSE 850.0 END::DOUBLE AS level, 35 + (iy + c) * 8.0::DOUBLE AS lat, -10 + (ix + d) * 7.0::DOUBLE AS lon, CASE WHEN a = 1 THEN wt ELSE 1 - wt END * CASE WHEN b = 1 THEN wp ELSE 1 - wp END * CASE WHEN c = 1 THEN wy ELSE 1 - wy END * CASE WHEN d = 1 THEN wx ELSE 1 - wx END AS wgt FROM w, range(0, 2) AS ra(a), range(0, 2) AS rb(b), range(0, 2) AS rc(c), range(0, 2) AS rd(d)),
uv AS (SELECT event_id, sum(wgt * u) AS u, sum(wgt * v) AS v FROM k JOIN grid USING (valid_time, level, lat, lon) GROUP BY event_id)"""


def _winds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wind.interpolated(traces(spark, sf_dir).withColumn("alt", F.col("alt") * 5), _grid(spark), "event_id")


@query(f"WITH {TR}, {_UV} SELECT event_id, round(u, 5) AS u, round(v, 5) AS v FROM uv")
def q_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind at each position from the 16 nodes around it."""
    return _winds(spark, sf_dir).select("event_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(f"""WITH {TR}, {_UV}, a AS (SELECT aircraft, u * sin(radians(lat * 3)) + v * cos(radians(lat * 3)) AS part FROM uv JOIN tr USING (event_id)) SELECT aircraft, round(avg(part), 5) AS mean, round(CASE WHEN min(230 + part) <= 1 THEN avg(part) ELSE count(*) / sum(1 / (230 + part)) - 230 END, 5) AS effective FROM a GROUP BY aircraft""")
def q_effective_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wind along bearings made of latitudes, by aircraft: plain and effective means."""
    part = _winds(spark, sf_dir).select("aircraft", wind.along(F.col("u"), F.col("v"), F.col("lat") * 3).alias("part"))
    return part.groupBy("aircraft").agg(F.round(F.avg("part"), 5).alias("mean"), F.round(wind.effective(F.col("part")), 5).alias("effective"))


@query(f"""WITH {_GRID_SQL}, e AS (SELECT valid_time, level, lat, lon, u + 30 AS u, v FROM grid) SELECT level, round(median(u), 6) AS median, round(avg(CASE WHEN u > 30 THEN 1.0 ELSE 0.0 END), 6) AS share FROM e WHERE level = 500 AND valid_time = {_T0 + 864000}::DOUBLE GROUP BY level""")
def q_grid_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of one hour of the grid."""
    out = wind.slice_share(_grid(spark).withColumn("u", F.col("u") + 30), "u", 500.0, _T0 + 864000, 30.0)
    return out.select(F.lit(500.0).alias("level"), F.round("median", 6).alias("median"), F.round("share", 6).alias("share"))


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS hours, count(DISTINCT event_type) AS levels FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day FROM h WHERE hours >= 24 AND levels = 5""")
def q_wind_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have all hours and levels (event types stand for levels)."""
    e = table(spark, sf_dir, "events").select((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9) * 3600).alias("valid_time"), F.col("event_type").alias("level"), F.col("value").alias("u"), F.col("value").alias("v"))
    return wind.complete_days(e, 24, 5)


_STEPS = f"""{LEGS}, st AS (SELECT aircraft, leg, event_id, t, lead(t) OVER w - t AS dt, alt - 400 AS alt, value AS tas, {_hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS km, value * 2 + 1 AS burn FROM (SELECT legs.*, alt / 80 AS value FROM legs) WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id)), steps AS (SELECT * FROM st WHERE dt IS NOT NULL)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("t", "event_id")
    value = F.col("alt") / 80
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    p = _legs(spark, sf_dir).withColumns({"dt": F.lead("t").over(w) - F.col("t"), "km": km, "tas": value, "burn": value * 2 + 1}).withColumn("alt", F.col("alt") - 400).where("dt is not null")
    return p.withColumn("i", F.struct("t", "event_id"))


_MASK = {"suolo": "alt <= 0", "a1000t40": "alt < 1000 AND tas < 40", "a1000t70": "alt < 1000 AND tas < 70", "a1000t100": "alt < 1000 AND tas < 100", "a3000t70": "alt < 3000 AND tas < 70"}
_SHARES = ", ".join(f"round(coalesce(sum(burn) FILTER (WHERE {m}), 0), 4) AS fuel_{k}_kg, round(coalesce(sum(dt) FILTER (WHERE {m}), 0), 3) AS t_{k}_s, count(*) FILTER (WHERE {m}) AS n_{k}, round(coalesce(sum(burn) FILTER (WHERE ({m}) AND early), 0), 4) AS fuel_{k}_dep_kg, round(coalesce(sum(burn) FILTER (WHERE ({m}) AND NOT early), 0), 4) AS fuel_{k}_arr_kg, round(coalesce(sum(burn) FILTER (WHERE {m}), 0) / sum(burn), 6) AS share_{k}" for k, m in _MASK.items())


@query(f"""WITH {_STEPS}, a AS (SELECT *, sum(km) OVER (PARTITION BY aircraft, leg ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS arc, sum(km) OVER (PARTITION BY aircraft, leg) AS total FROM steps), h AS (SELECT *, (arc - km / 2) / CASE WHEN total > 0 THEN total ELSE 1 END < 0.5 AS early FROM a) SELECT aircraft, leg, round(sum(burn), 4) AS fuel_kg, count(*) AS n_steps, {_SHARES} FROM h GROUP BY aircraft, leg""")
def q_ground_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumption on the ground by five definitions, by half of the path."""
    out = ground.ground_share(_steps(spark, sf_dir), KEYS)
    places = lambda c: 3 if c.startswith("t_") else 6 if c.startswith("share") else 4
    return out.select(*(F.round(c, places(c)).alias(c) if c.startswith(("fuel", "t_", "share")) else F.col(c) for c in out.columns))


_G = "(alt < 3000 AND alt / 80 < 30)"


@query(f"""WITH {LEGS}, p AS (SELECT *, {_G} AS g, alt / 80 AS gs, t - lag(t) OVER (PARTITION BY aircraft, leg ORDER BY t, event_id) AS dt, min(CASE WHEN NOT {_G} THEN t END) OVER (PARTITION BY aircraft, leg) AS up, max(CASE WHEN NOT {_G} THEN t END) OVER (PARTITION BY aircraft, leg) AS down FROM legs),
q AS (SELECT aircraft, leg, count(*) FILTER (WHERE g AND t < up) AS nd, count(*) FILTER (WHERE g AND t > down) AS na, max(up) - min(t) FILTER (WHERE g AND t < up) AS ds, max(t) FILTER (WHERE g AND t > down) - max(down) AS as_, sum(dt) FILTER (WHERE g AND t < up AND dt <= 9000) AS dseen, sum(dt) FILTER (WHERE g AND t > down AND dt <= 9000) AS aseen,
max(up) - min(t) FILTER (WHERE g AND t < up AND gs > 3) AS dm, max(t) FILTER (WHERE g AND t > down AND gs > 3) - max(down) AS am FROM p GROUP BY aircraft, leg) SELECT aircraft, leg, coalesce(nd + na, 0) AS n_ground, nd >= 2 AS dep_ok, na >= 2 AS arr_ok, CASE WHEN nd >= 2 THEN round(ds, 3) END AS taxi_dep_span_s, CASE WHEN na >= 2 THEN round(as_, 3) END AS taxi_arr_span_s, CASE WHEN nd >= 2 THEN round(dseen, 3) END AS taxi_dep_seen_s,
CASE WHEN na >= 2 THEN round(aseen, 3) END AS taxi_arr_seen_s, CASE WHEN nd >= 2 THEN round(dm, 3) END AS taxi_dep_moving_s, CASE WHEN na >= 2 THEN round(am, 3) END AS taxi_arr_moving_s FROM q""")
def q_taxi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time on the ground at both ends of each leg, by three definitions."""
    p = _legs(spark, sf_dir).withColumn("gs", F.col("alt") / 80)
    out = ground.taxi(p, p.select(*KEYS).distinct(), KEYS, 3000.0, 30.0, 9000.0, 2)
    return out.select(*KEYS, "n_ground", "dep_ok", "arr_ok", *(F.round(c, 3).alias(c) for c in out.columns if c.startswith("taxi")))


@query(f"""WITH {LEGS} SELECT CASE WHEN alt IS NULL THEN 'unknown' WHEN alt < 1000 THEN 'ground' WHEN (alt / 80 - 50) * 20 > 350 THEN 'climb' WHEN (alt / 80 - 50) * 20 < -350 THEN 'descent' ELSE 'cruise' END AS phase, count(*) AS n, round(avg(alt), 4) AS mean_alt FROM legs GROUP BY 1""")
def q_phase_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by phase of flight."""
    p = traces(spark, sf_dir)
    return p.groupBy(phase.phase_of(F.col("alt"), (F.col("alt") / 80 - 50) * 20).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("alt"), 4).alias("mean_alt"))


_SPACED = "SELECT {s} AS spacing, * FROM (SELECT aircraft, t, event_id, alt, t - first_value(t) OVER (PARTITION BY aircraft ORDER BY t, event_id) AS since FROM tr)"


@query(f"""WITH {TR}, s AS (SELECT * FROM tr, (VALUES (1), (2), (4)) AS x(k)), b AS (SELECT k, aircraft, CAST(floor(t / (k * 36000)) AS BIGINT) AS slot, arg_min(alt, t) AS alt FROM s GROUP BY ALL), a AS (SELECT k, count(*) AS n, sum(alt) AS total, sum(CASE WHEN alt < 2000 THEN alt ELSE 0 END) AS low FROM b GROUP BY k)
SELECT CAST(k AS BIGINT) AS spacing, n, round(low / total, 8) AS share_low, round((low / total - lag(low / total) OVER (ORDER BY k)) * 100, 6) AS drift FROM a""")
def q_thin_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a share of the total drifts as points get sparser: every spacing in one pass."""
    spaced = traces(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    b = spaced.groupBy("k", "aircraft", F.floor(F.col("t") / (F.col("k") * 36000)).alias("slot")).agg(F.min_by("alt", "t").alias("alt"))
    a = b.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("alt") < 2000, F.col("alt")).otherwise(0.0)) / F.sum("alt")).alias("share"))
    drift = (F.col("share") - F.lag("share").over(Window.orderBy("k"))) * 100  # three rows
    return a.select(F.col("k").cast("long").alias("spacing"), "n", F.round("share", 8).alias("share_low"), F.round(drift, 6).alias("drift"))


@query("""WITH h AS (SELECT p_partkey, 200 + p_size AS temp, 0.00001::DOUBLE * (1 + p_partkey % 40) AS q FROM part), e AS (SELECT *, exp(9.550426::DOUBLE - 5723.265::DOUBLE / temp + 3.53068::DOUBLE * ln(temp) - 0.00728332::DOUBLE * temp) AS sat FROM h) SELECT p_partkey, round(sat, 6) AS sat_pa, round(q * 25000 / (0.622::DOUBLE + 0.378::DOUBLE * q) / sat * 100, 6) AS rhi FROM e""")
def q_humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation over ice and relative humidity, at temperatures made of part sizes."""
    t, q = (F.col("p_size") + 200).cast("double"), 0.00001 * (1 + F.col("p_partkey") % 40)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(isa.saturation_pa_ice(t), 6).alias("sat_pa"), F.round(isa.relative_humidity_ice(q, t, F.lit(25000.0)), 6).alias("rhi"))


@query(f"""WITH {TR} SELECT event_id, strftime(make_timestamp(CAST(floor(t) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN abs(alt / 80 - 50) < 0.5 THEN '0' ELSE CASE WHEN alt / 80 > 50 THEN '+' ELSE '-' END || format('{{:.0f}}', floor(abs(round(alt / 80 - 50, 4)) + 0.5)) END AS signed, round(least(greatest(alt, 1000), 3000), 4) AS clipped, strftime(make_timestamp(CAST(floor(t) AS BIGINT) * 1000000), '%Y-%m') AS month,
CASE WHEN t < 1705276800 THEN 'winter' ELSE 'summer' END AS season FROM tr""")
def q_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants, signed figures, bounds, months and seasons as they are printed."""
    day = F.to_date(F.timestamp_seconds("t"))
    half = F.floor(F.abs(F.round(F.col("alt") / 80 - 50, 4)) + 0.5) * F.signum(F.col("alt") / 80 - 50)
    x = F.when(F.abs(F.col("alt") / 80 - 50) < 0.5, F.lit(0.0)).otherwise(half)
    return traces(spark, sf_dir).select("event_id", text.iso_utc(F.col("t")).alias("iso"), text.signed(x).alias("signed"), F.round(text.clipped(F.col("alt"), 1000.0, 3000.0), 4).alias("clipped"), text.month_of(day).alias("month"), text.season_of(day, "2024-01-15").alias("season"))


@query("""WITH h AS (SELECT p_partkey, p_size * 700.0::DOUBLE AS alt, CASE WHEN p_size % 4 <> 0 THEN p_size * 7.0::DOUBLE END AS ias, 400.0::DOUBLE + p_size AS gs FROM part), s AS (SELECT *, greatest(288.15::DOUBLE - 0.0065::DOUBLE * alt * 0.3048::DOUBLE, 216.65::DOUBLE) AS t, CASE WHEN alt * 0.3048::DOUBLE < 11000 THEN 101325.0::DOUBLE * pow(1 - 0.0065::DOUBLE * alt * 0.3048::DOUBLE / 288.15::DOUBLE, 9.80665::DOUBLE / (287.05287::DOUBLE * 0.0065::DOUBLE)) ELSE 22632.06::DOUBLE * exp(-9.80665::DOUBLE * (alt * 0.3048::DOUBLE - 11000) / (287.05287::DOUBLE * 216.65::DOUBLE)) END AS p FROM h)
SELECT p_partkey, round(CASE WHEN ias > 40 THEN sqrt(7.0::DOUBLE * 287.05287::DOUBLE * t * (pow(1 + 101325.0::DOUBLE * (pow(1 + 1.225::DOUBLE / (7 * 101325.0::DOUBLE) * pow(ias * 0.514444::DOUBLE, 2), 3.5::DOUBLE) - 1) / p, 2 / 7.0::DOUBLE) - 1)) / 0.514444::DOUBLE ELSE gs END, 4) AS tas FROM s""")
def q_airspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best airspeed that a report allows: the indicated one made true, or the ground's."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(isa.best_tas_kt(F.when(size % 4 != 0, size * 7.0), 400.0 + size, size * 700.0), 4).alias("tas"))
