"""Queries over traces, days, dimension tables and texts, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, isa
from waymark.operators import track
from waymark.sources.tables import table, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}
GAP, THIN, KNOTS = 21600.0, 36000.0, 150.0
TR = """tr AS (SELECT event_id, user_id AS aircraft, epoch_us(ts) / 1e6 AS t, 35 + (event_id * 37 % 3700) / 100.0::DOUBLE AS lat, -10 + (event_id * 53 % 3500) / 100.0::DOUBLE AS lon, value * 80 AS alt, event_type = 'signup' AS new_leg, event_type FROM events)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(least(greatest(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 0), 1))))"


LEGS = f"""{TR}, f AS (SELECT *, CASE WHEN lag(t) OVER w IS NOT NULL AND (new_leg OR t - lag(t) OVER w > {GAP}) THEN 1 ELSE 0 END AS s FROM tr WINDOW w AS (PARTITION BY aircraft ORDER BY t, event_id)),
legs AS (SELECT *, CAST(sum(s) OVER (PARTITION BY aircraft ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS leg FROM f)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.legs(traces(spark, sf_dir), GAP)


@query(f"WITH {LEGS} SELECT aircraft, leg, count(*) AS n, round(min(t), 3) AS t0, round(max(t), 3) AS t1, round(arg_max(alt, t), 4) AS last_alt FROM legs GROUP BY aircraft, leg")
def q_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs by flag or gap."""
    return _legs(spark, sf_dir).groupBy("aircraft", "leg").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 3).alias("t0"), F.round(F.max("t"), 3).alias("t1"), F.round(F.max_by("alt", "t"), 4).alias("last_alt"))


_WALK = """WITH RECURSIVE {tr}, o AS (SELECT *, row_number() OVER (PARTITION BY aircraft ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY aircraft) AS total FROM tr),
w AS (SELECT aircraft, rn, total, event_id, t, lat, lon, t AS kt, lat AS klat, lon AS klon, true AS kept FROM o WHERE rn = 1 UNION ALL
SELECT o.aircraft, o.rn, o.total, o.event_id, o.t, o.lat, o.lon, CASE WHEN {keep} THEN o.t ELSE w.kt END, CASE WHEN {keep} THEN o.lat ELSE w.klat END, CASE WHEN {keep} THEN o.lon ELSE w.klon END, {keep} FROM w JOIN o ON o.aircraft = w.aircraft AND o.rn = w.rn + 1)
SELECT aircraft, event_id, round(t, 3) AS t FROM w WHERE kept {more}"""


@query(_WALK.format(tr=TR, keep=f"(o.t - w.kt >= {THIN})", more="OR rn = total"))
def q_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy thinning: each kept point is at least the spacing after the last kept one; the ends stay."""
    return track.thinned(traces(spark, sf_dir), THIN).select("aircraft", "event_id", F.round("t", 3).alias("t"))


@query(_WALK.format(tr=TR, keep=f"(o.t > w.kt AND {_hav('w.klat', 'w.klon', 'o.lat', 'o.lon')} / 1.852 / ((o.t - w.kt) / 3600) <= {KNOTS})", more=""))
def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cleaning: points that the last kept one could have reached."""
    return track.cleaned(traces(spark, sf_dir), KNOTS).select("aircraft", "event_id", F.round("t", 3).alias("t"))


@query(f"""WITH {LEGS}, g AS (SELECT *, t - lag(t) OVER w AS gap, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM legs WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id)),
q AS (SELECT aircraft, leg, count(*) AS n, coalesce(sum(km), 0) AS path_km, coalesce(max(gap), 0) AS max_gap_s, coalesce(sum(gap) FILTER (WHERE gap > 3600), 0) AS hole_s, max(t) - min(t) AS took FROM g GROUP BY aircraft, leg)
SELECT aircraft, leg, n, round(path_km, 4) AS path_km, round(max_gap_s, 3) AS max_gap_s, round(hole_s, 3) AS hole_s, CASE WHEN took > 0 THEN round(1 - hole_s / took, 6) END AS coverage FROM q WHERE n >= 3""")
def q_leg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, holes, coverage and length of legs of three points or more."""
    q = track.quality(_legs(spark, sf_dir), ["aircraft", "leg"], 3600.0).where("n >= 3")
    return q.select("aircraft", "leg", "n", F.round("path_km", 4).alias("path_km"), F.round("max_gap_s", 3).alias("max_gap_s"), F.round("hole_s", 3).alias("hole_s"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {TR}, g AS (SELECT aircraft, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM tr WINDOW w AS (PARTITION BY aircraft ORDER BY t, event_id)) SELECT aircraft, count(*) AS n, round(coalesce(sum(km), 0), 4) AS path_km FROM g GROUP BY aircraft")
def q_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each aircraft's path."""
    return track.quality(traces(spark, sf_dir), ["aircraft"]).select("aircraft", "n", F.round("path_km", 4).alias("path_km"))


@query(f"""WITH {TR}, p AS (SELECT event_id, lat, lon, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM tr WINDOW w AS (PARTITION BY aircraft ORDER BY t, event_id)), q AS (SELECT event_id, degrees(atan2(sin(radians(lo - lon)) * cos(radians(la)), cos(radians(lat)) * sin(radians(la)) - sin(radians(lat)) * cos(radians(la)) * cos(radians(lo - lon)))) AS b FROM p WHERE la IS NOT NULL)
SELECT event_id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing FROM q""")
def q_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial bearing to the next point."""
    w = Window.partitionBy("aircraft").orderBy("t", "event_id")
    p = traces(spark, sf_dir).withColumns({"la": F.lead("lat").over(w), "lo": F.lead("lon").over(w)}).where("la is not null")
    return p.select("event_id", F.round(geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), 6).alias("bearing"))


_BOXES = (("north", 55.0, 75.0, -10.0, 25.0), ("south", 30.0, 45.0, -10.0, 5.0), ("east", 40.0, 60.0, 10.0, 25.0))
_BOX_SQL = "box(name, s, n, w, e) AS (VALUES " + ", ".join(f"('{b[0]}', {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE, {b[4]}::DOUBLE)" for b in _BOXES) + ")"


@query(f"""WITH {TR}, e AS (SELECT aircraft, arg_min(lat, t) AS lat1, arg_min(lon, t) AS lon1, arg_max(lat, t) AS lat2, arg_max(lon, t) AS lon2 FROM tr GROUP BY aircraft), d AS (SELECT *, {_hav('lat1', 'lon1', 'lat2', 'lon2')} / 6371.0088::DOUBLE AS d FROM e),
s AS (SELECT aircraft, lat1, lon1, d, i, sin((1 - i / 39.0::DOUBLE) * d) / sin(d) AS a, sin(i / 39.0::DOUBLE * d) / sin(d) AS b, lat2, lon2 FROM d, range(0, 40) AS r(i)), x AS (SELECT *, a * cos(radians(lat1)) * cos(radians(lon1)) + b * cos(radians(lat2)) * cos(radians(lon2)) AS x, a * cos(radians(lat1)) * sin(radians(lon1)) + b * cos(radians(lat2)) * sin(radians(lon2)) AS y, a * sin(radians(lat1)) + b * sin(radians(lat2)) AS z FROM s),
p AS (SELECT aircraft, i, CASE WHEN d < 1e-12 THEN lat1 ELSE degrees(atan2(z, sqrt(x * x + y * y))) END AS lat, CASE WHEN d < 1e-12 THEN lon1 ELSE degrees(atan2(y, x)) END AS lon FROM x), {_BOX_SQL}
SELECT aircraft, name, count(*) AS n, round(avg(lat), 6) AS mean_lat FROM p JOIN box ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY aircraft, name""")
def q_gc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty points of each aircraft's great circle, counted by the boxes (three rows) that hold them."""
    e = traces(spark, sf_dir).groupBy("aircraft").agg(*(f(c, "t").alias(c + n) for f, n in ((F.min_by, "1"), (F.max_by, "2")) for c in ("lat", "lon")))
    lat, lon = geo.gc_point(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), F.col("i") / 39.0)
    p = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("aircraft", lat.alias("lat"), lon.alias("lon"))
    boxes = F.broadcast(spark.createDataFrame(_BOXES, "name string, s double, n double, w double, e double"))
    return p.join(boxes, F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))).groupBy("aircraft", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 6).alias("mean_lat"))


@query(f"""WITH {TR}, pl AS (SELECT n_name AS place, 36 + n_nationkey * 1.45::DOUBLE AS plat, -9 + (n_nationkey * 7 % 25) * 1.35::DOUBLE AS plon FROM nation), m AS (SELECT event_id, place, sqrt(pow((plon - lon) * 111.32::DOUBLE * cos(radians(lat)), 2) + pow((plat - lat) * 110.57::DOUBLE, 2)) AS km FROM tr, pl),
b AS (SELECT event_id, place, km, row_number() OVER (PARTITION BY event_id ORDER BY km, place) AS r FROM m WHERE km < 80) SELECT tr.event_id, place, round(km, 4) AS km FROM tr LEFT JOIN (SELECT * FROM b WHERE r = 1) x ON tr.event_id = x.event_id""")
def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place strictly within the radius, by grid cells."""
    k = F.col("n_nationkey")
    places = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), (36 + k * 1.45).alias("plat"), (-9 + (k * 7 % 25) * 1.35).alias("plon"))
    return track.nearest(traces(spark, sf_dir), places, 80.0).select("event_id", "place", F.round("km", 4).alias("km"))


_CUTS = (("climb", 0.0, 0.2), ("cruise", 0.2, 0.8), ("descent", 0.8, 1.0))
_PART = ", ".join(f"round(sum(burn * CASE WHEN u1 > u0 THEN least(greatest(least(u1, {hi}::DOUBLE) - greatest(u0, {lo}::DOUBLE), 0) / (u1 - u0), 1) WHEN u0 >= {lo}::DOUBLE AND u0 {'<=' if n == 'descent' else '<'} {hi}::DOUBLE THEN 1 ELSE 0 END), 4) AS {n}" for n, lo, hi in _CUTS)


@query(f"""WITH {LEGS}, k AS (SELECT aircraft, leg, t, event_id, alt / 100 AS burn, {_hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS km FROM legs WINDOW w AS (PARTITION BY aircraft, leg ORDER BY t, event_id)),
c AS (SELECT *, sum(km) OVER (PARTITION BY aircraft, leg ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS done, sum(km) OVER (PARTITION BY aircraft, leg) AS total FROM k WHERE km IS NOT NULL), u AS (SELECT aircraft, leg, burn, (done - km) / total AS u0, done / total AS u1 FROM c WHERE total > 0)
SELECT aircraft, leg, {_PART}, round(sum(burn), 4) AS burn FROM u GROUP BY aircraft, leg""")
def q_bucket_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn by parts of the path, steps split at the cuts."""
    steps = track.arc_steps(_legs(spark, sf_dir), ["aircraft", "leg"], F.col("alt") / 100)
    parts = track.apportioned(steps, ["aircraft", "leg"], list(_CUTS) + [])
    whole = steps.groupBy("aircraft", "leg").agg(F.round(F.sum("burn"), 4).alias("burn"))
    return parts.select("aircraft", "leg", *(F.round(n, 4).alias(n) for n, *_ in _CUTS)).join(whole, ["aircraft", "leg"])


@query("""WITH c AS (SELECT user_id AS aircraft, event_type AS callsign, count(*) AS n, min(epoch_us(ts)) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY aircraft ORDER BY n DESC, first) AS r FROM c) SELECT aircraft, callsign, n FROM r WHERE r = 1""")
def q_mode_callsign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each aircraft's commonest callsign, the one seen first on ties."""
    c = traces(spark, sf_dir).groupBy("aircraft", F.col("event_type").alias("callsign")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))
    return c.groupBy("aircraft").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "callsign")).alias("x")).select("aircraft", "x.callsign", (-F.col("x.m")).alias("n"))


@query("""WITH c AS (SELECT event_id, upper(trim(' ' || substr(event_type, 1, 3) || CAST(user_id AS VARCHAR) || ' ')) AS s FROM events) SELECT CASE WHEN regexp_matches(s, '^[A-Z]{3}[0-9]') THEN substr(s, 1, 3) END AS operator, count(*) AS n, count(DISTINCT s) AS signs FROM c GROUP BY 1""")
def q_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators from callsigns: three letters and a digit."""
    s = F.upper(F.trim(F.concat(F.lit(" "), F.substring("event_type", 1, 3), F.col("user_id").cast("string"), F.lit(" "))))
    c = table(spark, sf_dir, "events").select(s.alias("s"))
    return c.groupBy(F.when(F.col("s").rlike("^[A-Z]{3}[0-9]"), F.substring("s", 1, 3)).alias("operator")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("signs"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 450000), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) SELECT day FROM s ANTI JOIN d USING (day)""")
def q_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between the first and last large order on which none was placed."""
    d = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).join(d, "day", "left_anti")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders EXCEPT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem")
def q_day_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of one table that another lacks."""
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).subtract(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), sp AS (SELECT day, h FROM (SELECT DISTINCT day FROM e), range(0, 24) AS r(h)), c AS (SELECT sp.day, CAST(sp.h AS INTEGER) AS h, coalesce(n, 0) AS n FROM sp LEFT JOIN e ON sp.day = e.day AND sp.h = e.h),
o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY day) AS r FROM c), m AS (SELECT x.day, x.h, x.n, median(y.n) AS typical FROM o x JOIN o y ON x.h = y.h AND y.r BETWEEN x.r - 15 AND x.r + 15 AND y.r <> x.r GROUP BY ALL) SELECT day, h AS hour, n, typical, n = 0 AND typical >= 1 AS missing FROM m""")
def q_hour_gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours against the median of the same hour in the 15 records before and after, the record itself left out."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = e.select("day").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    c = spine.join(e, ["day", "hour"], "left").na.fill(0, ["n"])
    w = Window.partitionBy("hour").orderBy("day")
    near = F.sort_array(F.concat(F.collect_list("n").over(w.rowsBetween(-15, -1)), F.collect_list("n").over(w.rowsBetween(1, 15))))
    k = F.size("near")
    middle = (F.element_at("near", F.floor((k + 1) / 2).cast("int")) + F.element_at("near", F.floor((k + 2) / 2).cast("int"))) / 2.0
    return c.withColumn("near", near).where("size(near) > 0").withColumn("typical", middle).select("day", "hour", "n", "typical", ((F.col("n") == 0) & (F.col("typical") >= 1)).alias("missing"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def q_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def q_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("WITH s AS (SELECT round(s_acctbal / 500) * 500 AS band, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT round(c_acctbal / 500) * 500 AS band, count(*) AS customers FROM customer GROUP BY 1) SELECT coalesce(s.band, c.band) AS band, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers FROM s FULL JOIN c ON s.band = c.band")
def q_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables' counts by balance band, a band that one of them lacks with 0."""
    s = table(spark, sf_dir, "supplier").groupBy((F.round(F.col("s_acctbal") / 500) * 500).alias("band")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy((F.round(F.col("c_acctbal") / 500) * 500).alias("band")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "band", "outer").na.fill(0, ["suppliers", "customers"])


@query(f"""WITH a AS (SELECT n_nationkey AS k, 36 + n_nationkey * 1.45::DOUBLE AS lat, -9 + (n_nationkey * 7 % 25) * 1.35::DOUBLE AS lon FROM nation), r AS (SELECT s_suppkey, 36 + (s_suppkey * 13 % 3600) / 100.0::DOUBLE AS rlat, -9 + (s_suppkey * 29 % 3300) / 100.0::DOUBLE AS rlon FROM supplier)
SELECT k, count(s_suppkey) AS receivers FROM a LEFT JOIN r ON {_hav('lat', 'lon', 'rlat', 'rlon')} <= 600 GROUP BY k""")
def q_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers within a distance of each place; places without any count 0. Receivers meet places in grid cells, both ways."""
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (36 + F.col("n_nationkey") * 1.45).alias("lat"), (-9 + (F.col("n_nationkey") * 7 % 25) * 1.35).alias("lon"))
    r = table(spark, sf_dir, "supplier").select("s_suppkey", (36 + (F.col("s_suppkey") * 13 % 3600) / 100.0).alias("rlat"), (-9 + (F.col("s_suppkey") * 29 % 3300) / 100.0).alias("rlon"))
    met = track.within(a, r, 600.0).groupBy("k").agg(F.count(F.lit(1)).alias("receivers"))
    return a.select("k").join(met, "k", "left").na.fill(0)


@query("""WITH h AS (SELECT p_partkey, p_size * 800.0::DOUBLE AS alt FROM part), s AS (SELECT *, greatest(288.15::DOUBLE - 0.0065::DOUBLE * alt * 0.3048::DOUBLE, 216.65::DOUBLE) AS t, CASE WHEN alt * 0.3048::DOUBLE < 11000 THEN 101325.0::DOUBLE * pow(1 - 0.0065::DOUBLE * alt * 0.3048::DOUBLE / 288.15::DOUBLE, 9.80665::DOUBLE / (287.05287::DOUBLE * 0.0065::DOUBLE)) ELSE 22632.06::DOUBLE * exp(-9.80665::DOUBLE * (alt * 0.3048::DOUBLE - 11000) / (287.05287::DOUBLE * 216.65::DOUBLE)) END AS p FROM h)
SELECT p_partkey, round(p, 2) AS pressure, round(sqrt(1.4::DOUBLE * 287.05287::DOUBLE * t) / 0.514444::DOUBLE, 4) AS sound, round(sqrt(7.0::DOUBLE * 287.05287::DOUBLE * t * (pow(1 + 101325.0::DOUBLE * (pow(1 + 1.225::DOUBLE / (7 * 101325.0::DOUBLE) * pow(250 * 0.514444::DOUBLE, 2), 3.5::DOUBLE) - 1) / p, 2 / 7.0::DOUBLE) - 1)) / 0.514444::DOUBLE, 4) AS tas FROM s""")
def q_isa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure, speed of sound, and true airspeed of 250 kt calibrated, at altitudes made of part sizes."""
    alt = F.col("p_size") * 800.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(isa.pressure_pa(alt), 2).alias("pressure"), F.round(isa.sound_kt(alt), 4).alias("sound"), F.round(isa.tas_kt(F.lit(250.0), alt), 4).alias("tas"))


def sentences(text: Column) -> Column:
    """Normalised sentences: tags and entities out, white space joined, split after . ! or ?, lower case."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&[a-zA-Z#0-9]+;", " "), r"[ \t\n\r]+", " "))
    return F.filter(F.transform(F.split(F.regexp_replace(plain, r"([.!?]) ", "$1\n"), "\n"), lambda s: F.lower(F.trim(s))), lambda s: s != "")


_SENT = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: lower(trim(s))), lambda s: s <> '')"""


@query(f"SELECT page_id, CAST(len(s) AS BIGINT) AS n, CAST(len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) AS BIGINT) AS with_digits, md5(array_to_string(s, '|')) AS digest FROM (SELECT page_id, {_SENT.format('html')} AS s FROM pages)")
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of pages, counted, and those with digits."""
    s = table(spark, sf_dir, "pages").select("page_id", sentences(F.col("html")).alias("s"))
    return s.select("page_id", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda x: x.rlike("[0-9]"))).cast("long").alias("with_digits"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"WITH b AS (SELECT DISTINCT unnest({_SENT.format('text')}) AS s FROM benchmark), d AS (SELECT DISTINCT unnest({_SENT.format('text')}) AS s FROM documents) SELECT s AS sentence FROM b ANTI JOIN d USING (s)")
def q_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of one collection that another doesn't have."""
    of = lambda name: table(spark, sf_dir, name).select(F.explode(sentences(F.col("text"))).alias("sentence"))
    return of("benchmark").distinct().join(of("documents"), "sentence", "left_anti")


@query(f"""WITH {TR}, f AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS s FROM tr WINDOW w AS (PARTITION BY aircraft ORDER BY t, event_id)), g AS (SELECT *, sum(s) OVER (PARTITION BY aircraft ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT aircraft, round(min(t), 3) AS t0, round(max(t), 3) AS t1, count(*) AS n FROM g GROUP BY aircraft, k""")
def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by time gap, by the plan that the stream runs (waymark.streaming.sessions)."""
    from waymark.streaming.sessions import sessions

    return sessions(table(spark, sf_dir, "events"), GAP).select("aircraft", "t0", "t1", "n")
