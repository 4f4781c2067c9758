"""Queries over cohorts of movements: gates, joins, second-level statistics, tops and sets, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import cohort, flights, ground, norm
from waymark.plans.movement_queries import MOV, _norm_sql
from waymark.sources.tables import movements, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PLACED = "placed AS (SELECT origin AS airport, 'dep' AS role, * FROM mov UNION ALL SELECT dest, 'arr', * FROM mov)"


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"WITH {MOV}, s AS (SELECT *, 1 - share AS coverage, flown_km >= 1.02 * gc_km AS ok FROM mov) SELECT typecode, count(*) AS n, round(sum(real), 2) AS sum_real FROM s WHERE ok AND coverage >= 0.97 AND gc_km >= 150 GROUP BY 1")
def q_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements seen well enough, by type."""
    rows = movements(spark, sf_dir).withColumns({"coverage": 1 - F.col("share"), "flown_ok": F.col("flown_km") >= 1.02 * F.col("gc_km")})
    return flights.sound(rows, 0.97).groupBy("typecode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("real"), 2).alias("sum_real"))


@query(f"WITH {MOV}, m(t, model) AS (VALUES ('AF', 'alpha'), ('RF', 'romeo'), ('NO', 'romeo')) SELECT model, count(*) AS n, round(avg(gc_km), 4) AS mean_km FROM mov JOIN m ON upper(lower(typecode)) = t GROUP BY 1")
def q_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements by performance model; types without one go."""
    rows = movements(spark, sf_dir).withColumn("typecode", F.lower("typecode"))
    return flights.modelled(rows, {"AF": "alpha", "RF": "romeo", "no": "romeo"}).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gc_km"), 4).alias("mean_km"))


@query("""WITH e AS (SELECT user_id, event_id, ts, value FROM events) SELECT hour(ts) AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM e WHERE 1 + value / 1000 < 1.02 AND hour(ts) IN (1, 2, 3, 4) AND value * 100 > 1000 GROUP BY 1""")
def q_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quiet-hour cohort by hour."""
    e = table(spark, sf_dir, "events").select("value", F.col("ts").cast("timestamp").alias("dep"), (1 + F.col("value") / 1000).alias("dist_ratio"), (F.col("value") * 100).alias("gc_km"))
    return flights.floor_cohort(e).groupBy(F.hour("dep").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {MOV} SELECT bin, count(*) AS n, round((sum(flown_km) - sum(gc_km)) / sum(gc_km) * 100, 6) AS extension FROM mov WHERE gc_km BETWEEN 370.4 AND 2000 GROUP BY 1")
def q_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extension of flown over direct distances, inside a range of distances."""
    rows = flights.in_perimeter(movements(spark, sf_dir), high_km=2000.0).withColumn("bin", geo.right_closed(F.col("gc_km")))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round((F.sum("flown_km") - F.sum("gc_km")) / F.sum("gc_km") * 100, 6).alias("extension"))


@query(f"WITH {MOV}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE total < 4) AS n_degenerate, (sum(real) - sum(ideal)) / sum(ideal) * 100 AS every, (sum(real) FILTER (WHERE total >= 4) - sum(ideal) FILTER (WHERE total >= 4)) / sum(ideal) FILTER (WHERE total >= 4) * 100 AS without FROM mov) SELECT n, n_degenerate, round(every, 6) AS every, round(without, 6) AS without, round(every - without, 6) AS shift FROM s")
def q_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far rows of too little excess move the total."""
    return _rounded(flights.degenerate_shift(movements(spark, sf_dir), 4.0), 6, "every", "without", "shift")


_NAMED = "r AS (SELECT *, CASE WHEN origin % 5 = 0 THEN '~' || origin ELSE 'P' || origin END || '-' || CASE WHEN dest % 7 = 0 THEN '~' || dest ELSE 'P' || dest END AS route FROM mov)"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = lambda c, k: F.concat(F.when(F.col(c) % k == 0, "~").otherwise("P"), F.col(c).cast("string"))
    return movements(spark, sf_dir).withColumn("route", F.concat(end("origin", 5), F.lit("-"), end("dest", 7)))


@query(f"WITH {MOV}, {_NAMED} SELECT route, count(*) AS n, round(avg(total), 6) AS mean FROM r WHERE route NOT LIKE '%~%' GROUP BY 1")
def q_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes whose ends both have names."""
    return flights.named_ends(_routes(spark, sf_dir)).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("mean"))


@query(f"WITH {MOV}, {_NAMED}, f AS (SELECT typecode, route, max(gc_km) AS gc_km FROM r GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY typecode ORDER BY gc_km DESC, route) AS k FROM f) SELECT typecode, route, gc_km, CAST(CASE typecode WHEN 'RF' THEN 1 WHEN 'NO' THEN 2 ELSE 3 END AS INTEGER) AS place FROM t WHERE k = 1")
def q_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's longest route, types in a given order."""
    return flights.longest_by_type(_routes(spark, sf_dir), ["RF", "NO"])


@query(f"WITH {MOV} SELECT origin, dest, count(*) AS n FROM mov WHERE lower(concat_ws(' ', origin, dest, typecode)) LIKE '%2 a%' GROUP BY ALL")
def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements whose ends and type hold a text."""
    return flights.searched(movements(spark, sf_dir), "2 A", "origin", "dest", "typecode").groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MOV}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT month, count(*) AS n, round(sum(real), 2) AS sum_real FROM mov WHERE day IN (SELECT day FROM d) GROUP BY 1")
def q_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of the days that another table has, by month: the semi join that a perimeter of days is."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    rows = movements(spark, sf_dir).join(d, "day", "left_semi")
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("real"), 2).alias("sum_real"))


_CELLS = "c1 AS (SELECT origin, month, count(*) AS n FROM mov GROUP BY ALL), c2 AS (SELECT origin, month, sum(real) AS real FROM mov WHERE typecode = 'RF' GROUP BY ALL)"


@query(f"WITH {MOV}, {_CELLS} SELECT origin, month, n, round(real, 2) AS real FROM c1 JOIN c2 USING (origin, month)")
def q_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of cells joined with both keys checked."""
    rows = movements(spark, sf_dir)
    left, right = rows.groupBy("origin", "month").agg(F.count(F.lit(1)).alias("n")), rows.where("typecode = 'RF'").groupBy("origin", "month").agg(F.round(F.sum("real"), 2).alias("real"))
    return norm.one_to_one(left, right, ["origin", "month"])


_TIMES = "x AS (SELECT n_nationkey AS airport, 8 + n_nationkey % 9 AS out_w, CASE WHEN n_nationkey % 6 <> 0 THEN 9.5 + n_nationkey % 7 END AS out_s, 4 + n_nationkey % 4 AS in_w, 5.5 + n_nationkey % 3 AS in_s FROM nation WHERE n_nationkey <> 3)"


@query(f"""WITH {MOV}, {_TIMES}, idle(typecode, ff) AS (VALUES ('AF', 0.21::DOUBLE), ('RF', 0.34::DOUBLE), ('NO', 0.4::DOUBLE)), r AS (SELECT origin, dest, day < DATE '1995-04-01' AS winter, ff FROM mov LEFT JOIN idle USING (typecode)),
c AS (SELECT origin AS airport, 'dep' AS role, winter, count(*) AS n, avg(ff) AS ff FROM r GROUP BY ALL UNION ALL SELECT dest, 'arr', winter, count(*), avg(ff) FROM r GROUP BY ALL), t AS (SELECT c.*, CASE WHEN role = 'dep' THEN CASE WHEN winter THEN out_w ELSE out_s END ELSE CASE WHEN winter THEN in_w ELSE in_s END END::DOUBLE AS minutes FROM c JOIN x USING (airport)),
e AS (SELECT *, minutes * 60 * ff * 3.16::DOUBLE * n AS co2 FROM t WHERE minutes IS NOT NULL AND ff IS NOT NULL), a AS (SELECT airport, CAST(coalesce(sum(n) FILTER (WHERE role = 'dep'), 0) AS BIGINT) AS n_dep, coalesce(sum(co2) FILTER (WHERE role = 'dep'), 0) AS co2_dep, coalesce(sum(minutes * n) FILTER (WHERE role = 'dep') / sum(n) FILTER (WHERE role = 'dep'), 0) AS t_dep,
CAST(coalesce(sum(n) FILTER (WHERE role = 'arr'), 0) AS BIGINT) AS n_arr, coalesce(sum(co2) FILTER (WHERE role = 'arr'), 0) AS co2_arr, coalesce(sum(minutes * n) FILTER (WHERE role = 'arr') / sum(n) FILTER (WHERE role = 'arr'), 0) AS t_arr FROM e GROUP BY airport)
SELECT airport, n_dep, round(co2_dep, 3) AS co2_dep, round(t_dep, 6) AS t_dep, n_arr, round(co2_arr, 3) AS co2_arr, round(t_arr, 6) AS t_arr, n_dep + n_arr AS mov, round((co2_dep + co2_arr) / (n_dep + n_arr), 6) AS co2_mov FROM a WHERE n_dep + n_arr >= 20 ORDER BY co2_mov DESC, airport LIMIT 8""")
def q_taxi_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight places of the most taxi emissions a movement."""
    k = F.col("n_nationkey")
    times = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(k.alias("airport"), (8.0 + k % 9).alias("out_w"), F.when(k % 6 != 0, 9.5 + k % 7).alias("out_s"), (4.0 + k % 4).alias("in_w"), (5.5 + k % 3).alias("in_s"))
    idle = spark.createDataFrame([("AF", 0.21), ("RF", 0.34), ("NO", 0.4)], "typecode string, ff double")
    out = ground.taxi_emissions(movements(spark, sf_dir), times, idle, "1995-04-01", 20)
    return _rounded(_rounded(out, 3, "co2_dep", "co2_arr"), 6, "t_dep", "t_arr", "co2_mov").orderBy(F.desc("co2_mov"), "airport").limit(8)


@query(f"WITH {MOV} SELECT month, round(sum(total * gc_km) / sum(gc_km), 6) AS by_distance, round(avg(total), 6) AS plain FROM mov GROUP BY 1")
def q_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean excess by month, weighted by distance and plain."""
    return movements(spark, sf_dir).groupBy("month").agg(F.round(cohort.weighted_mean(F.col("total"), F.col("gc_km")), 6).alias("by_distance"), F.round(F.avg("total"), 6).alias("plain"))


@query(f"WITH {MOV}, r AS (SELECT a, b, count(*) AS n, avg(mov.lateral) AS lat, avg(vertical) AS vertical, avg(total) AS total FROM mov GROUP BY ALL) SELECT count(*) AS routes, round(corr(n, total), 8) AS raw, round(corr(ln(n), total), 8) AS by_log, round(avg(CASE WHEN sign(lat - 4) = sign(vertical - 7) THEN 1.0 ELSE 0.0 END), 8) AS same_sign, round(stddev_samp(total), 8) AS sd, round(stddev_pop(total), 8) AS sd_pop FROM r")
def q_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over routes: correlation of traffic and excess, plain and by log, and how often the parts' signs agree."""
    r = norm.route(movements(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("lateral", "vertical", "total")))
    out = r.agg(F.count(F.lit(1)).alias("routes"), F.corr(F.col("n").cast("double"), F.col("total")).alias("raw"), cohort.log_correlation(F.col("n"), F.col("total")).alias("by_log"), cohort.same_sign(F.col("lateral") - 4, F.col("vertical") - 7).alias("same_sign"), F.stddev_samp("total").alias("sd"), F.stddev_pop("total").alias("sd_pop"))
    return _rounded(out, 8, "raw", "by_log", "same_sign", "sd", "sd_pop")


@query(f"WITH {MOV} SELECT typecode, round(max(abs(total - mov.lateral - vertical)), 6) AS max_residual, round(avg(CASE WHEN gc_km = round(gc_km / 100) * 100 THEN 1.0 ELSE 0.0 END), 6) AS exact FROM mov GROUP BY 1")
def q_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well parts add up, and how often a rounded distance is the distance."""
    checks = cohort.additivity(["lateral", "vertical"], "total", F.round(F.col("gc_km") / 100) * 100, F.col("gc_km"))
    return _rounded(movements(spark, sf_dir).groupBy("typecode").agg(*checks), 6, "max_residual", "exact")


@query(f"WITH {MOV}, {_PLACED}, m AS (SELECT airport, month, count(*) AS n, median(round(total, 4)) AS mid, avg(total) AS mean FROM placed GROUP BY ALL HAVING count(*) >= 30) SELECT airport, count(*) AS months, round(max(mid) - min(mid), 5) AS amplitude, round(stddev_samp(mean), 6) AS spread FROM m GROUP BY airport")
def q_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far places move through the months."""
    out = cohort.season_excursion(norm.double_entry(movements(spark, sf_dir), "month", "total"), "total", 30)
    return _rounded(_rounded(out, 5, "amplitude"), 6, "spread")


@query(f"WITH {MOV}, y AS (SELECT CAST(year(day) AS BIGINT) AS year, sum(real) AS real FROM mov GROUP BY 1), o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT year, round(real / first_value(real) OVER (ORDER BY year) * 100, 4) AS level FROM y) SELECT coalesce(i.year, o.year) AS year, coalesce(format('{{:.4f}}', level), '—') AS level, coalesce(CAST(n AS VARCHAR), '—') AS n FROM i FULL JOIN o ON i.year = o.year")
def q_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly index beside another yearly series; what one lacks is a dash."""
    y = movements(spark, sf_dir).groupBy(F.year("day").cast("long").alias("year")).agg(F.sum("real").alias("real"))
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return cohort.by_year(cohort.indexed(y, "year", "real").select("year", F.format_string("%.4f", F.round("index", 4)).alias("level")), o, "level", "n")


@query(f"WITH {MOV}, bins AS (SELECT bin, median(round(total, 4)) AS m FROM mov GROUP BY 1), d AS (SELECT origin, total, real, total - m AS adjusted FROM mov JOIN bins USING (bin)) SELECT origin AS airport, count(*) AS n, round(median(round(total, 4)), 5) AS med_total, round(median(round(adjusted, 4)), 5) AS med_adjusted, round(sum(real), 2) AS sum_real FROM d GROUP BY 1 HAVING count(*) >= 10")
def q_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by their departures alone."""
    return _rounded(_rounded(cohort.departures(movements(spark, sf_dir)), 5, "med_total", "med_adjusted"), 2, "sum_real")


@query(f"WITH {MOV}, {_PLACED}, e AS (SELECT airport, median(round(total, 4)) AS m FROM placed GROUP BY 1 HAVING count(*) >= 4000) SELECT count(*) AS airports, round(median(m), 7) AS med FROM e")
def q_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median place's median."""
    return _rounded(cohort.median_of_medians(norm.double_entry(movements(spark, sf_dir), "total"), "total", 4000), 7, "med")


@query(f"WITH {MOV} SELECT bin, round(sum(mov.lateral) / sum(total), 8) AS share_lateral, round(sum(vertical) / sum(total), 8) AS share_vertical FROM mov GROUP BY 1")
def q_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the excess by distance, as shares of sums."""
    rows = movements(spark, sf_dir).withColumn("bin", geo.right_closed(F.col("gc_km")))
    return _rounded(cohort.shares_of_sums(rows, ["lateral", "vertical"], "total", "bin"), 8, "share_lateral", "share_vertical")


@query(f"WITH {MOV} SELECT a, b, count(*) AS n, round(avg(total), 6) AS mean_total, round(max(total) - min(total), 6) AS spread FROM mov GROUP BY a, b HAVING count(*) >= 2")
def q_route_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes' mean excess, and how far their movements lie apart."""
    return _rounded(cohort.route_spread(movements(spark, sf_dir)), 6, "mean_total", "spread")


@query(f"WITH {MOV}, {_PLACED}, t AS (SELECT airport, count(*) AS n, sum(real) AS co2 FROM placed GROUP BY 1) SELECT 'moves' AS list, airport, n, round(co2 / n, 4) AS each FROM (SELECT * FROM t ORDER BY n DESC, airport LIMIT 15) UNION ALL SELECT 'each', airport, n, round(co2 / n, 4) FROM (SELECT * FROM t ORDER BY co2 / n DESC, airport LIMIT 8)")
def q_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen places by movements and eight by consumption a movement."""
    t = norm.double_entry(movements(spark, sf_dir), "real").groupBy("airport").agg(F.count(F.lit(1)).alias("n"), F.sum("real").alias("co2")).withColumn("each", F.col("co2") / F.col("n"))
    top = lambda name, order, k: t.orderBy(F.desc(order), "airport").limit(k).select(F.lit(name).alias("list"), "airport", "n", F.round("each", 4).alias("each"))
    return top("moves", "n", 15).unionByName(top("each", "each", 8))


@query(f"WITH {MOV}, {_PLACED}, t AS (SELECT month, airport, round(avg(total), 6) AS m FROM placed GROUP BY ALL) SELECT month, arg_max(airport, (m, -airport)) AS highest, arg_min(airport, (m, airport)) AS lowest FROM t GROUP BY month")
def q_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's highest and lowest place."""
    t = norm.double_entry(movements(spark, sf_dir), "month", "total").groupBy("month", "airport").agg(F.round(F.avg("total"), 6).alias("m"))
    return t.groupBy("month").agg(F.max_by("airport", F.struct("m", -F.col("airport"))).alias("highest"), F.min_by("airport", F.struct("m", "airport")).alias("lowest"))


@query("SELECT event_id, user_id, round(value, 4) AS value FROM events ORDER BY ts, event_id LIMIT 100")
def q_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred positions in time's order."""
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(100).select("event_id", "user_id", F.round("value", 4).alias("value"))


@query("WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 68) SELECT day, r.day IS NOT NULL AS ready, row_number() OVER (ORDER BY r.day IS NOT NULL DESC, day) AS place FROM d LEFT JOIN r USING (day)")
def q_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in the order of work: those that are ready first."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    ready = e.where("event_type = 'error'").groupBy("day").agg(F.count(F.lit(1)).alias("n")).where("n >= 68")
    out = cohort.work_list(e.select("day").distinct(), ready)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ready"), "day")))


@query(f"WITH {MOV}, m1 AS (SELECT DISTINCT a, b FROM mov WHERE month = '1995-03'), m2 AS (SELECT DISTINCT a, b FROM mov WHERE month = '1996-03') SELECT * FROM m1 INTERSECT SELECT * FROM m2")
def q_both_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes flown in both of two months."""
    rows = norm.route(movements(spark, sf_dir))
    of = lambda month: rows.where(F.col("month") == month).select("a", "b")
    return of("1995-03").intersect(of("1996-03"))


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 450000), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d), a AS (SELECT CAST(day AS VARCHAR) AS day FROM s ANTI JOIN d USING (day)) SELECT list_sort(list_intersect(list(day), ['1994-05-01', '1993-02-03', '1995-07-09', '1996-11-12', '1992-03-04'])) AS days FROM a")
def q_known_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a large order that are known to be so."""
    from waymark.plans.other_queries import q_missing_days

    absent = q_missing_days(spark, sf_dir).select(F.col("day").cast("string").alias("day"))
    return cohort.known_missing(absent, ["1994-05-01", "1993-02-03", "1995-07-09", "1996-11-12", "1992-03-04"])


@query("WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def q_same_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard that two tables hold the same days: what each has alone."""
    a, b = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    count = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return count(a.exceptAll(b), "only_a").join(count(b.exceptAll(a), "only_b"), F.lit(True))  # one row each


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer), s AS (SELECT s_nationkey AS k2, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT c_nationkey AS airport, c_custkey AS first, suppliers FROM r JOIN s ON c_nationkey = k2 WHERE k = 1")
def q_first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a place before the join."""
    c = cohort.first_of(table(spark, sf_dir, "customer"), "c_nationkey", F.desc("c_acctbal"), "c_custkey").select(F.col("c_nationkey").alias("airport"), F.col("c_custkey").alias("first"))
    return c.join(table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("airport")).agg(F.count(F.lit(1)).alias("suppliers")), "airport")


_ADJ = f"""load AS (SELECT day, origin, dest, typecode, gc_km, bin, real * (1 - share) * coalesce(f, 1) AS real, ideal * coalesce(f, 1) AS ideal, hybrid * coalesce(f, 1) AS hybrid, (real * (1 - share) - ideal) / ideal * 100 AS total, (real * (1 - share) - hybrid) / ideal * 100 AS vertical FROM mov LEFT JOIN (VALUES ('AF', 1.15::DOUBLE), ('RF', 0.9::DOUBLE)) AS k(typecode, f) USING (typecode))"""
_FACTORS = [("AF", 1.15), ("RF", 0.9)]


@query(f"""WITH {MOV}, {_ADJ}, cells AS (SELECT bin, typecode, count(*) AS n, median(round(total, 4)) AS m FROM load GROUP BY ALL), bins AS (SELECT bin, median(round(total, 4)) AS m FROM load GROUP BY ALL), dev AS (SELECT load.*, total - CASE WHEN n >= 1000 THEN cells.m ELSE bins.m END AS d FROM load JOIN cells USING (bin, typecode) JOIN bins ON load.bin = bins.bin)
SELECT typecode, count(*) AS n, round(sum(real) / 1e6, 6) AS real_m, round((sum(real) - sum(ideal)) / sum(ideal) * 100, 6) AS total_pct, round(avg(d), 6) AS mean_d FROM dev GROUP BY 1""")
def q_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis table by type: without the ground, calibrated, against the norm."""
    factors = spark.createDataFrame(_FACTORS, "typecode string, factor double")
    out = norm.analysed(movements(spark, sf_dir), None, factors, 1000)
    return out.groupBy("typecode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("real") / 1e6, 6).alias("real_m"), F.round((F.sum("real") - F.sum("ideal")) / F.sum("ideal") * 100, 6).alias("total_pct"), F.round(F.avg("d_total"), 6).alias("mean_d"))


@query(f"""WITH {MOV}, {_norm_sql('total')}, placed AS (SELECT origin AS airport, 'dep' AS role, * FROM dev UNION ALL SELECT dest, 'arr', * FROM dev), m AS (SELECT *, CASE WHEN role = 'dep' THEN dest ELSE origin END AS other FROM placed WHERE airport = 7), e AS (SELECT other FROM m GROUP BY 1 HAVING count(*) >= 10)
SELECT day, role, other, typecode, bin, gc_km, round(real, 8) AS real, round(ideal, 8) AS ideal, round(total, 8) AS total, round(d, 8) AS d FROM m JOIN e USING (other)""")
def q_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movements that are published of one place."""
    out = cohort.export(movements(spark, sf_dir), 7, 1000)["flights"]
    return _rounded(out, 8, "total", "d", "ideal", "real")


@query(f"""WITH {MOV}, {_norm_sql('total')}, placed AS (SELECT origin AS airport, 'dep' AS role, * FROM dev UNION ALL SELECT dest, 'arr', * FROM dev) SELECT role, count(*) AS n, round(median(round(total, 4)), 5) AS med_total, round(median(round(d, 4)), 5) AS med_d, round(sum(real), 2) AS sum_real FROM placed WHERE airport = 7 GROUP BY 1""")
def q_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that goes with it."""
    out = cohort.export(movements(spark, sf_dir), 7, 1000)["summary"]
    return _rounded(_rounded(out, 5, "med_total", "med_d"), 2, "sum_real")


@query(f"""WITH {MOV}, g AS (SELECT bin, count(*) AS n, median(round(flown_km * 12, 4)) AS real_alt, median(least(16000 + floor(gc_km / 250) * 2000, 39000)) AS ideal_alt FROM mov GROUP BY 1) SELECT bin, n, real_alt, ideal_alt, round(ideal_alt - real_alt, 4) AS delta FROM g""")
def q_altitude_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of reached and ideal altitudes by distance (altitudes made of distances)."""
    rows = movements(spark, sf_dir).select(geo.right_closed(F.col("gc_km")).alias("bin"), (F.col("flown_km") * 12).alias("real"), F.least(16000 + F.floor(F.col("gc_km") / 250) * 2000, F.lit(39000)).cast("double").alias("ideal"))
    g = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), norm.median(F.col("real")).alias("real_alt"), norm.median(F.col("ideal")).alias("ideal_alt"))
    return g.withColumn("delta", F.round(F.col("ideal_alt") - F.col("real_alt"), 4))


_PARTS = "p AS (SELECT *, vertical + share * real / ideal * 100 AS gate, share * real / ideal * 100 AS g FROM (SELECT day, typecode, ideal, real, share, (real * (1 - share) - hybrid) / ideal * 100 AS vertical FROM mov))"


@query(f"WITH {MOV}, {_PARTS} SELECT typecode, round(max(abs(gate * 0.3::DOUBLE - g / 2 + gate * 0.5::DOUBLE + gate * 0.2::DOUBLE - g / 2 - vertical)), 6) AS residual, round(avg(gate * 0.3::DOUBLE - g / 2), 6) AS climb, round(avg(gate * 0.2::DOUBLE - g / 2), 6) AS desc_ FROM p GROUP BY 1")
def q_phase_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases without the ground, and whether they add up."""
    from waymark.operators import phase

    on_ground = F.col("share") * F.col("real") / F.col("ideal") * 100
    rows = movements(spark, sf_dir).withColumn("vertical", (F.col("real") * (1 - F.col("share")) - F.col("hybrid")) / F.col("ideal") * 100)
    gate = F.col("vertical") + on_ground
    rows = rows.withColumns({"vert_climb": gate * 0.3, "vert_cruise": gate * 0.5, "vert_desc": gate * 0.2, "vert_dep": gate * 0.1, "vert_enr": gate * 0.6, "vert_arr": gate * 0.3, "ground_dep": on_ground / 2, "ground_arr": on_ground / 2})
    out = phase.without_ground(rows)
    gap = F.max(F.abs(F.col("vert_climb") + F.col("vert_cruise") + F.col("vert_desc") - F.col("vertical")))
    return out.groupBy("typecode").agg(F.round(gap, 6).alias("residual"), F.round(F.avg("vert_climb"), 6).alias("climb"), F.round(F.avg("vert_desc"), 6).alias("desc_"))


@query(f"WITH {MOV}, c AS (SELECT real / ideal * (1 - gc_km / flown_km) * 100 AS lat, total FROM mov WHERE flown_km > 0) SELECT round(median(round(lat, 4)), 5) AS lateral, round(median(round(total - lat, 4)), 5) AS vertical FROM c")
def q_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median movement by the other convention."""
    lat, vert = text.by_own_rate(F.col("real"), F.col("ideal"), F.col("gc_km"), F.col("flown_km"), F.col("total"))
    return movements(spark, sf_dir).select(lat.alias("lat"), vert.alias("vert")).agg(F.round(norm.median(F.col("lat")), 5).alias("lateral"), F.round(norm.median(F.col("vert")), 5).alias("vertical"))


@query("""SELECT n_nationkey, trim(replace(replace(replace(n_name || ' International Airport', ' International Airport', ''), ' Airport', ''), ' International', '')) AS name, regexp_replace(regexp_replace(lower(n_name || ' (Main) Field'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM nation""")
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places' names without common words, and as slugs."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", text.place_name(F.concat("n_name", F.lit(" International Airport"))).alias("name"), text.slug(F.concat("n_name", F.lit(" (Main) Field"))).alias("slug"))


@query(r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '^[Ww][Ww][Ww]\.', ''), '[?#].*$', '') AS r, url FROM pages) SELECT page_id, lower(regexp_extract(r, '^[^/]*')) || regexp_replace(regexp_replace(regexp_extract(r, '/.*$'), '/index\.html?$', '/'), '/+$', '') AS url, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) = 'ththre.example.com' AS same FROM r""")
def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses in one form, and whether their host is a given one."""
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"), text.same_host(F.col("url"), "ththre.example.com").alias("same"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN MAP {{500: p_retailprice, 1500: p_retailprice * 2.5, 2000: p_retailprice * 3}} WHEN p_size % 3 = 1 THEN MAP {{250: p_retailprice, 750: p_retailprice * 2}} ELSE MAP {{1000: p_retailprice}} END AS m FROM part), e AS (SELECT p_partkey, unnest(map_entries(m)) AS x FROM t), r AS (SELECT p_partkey, x.key AS d, x.value AS f, row_number() OVER (PARTITION BY p_partkey ORDER BY x.key DESC) AS k FROM e), l AS (SELECT a.p_partkey, round((a.f - b.f) / (a.d - b.d), 6) AS slope FROM r a JOIN r b ON a.p_partkey = b.p_partkey AND a.k = 1 AND b.k = 2) SELECT p_partkey, slope FROM part LEFT JOIN l USING (p_partkey)""".replace("{{", "{").replace("}}", "}"))
def q_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumption a distance from tables of two or three points; null from one."""
    price, kind = F.col("p_retailprice"), F.col("p_size") % 3
    table_ = F.when(kind == 0, F.create_map(F.lit(500), price, F.lit(1500), price * 2.5, F.lit(2000), price * 3)).when(kind == 1, F.create_map(F.lit(250), price, F.lit(750), price * 2)).otherwise(F.create_map(F.lit(1000), price))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.piecewise_slope(table_), 6).alias("slope"))


@query("SELECT event_id, CAST(strptime(replace(strftime(ts, 'planes-%Y.%m.%d-full'), 'planes-', ''), '%Y.%m.%d-full') AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hour FROM events")
def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days out of tags."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.day_of(F.concat(F.lit("planes-"), F.date_format(F.col("ts").cast("timestamp"), "yyyy.MM.dd"), F.lit("-full"))).alias("day"), F.hour("ts").cast("long").alias("hour"))


_MONTHS = ("1995-01", "1995-02", "1995-03", "1995-04")


@query(f"WITH {MOV}, {_PLACED}, p AS (SELECT airport, {', '.join(f"median(round(total, 4)) FILTER (WHERE month = '{m}') AS m{i}" for i, m in enumerate(_MONTHS))} FROM placed WHERE role = 'dep' AND typecode = 'RF' GROUP BY airport) SELECT airport, {', '.join(f'round(m{i}, 6) AS m{i}' for i in range(4))} FROM p WHERE (m0 IS NOT NULL)::INT + (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT >= 3")
def q_month_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by month, of those that have three of the months at least."""
    placed = norm.double_entry(movements(spark, sf_dir), "month", "typecode", "total").where("role = 'dep' and typecode = 'RF'")
    wide = placed.groupBy("airport").pivot("month", list(_MONTHS)).agg(norm.median(F.col("total")))
    return wide.select("airport", *(F.round(F.col(f"`{m}`"), 6).alias(f"m{i}") for i, m in enumerate(_MONTHS))).dropna(thresh=3, subset=[f"m{i}" for i in range(4)])


@query(f"WITH {MOV}, d AS (SELECT a, b, count(*) FILTER (WHERE origin = a) AS n1, count(*) FILTER (WHERE origin = b) AS n2, median(round(total, 4)) FILTER (WHERE origin = a) AS t1, median(round(total, 4)) FILTER (WHERE origin = b) AS t2, median(round(flown_km / gc_km, 4)) FILTER (WHERE origin = a) AS f1, median(round(flown_km / gc_km, 4)) FILTER (WHERE origin = b) AS f2 FROM mov WHERE a < b GROUP BY a, b) SELECT count(*) AS pairs, round(median(abs(t1 - t2)), 6) AS spread, round(median(abs(f1 - f2)), 6) AS detour FROM d WHERE n1 >= 10 AND n2 >= 10")
def q_dir_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pairs of places: the median difference between directions, of excess and of detour."""
    rows = norm.route(movements(spark, sf_dir)).where("a < b").withColumn("detour", F.col("flown_km") / F.col("gc_km"))
    out = F.col("origin") == F.col("a")
    mid = lambda c, when: F.percentile(F.when(when, F.round(c, 4)), 0.5)
    d = rows.groupBy("a", "b").agg(F.count(F.when(out, 1)).alias("n1"), F.count(F.when(~out, 1)).alias("n2"), *(mid(c, w).alias(f"{c}{k}") for c in ("total", "detour") for k, w in ((1, out), (2, ~out))))
    both = d.where("n1 >= 10 and n2 >= 10")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.percentile(F.abs(F.col("total1") - F.col("total2")), 0.5), 6).alias("spread"), F.round(F.percentile(F.abs(F.col("detour1") - F.col("detour2")), 0.5), 6).alias("detour"))


@query(f"WITH {MOV}, {_norm_sql('total')}, q AS (SELECT quantile_cont(round(d, 4), 0.75) AS q FROM dev) SELECT count(DISTINCT day) AS days, round(sum(greatest(d, 0) / 100 * ideal) * 365 / count(DISTINCT day) / 1e6, 6) AS all_m, round(sum(CASE WHEN round(d, 4) >= q THEN greatest(d, 0) / 100 * ideal ELSE 0 END) * 365 / count(DISTINCT day) / 1e6, 6) AS worst_m FROM dev, q")
def q_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a year would save if no movement were above its norm, and if the worst quarter were not."""
    dev = norm.deviations(movements(spark, sf_dir), {"d": "total"}, 1000)
    out = cohort.worst_quarter(dev, "d", F.greatest(F.col("d"), F.lit(0.0)) / 100 * F.col("ideal"))
    return out.select("days", *(F.round(F.col(c) * 365 / F.col("days") / 1e6, 6).alias(n) for c, n in (("a", "all_m"), ("w", "worst_m"))))


@query(f"WITH {MOV}, {_PLACED}, m AS (SELECT month, airport, count(*) AS n, round(median(round(total, 4)), 6) AS med FROM placed GROUP BY ALL HAVING count(*) >= 40), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY med DESC, airport) AS rank, count(*) OVER (PARTITION BY month) AS places FROM m) SELECT month, max(places) AS places, max(CASE WHEN rank = 1 THEN airport END) AS first, round(max(CASE WHEN rank = 1 THEN med END) - max(CASE WHEN rank = 10 THEN med END), 6) AS head_span, round(max(CASE WHEN airport = 7 THEN (places - rank) * 100.0 / places END), 6) AS percentile_7 FROM r GROUP BY month")
def q_month_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months: the first place, how far it is above the tenth, and where one place stands."""
    m = norm.double_entry(movements(spark, sf_dir), "month", "total").groupBy("month", "airport").agg(F.count(F.lit(1)).alias("n"), F.round(norm.median(F.col("total")), 6).alias("med")).where("n >= 40")
    r = m.withColumns({"rank": F.row_number().over(Window.partitionBy("month").orderBy(F.desc("med"), "airport")), "places": F.count(F.lit(1)).over(Window.partitionBy("month"))})
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    share = (F.col("places") - F.col("rank")) * 100.0 / F.col("places")
    return r.groupBy("month").agg(F.max("places").alias("places"), at(1, "airport").alias("first"), F.round(at(1, "med") - at(10, "med"), 6).alias("head_span"), F.round(F.max(F.when(F.col("airport") == 7, share)), 6).alias("percentile_7"))


@query(f"WITH {MOV}, r AS (SELECT a, b, count(*) AS n, round(median(round(total, 4)), 6) AS med FROM mov GROUP BY a, b HAVING count(*) >= 10) SELECT * FROM (SELECT 'top' AS list, * FROM r ORDER BY med DESC, a, b LIMIT 15) UNION ALL SELECT * FROM (SELECT 'bottom', * FROM r ORDER BY med, a, b LIMIT 15)")
def q_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen routes of the highest and fifteen of the lowest excess."""
    r = norm.route(movements(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(norm.median(F.col("total")), 6).alias("med")).where("n >= 10")
    end = lambda name, order: r.orderBy(order, "a", "b").limit(15).select(F.lit(name).alias("list"), "a", "b", "n", "med")
    return end("top", F.desc("med")).unionByName(end("bottom", F.asc("med")))


@query(f"WITH {MOV}, c AS (SELECT typecode, gc_km, 1 - share AS coverage, real / gc_km - 2 AS cruise_ff FROM mov) SELECT typecode, count(*) AS n, round(median(round(cruise_ff, 4)), 6) AS observed FROM c WHERE coverage >= 0.96 AND gc_km >= 150 AND cruise_ff > 0 GROUP BY 1")
def q_calibration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow that calibrates each type, from movements that may."""
    rows = movements(spark, sf_dir).withColumns({"coverage": 1 - F.col("share"), "cruise_ff": F.col("real") / F.col("gc_km") - 2})
    return flights.for_calibration(rows, 0.96).groupBy("typecode").agg(F.count(F.lit(1)).alias("n"), F.round(norm.median(F.col("cruise_ff")), 6).alias("observed"))


@query("""SELECT user_id AS aircraft, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.none')) AS absent FROM events GROUP BY 1""")
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a document in a column, and one that isn't there."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("aircraft")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"), F.count(F.get_json_object("props", "$.none")).alias("absent"))
