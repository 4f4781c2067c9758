"""Queries over movements, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import norm
from waymark.sources.tables import movements, table

CELL, FLOOR = 1000, 4000
_BIN = "CASE " + " ".join(f"WHEN gc_km > {lo} AND gc_km <= {hi} THEN '({lo}, {hi}]'" for lo, hi in zip(geo.NORM_EDGES, geo.NORM_EDGES[1:], strict=False)) + " ELSE 'nan' END"
MOV = f"""mov0 AS (SELECT CAST(l_shipdate AS DATE) AS day, strftime(l_shipdate, '%Y-%m') AS month, s_nationkey AS origin, c_nationkey AS dest, l_returnflag || l_linestatus AS typecode,
 l_quantity * 50.0::DOUBLE AS gc_km, l_quantity * 50.0::DOUBLE * (1 + l_tax) AS flown_km, l_extendedprice * (1 - l_discount) / (1 + l_tax) AS ideal, l_extendedprice * (1 - l_discount) AS hybrid,
 l_extendedprice * (1 + ((l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7) % 1000)::DOUBLE / 5000.0::DOUBLE + s_nationkey * 0.002::DOUBLE) AS real, l_discount / 2 AS share
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
mov AS (SELECT *, (real - ideal) / ideal * 100 AS total, (hybrid - ideal) / ideal * 100 AS lateral, (real - hybrid) / ideal * 100 AS vertical, least(origin, dest) AS a, greatest(origin, dest) AS b, {_BIN} AS bin FROM mov0)"""


def _norm_sql(metric: str, cell: int = CELL) -> str:
    return f"""cells AS (SELECT bin, typecode, count(*) AS n, median(round({metric}, 4)) AS m FROM mov GROUP BY ALL), bins AS (SELECT bin, median(round({metric}, 4)) AS m FROM mov GROUP BY ALL),
dev AS (SELECT mov.*, {metric} - CASE WHEN cells.n >= {cell} THEN cells.m ELSE bins.m END AS d FROM mov JOIN cells USING (bin, typecode) JOIN bins ON mov.bin = bins.bin)"""


_ENTRY = "placed AS (SELECT origin AS airport, 'dep' AS role, * FROM {0} UNION ALL SELECT dest, 'arr', * FROM {0})"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {MOV}, {_norm_sql('total')}, {_ENTRY.format('dev')}, t AS (SELECT airport, count(*) AS n, round(median(round(d, 4)), 5) AS d_total FROM placed GROUP BY airport HAVING count(*) >= {FLOOR})
SELECT airport, n, d_total, row_number() OVER (ORDER BY d_total DESC, airport) AS rank, n_name AS name FROM t JOIN nation ON airport = n_nationkey""")
def q_norm_airport(spark: SparkSession, sf_dir: str, cell: int = CELL, floor: int = FLOOR) -> DataFrame:
    """Places by the median of their movements' deviation from the peer norm (the flagship)."""
    out = norm.airport_table(movements(spark, sf_dir), floor, cell)
    return out.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), F.col("airport") == F.col("n_nationkey")).drop("n_nationkey")


@query(f"""WITH {MOV} SELECT a, b, count(*) AS n, round(median(round(total, 4)), 5) AS med_total, round(sum(real), 2) AS sum_real, round(min(gc_km), 4) AS min_gc, round(avg(CASE WHEN typecode = 'RF' THEN 1.0 ELSE 0.0 END), 6) AS share_rf
FROM mov GROUP BY a, b HAVING count(*) >= 100 ORDER BY med_total DESC, a, b LIMIT 25""")
def q_route_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 routes, whatever the direction, of the largest median excess."""
    out = norm.route(movements(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(norm.median(F.col("total")), 5).alias("med_total"), F.round(F.sum("real"), 2).alias("sum_real"), F.round(F.min("gc_km"), 4).alias("min_gc"), F.round(F.avg((F.col("typecode") == "RF").cast("double")), 6).alias("share_rf"))
    return out.where("n >= 100").orderBy(F.desc("med_total"), "a", "b").limit(25)


@query(f"""WITH {MOV} SELECT count(*) AS n, count(DISTINCT day) AS days, round(sum(real) / 1e6, 4) AS real_m, round((sum(real) - sum(ideal)) / sum(ideal) * 100, 6) AS total_pct, round((sum(hybrid) - sum(ideal)) / sum(ideal) * 100, 6) AS lateral_pct,
round((sum(real) - sum(hybrid)) / sum(ideal) * 100, 6) AS vertical_pct, round(median(round(total, 4)), 5) AS med_total, CAST(sum(CASE WHEN total < -50 THEN 1 ELSE 0 END) AS BIGINT) AS degenerate FROM mov""")
def q_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of sums over all movements, beside the median of ratios."""
    part = lambda a, b: F.round((F.sum(a) - F.sum(b)) / F.sum("ideal") * 100, 6)
    return movements(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.round(F.sum("real") / 1e6, 4).alias("real_m"), part("real", "ideal").alias("total_pct"), part("hybrid", "ideal").alias("lateral_pct"), part("real", "hybrid").alias("vertical_pct"), F.round(norm.median(F.col("total")), 5).alias("med_total"), F.sum((F.col("total") < -50).cast("long")).alias("degenerate"))


@query(f"""WITH {MOV} SELECT typecode, round((sum(flown_km) - sum(gc_km)) / sum(gc_km) * 100, 6) AS extension_pct, count(*) AS n FROM mov WHERE gc_km >= 150 GROUP BY typecode""")
def q_kea_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension of the flown path as a ratio of sums; the great circle is what the flown path and its ratio give."""
    rows = movements(spark, sf_dir).where("gc_km >= 150").withColumn("ratio", F.col("flown_km") / F.col("gc_km"))
    gc = F.sum(F.col("flown_km") / F.nullif(F.col("ratio"), F.lit(0.0)))
    return rows.where("ratio is not null").groupBy("typecode").agg(F.round((F.sum("flown_km") - gc) / gc * 100, 6).alias("extension_pct"), F.count(F.lit(1)).alias("n"))


_REF = {"RF": 60.0, "AF": 56.0, "NO": 62.0, "NF": 48.0}
_REF_SQL = "ref(typecode, published) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _REF.items()) + ")"


@query(f"""WITH {MOV}, {_REF_SQL}, obs AS (SELECT typecode, count(*) AS n, median(round(real / gc_km, 4)) AS observed FROM mov WHERE gc_km >= 150 GROUP BY typecode)
SELECT typecode, n, round(observed, 5) AS observed, round(published / observed, 6) AS ratio, CASE WHEN abs(published / observed - 1) > 0.10::DOUBLE AND n >= 100 THEN round(published / observed, 6) ELSE 1.0 END AS factor FROM obs LEFT JOIN ref USING (typecode)""")
def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor for each type: published over observed median, where they differ by over a tenth and 100 movements tell; else 1."""
    obs = movements(spark, sf_dir).where("gc_km >= 150").groupBy("typecode").agg(F.count(F.lit(1)).alias("n"), norm.median(F.col("real") / F.col("gc_km")).alias("observed"))
    ref = spark.createDataFrame(list(_REF.items()), "typecode string, published double")
    ratio = F.col("published") / F.col("observed")
    return obs.join(F.broadcast(ref), "typecode", "left").select("typecode", "n", F.round("observed", 5).alias("observed"), F.round(ratio, 6).alias("ratio"), F.when((F.abs(ratio - 1) > 0.10) & (F.col("n") >= 100), F.round(ratio, 6)).otherwise(1.0).alias("factor"))


_GROUND = (("suolo", 0.0), ("a1000t40", 0.01), ("a1000t70", 0.02), ("a1000t100", 0.03), ("a3000t70", 0.04))


@query(f"WITH {MOV} " + " UNION ALL ".join(f"SELECT '{name}' AS definition, round((sum(real * (1 - CASE WHEN share > {at}::DOUBLE THEN share ELSE 0 END)) - sum(ideal)) / sum(ideal) * 100, 6) AS total_pct, round(sum(CASE WHEN share > {at}::DOUBLE THEN share * real ELSE 0 END), 2) AS ground FROM mov" for name, at in _GROUND))
def q_ground_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the total moves with the definition of ground: masks as columns, one aggregation, unpivoted."""
    cut = lambda at: F.when(F.col("share") > at, F.col("share")).otherwise(0.0)
    sums = [x for name, at in _GROUND for x in ((F.sum(F.col("real") * (1 - cut(at)))).alias(f"r_{name}"), F.sum(cut(at) * F.col("real")).alias(f"g_{name}"))]
    one = movements(spark, sf_dir).agg(F.sum("ideal").alias("ideal"), *sums)
    stack = ", ".join(f"'{name}', r_{name}, g_{name}" for name, _ in _GROUND)
    return one.selectExpr("ideal", f"stack({len(_GROUND)}, {stack}) as (definition, r, g)").select("definition", F.round((F.col("r") - F.col("ideal")) / F.col("ideal") * 100, 6).alias("total_pct"), F.round("g", 2).alias("ground"))


@query(f"""WITH {MOV}, {_norm_sql('total')}, {_ENTRY.format('dev')} SELECT airport, round(median(round(d, 4)) FILTER (WHERE role = 'dep'), 5) AS dep, round(median(round(d, 4)) FILTER (WHERE role = 'arr'), 5) AS arr, count(*) AS n FROM placed GROUP BY airport HAVING count(*) >= {FLOOR}""")
def q_role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median deviation of each place by role, where both roles together reach the floor."""
    placed = norm.double_entry(norm.deviations(movements(spark, sf_dir), {"d": "total"}, CELL), "d")
    mids = norm.counted_medians(placed, ["airport", "role"], "d", "mid")
    of = lambda role: F.round(F.max(F.when(F.col("role") == role, F.col("mid"))), 5).alias(role)
    return mids.groupBy("airport").agg(of("dep"), of("arr"), F.sum("n").alias("n")).where(F.col("n") >= FLOOR)


@query(f"""WITH {MOV}, r AS (SELECT a, b, median(round(total, 4)) FILTER (WHERE origin = a) AS go, median(round(total, 4)) FILTER (WHERE origin <> a) AS back, count(*) AS n FROM mov WHERE a <> b GROUP BY a, b)
SELECT a, b, n, round(abs(go - back), 5) AS spread FROM r WHERE go IS NOT NULL AND back IS NOT NULL""")
def q_dir_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the two directions of a route differ."""
    side = lambda there: F.percentile(F.when((F.col("origin") == F.col("a")) == there, F.round("total", 4)), 0.5)
    out = norm.route(movements(spark, sf_dir)).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), side(F.lit(True)).alias("go"), side(F.lit(False)).alias("back"))
    return out.where("go is not null and back is not null").select("a", "b", "n", F.round(F.abs(F.col("go") - F.col("back")), 5).alias("spread"))


@query(f"""WITH {MOV}, {_norm_sql('total')}, {_ENTRY.format('dev')}, y AS (SELECT substr(month, 1, 4) AS year, airport, count(*) AS n, round(median(round(d, 4)), 5) AS d FROM placed GROUP BY ALL HAVING count(*) >= 300)
SELECT year, airport, n, d, row_number() OVER (PARTITION BY year ORDER BY d DESC, airport) AS rank, round(max(d) OVER (PARTITION BY year) - d, 5) AS behind FROM y""")
def q_month_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places ranked within each period (a year here, so that the floor of 300 is met)."""
    placed = norm.double_entry(norm.deviations(movements(spark, sf_dir), {"d": "total"}, CELL), "d", "month")
    out = norm.counted_medians(placed.withColumn("year", F.substring("month", 1, 4)), ["year", "airport"], "d", "d").where("n >= 300").withColumn("d", F.round("d", 5))
    year = Window.partitionBy("year")
    return out.withColumns({"rank": F.row_number().over(year.orderBy(F.desc("d"), "airport")), "behind": F.round(F.max("d").over(year) - F.col("d"), 5)})


@query(f"""WITH {MOV}, r AS (SELECT substr(month, 1, 4) AS p, a, b, round(median(round(total, 4)), 5) AS m FROM mov GROUP BY ALL HAVING count(*) >= 10), j AS (SELECT x.p AS p1, y.p AS p2, x.m AS m1, y.m AS m2 FROM r x JOIN r y ON x.a = y.a AND x.b = y.b AND x.p < y.p),
k AS (SELECT p1, p2, rank() OVER (PARTITION BY p1, p2 ORDER BY m1) + (count(*) OVER (PARTITION BY p1, p2, m1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY p1, p2 ORDER BY m2) + (count(*) OVER (PARTITION BY p1, p2, m2) - 1) / 2.0::DOUBLE AS r2 FROM j)
SELECT p1, p2, count(*) AS n, round(corr(r1, r2), 6) AS rho FROM k GROUP BY p1, p2 HAVING count(*) >= 30""")
def q_month_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho of routes' medians between each two periods that share 30 routes."""
    r = norm.route(movements(spark, sf_dir)).groupBy(F.substring("month", 1, 4).alias("p"), "a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(norm.median(F.col("total")), 5).alias("m")).where("n >= 10")
    x, y = r.select(F.col("p").alias("p1"), "a", "b", F.col("m").alias("m1")), r.select(F.col("p").alias("p2"), "a", "b", F.col("m").alias("m2"))
    pairs = x.join(y, ["a", "b"]).where("p1 < p2")
    ranked = norm.average_rank(norm.average_rank(pairs, "m1", "r1", "p1", "p2"), "m2", "r2", "p1", "p2")
    return ranked.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("r1", "r2"), 6).alias("rho")).where("n >= 30")


@query(f"""WITH {MOV}, g AS (SELECT a, b, round(median(round(total, 4)), 5) AS x, round(avg(gc_km), 4) AS y, count(*) AS z FROM mov GROUP BY a, b),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rz FROM g),
c AS (SELECT corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM k) SELECT round(xy, 6) AS xy, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""")
def q_partial_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of routes' excess and length, and what is left of it beside their traffic."""
    g = norm.route(movements(spark, sf_dir)).groupBy("a", "b").agg(F.round(norm.median(F.col("total")), 5).alias("x"), F.round(F.avg("gc_km"), 4).alias("y"), F.count(F.lit(1)).alias("z"))
    for c in "xyz":
        g = norm.average_rank(g, c, f"r{c}")
    c = g.agg(F.corr("rx", "ry").alias("xy"), F.corr("rx", "rz").alias("xz"), F.corr("ry", "rz").alias("yz"))
    return c.select(F.round("xy", 6).alias("xy"), F.round((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)), 6).alias("partial"))


@query(f"""WITH {MOV}, {_norm_sql('total')}, r AS (SELECT a, b, median(round(d, 4)) AS d, sum(ideal) AS ideal FROM dev GROUP BY a, b), q AS (SELECT quantile_cont(d, 0.75) AS q FROM r)
SELECT round(q, 4) AS q75, round(sum(greatest(d, 0) / 100 * ideal), 2) AS all_saved, round(sum(CASE WHEN d >= q THEN greatest(d, 0) / 100 * ideal ELSE 0 END), 2) AS worst_saved FROM r, q GROUP BY q""")
def q_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What meeting the norm would save: on all routes, and on the worst quarter."""
    r = norm.route(norm.deviations(movements(spark, sf_dir), {"d": "total"}, CELL)).groupBy("a", "b").agg(norm.median(F.col("d")).alias("d"), F.sum("ideal").alias("ideal"))
    one = r.agg(F.percentile("d", 0.75).alias("q"))  # one row
    saved = F.greatest(F.col("d"), F.lit(0.0)) / 100 * F.col("ideal")
    return r.join(F.broadcast(one)).groupBy("q").agg(F.round(F.sum(saved), 2).alias("all_saved"), F.round(F.sum(F.when(F.col("d") >= F.col("q"), saved).otherwise(0.0)), 2).alias("worst_saved")).select(F.round("q", 4).alias("q75"), "all_saved", "worst_saved")


@query(f"""WITH {MOV}, c AS (SELECT bin, typecode, count(*) AS n, avg(mov.lateral) FILTER (WHERE share > 0.005::DOUBLE) AS ml, avg(vertical) FILTER (WHERE share > 0.005::DOUBLE) AS mv FROM mov GROUP BY ALL), b AS (SELECT bin, avg(mov.lateral) FILTER (WHERE share > 0.005::DOUBLE) AS ml, avg(vertical) FILTER (WHERE share > 0.005::DOUBLE) AS mv FROM mov GROUP BY ALL),
d AS (SELECT mov.origin, mov.dest, mov.lateral - CASE WHEN c.n >= {CELL} THEN c.ml ELSE b.ml END AS dl, vertical - CASE WHEN c.n >= {CELL} THEN c.mv ELSE b.mv END AS dv FROM mov JOIN c USING (bin, typecode) JOIN b ON mov.bin = b.bin WHERE share > 0.005::DOUBLE),
p AS (SELECT origin AS airport, 'dep' AS role, dl, dv FROM d UNION ALL SELECT dest, 'arr', dl, dv FROM d), s AS (SELECT airport, role, sum(dl) AS l, sum(dv) AS v, avg(dl + dv) AS m FROM p GROUP BY ALL)
SELECT airport, role, round(l, 2) AS l, round(v, 2) AS v, CASE WHEN abs(m) >= 0.5::DOUBLE THEN round(l / (l + v), 4) END AS share_lateral FROM s""")
def q_phase_attrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a place's deviation is lateral: sums of mean-referenced parts, shared out where the mean deviates enough."""
    rows = movements(spark, sf_dir)
    some = {c: F.when(F.col("share") > 0.005, F.col(c)) for c in ("lateral", "vertical")}
    d = norm.mean_deviations(rows.withColumns(some), {"dl": "lateral", "dv": "vertical"}, CELL).where("dl is not null")
    s = norm.double_entry(d, "dl", "dv").groupBy("airport", "role").agg(F.sum("dl").alias("l"), F.sum("dv").alias("v"), F.avg(F.col("dl") + F.col("dv")).alias("m"))
    return s.select("airport", "role", F.round("l", 2).alias("l"), F.round("v", 2).alias("v"), F.when(F.abs("m") >= 0.5, F.round(F.col("l") / (F.col("l") + F.col("v")), 4)).alias("share_lateral"))


@query(f"WITH {MOV} SELECT bin, count(*) AS n, round(avg(gc_km), 4) AS mean_gc, round(sum(real) / sum(gc_km), 6) AS per_km FROM mov GROUP BY bin")
def q_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements by right-closed distance bin."""
    return movements(spark, sf_dir).groupBy(geo.right_closed(F.col("gc_km")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gc_km"), 4).alias("mean_gc"), F.round(F.sum("real") / F.sum("gc_km"), 6).alias("per_km"))


@query(f"WITH {MOV} SELECT CAST(round_even(gc_km / 100, 0) * 100 AS DOUBLE) AS bucket, count(*) AS n FROM mov GROUP BY 1")
def q_bround(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements by the nearest 100 km, halves to the even one."""
    return movements(spark, sf_dir).groupBy(geo.bucket(F.col("gc_km"), 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MOV}, {_REF_SQL}, k AS (SELECT mov.typecode, real / gc_km AS x, published FROM mov LEFT JOIN ref USING (typecode))
SELECT typecode, count(*) AS n, CAST(sum(CASE WHEN x BETWEEN published * 0.8::DOUBLE AND published * 1.2::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS in_band, CAST(sum(CASE WHEN published IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_ref, round(avg(x), 4) AS mean, round(min(x), 4) AS low, round(max(x), 4) AS high, round(stddev_pop(x), 4) AS sd FROM k GROUP BY typecode""")
def q_ref_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumption a km against a published value by type: within a fifth, or without a value."""
    ref = spark.createDataFrame(list(_REF.items()), "typecode string, published double")
    k = movements(spark, sf_dir).select("typecode", (F.col("real") / F.col("gc_km")).alias("x")).join(F.broadcast(ref), "typecode", "left")
    near = F.col("x").between(F.col("published") * 0.8, F.col("published") * 1.2)
    return k.groupBy("typecode").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("in_band"), F.count_if(F.col("published").isNull()).alias("no_ref"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"), F.round(F.stddev_pop("x"), 4).alias("sd"))
