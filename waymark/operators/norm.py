"""Peer norms, double entry, rankings and ratios over movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo


def median(x: Column) -> Column:
    """Exact, of values rounded to 4 places."""
    return F.percentile(F.round(x, 4), 0.5)


def medians(cells: DataFrame, keys: list[str], metrics: list[str], prefix: str) -> DataFrame:
    """keys, {prefix}_n (rows, null values as well) and the median of each metric, from a histogram: cells (keys, m: the metric's place, v: its value,
    n: how often it stands; a value may have several rows).

    The middle values are those at which the running count passes half; values of one metric and key run in order through a window
    over distinct values, so a key with many rows is as many rows as it has values, whatever the rows."""
    order = Window.partitionBy(*keys, "m").orderBy("v")
    known = cells.withColumn("__n", F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    run = known.withColumns({"__to": F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(Window.partitionBy(*keys, "m"))})
    a, b = F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2)
    holds = lambda at: (F.col("__to") >= at) & (F.col("__to") - F.col("__n") < at)
    pick = lambda i, at: F.max(F.when((F.col("m") == i) & holds(at), F.col("v")))
    return run.groupBy(*keys).agg(F.sum(F.when(F.col("m") == 0, F.col("n"))).alias(f"{prefix}_n"), *((pick(i, a) / 2 + pick(i, b) / 2).alias(f"{prefix}_{m}") for i, m in enumerate(metrics)))


def counted_medians(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, n and the median of value (to 4 places) of each group: by its histogram, so that no task holds a group's values."""
    cells = rows.groupBy(*keys, F.round(value, 4).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(0))
    return medians(cells, keys, [out], "mid").select(*keys, F.col("mid_n").alias("n"), F.col(f"mid_{out}").alias(out))


def deviations(rows: DataFrame, metrics: dict[str, str], cell_min: int, bins: Column | None = None) -> DataFrame:
    """rows with, for each output name of metrics, a metric's deviation from the median of its (bin, type) cell, or of its bin where
    the cell has fewer than cell_min rows.

    One histogram of the cells (values to 4 places, counted with partial sums) gives both levels' medians in one pass (each of its rows stands for its
    cell and for its bin), so that rows are read twice, once for the norms and once to join them, and no task sorts or holds a bin's rows. The norms,
    a row for each bin and type, are broadcast: rows are not dealt out by these few keys."""
    rows = rows.withColumn("bin", geo.right_closed(F.col("gc_km")) if bins is None else bins)
    names = list(metrics.values())
    values = F.array(*(F.struct(F.lit(i).alias("m"), F.round(F.col(m), 4).alias("v")) for i, m in enumerate(names)))
    cells = rows.select("bin", "typecode", F.explode(values).alias("x")).groupBy("bin", "typecode", "x.m", "x.v").agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(F.struct(F.lit(True).alias("own"), F.col("typecode")), F.struct(F.lit(False).alias("own"), F.lit(None).cast(cells.schema["typecode"].dataType).alias("typecode")))
    both = cells.select("bin", "m", "v", "n", F.explode(levels).alias("e")).select("bin", "e.own", "e.typecode", "m", "v", "n")
    mids = medians(both, ["own", "bin", "typecode"], names, "cell")
    whole = lambda m: F.max(F.when(~F.col("own"), F.col(f"cell_{m}"))).over(Window.partitionBy("bin"))
    norms = mids.withColumns({f"bin_{m}": whole(m) for m in names}).where("own").withColumnRenamed("cell_n", "n_cell")
    pick = lambda m: F.when(F.col("n_cell") >= cell_min, F.col(f"cell_{m}")).otherwise(F.col(f"bin_{m}")).alias(f"norm_{m}")
    joined = rows.join(F.broadcast(norms.select("bin", "typecode", "n_cell", *map(pick, names))), ["bin", "typecode"])
    return joined.withColumns({out: F.col(m) - F.col(f"norm_{m}") for out, m in metrics.items()}).drop(*(f"norm_{m}" for m in names))


def mean_deviations(rows: DataFrame, metrics: dict[str, str], cell_min: int) -> DataFrame:
    """As deviations(), by means: a cell counts all its rows towards cell_min, but means take only rows complete in all metrics; incomplete rows get null.
    Cells' sums give both levels' means, so rows are read twice; the means, a row for each bin and type, are broadcast."""
    rows = rows.withColumn("bin", geo.right_closed(F.col("gc_km")))
    whole = F.lit(True)
    for m in metrics.values():
        whole = whole & F.col(m).isNotNull()
    sums = rows.groupBy("bin", "typecode").agg(F.count(F.lit(1)).alias("n_cell"), F.count(F.when(whole, 1)).alias("__k"), *(F.sum(F.when(whole, F.col(m))).alias(f"__{m}") for m in metrics.values()))
    of_bin = lambda c: F.sum(c).over(Window.partitionBy("bin"))
    means = {f"cell_{m}": F.col(f"__{m}") / F.nullif(F.col("__k"), F.lit(0)) for m in metrics.values()} | {f"bin_{m}": of_bin(f"__{m}") / F.nullif(of_bin("__k"), F.lit(0)) for m in metrics.values()}
    cells = sums.withColumns(means).drop("__k", *(f"__{m}" for m in metrics.values()))
    joined = rows.join(F.broadcast(cells), ["bin", "typecode"])
    return joined.withColumns({out: F.when(whole, F.col(m) - F.when(F.col("n_cell") >= cell_min, F.col(f"cell_{m}")).otherwise(F.col(f"bin_{m}"))) for out, m in metrics.items()})


def double_entry(rows: DataFrame, *keep: str) -> DataFrame:
    """Each movement under its origin (role dep) and its destination (role arr): one scan, an array of two exploded. Rows without the place go."""
    pair = F.array(F.struct(F.col("origin").alias("airport"), F.lit("dep").alias("role")), F.struct(F.col("dest").alias("airport"), F.lit("arr").alias("role")))
    return rows.select(F.explode(pair).alias("e"), *keep).select("e.airport", "e.role", *keep).where("airport is not null")


def airport_table(rows: DataFrame, floor: int, cell_min: int) -> DataFrame:
    """airport, n, d_total: the median deviation of places with at least floor movements (both roles), and its rank."""
    placed = double_entry(deviations(rows, {"d": "total"}, cell_min), "d")
    out = counted_medians(placed, ["airport"], "d", "d_total").where(F.col("n") >= floor).withColumn("d_total", F.round("d_total", 5))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("d_total"), "airport")))


def route(rows: DataFrame) -> DataFrame:
    """rows with a and b: the route's ends in order, whatever the direction."""
    return rows.withColumns({"a": F.least("origin", "dest"), "b": F.greatest("origin", "dest")})


def corrected(rows: DataFrame) -> DataFrame:
    """rows whose real consumption is less its share on the ground, percentages computed anew."""
    real = F.col("real") * (1 - F.coalesce("share", F.lit(0.0)))
    out = rows.withColumn("real", real)
    ideal = F.nullif(F.col("ideal"), F.lit(0.0))
    return out.withColumns({"total": (F.col("real") - F.col("ideal")) / ideal * 100, "vertical": (F.col("real") - F.col("hybrid")) / ideal * 100})


def checked_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left join that must not multiply rows: raises where right has a key twice."""
    if right.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError(f"the right side has equal keys {keys}")
    return left.join(right, keys, "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of tables whose keys are unique on both sides; raises where one has a key twice."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(*keys).count().where("count > 1").head(1):
            raise ValueError(f"the {name} side has equal keys {keys}")
    return left.join(right, keys)


def calibrated(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """rows with real, ideal and hybrid times the type's factor (typecode, factor), 1 where it has none."""
    out = rows.join(factors, "typecode", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return out.withColumns({c: F.col(c) * F.col("factor") for c in ("real", "ideal", "hybrid")})


def analysed(rows: DataFrame, shares: DataFrame | None, factors: DataFrame, cell_min: int, keys: tuple[str, ...] = ("day", "flight_id")) -> DataFrame:
    """The analysis table: rows, their share on the ground (keys, share; joined without multiplying rows, no share where it has none), real
    consumption without it, percentages anew, calibrated levels, and deviations from the norm (d_total, d_lateral, d_vertical). Days
    that shares lacks as a whole raise, as a missing share would read as nothing on the ground."""
    out = rows
    if shares is not None:
        lacking = rows.select("day").distinct().join(shares.select("day").distinct(), "day", "left_anti").orderBy("day").limit(20).collect()
        if lacking:
            raise ValueError(f"days without ground shares: {[str(r['day']) for r in lacking]}")
        out = checked_left(rows.drop("share"), shares, list(keys))
    return deviations(calibrated(corrected(out), factors), {"d_total": "total", "d_lateral": "lateral", "d_vertical": "vertical"}, cell_min)


def average_rank(rows: DataFrame, column: str, out: str, *group: str) -> DataFrame:
    """rows with the average rank of column within group: from counts of its values, so ties are one row of the window."""
    values = rows.groupBy(*group, column).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(values.withColumn(out, before + (F.col("__n") + 1) / 2.0).drop("__n"), [*group, column])
