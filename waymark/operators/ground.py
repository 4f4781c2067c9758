"""Consumption and time on the ground: shares of a flight's steps by named thresholds, taxi spans by three definitions, taxi emissions by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name, altitude below (ft), speed below (kt); without thresholds, at altitude 0 or less. The last is the one in use.
DEFINITIONS = (("suolo", None, None), ("a1000t40", 1000, 40), ("a1000t70", 1000, 70), ("a1000t100", 1000, 100), ("a3000t70", 3000, 70))
IN_USE = "a3000t70"
GAP_S, MOVING_KT, LEAST_POINTS, CO2 = 600.0, 3.0, 3, 3.16


def masks(alt: Column, tas: Column) -> dict[str, Column]:
    return {name: (alt <= 0) if low is None else (alt < low) & (tas < slow) for name, low, slow in DEFINITIONS}


def ground_share(steps: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """keys, fuel_kg, n_steps, and for each definition the fuel, seconds and steps on the ground, the fuel in each half of the path (by the middle of
    the step), and its share of all fuel. steps: keys, order, dt, alt, tas, km, burn."""
    whole, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumns({"__arc": F.sum("km").over(up_to), "__all": F.sum("km").over(whole)})
    first = (F.col("__arc") - F.col("km") / 2) / F.when(F.col("__all") > 0, F.col("__all")).otherwise(1.0) < 0.5
    out = [F.sum("burn").alias("fuel_kg"), F.count(F.lit(1)).alias("n_steps")]
    for name, mask in masks(F.col("alt"), F.col("tas")).items():
        total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
        out += [total("burn", mask).alias(f"fuel_{name}_kg"), total("dt", mask).alias(f"t_{name}_s"), F.count(F.when(mask, 1)).alias(f"n_{name}"), total("burn", mask & first).alias(f"fuel_{name}_dep_kg"), total("burn", mask & ~first).alias(f"fuel_{name}_arr_kg")]
    rows = placed.groupBy(*keys).agg(*out)
    return rows.withColumns({f"share_{name}": F.when(F.col("fuel_kg") > 0, F.col(f"fuel_{name}_kg") / F.col("fuel_kg")).otherwise(0.0) for name, *_ in DEFINITIONS})


def taxi(points: DataFrame, flights: DataFrame, keys: list[str], alt_ft: float = 3000.0, kt: float = 70.0, gap_s: float = GAP_S, least: int = LEAST_POINTS) -> DataFrame:
    """Each of flights, those without points too: keys, n_ground, dep_ok, arr_ok (enough points on the ground at that end), and seconds of taxi at each
    end, null where it can't be told: _span (from the first point), _seen (steps of at most gap_s), _moving (from the first or to the last movement).

    points: keys, t, event_id, alt, gs. A point without altitude or speed is not on the ground."""
    ground = F.coalesce((F.col("alt") < alt_ft) & (F.col("gs") < kt), F.lit(False))
    order, whole = Window.partitionBy(*keys).orderBy("t", "event_id"), Window.partitionBy(*keys)
    p = points.withColumns({"__g": ground, "__dt": F.col("t") - F.lag("t").over(order)}).withColumns({"__up": F.min(F.when(~F.col("__g"), F.col("t"))).over(whole), "__down": F.max(F.when(~F.col("__g"), F.col("t"))).over(whole)})
    before, after = F.col("__g") & (F.col("t") < F.col("__up")), F.col("__g") & (F.col("t") > F.col("__down"))
    short, moving = F.col("__dt") <= gap_s, F.col("gs") > MOVING_KT
    when = lambda c, value="t": F.when(c, F.col(value))
    q = p.groupBy(*keys).agg(
        F.count(when(before)).alias("nd"), F.count(when(after)).alias("na"), (F.max("__up") - F.min(when(before))).alias("taxi_dep_span_s"), (F.max(when(after)) - F.max("__down")).alias("taxi_arr_span_s"),
        F.sum(when(before & short, "__dt")).alias("taxi_dep_seen_s"), F.sum(when(after & short, "__dt")).alias("taxi_arr_seen_s"),
        (F.max("__up") - F.min(when(before & moving))).alias("taxi_dep_moving_s"), (F.max(when(after & moving)) - F.max("__down")).alias("taxi_arr_moving_s"),
    )
    r = flights.join(q, keys, "left").withColumns({"dep_ok": F.coalesce(F.col("nd") >= least, F.lit(False)), "arr_ok": F.coalesce(F.col("na") >= least, F.lit(False)), "n_ground": F.coalesce(F.col("nd") + F.col("na"), F.lit(0))})
    return r.withColumns({f"taxi_{end}_{how}_s": F.when(F.col(f"{end}_ok"), F.col(f"taxi_{end}_{how}_s")) for end in ("dep", "arr") for how in ("span", "seen", "moving")}).drop("nd", "na")


def taxi_emissions(flights: DataFrame, times: DataFrame, idle: DataFrame, summer_from: str, least: int = 1) -> DataFrame:
    """airport, n_dep, co2_dep, t_dep, n_arr, co2_arr, t_arr, mov, co2_mov, of places with enough movements: the published taxi time of the season, times the
    mean idle flow of the types seen there, times movements. flights: day, origin, dest, typecode; times: airport, out_w, out_s, in_w, in_s in
    minutes; idle: typecode, ff in kg a second. Types without a flow, and seasons without a time, don't count; means are weighted by movements."""
    rows = flights.join(idle, "typecode", "left").withColumn("winter", F.col("day") < F.to_date(F.lit(summer_from)))
    ends = F.array(*(F.struct(F.col(c).alias("airport"), F.lit(role).alias("role")) for c, role in (("origin", "dep"), ("dest", "arr"))))
    cells = rows.select(F.explode(ends).alias("e"), "winter", "ff").select("e.airport", "e.role", "winter", "ff").groupBy("airport", "role", "winter").agg(F.count(F.lit(1)).alias("n"), F.avg("ff").alias("ff"))
    minutes = F.when(F.col("role") == "dep", F.when(F.col("winter"), F.col("out_w")).otherwise(F.col("out_s"))).otherwise(F.when(F.col("winter"), F.col("in_w")).otherwise(F.col("in_s")))
    timed = cells.join(times, "airport").withColumn("minutes", minutes).where("minutes is not null and ff is not null").withColumn("co2", F.col("minutes") * 60 * F.col("ff") * CO2 * F.col("n"))
    of = lambda role: [F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(f"n_{role}"), F.coalesce(F.sum(F.when(F.col("role") == role, F.col("co2"))), F.lit(0.0)).alias(f"co2_{role}"), F.coalesce(F.sum(F.when(F.col("role") == role, F.col("minutes") * F.col("n"))) / F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0.0)).alias(f"t_{role}")]
    out = timed.groupBy("airport").agg(*of("dep"), *of("arr")).withColumn("mov", F.col("n_dep") + F.col("n_arr"))
    return out.withColumn("co2_mov", (F.col("co2_dep") + F.col("co2_arr")) / F.col("mov")).where(F.col("mov") >= least)
