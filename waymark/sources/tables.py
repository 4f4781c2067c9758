"""The engine's inputs as DataFrames: strict loading, and movements and traces made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strict(df: DataFrame, schema: StructType) -> DataFrame:
    """df in the order and types of schema, NaN as null, floats as doubles; columns that schema lacks, or that df lacks, raise."""
    odd = set(df.columns) ^ set(schema.fieldNames())
    if odd:
        raise ValueError(f"columns that differ from the schema: {sorted(odd)}")
    kinds = dict(df.dtypes)
    clean = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("float", "double") else F.col(c)
    return df.select(*(clean(f.name).cast(f.dataType).alias(f.name) for f in schema))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a movement: day, month, origin, dest, typecode, gc_km, flown_km, ideal, hybrid, real, share, and the three excess percentages.

    Orders get their customer's place first, so that items are dealt out once, by order, and in columns that are the same for all passes over them where these need
    the same figures: Spark then reuses the exchange."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dest")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dest")
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.to_date("l_shipdate")
    jitter = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7) % 1000) / 5000.0
    hybrid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    gc = F.col("l_quantity") * 50.0
    rows = items.select(
        day.alias("day"), F.date_format(day, "yyyy-MM").alias("month"), F.col("s_nationkey").alias("origin"), "dest", F.concat("l_returnflag", "l_linestatus").alias("typecode"),
        gc.alias("gc_km"), (gc * (1 + F.col("l_tax"))).alias("flown_km"), (hybrid / (1 + F.col("l_tax"))).alias("ideal"), hybrid.alias("hybrid"), (F.col("l_extendedprice") * (1 + jitter + F.col("s_nationkey") * 0.002)).alias("real"), (F.col("l_discount") / 2).alias("share"),
    )
    percent = lambda a, b: (F.col(a) - F.col(b)) / F.col("ideal") * 100
    return rows.withColumns({"total": percent("real", "ideal"), "lateral": percent("hybrid", "ideal"), "vertical": percent("real", "hybrid")})


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a position: event_id, aircraft, t (unix seconds), lat, lon, alt, new_leg, event_type."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("aircraft"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (35 + (F.col("event_id") * 37 % 3700) / 100.0).alias("lat"), (-10 + (F.col("event_id") * 53 % 3500) / 100.0).alias("lon"),
        (F.col("value") * 80).alias("alt"), (F.col("event_type") == "signup").alias("new_leg"), "event_type",
    )
