"""Table functions for SQL: register(spark) adds gc_points(lat1, lon1, lat2, lon2, n) and profile(distance_km, altitude_ft, wind_ms)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from waymark.operators import performance as perf


@udtf(returnType=StructType([StructField("i", IntegerType()), StructField("lat", DoubleType()), StructField("lon", DoubleType())]))
class GcPoints:
    def eval(self, lat1: float, lon1: float, lat2: float, lon2: float, n: int):
        lat, lon = perf.gc_places(lat1, lon1, lat2, lon2, n)
        for i, (a, o) in enumerate(zip(lat.tolist(), lon.tolist(), strict=True)):
            yield i, a, o


@udtf(returnType=StructType([StructField("i", IntegerType()), *(StructField(c, DoubleType()) for c in ("dt", "alt", "vs", "tas", "km", "burn"))]))
class Profile:
    def eval(self, distance_km: float, altitude_ft: float, wind_ms: float):
        s = perf.profile(perf.PerfModel(), distance_km, altitude_ft, wind_ms)
        if s is not None:
            burn = perf.burned(perf.PerfModel(), s)
            for i, row in enumerate(zip(*(s[c].tolist() for c in ("dt", "alt", "vs", "tas", "km")), burn.tolist(), strict=True)):
                yield i, *row


def register(spark: SparkSession) -> None:
    spark.udtf.register("gc_points", GcPoints)
    spark.udtf.register("profile", Profile)
