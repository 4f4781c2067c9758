"""Small tables that the engine joins: places, factors, consumption by distance, wind grids, published taxi times; and their download.

Formats whose reader isn't part of Spark (grids as NetCDF, workbooks) are read by pandas or xarray where those have an engine for them, and raise
where they have none.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def airports(spark: SparkSession, path: str) -> DataFrame:
    """place, plat, plon, name from CSV (icao, lat, lon, name); rows without a code or with a place that is no number go."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    named = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    out = rows.select(F.upper(F.trim("icao")).alias("place"), F.col("lat").try_cast("double").alias("plat"), F.col("lon").try_cast("double").alias("plon"), named.alias("name"))
    return out.where("place <> '' and plat is not null and plon is not null")


def factors(spark: SparkSession, path: str) -> DataFrame:
    """typecode, factor from JSON: a map of types, alone or under "factors"; values that are no numbers go."""
    text = spark.read.option("wholetext", True).text(path).select("value")
    kind = "map<string,string>"
    inner = F.from_json(F.get_json_object("value", "$.factors"), kind)
    flat = text.select(F.explode(F.coalesce(inner, F.from_json("value", kind))).alias("typecode", "factor"))
    return flat.select("typecode", F.col("factor").try_cast("double").alias("factor")).where("factor is not null")


def consumption(spark: SparkSession, path: str) -> DataFrame:
    """typecode and table (distance to kg) from JSON of types, each with points of distance and kg, alone or under "types"."""
    text = spark.read.option("wholetext", True).text(path).select("value")
    kind = "map<string,struct<points:map<string,double>>>"
    inner = F.from_json(F.get_json_object("value", "$.types"), kind)
    return text.select(F.explode(F.coalesce(inner, F.from_json("value", kind))).alias("typecode", "x")).select("typecode", F.transform_keys("x.points", lambda k, _: k.cast("int")).alias("table")).where("table is not null")


def grid(spark: SparkSession, paths: list[str]) -> DataFrame:
    """valid_time, level, lat, lon, u, v from NetCDF files, one a day, read by tasks a time at a time. Needs xarray and an engine on the executors."""
    rows = spark.createDataFrame([(p,) for p in sorted(paths)], "path string").repartition(max(len(paths), 1))

    def read(batches):
        import xarray

        for batch in batches:
            for path in batch["path"]:
                with xarray.open_dataset(path) as ds:
                    for at in ds["valid_time"].values:
                        one = ds[["u", "v"]].sel(valid_time=at).to_dataframe().reset_index()
                        one["valid_time"] = at.astype("datetime64[s]").astype("int64").astype(float)
                        yield one.rename(columns={"pressure_level": "level", "latitude": "lat", "longitude": "lon"})[["valid_time", "level", "lat", "lon", "u", "v"]].astype(float)

    return rows.mapInPandas(read, "valid_time double, level double, lat double, lon double, u double, v double")


def taxi_times(spark: SparkSession, path: str, sheet: str | int = 0, key: str = "ICAO", value: str = "MEAN") -> DataFrame:
    """airport, minutes from a workbook of published means; rows without a code go. Needs pandas' engine for workbooks."""
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet)[[key, value]].dropna(subset=[key])
    return spark.createDataFrame([(str(k), float(v) if v == v else None) for k, v in frame.itertuples(index=False)], "airport string, minutes double")


def fetched(spark: SparkSession, urls: list[str], fields: str, get: Callable[[str], bytes] | None = None, least: int = 1) -> DataFrame:
    """Rows (fields: a schema) of JSON documents at urls that hold a list of objects, or an object of them; the first documents that are neither
    are passed over. Raises where fewer than least could be read."""
    get = get or (lambda url: urllib.request.urlopen(url, timeout=60).read())  # noqa: S310
    schema, rows, read = spark.createDataFrame([], fields).schema, [], 0
    for url in urls:
        try:
            doc = json.loads(get(url))
        except (OSError, ValueError):
            continue
        items = doc if isinstance(doc, list) else list(doc.values()) if isinstance(doc, dict) else []
        items = [x for x in items if isinstance(x, dict)]
        read += bool(items)
        rows += [tuple(x.get(f.name) for f in schema) for x in items]
    if read < least:
        raise OSError(f"{read} of {len(urls)} documents could be read")
    return spark.createDataFrame(rows, schema, verifySchema=False)


def downloaded(url: str, path: str, get: Callable | None = None, force: bool = False) -> str:
    """Fetches url to path, by a part file that is renamed when whole; what is there already stays."""
    if force or not os.path.exists(path):
        part = f"{path}.part"
        with (get or urllib.request.urlopen)(url) as source, open(part, "wb") as out:  # noqa: S310
            while piece := source.read(1 << 20):
                out.write(piece)
        os.replace(part, path)
    return path
