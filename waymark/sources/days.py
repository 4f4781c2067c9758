"""Tables kept by day: writing whole days, reading those that are sound, and naming the rest."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.sources.tables import strict


def numbered(flights: DataFrame, *order: str) -> DataFrame:
    """flights with flight_id, from 1 within each day, in an order that reruns repeat. (day, flight_id) is the key, never flight_id alone."""
    return flights.withColumn("flight_id", F.row_number().over(Window.partitionBy("day").orderBy(*order)))


def write_days(df: DataFrame, schema: StructType, path: str) -> None:
    """Replaces the days that df holds, and no others; columns that schema doesn't name raise."""
    strict(df, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def write_two(flights: DataFrame, points: DataFrame, schemas: tuple[StructType, StructType], path: str, keys: list[str], *order: str) -> None:
    """Flights numbered by day, and their points under the same numbers, as two tables by day. Points are in order of flight and time within
    their files, so that a flight's points are neighbours; each day of flights is replaced in both. keys: what flights and points share.

    Flights are settled first: both tables take numbers from the same rows, whatever is lost in between."""
    numbered(flights, *order).write.mode("overwrite").parquet(f"{path}/_numbered")
    made = flights.sparkSession.read.parquet(f"{path}/_numbered")
    write_days(made.select(*(F.col(c) for c in schemas[0].fieldNames())), schemas[0], f"{path}/flights")
    own = points.join(made.select(*keys, "flight_id"), keys).select(*schemas[1].fieldNames()).repartition("day").sortWithinPartitions("day", "flight_id", "t")
    write_days(own, schemas[1], f"{path}/points")


def manifest(spark: SparkSession, path: str, parameters: dict) -> None:
    """Records what a table was made with, as JSON beside it."""
    text = json.dumps(parameters, sort_keys=True, indent=1)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, part = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json"), jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json.part")
    where = at.getFileSystem(conf)
    out = where.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    where.delete(at, False)
    if not where.rename(part, at):
        raise OSError(f"could not write {at.toString()}")


def bundle(tables: dict[str, DataFrame], path: str, readme: str) -> None:
    """An export: each table as CSV, gzipped CSV and Parquet, one file each, and a text that says what they are. Exports are of one place, so small."""
    for name, df in tables.items():
        one = df.coalesce(1)
        one.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
        one.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/{name}.csv.gz")
        one.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(readme,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/README")


def sound_days(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Days whose files have sound footers and hold rows, and days whose don't: footers are read by tasks, no rows are. What is wrong with a file is told from
    its bytes; any other failure, a lost executor's included, is raised."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    where = root.getFileSystem(conf)
    files = []
    for day in where.listStatus(root):
        name = day.getPath().getName()
        if day.isDirectory() and name.startswith("day="):
            inside = [f.getPath() for f in where.listStatus(day.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            files += [(name[4:], _uri(p)) for p in inside] or [(name[4:], None)]
    if not files:
        return [], []

    def probe(batches):
        for batch in batches:
            rows = [_rows(uri) if uri else 0 for uri in batch.column("uri").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("day"), pa.array(rows, pa.int64())], ["day", "rows"])

    seen = spark.createDataFrame(files, "day string, uri string").repartition(min(len(files), 200)).mapInArrow(probe, "day string, rows long")
    found = seen.groupBy("day").agg(F.min(F.coalesce("rows", F.lit(-1))).alias("least"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows")).orderBy("day").collect()  # a row a day
    good = [r["day"] for r in found if r["least"] >= 0 and r["rows"] > 0]
    return good, [r["day"] for r in found if r["day"] not in set(good)]


def _uri(path) -> str:
    text = path.toUri().toString()
    return text.replace("file:/", "file:///", 1) if text.startswith("file:/") and not text.startswith("file:///") else text


def _rows(uri: str) -> int | None:
    """Rows by the footer; None where the file is no sound Parquet."""
    where, at = pafs.FileSystem.from_uri(uri)
    with where.open_input_file(at) as f:
        try:
            return pq.read_metadata(f).num_rows
        except pa.ArrowInvalid:
            return None


def read_days(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The sound days, and the names of those that were left out; raises where none is sound."""
    good, bad = sound_days(spark, path)
    if not good:
        raise ValueError(f"no sound day in {path}; unreadable: {bad}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/day={d}" for d in good)).withColumn("day", F.col("day").cast("string")), bad


def coverage_document(days: DataFrame, released: DataFrame) -> DataFrame:
    """One JSON document: each of days (day, status, flights, missing_hours) in order, with whether released (day) has it."""
    marked = days.join(released.select("day", F.lit(True).alias("included_in_release")).distinct(), "day", "left").na.fill({"included_in_release": False})
    one = marked.agg(F.array_sort(F.collect_list(F.struct("day", "status", "flights", "missing_hours", "included_in_release"))).alias("days"), F.count(F.lit(1)).alias("n_days"), F.sum("flights").alias("n_flights"))
    return one.select(F.to_json(F.struct("n_days", "n_flights", "days")).alias("document"))
