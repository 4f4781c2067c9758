"""Jobs that follow the data: catching up with new files day by day, cleaning and thinning as points come, and days that wait until they are whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from waymark.operators.track import _km


def catch_up(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None, files: int = 2) -> StreamingQuery:
    """Takes the files that source has gained since the last run, some at a time, and replaces the days that they hold; a run that is repeated leaves the same
    days. make(batch) gives the rows to write; they have a column day."""
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        (make(batch) if make else batch).write.mode("overwrite").partitionBy("day").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill(days: list[str], known_missing: list[str], run: Callable[[str], None], tries: int = 3) -> dict[str, str]:
    """Runs days from the last to the first, each up to so many times; days that are known to be missing are left out. Returns what became of each."""
    out = {}
    for day in sorted(days, reverse=True):
        if day in known_missing:
            out[day] = "missing"
            continue
        for left in range(tries - 1, -1, -1):
            try:
                run(day)
                out[day] = "done"
                break
            except OSError as e:
                out[day] = f"failed: {e}"
                if not left:
                    break
    return out


def whole_days(rows: DataFrame, least_hours: int, lag_days: int = 1) -> DataFrame:
    """rows of days that have enough hours and that lie lag_days before the latest: a day that is still being written waits."""
    day = F.to_date(F.timestamp_seconds("t"))
    marked = rows.withColumn("day", day)
    last = marked.agg(F.max("day").alias("__last"))
    ready = marked.groupBy("day").agg(F.count_distinct(F.hour(F.timestamp_seconds("t"))).alias("__hours")).join(last, F.lit(True)).where((F.col("__hours") >= least_hours) & (F.col("day") <= F.date_sub("__last", lag_days)))
    return marked.join(ready.select("day"), "day", "left_semi")


POINT = "aircraft long, event_id long, t double, lat double, lon double, alt double"


def kept_points(points: DataFrame, max_kt: float = 1400.0, spacing_s: float = 10.0, idle: str = "1 hour") -> DataFrame:
    """Of a stream of points (POINT, in order of time within an aircraft's batch): those that the last kept one could reach, spaced. The state is the last
    clean and the last spaced point of each aircraft; aircraft that are idle are forgotten. A stream has no last point, so the end isn't kept for its own sake."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None, None, None)
        for frame in frames:
            frame = frame.sort_values(["t", "event_id"])
            keep = []
            for t, lat, lon in zip(frame["t"], frame["lat"], frame["lon"], strict=True):
                at, la, lo, spaced = last
                sound = at is None or t > at and _km(la, lo, lat, lon) / 1.852 / ((t - at) / 3600) <= max_kt
                far = sound and (spaced is None or t - spaced >= spacing_s)
                keep.append(far)
                last = (t, lat, lon, t if far else spaced) if sound else last
            yield frame[keep]
        state.update(tuple(None if x is None else float(x) for x in last))
        state.setTimeoutDuration(3_600_000 if idle == "1 hour" else int(pd.Timedelta(idle).total_seconds() * 1000))

    return points.groupBy("aircraft").applyInPandasWithState(step, POINT, "t double, lat double, lon double, spaced double", "append", GroupStateTimeout.ProcessingTimeTimeout)
