"""Sessions of positions by time gap, the same plan for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap_s: float, late: str = "1 day") -> DataFrame:
    """aircraft, t0, t1, n of runs of events whose neighbours are at most gap_s apart; late bounds what a stream keeps open."""
    timed = events.select(F.col("user_id").alias("aircraft"), F.col("ts").cast("timestamp").alias("ts"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    # A session window ends gap after its last event, exclusively; one microsecond more joins neighbours exactly gap apart.
    window = F.session_window("ts", F.lit(f"{int(gap_s * 1_000_000) + 1} microseconds"))
    seconds = lambda x: F.round(F.unix_micros(x) / 1e6, 3)
    return timed.groupBy("aircraft", window).agg(seconds(F.min("ts")).alias("t0"), seconds(F.max("ts")).alias("t1"), F.count(F.lit(1)).alias("n")).drop("session_window")
