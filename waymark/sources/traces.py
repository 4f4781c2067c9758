"""Positions from tar files of trace documents (JSON, plain or gzipped), one row a point; damaged members are kept apart and named.

A day's dump may be one tar file, or parts that are one stream when put one after the other (day.tar.aa, day.tar.ab). Parts are read
through the file system that Spark reads (pyarrow's, or Hadoop's), a piece at a time, so neither a day's size nor a member that goes on in the next
part matters. A tar can't be split, so a task reads whole days; members go on in batches and are dealt out anew after it.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER = re.compile(r"(^|/)trace_full_[^/]*\.json$")
RAW = "member string, content string, damaged boolean"
BATCH_BYTES = 8 << 20


class Stream(io.RawIOBase):
    """Files read one after the other as one stream of bytes; read_bytes counts those that were consumed."""

    def __init__(self, uris: list[str]):
        self.left, self.file, self.read_bytes = list(uris), None, 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.file is None:
                if not self.left:
                    return 0
                where, path = pafs.FileSystem.from_uri(self.left.pop(0))
                self.file = where.open_input_stream(path, compression=None)
            data = self.file.read(len(buffer))
            if data:
                buffer[: len(data)] = data
                self.read_bytes += len(data)
                return len(data)
            self.file.close()
            self.file = None


def decoded(raw: bytes) -> str | None:
    """A member's JSON text, gunzipped where it is gzipped; None where it is damaged."""
    try:
        text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
        json.loads(text)
        return text
    except (OSError, EOFError, ValueError):
        return None


def unpacked(name: str, stream) -> Iterator[tuple[str, str | None, bool]]:
    """(member, JSON text or None, damaged) of the trace documents in a tar stream; padding inside it is skipped. A stream that breaks off gives what came
    before, and its name as a damaged member."""
    try:
        with tarfile.open(fileobj=io.BufferedReader(stream, 1 << 20), mode="r|", ignore_zeros=True) as tar:
            for info in tar:
                if info.isfile() and MEMBER.search(info.name):
                    text = decoded(tar.extractfile(info).read())
                    yield f"{name}!{info.name}", text, text is None
    except tarfile.TarError:
        yield name, None, True


def streams(paths: list[str]) -> dict[str, list[str]]:
    """Days and their parts in order: parts differ in what follows .tar alone."""
    out: dict[str, list[str]] = {}
    for path in sorted(paths):
        out.setdefault(re.sub(r"\.tar.*$", ".tar", path), []).append(path)
    return out


def _files(spark: SparkSession, path: str) -> list[str]:
    """URIs of the files in or under path, by Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, out = root.getFileSystem(conf).listFiles(root, True), []
    while found.hasNext():
        at = found.next().getPath()
        if ".tar" in at.getName():
            out.append(at.toUri().toString().replace("file:/", "file:///", 1) if at.toUri().getScheme() == "file" else at.toUri().toString())
    return out


def members(spark: SparkSession, path: str) -> DataFrame:
    """member, content, damaged of the dumps in a folder: one task a day, split parts joined."""
    days = streams(_files(spark, path))
    rows = spark.createDataFrame([(name, parts) for name, parts in days.items()], "name string, parts array<string>").repartition(max(len(days), 1))

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                held, size = [], 0
                for row in unpacked(name, Stream(parts)):
                    held.append(row)
                    size += len(row[1] or "")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], ["member", "content", "damaged"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], ["member", "content", "damaged"])

    return rows.mapInArrow(run, RAW)


class TraceSource(ABC):
    """Where traces come from: days, and the trace documents of a day. Another source need only say these two things."""

    @abstractmethod
    def days(self) -> list[str]: ...

    @abstractmethod
    def traces(self, day: str) -> Iterator[tuple[str, str | None, bool]]:
        """(member, JSON text or None, damaged)."""


class TarSource(TraceSource):
    def __init__(self, paths: list[str]):
        self.parts = streams(paths)

    def days(self) -> list[str]:
        return list(self.parts)

    def traces(self, day: str) -> Iterator[tuple[str, str | None, bool]]:
        return unpacked(day, Stream(self.parts[day]))


class TraceFormat(DataSource):
    """spark.read.format("traces").option("paths", "uri,uri"): a batch source over a TraceSource; source() makes one from the options."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return RAW

    def source(self) -> TraceSource:
        return TarSource([p for p in self.options.get("paths", "").split(",") if p])

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(self.source())


class TraceReader(DataSourceReader):
    def __init__(self, source: TraceSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(day) for day in self.source.days()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.traces(partition.value)


def points(raw: DataFrame) -> DataFrame:
    """icao, typecode, registration and each point's t, lat, lon, alt ("ground": 0; no number: null), gs, new_leg, vs, ias, mcp, callsign, in
    time's order with the document's order on ties (i). Points without a place go; damaged members have none."""
    doc = raw.where("not damaged").select(F.from_json("content", "icao string, t string, r string, timestamp double, trace array<array<string>>").alias("d")).select("d.*")
    at = lambda x, i: F.get(x, F.lit(i))
    number = lambda x, i: at(x, i).try_cast("double")
    more = lambda x, key: F.get_json_object(at(x, 8), f"$.{key}")
    one = lambda x, i: F.struct(
        i.alias("i"), (F.col("timestamp") + number(x, 0)).alias("t"), number(x, 1).alias("lat"), number(x, 2).alias("lon"), F.when(at(x, 3) == "ground", F.lit(0.0)).otherwise(number(x, 3)).alias("alt"), number(x, 4).alias("gs"),
        number(x, 6).cast("int").alias("flags"), number(x, 7).alias("vs"), number(x, 12).alias("ias"), more(x, "nav_altitude_mcp").try_cast("double").alias("mcp"), more(x, "flight").alias("callsign"),
    )
    rows = doc.select("icao", F.col("t").alias("typecode"), F.col("r").alias("registration"), F.explode(F.transform("trace", one)).alias("p")).select("icao", "typecode", "registration", "p.*")
    return rows.where("lat is not null and lon is not null and t is not null").withColumn("new_leg", F.col("flags").bitwiseAND(2) != 0).drop("flags")


def operator(callsign: Column) -> Column:
    """The three letters of an airline's callsign, which a digit follows; null for others."""
    s = F.upper(F.trim(callsign))
    return F.when(s.rlike("^[A-Z]{3}[0-9]"), F.substring(s, 1, 3))


def damaged(raw: DataFrame) -> DataFrame:
    return raw.where("damaged").select("member")
