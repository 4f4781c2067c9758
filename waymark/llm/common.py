"""What the operators of this folder share: reading, shared storage, batches for Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in every contract of this folder: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests (where it is unset) a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Bytes of a row group of settled files: what one task can read, however few files there are.
ROW_GROUP = 16 << 20
#: What a write has shuffled is deleted when it is done, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, label: str = "step", group_rows: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors. group_rows: rows of a row group at
    most, for rows of megabytes."""
    path = f"{shared_dir(df.sparkSession)}/waymark-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    conf, was = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a settled frame that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("waymark-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slim(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """Only the columns an operator needs, the text never null; other columns, whatever their names, stay behind."""
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a 64-bit hash of the text) and text, never null: what finds a row's text again where ids are null or repeat."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


#: Bounds of an Arrow batch: texts can be long, and a few hundred of them are enough to keep a worker busy.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session gives Python workers batches of bounded rows and bytes. A bound that the user has set stays."""
    for name, default, most in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        conf, key = df.sparkSession.conf, f"spark.sql.execution.arrow.{name}"
        if conf.get(key, default) in (default, None, "-1") or key.endswith("Bytes") and int(conf.get(key)) > most:
            conf.set(key, str(most))
    return df


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df (settled), marked for broadcast if it has at most so many rows; otherwise the join is left to the optimizer."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).collect()) <= most else df


def arrow_map(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow, where make() is called once in each task and gives the function from batch to batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return bounded(df).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most_bytes: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about most_bytes of text, so that long texts don't add up in memory."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def hex_sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
