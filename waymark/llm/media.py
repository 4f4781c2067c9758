"""Content-addressed media: payloads as PNG members of tar shards in shared storage, rows with digest, shard, offset and length.

A payload (here a text's UTF-8 bytes, then zero bytes up to a positive multiple of ROW) is stored as an 8-bit grey PNG image, ROW
samples a line, which is lossless. Each task writes its own shards under names that no other attempt uses, and keeps a digest at
most once; the index rows name shard, offset and length. Lost or repeated attempts leave shards that no index row names. A shard is
closed beyond SHARD_BYTES, so a task holds one member and an open file. headers() reads only the first HEAD bytes of a member for its
metadata, and described() fills the index with it; contents() reads whole members and computes what depends on the samples. Both read each distinct member once a task.

Defined results: a null or empty text has a payload of ROW zero bytes. Texts of any length are stored whole, in one member. Equal
texts share a member in each shard, and have equal values in every column but the shard and offset. Empty tables give an empty index.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import common

ROW, HEAD, SHARD_BYTES, LEVEL = 64, 33, 64_000_000, 6
_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """An 8-bit grey image, ROW wide; each line has filter type 0."""
    lines = len(payload) // ROW
    grid = np.zeros((lines, ROW + 1), np.uint8)
    grid[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, ROW)
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, lines, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(grid.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    """Width, height, bit depth and colour type, from the first HEAD bytes; raises if they are no sound PNG header."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    return dict(zip(("width", "height", "bit_depth", "colour"), struct.unpack(">IIBB", head[16:26]), strict=True))


def samples(media: bytes) -> bytes:
    """The samples of an image that png() made."""
    size, at, data = png_header(media[:HEAD]), 8, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(size["height"], size["width"] + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Lines, mean and deviation of the samples, and the shares (in 1/255) of 16 equal ranges of their values, as hex."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 4, minlength=16)
    return f"{len(x) // ROW}:{x.mean():.4f}:{x.std():.4f}:{(counts * 255 // len(x)).astype(np.uint8).tobytes().hex()}"


class Shards:
    """Writes members to tar files in a folder, one open at a time."""

    def __init__(self, folder: str):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.out = self.tar = None
        self.at: dict[bytes, tuple[str, int, int]] = {}

    def put(self, digest: bytes, make) -> tuple[str, int, int]:
        if found := self.at.get(digest):
            return found
        if self.tar is None:
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
            self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)
        media = make()
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        place = self.at[digest] = (self.name, self.tar.offset + 512, len(media))
        self.tar.addfile(info, io.BytesIO(media))
        if self.tar.offset > SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.out.close()
            self.out = self.tar = None


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The index of the shards it writes: id_col, n_bytes, payload_bytes, digest (hex SHA-256 of the payload), folder, shard, offset, length."""
    spark = docs.sparkSession
    folder = folder or f"{common.shared_dir(spark)}/waymark-media-{uuid.uuid4().hex}"
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    df = common.slim(docs, text_col, id_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        shards = Shards(folder)
        try:
            for batch in batches:
                rows = []
                for text in batch.column("text"):
                    payload = padded(raw := text.as_py().encode())
                    digest = hashlib.sha256(payload).digest()
                    rows.append((len(raw), len(payload), digest.hex(), folder, *shards.put(digest, lambda p=payload: png(p))))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, zip(*rows, strict=True))], [id_col, "n_bytes", "payload_bytes", "digest", "folder", "shard", "offset", "length"])
        finally:
            shards.close()

    return common.settled(common.bounded(df).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, digest string, folder string, shard string, offset long, length long"), "media-index")


def _read(index: DataFrame, id_col: str, keep: list[str], names: list[str], schema: str, look) -> DataFrame:
    """For each row keep and look(read), where read(n) gives the first n bytes of its member; rows of a shard are read by one task."""
    tasks = max(1, min(20_000, index.select("shard").distinct().count()))
    df = index.select(F.col(f"`{id_col}`"), *keep, *(c for c in ("folder", "shard", "offset", "length") if c not in keep)).repartition(tasks, "shard").sortWithinPartitions("shard", "offset")

    def run(batches):
        name, file, last, found = None, None, None, None
        for batch in batches:
            rows = []
            for folder, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("folder", "shard", "offset", "length")), strict=True):
                if (folder, shard) != name:
                    if file:
                        file.close()
                    where, path = fs.FileSystem.from_uri(folder)
                    file, name, last = where.open_input_file(f"{path}/{shard}"), (folder, shard), None
                if offset != last:
                    found, last = look(lambda n, f=file, at=offset, size=length: f.read_at(min(n, size), at)), offset
                rows.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in (id_col, *keep)] + list(map(pa.array, zip(*rows, strict=True))), [id_col, *keep, *names])
        if file:
            file.close()

    kinds = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return common.bounded(df).mapInArrow(run, f"{kinds}, {schema}")


def headers(index: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("digest",)) -> DataFrame:
    """id_col, keep, width, height, bit_depth, read from the header alone."""

    def look(read):
        head = png_header(read(HEAD))
        return head["width"], head["height"], head["bit_depth"]

    return _read(index, id_col, list(keep), ["width", "height", "bit_depth"], "width long, height long, bit_depth long", look)


def described(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The index with width, height and bit_depth, each from the first HEAD bytes of its member."""
    return headers(index, id_col, tuple(c for c in index.columns if c != id_col))


def contents(index: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """id_col, keep and what the stored samples give: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def look(read):
        payload = samples(media := read(1 << 62))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return _read(index, id_col, list(keep), names, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", look)


def restored(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and text: the first n_bytes of each payload, read back."""

    def look(read):
        return (samples(read(1 << 62)),)

    return _read(index, id_col, ["n_bytes"], ["payload"], "payload binary", look).select(id_col, F.expr("decode(substring(payload, 1, int(n_bytes)), 'UTF-8')").alias("text"))
