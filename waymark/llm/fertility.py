"""Quality rules by tokeniser fertility: how a public vocabulary cuts a text's words, against bands by language or script.

Each word (a run without space, \\t, \\n, \\v, \\f, \\r) is cut by a public sentencepiece vocabulary with byte fallback. Of a text are
measured: code points per token, the share of byte-fallback tokens, and the entropy of its tokens as a share of the most that as
many tokens can have. For each language (or, where it is null or not given, script) a histogram over all texts of fixed bins gives quartiles;
a text is rejected where a measure is outside the quartiles by more than FENCE times their distance, widened for short texts by
1 + SHORT / sqrt(tokens). Base rules come first: too few words, or too many words in repeated windows of five.

Defined results: a null, empty or blank text has no words, zero measures and fails the base rules. Texts of any length are measured
whole. Equal rows get equal verdicts, each its own row. In an empty table there are no bands. Where a measure's quartiles meet, their distance counts as
LEAST. Other columns are neither read nor changed.
"""

from __future__ import annotations

import functools
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from waymark.llm import common

#: Bins of a measure in its histogram: name, bins a unit, least distance of quartiles in bins.
MEASURES = (("m_chars", 400, 12), ("m_bytes", 400, 8), ("m_entropy", 400, 12))
FENCE, SHORT, MEMO = 2.5, 10.0, 400_000
#: Ranges of code points by script, for texts without a language.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, m_chars double, m_bytes double, m_entropy double, script string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words in windows of so many words that occur twice or more; ids: a number for each word, equal for equal words."""
    if len(ids) <= width:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    x ^= x >> np.uint64(32)
    n = len(ids) - width + 1
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key ^ (key >> np.uint64(29))) * _MIX[1 + i % 4] + x[i : i + n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = [(int(((points >= lo) & (points <= hi)).sum()), name) for name, lo, hi in SCRIPTS]
    return max(counts, key=lambda x: x[0])[1] if any(n for n, _ in counts) else "none"


class Meter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)
        self.reset()

    def reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.start, self.count, self.bytes_in = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.int32), 0

    def learn(self, words: list[bytes]) -> None:
        first, n = len(self.memo), len(words)
        while first + n > len(self.start):
            self.start, self.count, self.bytes_in = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.bytes_in))
        cut = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        counts = np.fromiter(map(len, cut), np.int64, n)
        flat = np.fromiter((t for c in cut for t in c), np.int32, int(counts.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        self.start[first : first + n] = self.used + ends - counts
        self.count[first : first + n] = counts
        self.bytes_in[first : first + n] = total[ends] - total[ends - counts]
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.memo.update(zip(words, range(first, first + n), strict=True))

    def row(self, text: str, with_script: bool) -> tuple:
        raw = text.encode()
        words = raw.split()
        if len(self.memo) > MEMO:
            self.reset()
        if new := set(words).difference(self.memo):
            self.learn(list(new))
        ids = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        seen, times = np.unique(ids, return_counts=True)
        counts = self.count[seen]
        n_tokens, n_byte = int((counts * times).sum()), int((self.bytes_in[seen] * times).sum())
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        entropy = 0.0
        if n_tokens > 1:
            at = np.repeat(self.start[seen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            weight = np.bincount(self.flat[at], np.repeat(times, counts))
            p = weight[weight > 0] / n_tokens
            entropy = float(-(p * np.log2(p)).sum() / np.log2(n_tokens))
        lines = Counter(filter(bytes.strip, raw.split(b"\n"))) if b"\n" in raw else {}
        script = script_of(text) if with_script else None
        return len(words), chars, sum(map(text.count, "#*$%&|<>")), sum(lines.values()) - len(lines), repeated_words(ids), n_tokens, n_byte, chars / max(n_tokens, 1), n_byte / max(n_tokens, 1), entropy, script


@functools.lru_cache(maxsize=2)
def meter(path: str) -> Meter:
    return Meter(path)


def measured(df: DataFrame, text_col: str = "text", lang_col: str | None = None, vocabulary: str | None = None, prefix: str = "") -> DataFrame:
    """df and the columns of SCHEMA, their names after prefix."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    schema = StructType([*df.schema.fields, *(StructField(prefix + f.name, f.dataType) for f in StructType.fromDDL(SCHEMA))])

    def make():
        own = meter(path)

        def step(batch: pa.RecordBatch):
            for part in common.pieces(batch.set_column(batch.schema.get_field_index(text_col), text_col, batch.column(text_col).fill_null("")), column=text_col):
                langs = part.column(lang_col).is_null().to_pylist() if lang_col else repeat(True, part.num_rows)
                rows = [own.row(text, no_lang) for text, no_lang in zip(part.column(text_col).to_pylist(), langs, strict=True)]
                kinds = [pa.int64()] * 7 + [pa.float64()] * 3 + [pa.string()]
                new = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(prefix + x for x in NAMES)])

        return step

    return common.arrow_map(df, make, schema)


def bands(rows: DataFrame, key: Column) -> DataFrame:
    """key, and lo_ and hi_ of each measure, in its unit, from texts with at least ten words: the quartiles and FENCE distances beyond. One row a key."""
    cells = (
        rows.where("n_words >= 10")
        .select(key.alias("key"), F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.floor(F.col(name) * k).alias("bin")) for i, (name, k, _) in enumerate(MEASURES)))).alias("x"))
        .groupBy("key", "x.m", "x.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy("key", "m")
    ranked = cells.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    quart = ranked.groupBy("key", "m").agg(F.min(F.when(F.col("below") * 4 >= F.col("total"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("below") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"))
    out = []
    for i, (name, k, least) in enumerate(MEASURES):
        mine = lambda x, i=i: F.max(F.when(F.col("m") == i, x))
        out += [mine(F.col("q1") / k).alias(f"q1_{name}"), mine((F.col("q3") + 1) / k).alias(f"q3_{name}"), mine(F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) / k).alias(f"d_{name}")]
    return quart.groupBy("key").agg(*out)


def judged(rows: DataFrame, key: Column, min_words: int = 10, max_repeat: int = 20, fence: float = FENCE) -> DataFrame:
    """rows (settled, as they are read twice), with base_failed, kept and reason."""
    wide = fence * (1 + SHORT / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    outside = []
    for name, *_ in MEASURES:
        low, high = F.col(name) < F.col(f"q1_{name}") - wide * F.col(f"d_{name}"), F.col(name) > F.col(f"q3_{name}") + wide * F.col(f"d_{name}")
        outside.append(F.when(F.coalesce(high | low if name != "m_bytes" else high, F.lit(False)), name))
    named = rows.withColumn("__key", key)
    limits = common.small(common.settled(bands(rows, key).withColumnRenamed("key", "__band"), "bands"))
    out = named.join(limits, F.col("__key").eqNullSafe(F.col("__band")), "left")
    out = out.withColumn("base_failed", failed).withColumn("reason", F.when(failed, "base").otherwise(F.coalesce(*outside)))
    return out.withColumn("kept", F.col("reason").isNull()).select(*rows.columns, "base_failed", "kept", "reason")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """id_col, the measures, base_failed, kept and reason; one row for each of docs."""
    lang = [F.col(lang_col).cast("string").alias("lang")] if lang_col else []
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *lang)
    rows = common.settled(measured(df, "text", "lang" if lang else None, vocabulary).drop("text"), "fertility")
    key = F.coalesce(F.col("lang"), F.concat(F.lit("script "), F.col("script"))) if lang else F.col("script")
    return judged(rows, key).withColumnRenamed("id", id_col)


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """The rows of docs that are kept, with their own columns; the measured rows, text included, stand once in shared storage meanwhile."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    thin = measured(df, "text", "lang", vocabulary).drop("text")
    rows = common.settled(thin, "fertility")
    key = F.coalesce(F.col("lang"), F.concat(F.lit("script "), F.col("script")))
    return judged(rows, key).where("kept").select("row.*")
