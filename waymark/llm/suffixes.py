"""Suffix sorting of a whole corpus by the difference cover modulo 3, in DataFrame operations: every step is a sort or a join over all tasks.

A corpus is a table of symbols (row, pos, c; c from 1), one row a byte. Triples of symbols at places 1 and 2 modulo 3 are sorted and named by
their rank; where names repeat and don't cover DEPTH places yet, the names of each text, those at 1 first, are a text of their own, which is sorted by
recursion; the suffixes at 0 modulo 3 are sorted by their first symbol and the next suffix's name, and merged by counting the sampled ones below
them. Neighbours in that order are then compared on their first LENGTH bytes.

This is the plain form of repeats.py, which settles most places by hash before it sorts the rest: see the README for what this one moves. Nothing is
held by a task but a batch; the driver holds a number a partition.

Defined results: those of repeats.removed. Null ids and repeated rows are texts of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import common
from waymark.llm.repeats import LENGTH, united

PART = "shiftright(monotonically_increasing_id(), 33)"


def symbols(texts: DataFrame) -> DataFrame:
    """row, pos, c of texts (row, text)."""

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                for a in range(0, len(raw), 1 << 20):
                    c = raw[a : a + (1 << 20)].astype(np.int64) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), row)), pa.array(np.arange(a, a + len(c))), pa.array(c)], ["row", "pos", "c"])

    return common.bounded(texts).mapInArrow(run, "row long, pos long, c long")


def _placed(df: DataFrame, *keys: str) -> tuple[DataFrame, dict[int, int]]:
    """df in the order of keys over all partitions (settled), with part and its place there (at), and how many rows stand before each part."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).selectExpr("*", f"{PART} AS part", f"monotonically_increasing_id() - shiftleft({PART}, 33) AS at")
    rows = common.settled(rows, "order")
    before, total = {}, 0
    for r in rows.groupBy("part").count().orderBy("part").collect():
        before[r["part"]], total = total, total + r["count"]
    return rows, before


def _offset(before: dict[int, int]):
    parts = [x for p, n in before.items() for x in (F.lit(p), F.lit(n).cast("long"))]
    return F.element_at(F.create_map(*parts), F.col("part")) if parts else F.lit(0).cast("long")


def named(df: DataFrame, *keys: str) -> DataFrame:
    """df with name: the rank of its keys among all distinct ones, from 1."""
    order, before = _placed(df.select(*keys).distinct(), *keys)
    ranks = order.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col("at") + _offset(before) + 1).alias("name"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return df.join(ranks, same).drop(*(f"__{k}" for k in keys))


def _below(rest: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """row, pos, n of rest: how many of others have smaller keys."""
    both = rest.select(*keys, F.lit(0).alias("other"), "row", "pos").unionByName(others.select(*keys, F.lit(1).alias("other"), "row", "pos"))
    order, _ = _placed(both, *keys, "other")
    per = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.sum("other").alias("n")).collect()}
    ahead, total = {}, 0
    for p in sorted(per):
        ahead[p], total = total, total + per[p]
    df = order.select("part", "at", "other", "row", "pos").repartition("part").sortWithinPartitions("part", "at")

    def run(batches):
        part, n = None, 0
        for batch in batches:
            p, o = batch.column("part").to_numpy(), batch.column("other").to_numpy()
            out = np.empty(len(p), np.int64)
            starts = np.flatnonzero(np.concatenate([[p[0] != part], p[1:] != p[:-1]]))
            for a, b in zip([0, *starts[starts > 0]], [*starts[starts > 0], len(p)], strict=True):
                n = ahead[int(p[a])] if p[a] != part else n
                out[a:b], part = n + np.cumsum(o[a:b]), p[a]
                n = int(out[b - 1])
            keep = pa.array(o == 0)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep), batch.column("pos").filter(keep), pa.array(out).filter(keep)], ["row", "pos", "n"])

    return common.bounded(df).mapInArrow(run, "row long, pos long, n long")


def ranked(text: DataFrame, depth: int, covered: int = 1) -> DataFrame:
    """row, pos, name: the rank of each suffix of text (row, pos, c) by its first depth places at least; suffixes that agree on those may get equal ones."""
    ahead = text.select("row", F.explode(F.array(*(F.struct((F.col("pos") - k).alias("pos"), F.lit(k).alias("k")) for k in range(3)))).alias("x"), "c").select("row", "x.pos", "x.k", "c")
    three = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("c"))), F.lit(0)).cast("long").alias(f"t{k}") for k in range(3)]
    triples = common.settled(ahead.where("pos >= 0").groupBy("row", "pos").agg(*three).where("t0 > 0"), "triples")
    names = common.settled(named(triples.where("pos % 3 <> 0"), "t0", "t1", "t2"), "names")
    count = names.agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("top")).head()
    if count["n"] and count["top"] < count["n"] and covered * 3 < depth:
        half = triples.groupBy("row").agg(F.floor((F.max("pos") + 2) / 3).alias("half"))
        with_half = names.join(half, "row")
        inner = with_half.select("row", F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(F.col("half") + 1 + F.floor(F.col("pos") / 3)).alias("pos"), F.col("name").alias("c"))
        deep = ranked(common.settled(inner, "inner"), depth, covered * 3).join(half, "row")
        back = F.when(F.col("pos") < F.col("half"), F.col("pos") * 3 + 1).otherwise((F.col("pos") - F.col("half") - 1) * 3 + 2)
        names = common.settled(names.drop("name").join(deep.select("row", back.alias("pos"), "name"), ["row", "pos"]), "names")
    after = lambda k: names.select("row", (F.col("pos") - k).alias("pos"), F.col("name").alias(f"r{k}"))
    keyed = triples.select("row", "pos", "t0", "t1").join(after(1), ["row", "pos"], "left").join(after(2), ["row", "pos"], "left").na.fill(0, ["r1", "r2"])
    keyed = common.settled(keyed, "keyed")
    rest, one, two = (keyed.where(F.col("pos") % 3 == k) for k in range(3))
    below = _below(rest, one, "t0", "r1").union(_below(rest, two, "t0", "t1", "r2")).groupBy("row", "pos").agg(F.sum("n").alias("n"))
    first = rest.join(below, ["row", "pos"]).select("row", "pos", (2 * F.col("n") + 1).alias("a"), F.col("t0").alias("b"), F.col("r1").alias("d"))
    last = common.settled(_placed(names.select("row", "pos", "name"), "name")[0].drop("part", "at"), "sampled")
    order, before = _placed(last, "name")
    upto = order.withColumn("place", F.col("at") + _offset(before) + 1).groupBy("name").agg(F.max("place").alias("upto"))
    sampled = names.join(upto, "name").select("row", "pos", (2 * F.col("upto")).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("d"))
    return named(first.unionByName(sampled), "a", "b", "d").select("row", "pos", "name")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept: as repeats.removed, by sorting all suffixes."""
    slim = common.slim(docs, text_col, id_col)
    texts = common.settled(slim.select(F.col(f"`{id_col}`").alias("id"), "text", F.monotonically_increasing_id().alias("row")), "texts")
    order = ranked(common.settled(symbols(texts.select("row", "text")), "symbols"), length)

    def strings(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                for a in range(0, len(raw) - length + 1, 4096):
                    at = range(a, min(a + 4096, len(raw) - length + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(at)), pa.array(list(at)), pa.array([raw[p : p + length] for p in at], pa.binary())], ["row", "pos", "s"])

    whole = order.join(common.bounded(texts.select("row", "text")).mapInArrow(strings, "row long, pos long, s binary"), ["row", "pos"])
    sorted_, _ = _placed(whole, "name", "row", "pos")
    ends = sorted_.groupBy("part").agg(F.min_by("s", "at").alias("first"), F.max_by("s", "at").alias("last")).orderBy("part").collect()
    before = {int(b["part"]): bytes(a["last"]) for a, b in zip(ends, ends[1:], strict=False)}
    after = {int(a["part"]): bytes(b["first"]) for a, b in zip(ends, ends[1:], strict=False)}

    def adjacent(batches):
        held = None  # the last row of the batch before: part, row, pos, string, whether it met its like

        def closed(following):
            part, row, pos, s, met = held
            return (row, pos) if met or s == following else None

        for batch in batches:
            out = []
            for part, row, pos, s in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "pos", "s")), strict=True):
                if held is None or held[0] != part:
                    if held is not None and (x := closed(after.get(held[0]))):
                        out.append(x)
                    met = before.get(part) == s
                else:
                    met = held[3] == s
                    if x := closed(s):
                        out.append(x)
                held = (part, row, pos, s, met)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["row", "pos"])
        if held is not None and (x := closed(after.get(held[0]))):
            yield pa.RecordBatch.from_arrays([pa.array([x[0]]), pa.array([x[1]])], ["row", "pos"])

    hits = common.bounded(sorted_.select("part", "at", "row", "pos", "s").repartition("part").sortWithinPartitions("part", "at").drop("at")).mapInArrow(adjacent, "row long, pos long")
    starts = hits.groupBy("row").agg(F.collect_list("pos").alias("starts"))  # a text's own places
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                raw, a = text.encode(), np.array(at or [], np.int64)
                spans = united(np.stack([a, a + length], 1))
                edges = [0, *spans.ravel().tolist(), len(raw)]
                kept = b"".join(raw[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(spans), kept))
            if rows:
                n, gone, count, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return common.bounded(texts.join(starts, "row", "left").select("id", "text", "starts")).mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
