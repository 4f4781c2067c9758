"""Removal of byte strings that repeat: difference-cover suffix sorting of the places where repeats can start or end.

A string of LENGTH bytes that occurs twice has the same anchor in both places: of its hashes of K bytes, the least (ties all). So
a row for each anchor of a text (hash, hash of the bytes around it that any string with this anchor can cover) is dealt out by its hash.
Where the whole surroundings occur twice (by two 64-bit hashes, the anchor's and theirs), all of it is removed. Where only the anchor does (a repeat starts or ends nearby), the
surroundings are brought together, once for each distinct one, dealt by anchor, and sorted: the offsets that a string can have are
cut in ranges, pieces that don't share their range's core are set aside, equal pieces count as one, and the suffixes of the rest are sorted by a
difference cover modulo 3 (suffix_order: sampled triples are named, names are sorted by recursion until they cover LENGTH bytes, and
the remaining suffixes are merged). Adjacent suffixes that agree on LENGTH bytes, as bytes, mark repeats. Tasks hold pieces, not
texts; groups are sorted in runs of about POOL bytes. An anchor with PAIRS pieces at most has them compared two by two instead; one with more than
HOT has its strings counted by hash, so that no task holds them. Null ids and repeated rows are rows like others; a text's spans are found by its key.

Defined results: a null or empty text is no bytes. Texts shorter than LENGTH lose nothing. Texts of any length are read whole, in
overlapping segments. Of equal texts of LENGTH bytes or more nothing is left. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import common

LENGTH, K, SEGMENT, POOL = 200, 100, 1 << 20, 1_000_000
W = LENGTH - K + 1
#: Pieces of an anchor that are compared two by two, at most; pieces beyond which an anchor's strings are counted by hash; bytes of a run; parts of a join.
PAIRS, HOT, RUN, SALT = 40, 20_000, 8_000_000, 32
#: Offsets (anchor's place less string's start) in ranges, first and last + 1.
RANGES = tuple((first, min(first + 5, W) if first < W - 6 else W) for first in range(0, W - 1, 5))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {x: np.cumprod(np.full(SEGMENT + 4 * LENGTH + 1, x, np.uint64)) for x in (_BASE, _INVERSE)}
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(256)], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any stretch of a segment of bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _POWERS[_BASE][: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _stirred((self.sums[end] - self.sums[start]) * _POWERS[_INVERSE][start])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each width values in a row."""
    n = len(x)
    filled = np.full(-(-n // width) * width, x[-1], x.dtype)
    filled[:n] = x
    blocks = filled.reshape(-1, width)
    front = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], front[width - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's bytes: places of anchors, hash of each, hash of its surroundings."""
    n, found = len(data), []
    if n < LENGTH:
        return (np.empty(0, np.int64),) + (np.empty(0, np.uint64),) * 2
    for start in range(0, n, SEGMENT):
        lo, hi = max(0, start - 2 * LENGTH), min(n, start + SEGMENT + 2 * LENGTH)
        if hi - lo < LENGTH:
            continue
        hashes = Hashes(data[lo:hi])
        at = np.arange(hi - lo - K + 1)
        h = hashes(at, at + K)
        low = sliding(h, W, np.minimum)
        pad = np.zeros(W - 1, np.uint64)
        best = sliding(np.concatenate([pad, low, pad]), W, np.maximum)
        place = np.flatnonzero(best == h)
        place = place[(place + lo >= start) & (place + lo < start + SEGMENT)]
        left, right = np.maximum(place - (W - 1), 0), np.minimum(place + LENGTH, hi - lo)
        around = hashes(left, right) + (place - left).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (right - place).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        found.append((place + lo, h[place], around))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def united(spans: np.ndarray) -> np.ndarray:
    """Spans (rows of start, end) joined where they overlap or touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], ends[np.append(first[1:], len(spans)) - 1]], 1)


def surroundings(place: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.maximum(place - (W - 1), 0), np.minimum(place + LENGTH, n)], 1)


def suffix_order(text: np.ndarray, depth: int, covered: int = 1) -> np.ndarray:
    """Rank of each suffix of text (whole numbers from 1, then three zeros) by its first depth places at least; suffixes that agree on those
    may get equal ranks. covered: how many of the caller's places one number stands for.

    Suffixes at places 1 and 2 modulo 3 are named by triples; if names repeat and don't cover depth, the names are sorted by recursion.
    Those at 0 modulo 3 are sorted by first number and the next suffix's rank, and merged by counting the sampled ones below."""
    n = len(text) - 3
    if n <= 0:
        return np.zeros(0, np.int64)
    places = np.concatenate([np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)])
    top = int(text.max()) + 1
    wide = top**3 < 2**62
    if wide:
        key = (text[places] * top + text[places + 1]) * top + text[np.minimum(places + 2, n + 2)]
        names = np.unique(key, return_inverse=True)[1] + 1
    else:
        order = np.lexsort((text[np.minimum(places + 2, n + 2)], text[places + 1], text[places]))
        rows = np.stack([text[places], text[places + 1], text[np.minimum(places + 2, n + 2)]], 1)[order]
        names = np.empty(len(places), np.int64)
        names[order] = np.concatenate([[1], 1 + np.cumsum((rows[1:] != rows[:-1]).any(1))])
    if len(names) and names.max() < len(names) and covered * 3 < depth:
        inner = np.zeros(len(names) + 3, np.int64)
        inner[: len(names)] = names
        names = suffix_order(inner, depth, covered * 3)
    rank = np.zeros(n + 4, np.int64)
    rank[places] = names
    rest = np.arange(0, n, 3)
    big = len(names) + 2
    one, two = places[places % 3 == 1], places[places % 3 == 2]
    first = lambda p: text[p] * big + rank[p + 1]
    second = lambda p: (text[p] * top + text[p + 1]) * big + rank[p + 2]
    if top * top * big >= 2**62:
        pairs = np.unique(text[:-1] * top + text[1:], return_inverse=True)[1]
        second = lambda p: pairs[p] * big + rank[p + 2]
    key0, keys1, keys2 = first(rest), np.sort(first(one)), np.sort(second(two))
    firsts, group = np.unique(key0, return_inverse=True)
    lead = np.zeros(len(firsts), np.int64)
    lead[group] = np.arange(len(rest))
    below = np.searchsorted(keys1, firsts) + np.searchsorted(keys2, second(rest[lead]))
    # A rank for all: twice the sampled ones below, odd for the others, then their own order.
    sampled = np.sort(names)
    out = np.empty((n + 1, 2), np.int64)
    out[rest] = np.stack([2 * below[group] + 1, group], 1)
    out[places] = np.stack([2 * np.searchsorted(sampled, names, side="right"), np.zeros(len(places), np.int64)], 1)
    return np.unique((out[:n, 0] * (len(firsts) + 1)) + out[:n, 1], return_inverse=True)[1] + 1


def repeated_offsets(group: np.ndarray, pieces: list[bytes], left: np.ndarray) -> list[np.ndarray]:
    """For each piece (bytes around an anchor, the anchor at left) the offsets of strings that another piece of its group has too, at the same offset."""
    out: list[list[np.ndarray]] = [[] for _ in pieces]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for first, last in RANGES:
        offset = np.arange(first, last)
        core_at = left - first
        usable = np.flatnonzero((core_at >= 0) & (left - last + 1 + LENGTH <= sizes))
        cores: dict[tuple, list[int]] = {}
        for i in usable.tolist():
            core = pieces[i][core_at[i] : left[i] - last + 1 + LENGTH]
            cores.setdefault((group[i], core), []).append(i)
        pool, total = [], 0
        for members in cores.values():
            if len(members) < 2:
                continue
            same: dict[bytes, list[int]] = {}
            for i in members:
                whole = left[i] - last + 1 >= 0 and left[i] - first + LENGTH <= sizes[i]
                same.setdefault(pieces[i][left[i] - last + 1 : left[i] - first + LENGTH] if whole else i, []).append(i)
            for equal in same.values():
                if len(equal) > 1:
                    for i in equal:
                        out[i].append(offset)
            if len(same) > 1:
                pool.append([equal[0] for equal in same.values()])
                total += len(same) * (LENGTH + last - first)
            if total > POOL:
                _sorted_run(pool, pieces, left, sizes, offset, out)
                pool, total = [], 0
        if pool:
            _sorted_run(pool, pieces, left, sizes, offset, out)
    return [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in out]


def _sorted_run(pool: list[list[int]], pieces, left, sizes, offset, out) -> None:
    members = np.concatenate([np.array(m) for m in pool])
    groups = np.repeat(np.arange(len(pool)), [len(m) for m in pool])
    width = LENGTH + len(offset) - 1
    start = left[members] - offset[-1]
    text = np.zeros((len(members), width + 1), np.int64)
    for row, (i, s) in enumerate(zip(members.tolist(), start.tolist(), strict=True)):
        piece = np.frombuffer(pieces[i], np.uint8)[max(s, 0) : s + width]
        text[row, max(-s, 0) : max(-s, 0) + len(piece)] = piece.astype(np.int64) + 2
    text[:, -1] = 1
    text[text == 0] = 1
    flat = np.concatenate([text.ravel(), np.zeros(3, np.int64)])
    rank = suffix_order(flat, LENGTH)
    row, shift = np.divmod(np.arange(len(members) * len(offset)), len(offset))
    begin = start[row] + shift
    valid = (begin >= 0) & (begin + LENGTH <= sizes[members[row]])
    row, shift = row[valid], shift[valid]
    at = row * (width + 1) + shift
    order = np.lexsort((rank[at], shift, groups[row]))
    row, shift, at = row[order], shift[order], at[order]
    near = (groups[row[1:]] == groups[row[:-1]]) & (shift[1:] == shift[:-1])
    same = np.zeros(len(near), bool)
    span = np.arange(LENGTH)
    for i in range(0, len(near), 20_000):
        part = np.flatnonzero(near[i : i + 20_000]) + i
        same[part] = (flat[at[part][:, None] + span] == flat[at[part + 1][:, None] + span]).all(1)
    hit = np.zeros(len(row), bool)
    hit[1:] |= same
    hit[:-1] |= same
    for r, s in zip(row[hit].tolist(), shift[hit].tolist(), strict=True):
        out[members[r]].append(np.array([offset[-1] - s]))


def pair_spans(place: np.ndarray, pieces: list[bytes], left: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (a, b) of pieces around the same anchor: the pieces that share a string at the same offset (places in the list), and the spans of
    all such strings: from the anchor, both are followed to the left and to the right as far as they agree."""
    width = W - 1 + LENGTH
    grid = np.zeros((len(pieces), width), np.int16)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16) + 1
    row = np.repeat(np.arange(len(pieces)), lens)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(W - 1 - left, lens)] = flat
    which, spans = [], []
    for i in range(0, len(a), 20_000):
        p, q = a[i : i + 20_000], b[i : i + 20_000]
        other = (grid[p] != grid[q]) | (grid[p] == 0)
        back, ahead = other[:, : W - 1][:, ::-1], other[:, W - 1 :]
        before = np.where(back.any(1), back.argmax(1), W - 1)
        after = np.where(ahead.any(1), ahead.argmax(1), LENGTH)
        hit = np.flatnonzero(before + after >= LENGTH)
        for side in (p[hit], q[hit]):
            which.append(side)
            spans.append(np.stack([place[side] - before[hit], place[side] + after[hit]], 1))
    return (np.concatenate(which), np.concatenate(spans)) if which else (np.empty(0, np.int64), np.empty((0, 2), np.int64))


def _key():
    return F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key) of each text, and for each key that has any, spans: a flat array of starts and ends of what is to be removed, joined."""
    df = common.slim(docs, text_col, id_col).withColumnRenamed(id_col, "id").withColumn("key", _key())
    where = common.settled(df.select("id", "key"), "keys")

    def make():
        def step(batch):
            for part in common.pieces(batch, 8_000_000):
                columns = [[] for _ in range(6)]
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    place, h, around = anchors(data)
                    if not len(place):
                        continue
                    _, first, back, times = np.unique(np.stack([h, around], 1), axis=0, return_index=True, return_inverse=True, return_counts=True) if len(np.unique(around)) < len(around) else (None, np.arange(len(h)), None, np.ones(len(h), np.int64))
                    spans: list = [None] * len(first)
                    if back is not None:
                        by = np.argsort(back.ravel(), kind="stable")
                        ends = np.cumsum(times)
                        for i in np.flatnonzero(times > 1).tolist():
                            spans[i] = united(surroundings(place[by[ends[i] - times[i] : ends[i]]], len(data))).ravel().astype(np.int32)
                    lo_hi = surroundings(place[first], len(data))
                    for column, value in zip(columns, (h[first].view(np.int64), around[first].view(np.int64), place[first], times, lo_hi[:, 0], lo_hi[:, 1]), strict=True):
                        column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c[-1]) for c in columns] + [pa.array([key] * len(first)), pa.array(spans, pa.list_(pa.int32()))], ["h", "c", "place", "times", "lo", "hi", "key", "spans"])

        return step

    rows = common.arrow_map(df.select("key", "text"), make, "h long, c long, place long, times long, lo long, hi long, key string, spans array<int>")
    by_h, by_c = Window.partitionBy("h"), Window.partitionBy("h", "c")
    rows = rows.repartition("h").withColumn("n_c", F.sum("times").over(by_c)).withColumn("n_h", F.sum("times").over(by_h)).where("n_h > 1")
    rows = rows.withColumn("edges", F.min("n_c").over(by_h) == 1).withColumn("turn", F.row_number().over(by_c.orderBy("key", "place")))
    rows = common.settled(rows.where("n_c > 1 or edges").select("h", "c", "key", "place", "lo", "hi", "spans", (F.col("n_c") > 1).alias("inner"), (F.col("edges") & (F.col("turn") == 1)).alias("shown")), "anchors")
    inner = rows.where("inner and hi - lo >= %d" % LENGTH).select("key", F.coalesce("spans", F.array(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("spans")).distinct()
    # The surroundings of undecided anchors, cut from one text of each key.
    firsts = where.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("lacks"), "id")).alias("first"))
    undecided = rows.where("shown")
    many = common.settled(undecided.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("h"), "hot-anchors")
    marked = undecided.join(many.withColumn("hot", F.lit(True)), "h", "left").na.fill(False, ["hot"])
    asked = marked.groupBy("key").agg(F.collect_list(F.struct("h", "inner", "place", "lo", "hi", "hot")).alias("asked")).join(firsts, "key").select(F.col("first.id").alias("__id"), F.col("key").alias("__key"), "asked")
    texts = df.join(asked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).dropDuplicates(["key"]).select("key", "text", "asked")

    def cut(batches):
        for batch in batches:
            for key, text, list_ in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "asked")), strict=True):
                raw = text.encode()
                names = ["h", "key", "inner", "place", "bytes", "left_n", "hot"]
                yield pa.RecordBatch.from_arrays([pa.array([x["h"] for x in list_], pa.int64()), pa.array([key] * len(list_)), pa.array([x["inner"] for x in list_]), pa.array([x["place"] for x in list_], pa.int64()), pa.array([raw[x["lo"] : x["hi"]] for x in list_], pa.binary()), pa.array([x["place"] - x["lo"] for x in list_], pa.int64()), pa.array([x["hot"] for x in list_])], names)

    around = common.bounded(texts).mapInArrow(cut, "h long, key string, inner boolean, place long, bytes binary, left_n long, hot boolean")
    if many.head(1):
        around = common.settled(around, "around")
    few = around.where("not hot").repartition("h").sortWithinPartitions("h")
    outer = common.bounded(few).mapInArrow(_settle_few, "key string, spans array<int>")
    if many.head(1):
        outer = outer.union(_counted_strings(around.where("hot and not inner"), around.where("hot")))
    return where, common.settled(inner.union(outer).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def _settle_few(batches):
    """Spans of the strings that pieces share with others of their anchor; whole anchors at a time, in runs of about RUN bytes. An anchor has HOT pieces at most."""
    held: list[pa.RecordBatch] = []
    total = 0

    def decided(table: pa.Table):
        h, pieces = table.column("h").to_numpy(), table.column("bytes").to_pylist()
        place, left = table.column("place").to_numpy(), table.column("left_n").to_numpy()
        keys, inside = table.column("key").to_pylist(), table.column("inner").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(starts, append=len(h))
        out_keys, out_spans = [], []
        pairs = [(np.repeat(starts[sizes == n], n * (n - 1) // 2) + np.tile(i, (sizes == n).sum()), np.repeat(starts[sizes == n], n * (n - 1) // 2) + np.tile(j, (sizes == n).sum())) for n in range(2, PAIRS + 1) for i, j in [np.triu_indices(n, 1)]]
        which, spans = pair_spans(place, pieces, left, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
        open_ = ~inside[which]
        for i, span in zip(which[open_].tolist(), spans[open_].astype(np.int32), strict=True):
            out_keys.append(keys[i])
            out_spans.append(span)
        large = np.flatnonzero(np.repeat(sizes > PAIRS, sizes))
        hits = repeated_offsets(h[large], [pieces[i] for i in large], left[large])
        for i, offsets in zip(large.tolist(), hits, strict=True):
            if len(offsets) and not inside[i]:
                out_keys.append(keys[i])
                out_spans.append(united(np.stack([place[i] - offsets, place[i] - offsets + LENGTH], 1)).ravel().astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(out_keys, pa.string()), pa.array(out_spans, pa.list_(pa.int32()))], ["key", "spans"])

    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total > RUN:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if whole:
                yield decided(table.slice(0, whole))
            held, total = table.slice(whole).combine_chunks().to_batches(), 0 if whole else -RUN
    if held:
        yield decided(pa.Table.from_batches(held))


def _counted_strings(open_: DataFrame, every: DataFrame) -> DataFrame:
    """key and spans of the repeated strings around anchors with very many pieces: each string of a piece is a row (its anchor, its hash, its place), counted
    with partial sums, and found again by parts, so that no task holds an anchor's pieces. open_: pieces to settle; every: all pieces."""

    def strings(batches):
        for batch in batches:
            for h, key, place, piece, left in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "place", "bytes", "left_n")), strict=True):
                at = np.arange(max(len(piece) - LENGTH + 1, 0))
                at = at[(at <= left) & (at + LENGTH >= left + K)]
                if len(at):
                    s = Hashes(np.frombuffer(piece, np.uint8))(at, at + LENGTH)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(s.view(np.int64)), pa.array([key] * len(at)), pa.array(place - left + at), pa.array(left - at)], ["h", "s", "key", "start", "o"])

    shape = "h long, s long, key string, start long, o long"
    repeated = common.bounded(every).mapInArrow(strings, shape).groupBy("h", "o", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "o", "s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    mine = common.bounded(open_).mapInArrow(strings, shape).withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALT)).cast("int"))
    found_ = mine.join(repeated, ["h", "o", "s", "salt"], "left_semi")
    return found_.select("key", F.array(F.col("start").cast("int"), (F.col("start") + LENGTH).cast("int")).alias("spans"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) for each row."""
    _, spans = found(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    df = common.slim(docs, text_col, id_col).withColumnRenamed(id_col, "id").withColumn("key", _key()).join(spans, "key", "left").select("id", "text", "spans")

    def make():
        def step(batch):
            for part in common.pieces(batch):
                rows = []
                for text, flat in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw = text.encode()
                    spans = united(np.array(flat or [], np.int64).reshape(-1, 2))
                    edges = [0, *spans.ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(raw), len(raw) - len(kept), len(spans), kept))
                n, gone, count, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

        return step

    return common.arrow_map(df, make, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return removed(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
