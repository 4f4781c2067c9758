"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The VOCAB commonest training tokens, and one tail class for all others, are the leaves of a tree of classes with WAYS children each,
built from the counts (a Huffman tree, so that common tokens have few factors). The probability of a token is the product of a softmax
at each class on its path, over the class's children; in the tail it is the smoothed share of the token's count. Features of a softmax
are hashed rows of weights, by the class and the token before, the class and the token before that (a skip), and the class and both;
context tokens outside the vocabulary are one. Without features a softmax is that of the counts.

Training is by distributed gradient updates: in each of EPOCHS every task takes adaptive steps over all positions of all its training
texts, from the common weights; the tasks' changes are averaged row by row, each by how often the task has met the row, so that
a row that one task has met moves as far as there. Averages are sums by slice, which stream.

Texts are tokenised once, into chunks of about CHUNK tokens in shared storage: the distinct tokens' hashes, and their places by position.
Counts are of all training texts, exact, by 64-bit hash. Texts are scored in batches of sparse features in numpy; counts of tokens
outside the vocabulary come from a join by hash of each chunk's distinct ones. What a task holds is a chunk and the model,
whatever the corpus; nothing but the vocabulary and the weights reaches the driver.

Defined results: a null or empty text is one token, the end. Texts of any length are scored whole. Equal texts have equal scores. With no training
texts N and V are 0 and the base score of a token is log10(0.5 / 0.5). Null ids and repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import common
from waymark.llm.toxicity import remainder

#: Children of a class; tokens in the tree; rows of weights by token before, by the one before that, and by both.
WAYS, VOCAB, ROWS = 16, 65_535, (1 << 17, 1 << 16, 1 << 18)
EPOCHS, RATE, START, BATCH = 1, 1.0, 0.5, 1 << 14
#: Tokens of a chunk; rows of a slice of the weights; training tasks a core.
CHUNK, SLICE, TASKS = 1 << 19, 1 << 14, 2
#: Rows of weights in a row that the driver reads.
SENT = 1 << 12
MEMO = 600_000
END = b"\n"
_ODD, _K1, _K2, _K3 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))


class Tokens:
    """Hashes of a text's words, ASCII lower case, then the end's."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.hash, self.memo, self.end = xxh3_64_intdigest, {}, xxh3_64_intdigest(END)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if len(self.memo) > MEMO:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = self.hash(w)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        out[-1] = self.end
        return out


def chunked(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Chunks of texts (settled): chunk, ids, train, lens (int32 each), hashes (uint64, distinct, sorted), codes (int32, a place in hashes for each
    position), counts (int32, how often each stands in training texts). A text is whole in its chunk."""
    df = common.slim(docs.withColumn("__train", F.coalesce(train, F.lit(False))), text_col, id_col, "__train")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["chunk", "ids", "train", "lens", "hashes", "codes", "counts"]

    def run(batches):
        tokens, base, k = Tokens(), TaskContext.get().partitionId() << 32, 0
        ids, flags, held, total = [], [], [], 0

        def row():
            lens = np.array([len(h) for h in held], np.int32)
            train_at = np.concatenate(flags)
            hashes, codes = np.unique(np.concatenate(held), return_inverse=True)
            counts = np.bincount(codes[np.repeat(train_at, lens)], minlength=len(hashes)).astype(np.int32)
            every = pa.concat_arrays(ids)
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            raw = lambda x: pa.array([x.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([base + k]), lists(every), lists(pa.array(train_at)), raw(lens), raw(hashes), raw(codes.astype(np.int32)), raw(counts)], names)

        for batch in batches:
            for part in common.pieces(batch):
                first, texts = 0, part.column("text").to_pylist()
                for i, text in enumerate(texts):
                    held.append(tokens(text))
                    total += len(held[-1])
                    if total >= CHUNK or i == len(texts) - 1:
                        ids.append(part.column(id_col).slice(first, i + 1 - first))
                        flags.append(part.column("__train").slice(first, i + 1 - first).to_numpy(zero_copy_only=False).astype(bool))
                        first = i + 1
                    if total >= CHUNK:
                        yield row()
                        ids, flags, held, total, k = [], [], [], 0, k + 1
        if held:
            yield row()

    return common.settled(common.bounded(df).mapInArrow(run, f"chunk long, ids array<{kind}>, train array<boolean>, lens binary, hashes binary, codes binary, counts binary"), "chunks", 8)


def counted(chunks: DataFrame) -> DataFrame:
    """h, c: how often each token stands in training texts."""

    def run(batches):
        for batch in batches:
            for raw, times in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(times, np.int32)
                met = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64)[met]), pa.array(n[met].astype(np.int64))], ["h", "c"])

    return chunks.select("hashes", "counts").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A WAYS-ary Huffman tree of leaves with these masses: the path of each leaf from the root (classes, -1 beyond its end; slots), its depth,
    and the logarithms of the masses of each class's children (-1e9: no child)."""
    n = len(mass)
    short = -(n - 1) % (WAYS - 1)
    heap = [(float(m), i) for i, m in enumerate(mass)] + [(0.0, -1)] * short
    heapq.heapify(heap)
    children, weights = [], []
    while len(heap) > 1 or not children:
        low = [heapq.heappop(heap) for _ in range(min(WAYS, len(heap)))]
        children.append([i for _, i in low])
        weights.append([m for m, _ in low])
        heapq.heappush(heap, (sum(weights[-1]), n + len(children) - 1))
    prior = np.full((len(children), WAYS), -1e9, np.float32)
    up, slot = np.full(n + len(children), -1), np.zeros(n + len(children), np.int64)
    for c, (kids, own) in enumerate(zip(children, weights, strict=True)):
        for s, (kid, m) in enumerate(zip(kids, own, strict=True)):
            if kid >= 0:
                up[kid], slot[kid], prior[c, s] = c, s, np.log(max(m, 1e-9))
    at, paths = np.arange(n), []
    while (at >= 0).any():
        above = np.where(at >= 0, up[at], -1)
        paths.append((above, np.where(at >= 0, slot[at], 0)))
        at = np.where(above >= 0, above + n, -1)
    depth = sum((c >= 0).astype(np.int64) for c, _ in paths)
    longest = int(depth.max())
    classes, slots = np.full((n, longest), -1, np.int32), np.zeros((n, longest), np.int8)
    for k in range(longest):  # from the root down
        from_leaf = depth - 1 - k
        for j, (c, s) in enumerate(paths):
            here = from_leaf == j
            classes[here, k], slots[here, k] = c[here], s[here]
    prior -= np.log(np.exp(prior).sum(1, keepdims=True))
    return classes, slots, depth, prior


_ONES, _ROW = np.ones(WAYS, np.float32), np.dtype((np.void, 4 * WAYS))


def _summed(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the rows of x with equal numbers (row, sorted), the numbers, and how many each had. Those that stand alone, most of them, are not summed."""
    first = np.concatenate([[True], row[1:] != row[:-1]])
    starts = np.flatnonzero(first)
    times = np.diff(starts, append=len(row))
    out, several = x.take(starts, 0), times > 1
    if several.any():
        inside = np.repeat(several, times)
        many = times[several]
        out[several] = np.add.reduceat(x[inside], np.cumsum(many) - many, 0)
    return out, row[starts], times


class Model:
    """Weights, the vocabulary's hashes (sorted) with their leaves, and the tree. Leaf 0 is the tail."""

    def __init__(self, vocab: list[tuple[int, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        hashes, counts = np.array([h % 2**64 for h, _ in vocab], np.uint64), np.array([c for _, c in vocab], np.float64)
        self.tail_total = total - counts.sum() + 0.5 * (distinct - len(vocab) + 1)
        order = np.argsort(hashes)
        self.hashes, self.leaves = hashes[order], (order + 1).astype(np.int32)
        self.counts = np.concatenate([[0], counts])
        self.classes, self.slots, self.depth, self.prior = tree(np.concatenate([[self.tail_total], counts + 0.5]))
        rng = np.random.default_rng(7)
        self.stir = rng.integers(0, 2**32, len(self.prior), np.uint32)
        self.symbol = rng.integers(0, 2**32, len(vocab) + 2, np.uint32)  # of a leaf as context; the last: before the text
        self.weights = [np.zeros((n, WAYS), np.float32) for n in ROWS]

    def _with(self, kind) -> Model:
        out = Model.__new__(Model)
        out.__dict__.update(self.__dict__)
        out.weights = [w.astype(kind) for w in self.weights]
        return out

    def packed(self) -> Model:
        """With weights of half the size, as tasks get them."""
        return self._with(np.float16)

    def unpacked(self) -> Model:
        """With weights of its own, to compute with."""
        return self._with(np.float32)

    def leaf(self, h: np.ndarray) -> np.ndarray:
        """The leaf of each hash: 0 outside the vocabulary."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.leaves[at], 0)

    def contexts(self, leaf: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Three context hashes of each position of texts that stand one after the other: of the leaf before, the one before that, and both."""
        own, starts = self.symbol[leaf], np.concatenate([[0], np.cumsum(lens)[:-1]])
        one, two = np.empty_like(own), np.empty_like(own)
        one[1:], two[2:] = own[:-1], own[:-2]
        one[starts] = two[starts] = two[(starts + 1)[lens > 1]] = self.symbol[-1]
        return one * _K1, two * _K2, (one + (two * _ODD ^ two >> np.uint32(15))) * _K3

    def _factor(self, ctx, node):
        rows = []
        for c, w in zip(ctx, self.weights, strict=True):
            x = (c ^ self.stir[node]) * _ODD
            rows.append((x ^ x >> np.uint32(13)) * _K2 >> np.uint32(33 - len(w).bit_length()))
        z = self.prior.take(node, 0)
        for w, r in zip(self.weights, rows, strict=True):
            z += w.take(r, 0)
        np.minimum(z, 80, out=z)  # priors are logarithms of shares, so sums are about 0 at most; the bound guards the exponential
        np.exp(z, out=z)
        z *= (1 / (z @ _ONES + np.float32(1e-30)))[:, None]
        return z, rows

    def logs(self, leaf: np.ndarray, ctx: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of the probability of each position's leaf."""
        out = np.zeros(len(leaf))
        for i in range(0, len(leaf), BATCH):
            own, sub = leaf[i : i + BATCH], [c[i : i + BATCH] for c in ctx]
            p, depth = np.ones(len(own)), self.depth[own]
            for k in range(int(depth.max())):
                sel = np.flatnonzero(depth > k)
                z, _ = self._factor([c[sel] for c in sub], self.classes[own[sel], k])
                p[sel] *= z[np.arange(len(sel)), self.slots[own[sel], k]]
            out[i : i + BATCH] = np.log10(np.maximum(p, 1e-300))
        return out

    def learn(self, leaf: np.ndarray, ctx: tuple[np.ndarray, ...], squares: list[np.ndarray], met: list[np.ndarray], rate: float = RATE) -> None:
        """Adaptive gradient steps over these positions, BATCH at a time. squares: sums of squared gradients by row; met: positions by row."""
        for i in range(0, len(leaf), BATCH):
            own, sub = leaf[i : i + BATCH], [c[i : i + BATCH] for c in ctx]
            depth = self.depth[own]
            for k in range(int(depth.max())):
                sel = np.flatnonzero(depth > k)
                at = own[sel]
                z, rows = self._factor([c[sel] for c in sub], self.classes[at, k])
                np.negative(z, out=z)
                z[np.arange(len(sel)), self.slots[at, k]] += 1
                for w, s, m, r in zip(self.weights, squares, met, rows, strict=True):
                    key = np.sort(r << np.uint32(14) | np.arange(len(r), dtype=np.uint32))  # row and place in one number: BATCH is 1 << 14, rows at most 1 << 18
                    g, r, times = _summed(z.take(key & np.uint32(BATCH - 1), 0), key >> np.uint32(14))
                    m[r] += times
                    total = s.take(r) + np.einsum("ij,ij->i", g, g)
                    s[r] = total
                    g *= (rate / np.sqrt(total + START))[:, None]
                    g += w.take(r, 0)
                    w.view(_ROW).ravel()[r] = g.view(_ROW).ravel()


def _positions(model: Model, batch: pa.RecordBatch):
    """Of each chunk of a batch: its row, lens, leaf of each position, context hashes."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        lens = np.frombuffer(row["lens"].as_buffer(), np.int32)
        leaf = model.leaf(np.frombuffer(row["hashes"].as_buffer(), np.uint64))[np.frombuffer(row["codes"].as_buffer(), np.int32)]
        yield row, lens, leaf, model.contexts(leaf, lens)


def trained(chunks: DataFrame, model: Model, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """The model after epochs over every position of every training text of chunks."""
    spark = chunks.sparkSession
    slices = [(j, a) for j, n in enumerate(ROWS) for a in range(0, n, SLICE)]
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast(model.packed())

        def run(batches, sent=sent):
            own = None
            for batch in batches:
                if own is None:
                    own = sent.value.unpacked()
                    squares, met = [np.zeros(n, np.float32) for n in ROWS], [np.zeros(n, np.float32) for n in ROWS]
                for row, lens, leaf, ctx in _positions(own, batch):
                    mask = np.repeat(np.array(row["train"].as_py(), bool), lens)
                    own.learn(leaf[mask], tuple(c[mask] for c in ctx), squares, met, rate)
            if own is not None:
                for k, (j, a) in enumerate(slices):
                    change = own.weights[j][a : a + SLICE] - sent.value.weights[j][a : a + SLICE].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([met[j][a : a + SLICE].tobytes()], pa.binary()), pa.array([change.astype(np.float16).tobytes()], pa.binary())], ["slice", "met", "change"])

        def add(batches):
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for k, m, x in zip(*(batch.column(c).to_pylist() for c in ("slice", "met", "change")), strict=True):
                    times = np.frombuffer(m, np.float32).astype(np.float64)
                    new = [times, np.frombuffer(x, np.float16).reshape(-1, WAYS) * times[:, None]]
                    sums[k] = [a + b for a, b in zip(sums[k], new, strict=True)] if k in sums else new
            for k, (m, x) in sums.items():
                mean = (x / np.maximum(m, 1)[:, None]).astype(np.float16)
                for i in range(0, len(mean), SENT):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i]), pa.array([mean[i : i + SENT].tobytes()], pa.binary())], ["slice", "start", "mean"])

        few = common.bounded(chunks.select("train", "lens", "hashes", "codes").coalesce(TASKS * spark.sparkContext.defaultParallelism))
        changes = few.mapInArrow(run, "slice long, met binary, change binary").repartition(len(slices), "slice")
        means = common.settled(changes.mapInArrow(add, "slice long, start long, mean binary"), "means")
        sent.destroy()
        model.weights = model.packed().unpacked().weights
        for r in means.toLocalIterator():  # a file or a few at a time pass through the driver, in half precision as they go out again
            j, a = slices[r["slice"]]
            change = np.frombuffer(r["mean"], np.float16).reshape(-1, WAYS)
            model.weights[j][a + r["start"] : a + r["start"] + len(change)] += change
        common.dropped(spark, means)
    return model


def fitted(chunks: DataFrame, epochs: int = EPOCHS) -> tuple[DataFrame, Model]:
    """The counts (h, c; settled) of the training texts of chunks, and the trained model."""
    counts = common.settled(counted(chunks), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).head()
    # Settled first: a limit that is collected brings VOCAB rows of every partition to the driver.
    top = common.settled(counts.orderBy(F.desc("c"), "h").limit(VOCAB), "vocabulary").toArrow()
    h, c = (top.column(x).to_numpy() for x in ("h", "c"))
    order = np.lexsort((h, -c))
    return counts, trained(chunks, Model(list(zip(h[order].tolist(), c[order].tolist(), strict=True)), total["n"] or 0, total["v"]), epochs)


def _met(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows without rare, but n_rare (its length), and at and c: places in rare that training texts have, and how often. Both joins are merges: Spark
    takes exploded rows for as small as the file, and the counts of a chunk for a few bytes, and would send them through the driver."""
    each = rows.select("chunk", F.posexplode("rare").alias("place", "h"))
    met = each.hint("merge").join(counts, "h").groupBy("chunk").agg(F.collect_list("place").alias("at"), F.collect_list("c").alias("c"))
    return rows.select("*", F.size("rare").alias("n_rare")).drop("rare").join(met.hint("merge"), "chunk", "left")


def scored(chunks: DataFrame, counts: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id_col, train, n_tokens, n_known, train_tokens, base_score and score of each text of chunks."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    sent = chunks.sparkSession.sparkContext.broadcast(model.packed())
    unit, tail_unit = np.log10(model.total + 0.5 * (model.distinct + 1)), np.log10(model.tail_total)

    def look(batches):
        own = sent.value.unpacked()
        for batch in batches:
            for row, lens, leaf, ctx in _positions(own, batch):
                text = np.repeat(np.arange(len(lens)), lens)
                per = lambda x, text=text, n=len(lens): np.bincount(text, x, n)
                tail = leaf == 0
                score = per(own.logs(leaf, ctx)) - tail_unit * per(tail.astype(float))
                base = per(np.where(tail, 0.0, np.log10(own.counts[leaf] + 0.5)))
                code = np.frombuffer(row["codes"].as_buffer(), np.int32)[tail]
                seen, place = np.unique(code, return_inverse=True)
                rare = np.frombuffer(row["hashes"].as_buffer(), np.int64)[seen]
                raw = lambda x: pa.array([x.tobytes()], pa.binary())
                lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"].as_py()]), lists(row["ids"].values), lists(row["train"].values), raw(lens), raw(score), raw(base), raw(per((~tail).astype(float))), lists(pa.array(rare, pa.int64())), raw(text[tail].astype(np.int32)), raw(place.astype(np.int32))],
                    ["chunk", "ids", "train", "lens", "score", "base", "known", "rare", "text", "place"],
                )

    rows = common.settled(common.bounded(chunks.drop("counts")).mapInArrow(look, f"chunk long, ids array<{kind}>, train array<boolean>, lens binary, score binary, base binary, known binary, rare array<long>, text binary, place binary"), "scored", 8)
    sent.destroy()
    both = _met(rows, counts)

    def sum_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                of = lambda c, k, row=row: np.frombuffer(row[c].as_buffer(), k)
                n, times = of("lens", np.int32).astype(np.int64), np.zeros(row["n_rare"].as_py())
                if row["at"].is_valid:
                    times[row["at"].values.to_numpy()] = row["c"].values.to_numpy()
                text, place = of("text", np.int32), of("place", np.int32)
                logs = np.bincount(text, np.log10(times + 0.5)[place], len(n))
                known = of("known", np.float64) + np.bincount(text, (times > 0)[place].astype(float), len(n))
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values, row["train"].values, pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model_total)), pa.array(of("base", np.float64) + logs - n * unit), pa.array(of("score", np.float64) + logs)],
                    ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    model_total = int(model.total)
    out = common.bounded(both).mapInArrow(sum_up, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns; rows whose id has remainder 1 of 5 are held out of training."""
    held = F.coalesce(remainder(F.col(f"`{id_col}`"), 5) == 1, F.lit(False))
    chunks = chunked(docs, id_col, text_col, ~held)
    counts, model = fitted(chunks)
    rows = scored(chunks, counts, model, id_col)
    common.dropped(docs.sparkSession, chunks)  # what is scored is settled
    return rows.select(F.col(f"`{id_col}`"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
