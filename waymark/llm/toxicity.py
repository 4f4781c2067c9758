"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Words are runs without white space; one of more than PIECE bytes is read as pieces of PIECE bytes, each a place of its own, that share two
bytes with the next, so that every byte trigram of a run is in a piece. A word's input joins three parts: a row for the word itself (lower case, without punctuation around it; words that the training sample
has seldom share one row), the mean of rows for all its byte trigrams and the sum of rows for its beginnings (those of HEADS bytes that the sample has often enough). Both directions of a gated recurrent layer read a window of
WINDOW words, attention pools their states, a logistic unit gives the window's score. All windows, each overlapping the next by
WINDOW - STRIDE words, are scored, so that each passage of up to one word more than that stands whole in one; the text's score is that of its highest window, shifted so that the decision that does best on
the calibration part of the sample stands at CUT.

Training takes a bounded sample: of the labelled texts that may be learned from, at most CLASS_DOCS of each class, in the order of
a hash of their id, and of each at most DOC_WINDOWS windows, evenly spaced among those at each LEARNED words; an epoch takes EPOCH_ROWS windows
of a class at most (or as many as the positive ones, if those are more), drawn anew each time. A toxic text's label holds for at least one of its
windows: after a first pass over all, its highest windows are the positive ones. Everything is seeded; reruns agree.

Defined results: a null or empty text is scored as one window of padding. Texts of any length are scored whole. Equal texts have
equal scores, one row each. Repeated labels of an id count once (toxic if any is). Without labels of both classes the score is 0. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import common

WINDOW, STRIDE, LEARNED, HIDDEN, ATTENTION = 48, 24, 36, 8, 8
WORDS, SEEN, WORD_DIM, GRAMS, GRAM_DIM, PIECE = 4096, 8, 12, 512, 6, 32
HEADS, STARTS, HEAD_DIM = (4, 5, 6, 7, 8), 24_000, 10
CLASS_DOCS, DOC_WINDOWS, BATCH, EPOCHS, RATE, DECAY, CUT = 1500, 24, 256, 5, 0.01, 0.5, 0.3
EPOCH_ROWS, LEAST_ROWS = 12_000, 4_000
MEMO, BLOCK = 300_000, 4096
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_"


def normal(words: list[bytes]) -> list[bytes]:
    return [w.lower().strip(_STRIP) for w in words]


def places(text: str) -> list[bytes]:
    """The text's words in order, longer ones than PIECE in pieces."""
    words = text.encode().split()
    if words and len(max(words, key=len)) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, max(len(w) - 2, 1), PIECE - 2)]
    return words


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words' trigrams (with ends), one word's after another's, and how many each word has, one at least."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    times = np.maximum(sizes, 1)
    flat = np.zeros((times + 2).sum(), np.int64)
    first = np.cumsum(times + 2) - times - 2
    inner = np.repeat(first + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    flat[inner] = np.frombuffer(b"".join(words), np.uint8)
    flat[first] = 256
    flat[first + sizes + 1] = 257
    at = ragged(first, times)
    code = ((flat[at] * 263 + flat[at + 1]) * 269 + flat[at + 2]) * 0x9E3779B1 >> 13
    return code % GRAMS, times


def ragged(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, times[0] numbers, then those of the others."""
    return np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())


def means(rows: np.ndarray, code: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The mean of each word's rows."""
    return np.add.reduceat(rows[code], np.cumsum(times) - times, axis=0) / times[:, None].astype(np.float32) if len(times) else np.zeros((0, rows.shape[1]), np.float32)


def windows(n: int, stride: int = STRIDE) -> list[int]:
    """Where windows over n words start: each stride words until one reaches the end."""
    return list(range(0, max(n - WINDOW, 0) + stride, stride)) if n > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters and passes; words is the list of words with rows of their own, from row 1 (row 0: all others)."""

    def __init__(self, words: list[bytes], heads: list[bytes] = (), seed: int = 7):
        rng = np.random.default_rng(seed)
        normal_ = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.rows = {w: i + 1 for i, w in enumerate(words)}
        self.starts = {w: i + 1 for i, w in enumerate(heads)}
        d, h = WORD_DIM + GRAM_DIM + HEAD_DIM, HIDDEN
        self.p = {
            "word": normal_(len(words) + 1, WORD_DIM, scale=0.3), "gram": normal_(GRAMS, GRAM_DIM, scale=0.3), "head": normal_(len(heads) + 1, HEAD_DIM, scale=0.1), "wx": normal_(2, d, 3 * h, scale=d**-0.5), "bx": np.zeros((2, 1, 3 * h), np.float32),
            "u": normal_(2, h, 3 * h, scale=h**-0.5), "att": normal_(2 * h, ATTENTION, scale=0.3), "v": normal_(ATTENTION, scale=0.3), "out": normal_(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input of each word (normal form), as rows."""
        at = np.fromiter((self.rows.get(w, 0) for w in words), np.int64, len(words))
        return np.concatenate([self.p["word"][at], means(self.p["gram"], *grams(words)), self.p["head"][self.beginnings(words)].sum(1)], 1)

    def beginnings(self, words: list[bytes]) -> np.ndarray:
        """Rows of each word's beginnings; row 0 where it is shorter or the sample hasn't it."""
        get = self.starts.get
        return np.array([[get(w[:n], 0) if len(w) >= n else 0 for n in HEADS] for w in words], np.int64).reshape(len(words), len(HEADS))

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the gates get from each input: both directions side by side."""
        return np.concatenate([x @ self.p["wx"][k] + self.p["bx"][k] for k in (0, 1)], 1).astype(np.float32)

    def forward(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: index (windows, places) into rows of table, mask 1 at words. keep: what backward() needs as well."""
        b, t = index.shape
        h, u = HIDDEN, self.p["u"]
        gates = table[index.T]
        on = mask.T[:, :, None]
        state, states, past = np.zeros((2, b, h), np.float32), np.empty((t, 2, b, h), np.float32), []
        pair, masks = np.empty((2, b, 3 * h), np.float32), np.empty((2, b, 1), np.float32)
        for i in range(t):
            pair[0], pair[1] = gates[i, :, : 3 * h], gates[t - 1 - i, :, 3 * h :]
            masks[0], masks[1] = on[i], on[t - 1 - i]
            own = np.matmul(state, u)
            zr = _sigmoid(pair[:, :, : 2 * h] + own[:, :, : 2 * h])
            z, r = zr[:, :, :h] * masks, zr[:, :, h:]
            new = np.tanh(pair[:, :, 2 * h :] + r * own[:, :, 2 * h :])
            if keep:
                past.append((state, zr, own[:, :, 2 * h :].copy(), new, masks.copy()))
            state = state + z * (new - state)
            states[i] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        hidden = np.tanh(both @ self.p["att"])
        score = hidden @ self.p["v"] + (on[:, :, 0] - 1) * 1e4
        score -= score.max(0)
        alpha = np.exp(score)
        alpha /= alpha.sum(0)
        pooled = np.einsum("tb,tbk->bk", alpha, both)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (index, past, both, hidden, alpha, pooled)) if keep else logit

    def backward(self, kept, slope: np.ndarray, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the inputs', and of the inputs x, from the loss's slope at each logit."""
        index, past, both, hidden, alpha, pooled = kept
        t, b, h, p = len(past), len(index), HIDDEN, self.p
        g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * p["out"]
        d_alpha = np.einsum("bk,tbk->tb", d_pooled, both)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        g["v"] = np.einsum("tb,tbk->k", d_score, hidden)
        g["att"] = np.einsum("tbi,tbj->ij", both, d_hidden)
        d_both = alpha[:, :, None] * d_pooled + d_hidden @ p["att"].T
        d_states = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], 1)
        d_gates = np.zeros((t, b, 6 * h), np.float32)
        g["u"], d_state = np.zeros_like(p["u"]), np.zeros((2, b, h), np.float32)
        for i in range(t - 1, -1, -1):
            state, zr, own, new, masks = past[i]
            d_state = d_state + d_states[i]
            z, r = zr[:, :, :h], zr[:, :, h:]
            d_new = d_state * z * masks * (1 - new**2)
            d_z = d_state * (new - state) * masks * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r], 2)
            d_in = np.concatenate([d_z, d_r, d_new], 2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), d_own)
            d_state = d_state * (1 - z * masks) + np.matmul(d_own, p["u"].transpose(0, 2, 1))
            d_gates[i, :, : 3 * h] += d_in[0]
            d_gates[t - 1 - i, :, 3 * h :] += d_in[1]
        sums = np.zeros((len(x), 6 * h), np.float32)
        np.add.at(sums, index.T.ravel(), d_gates.reshape(-1, 6 * h))
        g["wx"] = np.stack([x.T @ sums[:, : 3 * h], x.T @ sums[:, 3 * h :]])
        g["bx"] = np.stack([sums[:, : 3 * h].sum(0)[None], sums[:, 3 * h :].sum(0)[None]])
        return g, sums[:, : 3 * h] @ p["wx"][0].T + sums[:, 3 * h :] @ p["wx"][1].T


def trained(rows: list[tuple[object, int, list[bytes]]], seed: int = 7) -> Network | None:
    """Fits (id, label, a window's words in normal form); None without both labels."""
    labels = {i: y for i, y, _ in rows}
    if len(set(labels.values())) < 2:
        return None
    names: dict[bytes, int] = {}
    for _, _, words in rows:
        for w in set(words):
            names[w] = names.get(w, 0) + 1
    own = sorted((w for w, n in names.items() if n >= SEEN), key=lambda w: (-names[w], w))[:WORDS]
    starts: dict[bytes, int] = {}
    for w, times in names.items():
        for k in HEADS:
            if len(w) >= k:
                starts[w[:k]] = starts.get(w[:k], 0) + times
    heads = sorted((w for w, k in starts.items() if k >= 2 * SEEN), key=lambda w: (-starts[w], w))[:STARTS]
    net, rng = Network(own, heads, seed), np.random.default_rng(seed)
    ids = sorted(labels, key=str)
    held = set(ids[::5])
    every = [b"", *sorted(names)]
    place = {w: i for i, w in enumerate(every)}
    index = np.zeros((len(rows), WINDOW), np.int64)
    mask = np.zeros((len(rows), WINDOW), np.float32)
    for k, (_, _, words) in enumerate(rows):
        index[k, : len(words)] = [place[w] for w in words]
        mask[k, : len(words)] = 1
    y = np.array([r[1] for r in rows], np.float32)
    train = np.array([r[0] not in held for r in rows])
    code, times = grams(every)
    first = np.cumsum(times) - times
    at = np.fromiter((net.rows.get(w, 0) for w in every), np.int64, len(every))
    begin = net.beginnings(every)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    doc_of = np.unique([str(r[0]) for r in rows], return_inverse=True)[1]

    def logits() -> np.ndarray:
        table = net.projected(net.inputs(every))
        return np.concatenate([net.forward(table, index[i : i + BLOCK], mask[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])

    for epoch in range(EPOCHS):
        chosen = train.copy()
        if epoch:
            z = logits()
            top = np.full(doc_of.max() + 1, -np.inf)
            np.maximum.at(top, doc_of, z)
            chosen &= (y == 0) | (z >= top[doc_of] - 1e-6) | (z > 0)
        pos, neg = np.flatnonzero(chosen & (y > 0)), np.flatnonzero(chosen & (y == 0))
        n = max(len(pos), min(len(neg), EPOCH_ROWS), LEAST_ROWS)  # small samples are gone over again
        order = np.concatenate([rng.permutation(np.resize(rng.permutation(pos), n)), rng.permutation(np.resize(rng.permutation(neg), n))])
        rng.shuffle(order)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            used, back = np.unique(index[pick], return_inverse=True)
            words_at, many = at[used], times[used]
            codes = code[ragged(first[used], many)]
            x = np.concatenate([net.p["word"][words_at], means(net.p["gram"], codes, many), net.p["head"][begin[used]].sum(1)], 1)
            logit, kept = net.forward(net.projected(x), back.reshape(len(pick), WINDOW), mask[pick], keep=True)
            slope = ((_sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32)
            g, dx = net.backward(kept, slope, x)
            g |= {k: np.zeros_like(net.p[k]) for k in ("word", "gram", "head")}
            np.add.at(g["word"], words_at, dx[:, :WORD_DIM])
            np.add.at(g["gram"], codes, np.repeat(dx[:, WORD_DIM : WORD_DIM + GRAM_DIM] / many[:, None].astype(np.float32), many, 0))
            np.add.at(g["head"], begin[used].ravel(), np.repeat(dx[:, WORD_DIM + GRAM_DIM :], len(HEADS), 0))
            g["head"][0] = 0
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.8 * (epoch + i / len(order)) / EPOCHS)
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                if k in ("word", "gram", "head"):
                    v *= 1 - rate * DECAY
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    z = logits()
    top = np.full(doc_of.max() + 1, -np.inf)
    np.maximum.at(top, doc_of, z)
    doc_y, doc_held = np.zeros(len(top)), np.zeros(len(top), bool)
    doc_y[doc_of], doc_held[doc_of] = y, ~train
    net.shift = cut_shift(top[doc_held], doc_y[doc_held]) if len(set(doc_y[doc_held])) == 2 else 0.0
    return net


def cut_shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to add to logits so that the best decision on (z, y), by F1 with both classes weighing as 1 to 8, is at CUT; in the middle of equally good ones."""
    weight = np.where(y > 0, 1.0, 8.0 * (y > 0).sum() / max((y == 0).sum(), 1))
    order = np.argsort(-z, kind="stable")
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    zs = z[order]
    high, low = zs[best[0]], zs[min(best[-1] + 1, len(zs) - 1)]
    return float(np.log(CUT / (1 - CUT)) - (high + low) / 2)


class Scorer:
    def __init__(self, net: Network):
        self.net, self.memo = net, {}
        self.reset()

    def reset(self) -> None:
        self.memo = {b"": 0}
        self.table, self.used = np.zeros((4096, 6 * HIDDEN), np.float32), 1
        self.table[0] = self.net.projected(self.net.inputs([b""]))[0]

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.reset()
        if new := list(set(words).difference(self.memo)):
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(new)] = self.net.projected(self.net.inputs(normal(new)))
            self.memo.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str]) -> list[float]:
        top = np.full(len(texts), -np.inf)
        index, owner, count = [], [], 0

        def run() -> None:
            nonlocal index, owner, count
            if count:
                at, own = np.concatenate(index), np.concatenate(owner)
                for i in range(0, len(at), BLOCK):
                    part = at[i : i + BLOCK]
                    np.maximum.at(top, own[i : i + BLOCK], self.net.forward(self.table, np.maximum(part, 0), (part >= 0).astype(np.float32)))
            index, owner, count = [], [], 0

        for k, text in enumerate(texts):
            words = places(text)
            if len(self.memo) + len(words) > MEMO:
                run()
            ids = self.rows(words)
            starts = np.array(windows(len(ids)))
            padded = np.full(int(starts[-1]) + WINDOW, -1, np.int64)
            padded[: len(ids)] = ids[: len(padded)]
            index.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts])
            owner.append(np.full(len(starts), k))
            count += len(starts)
            if count >= BLOCK:
                run()
        run()
        return (1 / (1 + np.exp(-np.clip(top + self.net.shift, -50, 50)))).tolist()


def remainder(id_col: Column, parts: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> list[tuple[object, int, list[bytes]]]:
    """Windows of at most 2 * CLASS_DOCS texts, at most DOC_WINDOWS of each, in normal form."""
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).where(F.col("y").isin(0, 1) & usable)
    per_class = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(CLASS_DOCS) for y in (0, 1)]
    ids = per_class[0].union(per_class[1])  # at most 2 * CLASS_DOCS rows, so fit to broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.pieces(batch):
                out = []
                for i, y, text in zip(part.column("id").to_pylist(), part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = places(text)
                    starts = windows(len(words), LEARNED)
                    picked = starts if len(starts) <= DOC_WINDOWS else [starts[k * len(starts) // DOC_WINDOWS] for k in range(DOC_WINDOWS)]
                    out += [(i, y, b" ".join(w or b"-" for w in normal(words[s : s + WINDOW]))) for s in picked]
                if out:
                    ids_, ys, ws = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids_, batch.column("id").type), pa.array(ys, pa.int32()), pa.array(ws, pa.binary())], ["id", "y", "words"])

        return step

    rows = common.arrow_map(texts, make, f"id {docs.schema[id_col].dataType.simpleString()}, y int, words binary").collect()
    return sorted(((r["id"], r["y"], bytes(r["words"]).split(b" ") if r["words"] else []) for r in rows), key=lambda r: (str(r[0]), r[2]))


def scored(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score for each row of docs; the network, of fixed size, is broadcast."""
    df = common.slim(docs, text_col, id_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(sent.value) if sent.value else None

        def step(batch: pa.RecordBatch):
            for part in common.pieces(batch):
                values = scorer.scores(part.column("text").to_pylist()) if scorer else [0.0] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(values, pa.float64())], [id_col, "score"])

        return step

    return common.arrow_map(df, make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The contract's columns; rows whose id has remainder 2 of 4 are held out of training."""
    net = trained(sample(docs, labels, id_col, text_col, label_col, remainder(F.col("id"), 4) != 2))
    rows = scored(docs, net, id_col, text_col)
    return rows.select(id_col, F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
