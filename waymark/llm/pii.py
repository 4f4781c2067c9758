"""Personal data by boosted candidates, in DataFrame columns only.

High-recall generators propose overlapping spans. Those of the base rules (an email, IPv4, card or phone pattern and its check) are
always selected. All others, of the base patterns without their check and of further forms (spelled-out and spaced addresses, defanged and
long IPs, cards and phones in national groupings), are scored by boosted trees and selected at their kind's threshold, unless they lie inside a base span.

The trees don't see the base check: they learn, from all base candidates, those that pass it against those that don't, by what stands
around them and how they are written (a cue word of their own or of another kind before them, what they are joined to, separators,
groups, length) and by whether the same text holds sound spans of other kinds. Candidates are summed by these features (small
integers with at most CELLS combinations, whatever the corpus) and the trees are fitted on that table of sums; texts whose id hashes to 0
of 5 are left out of it, and each kind's threshold is the lowest at which its candidates there reach PRECISION (a kind without enough
of both outcomes takes that of all kinds). Scoring is one map over the texts, without a shuffle.

Defined results: a null or empty text has no spans. Texts of any length are read whole. Equal texts have equal spans, rows stay rows.
An empty table, or one without candidates of both outcomes, gives no model, and no spans but the base ones. Other columns, whatever
their names, are not read; redacted() keeps them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import common, spans

KINDS = ("email", "ip", "card", "phone")
#: The base rules' patterns, in forms that take linear time in Java.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|(?![A-Za-z0-9.-]))",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[0-9]|[ -][0-9])[0-9 -]*?(?![0-9]|[ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further forms: spelled-out or spaced addresses; defanged dots and IPv6; cards in groups or by dots; national and 00 phones.
MORE = {
    "email": r"(?i:(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}|@| at ) ?[a-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z]{2,12}+)",
    "ip": r"(?i:(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])|(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?![0-9.]))",
    "card": r"(?<![0-9.-])[0-9]{4}[ .-]{1,2}[0-9]{4,6}[ .-]{1,2}[0-9]{4,5}(?:[ .-]{1,2}[0-9]{4})?(?![0-9]|[.-][0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9]|[.-][0-9])",
}
CONTEXT = 32
#: Words that announce a kind, a short word at most between them and the candidate.
CUES = {"email": "e-?mail|mail|mailto|contact|write to|reach", "ip": "ip|host|server|address|addr|node|ping", "card": "card|visa|master|amex|credit|debit|payment|charge", "phone": "tel|phone|call|fax|mobile|cell|dial|ring"}
_AFTER = r")s?[^A-Za-z0-9]{0,4}(?:[a-z]{1,6}[^A-Za-z0-9]{1,3})?$"
#: Features: name and number of values; at most their product of cells.
FEATURES = (("kind", 4), ("cue", 3), ("edge", 3), ("marks", 4), ("groups", 7), ("length", 6), ("company", 3))
CELLS = math.prod(n for _, n in FEATURES)
ROUNDS, RATE, PRECISION, ENOUGH = 24, 0.3, 0.98, 20


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), F.expr("true") & F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def features(kind: int, s: Column, company: Column) -> Column:
    """Of a candidate of the kind, a place in KINDS. company: how many other kinds have sound spans in its text."""
    match, left = s["match"], s["left"]
    size = F.length(match)
    own, other = (r"(?i)(?:^|[^a-z])(?:" + "|".join(words) + _AFTER for words in ([CUES[KINDS[kind]]], [c for k, c in CUES.items() if k != KINDS[kind]]))
    marks = F.regexp_replace(match, "[A-Za-z0-9]", "")
    step = lambda x, *at: sum((F.when(x >= a, 1).otherwise(0) for a in at), F.lit(0))
    return F.struct(
        F.lit(kind).alias("kind"), F.when(left.rlike(own), 2).when(left.rlike(other), 1).otherwise(0).alias("cue"), F.when(left.rlike("[A-Za-z0-9]$"), 2).when(left.rlike(r"[^\s]$"), 1).otherwise(0).alias("edge"),
        F.when(marks == "", 0).when(marks.rlike(r"^(.)\1*$"), 1).when(F.length(marks) <= 4, 2).otherwise(3).alias("marks"), (F.least(F.size(F.split(match, "[^A-Za-z0-9]+")), F.lit(7)) - 1).alias("groups"), step(size, 8, 12, 16, 24, 40).alias("length"), F.least(company, F.lit(2)).cast("int").alias("company"),
    )


def _found(text: Column, context: int) -> dict[str, Column]:
    """The base patterns' matches by kind."""
    digit = text.rlike("[0-9]")
    when = {"email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": text.contains("+")}
    return {kind: spans.spans(text, pattern, context, when[kind]) for kind, pattern in BASE.items()}


def _further(text: Column) -> Column:
    """All kinds' candidates in one pass: at a place, a kind's base form before its further ones, and cards last, as their base form takes any number."""
    whole = "|".join(f"(?:{form[kind]})" for kind in ("email", "ip", "phone", "card") for form in ((MORE, BASE) if kind == "card" else (BASE, MORE)))
    return spans.spans(text, whole, CONTEXT, text.rlike(r"[0-9]|@|(?i:[(\[{]at[)\]}]| at )"))


def _of_kind(kind: str, match: Column) -> Column:
    """Whether a candidate reads as this kind, by its own forms; the kinds are asked in order."""
    return match.rlike(f"^(?:{_PLAIN[kind]})$")


#: The same forms without what they look around for: a candidate stands alone.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|(?i:[a-z0-9][a-z0-9._%+-]* ?(?:\(at\)|\[at\]|\{at\}|@| at ) ?[a-z0-9-]+ ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z]+)",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4})|[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]|(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{3,4}",
    "card": r"[0-9][0-9 .-]*[0-9]",
}


def _company(base: dict[str, Column] | Column, k: int) -> Column:
    return sum((F.when(F.size(base[kind]) > 0, 1).otherwise(0) for j, kind in enumerate(KINDS) if j != k), F.lit(0))


@dataclass(frozen=True)
class Model:
    """Depth-two trees: (feature, at most, (feature, at most, low, high), (feature, at most, low, high)); selected: score of bias and trees at least the kind's threshold."""

    bias: float
    trees: tuple
    thresholds: tuple

    def score(self, x: Column) -> Column:
        def leaf(rule) -> Column:
            name, most, low, high = rule
            return F.when(x[name] <= most, F.lit(low)).otherwise(F.lit(high))

        total = F.lit(self.bias)
        for name, most, left, right in self.trees:
            total = total + F.when(x[name] <= most, leaf(left)).otherwise(leaf(right))
        return total


def boosted(rows: list[tuple[tuple[int, ...], int, float, float]]) -> Model | None:
    """Fits rows of (features, outcome, weight to fit, weight to calibrate) by Newton steps on the log loss; None without both outcomes."""
    import numpy as np

    if not rows:
        return None
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    w, held = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    if min((w * y).sum(), (w * (1 - y)).sum()) <= 0:
        return None
    w = w / w.sum() * 1000
    bias = math.log((w * y).sum() / (w * (1 - y)).sum())
    at, trees = np.full(len(y), bias), []
    cuts = [(j, int(v)) for j in range(x.shape[1]) for v in np.unique(x[:, j])[:-1]]

    def gain(g, h):
        return g * g / (h + 1.0)

    def best(mask, g, h):
        top = (0.0, None)
        for j, v in cuts:
            low = mask & (x[:, j] <= v)
            gl, hl, gt, ht = g[low].sum(), h[low].sum(), g[mask].sum(), h[mask].sum()
            if (value := gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)) > top[0] + 1e-9:
                top = (value, (j, v, RATE * gl / (hl + 1.0), RATE * (gt - gl) / (ht - hl + 1.0)))
        return top[1] or (0, -1, 0.0, RATE * g[mask].sum() / (h[mask].sum() + 1.0))

    names = [n for n, _ in FEATURES]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-at))
        g, h = w * (y - p), w * p * (1 - p)
        j, v, *_ = best(np.ones(len(y), bool), g, h)
        sides, low = [], x[:, j] <= v
        for mask in (low, ~low):
            a, b, lo, hi = best(mask, g, h)
            at[mask] += np.where(x[mask, a] <= b, lo, hi)
            sides.append((names[a], b, float(lo), float(hi)))
        trees.append((names[j], v, *sides))
    at = at.round(9)

    def threshold(rows) -> float:
        weight = held[rows] if held[rows].sum() else w[rows]
        found = float("inf")
        for t in sorted(set(at[rows]), reverse=True):
            above = at[rows] >= t
            if weight[above].sum() and (weight * y[rows])[above].sum() / weight[above].sum() >= PRECISION:
                found = t - 1e-6
        return found

    every, own = threshold(np.ones(len(y), bool)), []
    for k in range(len(KINDS)):
        rows_k = x[:, 0] == k
        some = min((held[rows_k] * y[rows_k]).sum(), (held[rows_k] * (1 - y[rows_k])).sum()) >= ENOUGH
        own.append(threshold(rows_k) if some else every)
    return Model(bias, tuple(trees), tuple(own))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model of a corpus. What reaches the driver is the table of sums, of at most 2 * CELLS rows."""
    df = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(5)).alias("fold"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = F.struct(*(c.alias(kind) for kind, c in _found(F.col("text"), CONTEXT).items()))

    sound_of = lambda kind: lambda s: passes(kind, s["match"])

    def rows(f: Column) -> Column:
        sound = F.struct(*(F.filter(f[kind], sound_of(kind)).alias(kind) for kind in KINDS))
        row = lambda k, kind, b: F.transform(f[kind], lambda s: F.struct(features(k, s, _company(b, k)).alias("x"), passes(kind, s["match"]).cast("int").alias("y")))
        return spans.let(sound, lambda b: F.concat(*(row(k, kind, b) for k, kind in enumerate(KINDS))))

    cells = df.select("fold", F.explode(spans.let(found, rows)).alias("c")).groupBy("c.x", "c.y").agg(F.sum(F.when(F.col("fold") > 0, 1).otherwise(0)).alias("w"), F.sum(F.when(F.col("fold") == 0, 1).otherwise(0)).alias("held"))
    return boosted(sorted((tuple(r["x"]), r["y"], r["w"], r["held"]) for r in cells.collect()))


def with_spans(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "found") -> DataFrame:
    """docs and a struct out: base (arrays of spans by kind) and all (structs of k, start, end: base and selected ones, by kind and start)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = _found(text, 0)
    sound = lambda kind: lambda s: passes(kind, s["match"])
    base = F.struct(*(F.filter(found[kind], sound(kind)).alias(kind) for kind in KINDS))
    place = lambda k: lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"))
    lists = lambda b: [F.transform(b[kind], place(k)) for k, kind in enumerate(KINDS)]
    if model is None or all(t == float("inf") for t in model.thresholds):
        return docs.withColumn(out, spans.let(base, lambda b: F.struct(b.alias("base"), F.concat(*lists(b)).alias("all"))))

    def chosen(b: Column) -> Column:
        above = lambda k: lambda x: model.score(x) >= model.thresholds[k]

        def likely(s: Column) -> Column:
            of, score = F.lit(None).cast("int"), F.lit(False)
            for kind in ("card", "phone", "ip", "email"):  # the first kind that it reads as is asked last, so stands first
                k = KINDS.index(kind)
                is_kind = _of_kind(kind, s["match"])
                of = F.when(is_kind, F.lit(k)).otherwise(of)
                pick = spans.let(features(k, s, _company(b, k)), above(k))
                score = F.when(is_kind, pick).otherwise(score)
            return F.when(score, of)

        scored = F.transform(_further(text), lambda s: F.struct(likely(s).alias("k"), s["start"].alias("start"), s["end"].alias("end")))
        return F.filter(scored, lambda s: s["k"].isNotNull())

    def joined(b: Column) -> Column:
        own = lambda every: F.filter(every, lambda s: ~F.exists(F.concat(*lists(b)), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
        more = spans.let(chosen(b), lambda c: F.when(F.size(c) > 0, own(c)).otherwise(c))
        return F.struct(b.alias("base"), spans.let(more, lambda m: F.when(F.size(m) == 0, F.concat(*lists(b))).otherwise(F.array_sort(F.concat(*lists(b), m)))).alias("all"))

    return docs.withColumn(out, spans.let(base, joined))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id_col, found (as with_spans has it) for each row."""
    return with_spans(common.slim(docs, text_col, id_col), model, "text").select(id_col, "found")


def redacted(docs: DataFrame, model: Model | None, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs, each span in the text (overlapping ones joined) replaced by <KIND>; n_chars_col, where docs has it, counts the new text. A null text stays null."""
    out, columns = "__found", docs.columns
    rows = with_spans(docs, model, text_col, out)
    by_start = F.array_sort(F.transform(F.col(out)["all"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    names = F.array(*(F.lit(k.upper()) for k in KINDS))
    found = spans.merged(by_start, lambda s: F.element_at(names, s["k"] + 1))
    text = spans.replaced(F.col(f"`{text_col}`"), found, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))
    changed = rows.withColumn(text_col, F.when(F.size(F.col(out)["all"]) > 0, text).otherwise(F.col(f"`{text_col}`")))
    if n_chars_col in columns:
        changed = changed.withColumn(n_chars_col, F.when(F.size(F.col(out)["all"]) > 0, F.length(F.col(f"`{text_col}`")).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(f"`{n_chars_col}`")))
    return changed.select(*(F.col(f"`{c}`") for c in columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digest columns: counts and hash of the base spans, and all spans as text."""
    found = detected(docs, id_col, text_col, fitted(docs, id_col, text_col))
    base = F.concat(*(spans.written(kind, F.col("found")["base"][kind]) for kind in KINDS))
    names = F.array(*(F.lit(k) for k in KINDS))
    every = F.transform(F.col("found")["all"], lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(F.col("found")["base"][kind]).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(id_col, *counts, common.hex_sha(F.array_join(base, ",")).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
