"""Spans of regular expressions in whole texts, as DataFrame columns only: no Python runs on the executors.

A match's place can't be asked of Spark's regular expressions, so matches are marked by a control character, the text is split at
the marks, and lengths are summed. Sums go in two levels, so that a text with n matches takes about n * CHUNK steps, not n * n.
Patterns are written without repeated groups, as Java's matcher recurses into those, and with possessive or reluctant runs of single
characters, so that time and stack stay in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Even, so that odd parts are matches in every chunk.
CHUNK = 128
MARK, OTHER = "\x01", "\x02"
SPAN = "array<struct<start:bigint,end:bigint,match:string,left:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def none() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, context: int = 0, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (code points, end exclusive), match, and up to so many characters before it (from the previous match's end). Where when is false: none."""

    def located(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))

        def placed(chunks: Column) -> Column:
            lengths = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
            starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

            def step(a: Column, x: Column) -> Column:
                end = a["at"] + F.length(x)
                found = F.struct(a["at"].alias("start"), end.alias("end"), x.alias("match"), a["left"].alias("left"))
                return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), (F.right(x, F.lit(context)) if context else F.lit("")).alias("left"), F.when(a["odd"], F.array_append(a["out"], found)).otherwise(a["out"]).alias("out"))

            def walk(chunk: Column, at: Column) -> Column:
                return F.aggregate(chunk, F.struct(at.alias("at"), F.lit(False).alias("odd"), F.lit("").alias("left"), none().alias("out")), step, lambda a: a["out"])

            return let(starts, lambda s: F.flatten(F.transform(chunks, lambda chunk, c: walk(chunk, s[c]))))

        return let(chunks, placed)

    plain = F.translate(text, MARK, OTHER)
    parts = F.split(F.regexp_replace(plain, pattern, MARK + "$0" + MARK), MARK)
    found = let(parts, lambda p: F.when(F.size(p) > 1, located(p)).otherwise(none()))
    return found if when is None else F.when(when, found).otherwise(none())


def written(kind: Column | str, found: Column) -> Column:
    """kind:start:end of each span, as an array of strings."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(found, lambda s: F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string")))


def replaced(text: Column, found: Column, mark: Callable[[Column], Column]) -> Column:
    """text, in which each of found (structs with start and end, sorted by start, without overlap) stands as mark(span)."""

    def cut(state: Column, chunk: Column) -> Column:
        n = (F.element_at(chunk, -1)["end"] - state["at"]).cast("int")
        piece = F.struct(state["at"].alias("at"), F.substring(state["rest"], F.lit(1), n).alias("text"), chunk.alias("spans"))
        return F.struct(F.element_at(chunk, -1)["end"].alias("at"), F.substring(state["rest"], n + 1, F.length(state["rest"])).alias("rest"), F.array_append(state["out"], piece).alias("out"))

    def fill(piece: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            kept = F.substring(piece["text"], (a["at"] - piece["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
            return F.struct(s["end"].alias("at"), F.array_append(a["out"], F.concat(kept, mark(s))).alias("out"))

        return F.aggregate(piece["spans"], F.struct(piece["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.concat_ws("", a["out"]))

    def whole(spans_in: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans_in) - 1) / CHUNK).cast("int")), lambda c: F.slice(spans_in, c * CHUNK + 1, CHUNK))
        first = F.struct(F.lit(0).cast("long").alias("at"), text.alias("rest"), F.filter(F.transform(chunks, lambda c: F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"), c.alias("spans"))), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(chunks, first, cut, lambda a: F.concat(F.concat_ws("", F.transform(a["out"], fill)), a["rest"]))

    return F.when(F.size(found) > 0, let(found, whole)).otherwise(text)


def merged(found: Column, name: Callable[[Column], Column]) -> Column:
    """Overlapping spans of found (sorted by start) joined to one with the first's name; each out: kind, start, end."""

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        one = F.struct(name(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        grown = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (s["start"] < last["end"]), F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), grown)).otherwise(F.array_append(a, one))

    return F.aggregate(found, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"), step)
