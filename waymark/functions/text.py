"""Text, dates and small figures as Column expressions; entities and NFKC, which Spark lacks, by an Arrow function."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Entities decoded, in the compatibility form NFKC."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def escaped(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def plain(markup: Column) -> Column:
    """Markup without scripts, styles and tags, entities decoded, white space joined."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"\s+", " "))


def slug(name: Column) -> Column:
    """Lower case letters and digits, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www, query, fragment, a page's index name and a slash at the end; the host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[A-Za-z]+://", ""), "^[Ww][Ww][Ww]\\.", ""), "[?#].*$", "")
    host, path = F.lower(F.regexp_extract(rest, "^[^/]*", 0)), F.regexp_extract(rest, "/.*$", 0)
    return F.concat(host, F.regexp_replace(F.regexp_replace(path, "/index\\.html?$", "/"), "/+$", ""))


def same_host(url: Column, host: str) -> Column:
    """Whether a URL's host is exactly host."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]*)", 1)) == host.lower()


def place_name(name: Column) -> Column:
    """A place's name without the words that all have."""
    out = name
    for word in (" International Airport", " Airport", " International"):
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.trim(out)


def signed(x: Column, places: int = 0) -> Column:
    """With its sign, rounded; what rounds to nothing is 0 without a sign."""
    small = F.abs(x) < 0.5 * 10.0**-places
    return F.when(small, F.lit(f"{0:.{places}f}")).otherwise(F.concat(F.when(x > 0, "+").otherwise("-"), F.format_string(f"%.{places}f", F.abs(x))))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def day_of(tag: Column) -> Column:
    """The day in a tag that begins with, or holds, YYYY.MM.DD or YYYY-MM-DD."""
    return F.to_date(F.regexp_replace(F.regexp_extract(tag, r"(\d{4}[.-]\d{2}[.-]\d{2})", 1), r"\.", "-"))


def month_of(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)


def season_of(day: Column, summer_from: str) -> Column:
    return F.when(day < F.to_date(F.lit(summer_from)), "winter").otherwise("summer")


def iso_utc(seconds: Column) -> Column:
    """Unix seconds as 2026-01-31T12:00:00Z; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def piecewise_slope(table: Column, low: int = 1500, high: int = 2000) -> Column:
    """From a map of distance to kg: the slope between two distances, or, where one is missing, between the last two; null below two."""
    keys = F.array_sort(F.map_keys(table))
    between = lambda a, b: (F.element_at(table, b) - F.element_at(table, a)) / (b - a)
    both = F.map_contains_key(table, F.lit(low)) & F.map_contains_key(table, F.lit(high))
    return F.when(both, between(F.lit(low), F.lit(high))).when(F.size(keys) >= 2, between(F.element_at(keys, -2), F.element_at(keys, -1)))


def scaled(x: Column, low: float, high: float, start: float, end: float) -> Column:
    """x of [low, high] on [start, end]: a chart's axis."""
    return start + (x - low) / (high - low) * (end - start)


def polyline(points: Column) -> Column:
    """An array of structs x, y as "x,y x,y", one decimal."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.1f,%.1f", p["x"], p["y"])), " ")


def by_own_rate(real: Column, ideal: Column, gc_km: Column, flown_km: Column, total: Column) -> tuple[Column, Column]:
    """Lateral and vertical by the other convention: further kilometres at the flight's own rate; the total stays."""
    lateral = real / F.nullif(ideal, F.lit(0.0)) * (1 - gc_km / F.nullif(flown_km, F.lit(0.0))) * 100
    return lateral, total - lateral


def percent(a: Column, b: Column) -> Column:
    """a's excess over b in percent; null for b of 0."""
    return (a - b) / F.nullif(b, F.lit(0.0)) * 100
