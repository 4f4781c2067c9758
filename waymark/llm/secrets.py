"""Secret scans with corpus-wide ownership frequency, in DataFrame columns only.

Each text's candidates are the base rules' matches (assignments, access keys, hex runs) and those of further generators. The hash
of a candidate's value is counted over the corpus by distinct repositories and by distinct owners (columns, or texts themselves).
A value with more than MAX_OWNERS owners or MAX_REPOS repositories is a widely copied example; one with fewer is owner-specific and
live-looking. Base spans always stay; further candidates become spans if they are live-looking. Texts are read once: what is joined
and counted afterwards are spans and hashes. Counting goes by value and owner first, then by value; the verdicts go back by value
and one of SALT parts, so that a value that a third of all rows hold meets in no single task.

Defined results: a null or empty text has no spans. Texts of any length are read whole. A value that a text repeats counts once for
it; equal rows are rows of their own, with equal spans. A null owner or repository is one owner or repository. An empty table gives none.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import common, spans

KINDS = ("assign", "access", "hex")
_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
BASE = {"assign": _ASSIGN + r"[A-Za-z0-9+/_.=-]++", "access": r"AKIA[A-Z0-9]{14,}", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+"}
#: What is no part of a match's value: the name before it; a key block's line breaks, plain or escaped.
VALUE = {"assign": "^" + _ASSIGN, "keyblock": r"\\[rn]|\s"}
#: Further kinds, after the base ones in order of name: tokens with a vendor's prefix, signed web tokens, key blocks, long mixed runs.
#: A key block goes through its END line; where the next five dashes are no END line, through the key's characters, if any follow.
MORE = {
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "keyblock": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?>[\s\S]*?-----)END [A-Z ]{0,40}PRIVATE KEY-----|[\s\\]*+[A-Za-z0-9+/=]{16,}+[A-Za-z0-9+/=\s\\]*+|)",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{0,40}[0-9])(?=[A-Za-z0-9+/_-]{0,40}[A-Z])(?=[A-Za-z0-9+/_-]{0,40}[a-z])[A-Za-z0-9+/_-]{32,}+",
    "vendor": r"(?<![A-Za-z0-9])(?:gh[pousr]_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}+",
}
ALL = (*KINDS, *MORE)
MAX_OWNERS, MAX_REPOS, SALT = 1, 20, 32


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """id_col, owner, repo, found: structs of k (place in ALL), start, end, hash, in order of start and k."""
    text = F.col("text")
    when = {"assign": text.rlike(r"[:=]"), "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{16}"), "jwt": text.contains("eyJ"), "keyblock": text.contains("-----BEGIN"), "mixed": text.rlike("[A-Za-z0-9+/_-]{32}"), "vendor": text.rlike("gh[pousr]_|glpat-|_live_|xox|AIza")}

    def kept(k: int, kind: str) -> Column:
        found = spans.spans(text, (BASE | MORE)[kind], 0, when[kind])
        shaped = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.regexp_replace(s["match"], VALUE[kind], "").alias("value") if kind in VALUE else s["match"].alias("value")))
        return F.filter(shaped, lambda s: F.length(s["value"]) >= 12) if kind == "assign" else shaped

    merged = F.array_sort(F.concat(*(kept(k, kind) for k, kind in enumerate(ALL))))
    hashed = F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), F.substring(F.sha2(s["value"].cast("binary"), 256), 1, 32).alias("hash")))
    name = lambda c, alias: (F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(alias)
    df = docs.select(F.col(f"`{id_col}`"), name(owner_col, "__owner"), name(repo_col, "__repo"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return df.select(F.monotonically_increasing_id().alias("__row"), id_col, "__owner", "__repo", hashed.alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: how many distinct ones hold each value."""
    pairs = found.select("__owner", "__repo", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    repos = pairs.groupBy("hash", "__owner", "__repo").agg(F.lit(1).alias("one"))
    return repos.groupBy("hash", "__owner").agg(F.sum("one").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """id_col and found for each row: structs of start, k, end, hash, live (whether the value is owner-specific)."""
    rows = common.settled(candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    wide = ownership(rows).where((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    each = rows.select("__row", F.pmod(F.xxhash64("__row"), F.lit(SALT)).cast("int").alias("salt"), F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    copied = each.join(wide, ["hash", "salt"], "left_semi").groupBy("__row").agg(F.collect_set("hash").alias("copied"))
    out = rows.join(copied, "__row", "left")
    live = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["hash"].alias("hash"), (~F.coalesce(F.array_contains("copied", s["hash"]), F.lit(False))).alias("live")))
    return out.select(id_col, live.alias("found"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id") -> DataFrame:
    """The contract's digest columns, and the numbers of live and of widely copied base spans."""
    found = scanned(docs, id_col, text_col, owner_col, repo_col)
    base = F.filter("found", lambda s: s["k"] < len(KINDS))
    names = F.array(*(F.lit(k) for k in ALL))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: lambda s: s["k"] == k
    counts = [F.size(F.filter("found", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    shown = F.filter("found", lambda s: (s["k"] < len(KINDS)) | s["live"])
    more = [F.size(F.filter(base, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter(base, lambda s: ~s["live"])).cast("long").alias("n_copied")]
    return found.select(id_col, *counts, common.hex_sha(text(base)).alias("base_sha256"), text(shown).alias("spans"), *more)
