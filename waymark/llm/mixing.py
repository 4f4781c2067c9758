"""Mixing sources to target token counts by entropy balancing, in DataFrame columns only.

Sources, in code point order with null last, have weights 5, 2, 1 and again; they share all sizes by weight, and no target goes
beyond MOST times its source's size (the excess goes to the others by weight). The rates of documents minimise the relative entropy
to one copy each, under the constraint that each source's expected tokens meet its target and that no rate exceeds MOST: the dual is
convex, with one multiplier a source, and a document's rate is min(MOST, exp(multiplier * size / mean size of its source)). Newton
steps on the logarithm of the dual's gradient, kept inside a shrinking bracket, find the multipliers; each step is one aggregation
over the (source, size) histogram, which is exact as rates depend on nothing else. Multipliers stay in a table in shared storage, one row
a source; targets() puts that table in order in one task, so sources are meant to be collections (up to millions), not documents.

Rates become whole copies by running sums: within a source, in the order of size (largest first), each document gets the whole
numbers that the running sum of rates passes, so the error in tokens is about one gap between neighbouring sizes. The running sum
is cut into parts: the histogram gives where each size starts, and documents of one size are spread over PARTS by a hash of their
id, so no source or size sums in one task.

Defined results: a null or empty text has size 0 and one copy. Rows with equal ids are told apart by text and source, in mixed() by
all columns but maps; rows equal in those get the copies of either. Null ids are ids. A source of size 0 has target 0. In an empty
table there is nothing. Reruns agree. Other columns, whatever their names, are kept by mixed() and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import common

WEIGHTS, MOST, PARTS = (5.0, 2.0, 1.0), 3.0, 64
#: Newton steps at most, and how far (as a share of the target) a source may be from it when they end; beyond that an error is raised.
STEPS, TOLERANCE = 80, 1e-9


def words(text: Column) -> Column:
    """How many words a text has: the places where one begins."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.length(F.regexp_replace(F.regexp_replace(plain, "[^ ]++", "x"), " ++", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target, from a table of (source, source_size), one row a source.

    With the sources in order of the share a weight at which they are full, those before some place are full, and the rest share what
    is left by weight; the place is the first at which the next source isn't full."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    kinds = F.array(*map(F.lit, weights))
    rows = sources.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("full", most * F.col("source_size") / F.col("weight"))
    ends = Window.orderBy("full", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("before", F.coalesce(F.sum(most * F.col("source_size")).over(ends), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(ends), F.lit(0.0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / (F.sum("weight").over(every) - F.col("used")))
    level = F.max(F.when(F.col("full") >= F.col("level"), F.col("level"))).over(every)
    rows = rows.withColumn("target", F.least(F.col("full"), F.coalesce(level, F.col("full"))) * F.col("weight"))
    return rows.select("source", "source_size", "target")


def rate(multiplier: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    return F.when(multiplier * size / mean < F.log(F.lit(most)), F.exp(multiplier * size / mean)).otherwise(F.lit(most))


def multipliers(cells: DataFrame, most: float = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """source, source_size, target, mean, lam for each source; cells: source, size, n (how many documents). Steps go on until each
    source that its cap doesn't fill is within tolerance of its target, or raise after so many."""
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    goal = targets(sums.select("source", "source_size"), most=most)
    state = sums.drop("source_size").join(goal, sums["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    state = state.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    # Below lo even the smallest text has next to nothing, above hi even the smallest has most copies.
    state = state.withColumn("lo", F.lit(-60.0) * F.col("mean") / F.coalesce(F.col("smallest"), F.lit(1))).withColumn("hi", (F.log(F.lit(most)) + 1e-9) * F.col("mean") / F.coalesce(F.col("smallest"), F.lit(1))).withColumn("lam", F.lit(0.0))
    state = common.settled(state, "multipliers")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    for _ in range(steps):
        at = cells.join(state.select(F.col("source").alias("s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        r, z = rate(F.col("lam"), F.col("size"), F.col("mean"), most), F.col("size") / F.col("mean")
        dual = at.groupBy("source").agg(F.sum(r * F.col("size") * F.col("n")).alias("g"), F.sum(F.when(r < most, r * F.col("size") * z * F.col("n")).otherwise(0.0)).alias("h")).withColumnRenamed("source", "s")
        joined = state.join(dual, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        above = F.col("g") >= F.col("target")
        joined = joined.withColumn("hi", F.when(above, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(above, F.col("lo")).otherwise(F.col("lam")))
        newton = F.col("lam") + (F.log(F.greatest(F.col("target"), F.lit(1e-12))) - F.log(F.greatest(F.col("g"), F.lit(1e-12)))) * F.col("g") / F.col("h")
        inside = (F.col("h") > 0) & (newton >= F.col("lo")) & (newton <= F.col("hi"))
        met = full | (F.abs(F.col("g") - F.col("target")) <= tolerance * F.col("target"))
        moved = joined.withColumn("lam", F.when(met, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)).withColumn("met", met).drop("g", "h")
        state, old = common.settled(moved, "multipliers"), state
        common.dropped(state.sparkSession, old)
        if not state.where("not met").head(1):
            break
        state = state.drop("met")
    else:
        raise RuntimeError("the multipliers did not meet their targets within the limit of steps")
    return state.select("source", "source_size", "target", "mean", F.when(full, F.col("hi") + 1e3 * F.abs(F.col("hi")) + 1e3).otherwise(F.col("lam")).alias("lam"))


def planned(rows: DataFrame, most: float = MOST, parts: int = PARTS) -> DataFrame:
    """rows (id, key, source, size, and any others; settled, as they are read again) with source_size, target, rate and copies."""
    cells = common.settled(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    duals = multipliers(cells, most)
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    split = rows.groupBy("source", "size", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s")
    limits = split.join(duals, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate(F.col("lam"), F.col("size"), F.col("mean"), most))
    # Where a part's running sum starts: sums over blocks of sizes (an eighth of an octave), then inside the block.
    limits = limits.withColumn("block", F.floor(F.log2(F.col("size") + 1) * 8))
    blocks = limits.groupBy("source", "block").agg(F.sum(F.col("rate") * F.col("n")).alias("mass")).withColumn("block_from", F.coalesce(F.sum("mass").over(Window.partitionBy("source").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "block_from")
    before = Window.partitionBy("source", "block").orderBy(F.desc("size"), "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = limits.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("start", F.col("block_from") + F.coalesce(F.sum(F.col("rate") * F.col("n")).over(before), F.lit(0.0)))
    starts = starts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "rate", "start", "source_size", "target")
    own = Window.partitionBy("source", "size", "part").orderBy("id", "key")
    placed = rows.withColumn("part", part).withColumn("place", F.row_number().over(own))
    out = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    passed = lambda x: F.floor(F.col("start") + F.col("rate") * x + 0.5 + 1e-9)
    copies = F.least(F.greatest(passed(F.col("place")) - passed(F.col("place") - 1), F.lit(0)), F.lit(int(most)))
    return out.withColumn("copies", F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(copies)).select(*rows.columns, "source_size", "target", "rate", "copies")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """id, key (orders rows of equal ids), source, size of each row; with keep also row, the columns of docs, and number, by which a row is found again."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if keep and "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text, source, *others).alias("key"), source.alias("source"), words(text).alias("size"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("number")] if keep else []))
    return common.settled(rows, "sized")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The contract's columns: id_col, size, source_size, target, taken; and the rate and copies."""
    rows = planned(sized(docs, id_col, text_col, source_col))
    return rows.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, whether ids are null or repeat. Rows are written once with their numbers, and
    planned and delivered by number."""
    rows = sized(docs, id_col, text_col, source_col, keep=True)
    plan = planned(rows.drop("row")).where("copies > 0").select(F.col("number").alias("__number"), F.col("copies").cast("int").alias("__copies"))
    out = rows.select("number", "row").join(plan, F.col("number") == F.col("__number"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
