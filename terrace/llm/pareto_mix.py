"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order weigh 1, 2, 3, repeating, and share all words; a source's target
stops at CAP times its words, the excess being shared again by weight (a water level, found in closed
form from sorted ratios). Within a source a document's expected copies e rise with its size class
(weight 1 + the bits of its size), up to CAP, and add up to the target. floor(e) copies are certain;
the rest is a Pareto sample: documents are ranked by odds of a uniform number over odds of the
fractional part, and taken in that order until the source's remaining words are filled. Further passes
fill what a document too long for the gap leaves open.

The ranking is a running sum spread over bins of the rank variable, so a source with a third of all
rows is spread over tasks as well. The uniform number is a hash of the row and a seed: reruns agree.

Defined results: null text has size 0 and is never taken; null sources are one source, last; equal
rows tie and are taken one by one; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import WORD, checkpointed, quoted

CAP = 3
#: Bins of the rank variable: at least so many, and one for about so many rows.
BINS, BIN_ROWS = 4096, 1000
PASSES = 3
SEED = 20240607


def water_level(rows: DataFrame, by: list[str], order: Column, weight: str, cap: str, total: str) -> DataFrame:
    """Adds level: the x at which the sum of min(cap, x * weight) over rows with equal by is total. order sorts cap / weight."""
    ordered = Window.partitionBy(*by).orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    # What is left over the weights that are left rises while caps bind and falls after: its highest value is the level.
    here = (F.col(total) - full) / F.sum(weight).over(after)
    return rows.withColumn("_here", here).withColumn("level", F.max("_here").over(Window.partitionBy(*by))).drop("_here")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a hash of the text and the row's uniform number."""
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    row = row.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit(SEED)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    kind = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    return checkpointed(row.select("doc_id", "source", "size", "h", uniform.alias("u"), name.alias("skey"), kind.alias("kind")))


def plan(rows: DataFrame) -> DataFrame:
    """One row a (source, size class): source_size, target, expected copies e."""
    classes = rows.groupBy("skey", "kind").agg(F.min("source").alias("source"), F.sum("size").cast("double").alias("words"))
    sources = classes.groupBy("skey").agg(F.min("source").alias("source"), F.sum("words").alias("source_size"))
    # One row a source from here on.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", (place % 3 + 1).cast("double")).withColumn("cap", CAP * F.col("source_size")).withColumn("one", F.lit(1)).withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
    sources = water_level(sources, ["one"], F.col("cap") / F.col("weight"), "weight", "cap", "total")
    sources = sources.select("skey", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    filled = classes.where(F.col("kind") > 0).join(sources, "skey").withColumn("v", (1 + F.col("kind")).cast("double"))
    filled = filled.withColumn("w", F.col("words") * F.col("v")).withColumn("cap", CAP * F.col("words"))
    filled = water_level(filled, ["skey"], -F.col("v"), "w", "cap", "target").select("skey", "kind", F.least(F.lit(float(CAP)), F.col("level") * F.col("v")).alias("e"))
    return classes.select("skey", "kind").join(sources, "skey").join(filled, ["skey", "kind"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h, source_size, target and the copies taken of every row."""
    rows = sizes(docs)
    rows = rows.join(plan(rows), ["skey", "kind"])
    whole = F.floor(F.col("e") + 1e-9)
    part = F.greatest(F.col("e") - F.col("whole"), F.lit(0.0))
    rows = rows.withColumn("whole", whole).withColumn("part", F.when(part > 1e-9, part).otherwise(0.0))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    rows = checkpointed(rows.withColumn("z", F.when(F.col("part") > 0, odds / (1 + odds))).withColumn("more", F.lit(0)))
    bins = max(BINS, rows.count() // BIN_ROWS)
    for n in range(PASSES):
        rows = _fill(rows, bins, last=n == PASSES - 1)
    return rows.select("doc_id", "source", "size", "h", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def _fill(rows: DataFrame, cells: int, last: bool) -> DataFrame:
    """Take documents in the order of z while they fit what their source lacks; in the last pass also one that comes nearer."""
    used = rows.groupBy("skey").agg((F.first("target") - F.sum((F.col("whole") + F.col("more")) * F.col("size"))).alias("gap"))
    rows = rows.join(used, "skey")
    free = F.col("z").isNotNull() & (F.col("more") == 0) & (F.col("size") > 0)
    room = F.col("size") <= F.col("gap") if not last else F.col("size") / 2 <= F.col("gap")
    rows = rows.withColumn("bin", F.when(free & room, F.floor(F.col("z") * cells)))
    # Summed and written first, so that a source's rows never meet: its window goes over bins alone.
    bins = checkpointed(rows.where(F.col("bin").isNotNull()).groupBy("skey", "bin").agg(F.sum("size").alias("words")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(bins.select("skey", "bin", before.alias("before")), ["skey", "bin"], "left")
    # Rows out of the running are dealt by their hash, so that they don't meet in one task.
    spread = F.coalesce(F.col("bin"), -1 - F.pmod(F.col("h"), F.lit(cells)))
    inside = F.sum("size").over(Window.partitionBy("skey", "spread").orderBy("z", "doc_id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("spread", spread).withColumn("sum", F.col("before") + inside)
    fits = (F.col("sum") - F.col("size") / 2 if last else F.col("sum")) <= F.col("gap")
    return checkpointed(rows.withColumn("more", F.when(F.col("bin").isNotNull() & fits, 1).otherwise(F.col("more"))).drop("gap", "bin", "before", "spread", "sum"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies."""
    rows = copies(docs)
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay."""
    key = lambda id_, h: F.struct(id_.alias("id"), h.alias("h")).alias("key")
    counted = copies(docs).groupBy(key(F.col("doc_id"), F.col("h"))).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("same"))
    # The row as a struct, so that no name of its columns can clash.
    rows = docs.select(key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))), F.struct(*map(quoted, docs.columns)).alias("row"))
    rows = rows.join(counted.where("copies > 0"), "key")
    # Rows that are equal in id and text share their copies.
    place = F.when(F.col("same") > 1, F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).otherwise(1)
    own = F.floor(F.col("copies") / F.col("same")) + (place <= F.col("copies") % F.col("same")).cast("int")
    return rows.withColumn("n", own.cast("int")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
