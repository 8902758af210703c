"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are a text's distinct lower-case words, weighted by their counts. For each of SAMPLES hashes a
term draws r and c from Gamma(2, 1), each a sum of two exponentials, and b from (0, 1), all from hashes of the term; with
t = floor(ln(weight) / r + b) the sample is the term of the least ln(c) - r * (t - b + 1), together
with t. Two texts agree in a sample with a probability of their generalised Jaccard similarity.

Words are hashed, sorted and counted within the row, those of a text and its edited form together, so that
terms of both share their draws; the rows of its terms are folded to SAMPLES
minima by an aggregation whose partitioning the texts already have, so that only whole texts and
finished fingerprints cross a shuffle. A sample packs the order of its value into the upper half of a
long and a hash of (term, t) into the lower; the minimum then is the sample.

The document after another, by doc_id, is found by a range partitioning of ids alone: lead() within
each range, and the next range's first id at its end.

Defined results: null text counts as empty; an empty text has a fingerprint of its own, like itself
only; the last document is followed by the first, a lone one by itself; rows equal in doc_id and text
are one document and get one result each, rows with equal doc_id and other texts follow one another by
a hash of the text; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import checkpointed, partitions_for, text_or_empty, written

SAMPLES = 64
#: Samples computed for one row of the fold; with more, the JVM no longer compiles the generated method.
GROUP = 2
#: Steps of a sample's value in its order; values lie within ±64.
STEPS = 1 << 24


def hashed_words(text: Column, kind: int) -> Column:
    """The lower-case words of a text as hashes whose last bit is kind."""
    words = F.split(F.btrim(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(-2).bitwiseOR(kind))


def _starts(words: Column) -> Column:
    """Places at which a new value begins in a sorted array."""
    marked = F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _exponential(bits: Column) -> Column:
    """A draw of -ln(u) from 32 bits: trailing zeros give u's binary order, the upper bits its fraction."""
    low = bits.bitwiseAND((1 << 16) - 1).bitwiseOR(1 << 16)
    order = F.bit_count(low.bitwiseAND(-low) - 1)
    m = F.shiftright(bits, 16).bitwiseAND((1 << 16) - 1) * F.lit(2.0**-16)
    # -ln of (1 + m) / 2 by a polynomial.
    poly = F.lit(float(_LOG[0]))
    for c in _LOG[1:]:
        poly = poly * m + F.lit(float(c))
    return order * F.lit(LN2) + F.greatest(poly, F.lit(1e-6))


LN2 = float(np.log(2))
_X = (np.arange(1 << 16) + 0.5) / (1 << 16)
_LOG = np.polyfit(_X, -np.log((1 + _X) / 2), 6)
#: Between these values ln(x) comes from x's ratio to MIDDLE: 2 artanh(z), z = (x - MIDDLE) / (x + MIDDLE), by an odd polynomial.
NEAR, FAR = 0.4, 12.0
MIDDLE = (NEAR * FAR) ** 0.5
_Z = np.sin(np.linspace(0, np.pi / 2, 4001)) * (FAR - MIDDLE) / (FAR + MIDDLE)
_ARTANH = np.linalg.lstsq(_Z[1:, None] ** np.arange(13, 0, -2), 2 * np.arctanh(_Z[1:]), rcond=None)[0]


def _ratio(x: Column) -> Column:
    return (x - F.lit(MIDDLE)) / (x + F.lit(MIDDLE))


def _ln(x: Column, z: Column) -> Column:
    """ln(x), z its _ratio(); Spark's own, which costs as much as the rest of a draw, only for the few draws beyond NEAR and FAR."""
    poly = F.lit(float(_ARTANH[0]))
    for c in _ARTANH[1:]:
        poly = poly * (z * z) + F.lit(float(c))
    return F.when((x > NEAR) & (x < FAR), poly * z + F.lit(float(np.log(MIDDLE)))).otherwise(F.log(x))


def _draws(term: Column, k: Column) -> tuple[Column, Column, Column, Column]:
    """r, c, b of a term's k-th sample, and a hash for its name."""
    h1 = F.xxhash64(term, k)
    h2 = F.xxhash64(h1)
    h3 = F.xxhash64(h2)
    r = _exponential(h1) + _exponential(F.shiftrightunsigned(h1, 32))
    c = _exponential(h2) + _exponential(F.shiftrightunsigned(h2, 32))
    b = (F.shiftrightunsigned(h3, 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return r, c, b, h3


def _sample(r: Column, log_c: Column, b: Column, h3: Column, log_weight: Column) -> Column:
    """A long: the order of the sample's value, then a hash of (term, t). Null without a weight."""
    t = F.when(log_weight == 0, F.lit(0).cast("long")).otherwise(F.floor(log_weight / r + b))
    value = log_c - r * (t - b + 1)
    # Within a step the hash of (term, t) decides.
    order = F.least(F.greatest(((value + 64) * STEPS).cast("long"), F.lit(0)), F.lit((1 << 31) - 1))
    return F.when(log_weight.isNotNull(), F.shiftleft(order, 32).bitwiseOR(F.shiftrightunsigned(h3, 32).bitwiseXOR(t.bitwiseAND((1 << 32) - 1))))


def fingerprints(rows: DataFrame, keys: list[str], texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """keys and one or two texts -> keys and, for each text, its fingerprint (an array of SAMPLES longs) under its name.

    rows must be partitioned by keys or some of them. Two texts of a row share the draws of the terms that both have.
    """
    words = F.concat(*(hashed_words(F.col(c), kind) for kind, c in enumerate(texts)))
    found = rows.select(*keys, F.sort_array(words).alias("words")).select(*keys, "words", _starts(F.col("words")).alias("starts"))
    # A run's count is the way to the next start; a term's run of the first text stands before that of the second.
    ends = lambda i: F.coalesce(F.get("starts", i + 1), F.size("words"))
    runs = F.transform("starts", lambda s, i: F.struct(F.get("words", s).alias("v"), F.log((ends(i) - s).cast("double")).alias("w")))
    found = found.select(*keys, runs.alias("runs"))
    run = lambda i: F.get("runs", i)
    second = lambda x: x["v"].bitwiseAND(1) == 1
    same = lambda x, y: F.coalesce(x["v"].bitwiseAND(-2) == y["v"].bitwiseAND(-2), F.lit(False))
    terms = F.transform("runs", lambda x, i: F.when(~second(x) | (i == 0) | ~same(x, run(i - 1)), F.struct(x["v"].bitwiseAND(-2).alias("term"), F.when(~second(x), x["w"]).alias("w0"), F.when(second(x), x["w"]).when(same(x, run(i + 1)), run(i + 1)["w"]).alias("w1"))))
    exploded = found.select(*keys, F.explode(F.filter(terms, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.term", "x.w0", "x.w1")
    exploded = exploded.withColumn("g", F.explode(F.array(*(F.lit(g) for g in range(0, SAMPLES, GROUP)))))
    draws = [[x.alias(f"{n}{k}") for n, x in zip("rcbh", _draws(F.col("term"), F.col("g") + F.lit(k)), strict=True)] for k in range(GROUP)]
    drawn = exploded.select(*keys, "g", "w0", "w1", *(x for own in draws for x in own))
    # Steps of their own, so that a ratio is divided once.
    drawn = drawn.select("*", *(_ratio(F.col(f"c{k}")).alias(f"z{k}") for k in range(GROUP)))
    drawn = drawn.withColumns({f"c{k}": _ln(F.col(f"c{k}"), F.col(f"z{k}")) for k in range(GROUP)})
    least = [F.min(_sample(*(F.col(f"{n}{k}") for n in "rcbh"), F.col(f"w{kind}"))).alias(f"m{kind}{k}") for kind in range(len(texts)) for k in range(GROUP)]
    folded = drawn.groupBy(*keys, "g").agg(*least)
    low = lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    parts = folded.select(*keys, "g", *(F.array(*(low(f"m{kind}{k}") for k in range(GROUP))).alias(f"part{kind}") for kind in range(len(texts))))
    whole = F.array_sort(F.collect_list(F.struct("g", *(f"part{kind}" for kind in range(len(texts))))))
    return parts.groupBy(*keys).agg(whole.alias("parts")).select(*keys, *(F.flatten(F.col(f"parts.part{kind}")).alias(c) for kind, c in enumerate(texts)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / SAMPLES


def shown(fingerprint: Column) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def followers(ids: DataFrame) -> DataFrame:
    """(id, h) of distinct documents -> id, h, next_id, next_h in ascending order, the first after the last."""
    n = partitions_for(ids)
    ranged = checkpointed(ids.repartitionByRange(n, "id", "h").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("id", "h")
    edges = ranged.groupBy("range").agg(F.min(F.struct("id", "h")).alias("first"))
    # One row a range from here on.
    every = Window.orderBy("range")
    edges = edges.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    rows = ranged.withColumn("next", F.lead(F.struct("id", "h")).over(inside)).join(edges, "range")
    rows = rows.withColumn("next", F.coalesce("next", "after"))
    return rows.select("id", "h", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    text = text_or_empty().cast("string")
    # id: order-keeping text of a nullable long would be slow; null gets the least long instead.
    every = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    counts = every.groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"))
    counts = checkpointed(counts)
    order = followers(counts.select("id", "h"))
    order = checkpointed(order.join(counts.select("id", "h", "n"), ["id", "h"]).withColumn("cut", F.floor(F.col("n") / 4).cast("int")))
    once = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0)))
    texts = every if counts.where("copies > 1").isEmpty() else every.withColumn("_n", once).where("_n = 1").drop("_n")
    # What the document before needs of a text: its first `cut` characters.
    asked = order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("for_id"), F.col("h").alias("for_h"), "cut")
    heads = texts.join(asked, ["id", "h"]).select(F.col("for_id").alias("id"), F.col("for_h").alias("h"), F.expr("substring(text, 1, cut)").alias("head"), "cut")
    both = texts.join(heads, ["id", "h"])
    edited = F.concat(F.expr("substring(text, 1, length(text) - cut)"), F.col("head"))
    both = both.select("id", "h", F.col("text").alias("own"), edited.alias("edited"))
    own = fingerprints(both, ["id", "h"], ("own", "edited"))
    digests = both.select("id", "h", F.sha2("edited", 256).alias("edited_sha256"))
    # Written, since a fingerprint is wanted twice: for its document and for the one before.
    own = written(own.join(digests, ["id", "h"]).join(order, ["id", "h"]), "fingerprints")
    after = own.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("own").alias("after"))
    rows = own.join(after, ["next_id", "next_h"]).join(counts.select("id", "h", "copies"), ["id", "h"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
