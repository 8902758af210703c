"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of distinct five-word shingles; two are linked when their Jaccard similarity is
LIKE percent or more. Equal sets are one class. A global order puts rare shingles first. A class of n
shingles may miss t = n - ceil(LIKE * n / 100) of them in a partner, so from its prefix in that order
it needs signatures that t misses can't all destroy: a rare shingle is a signature alone; the frequent
ones are dealt into subclasses by hash, and within a subclass every k of them form one. c shingles of a
subclass resist c - k + 1 misses, and the prefix is extended until t + 1 are resisted. Shingles that no
other class has stand first and need no index, so most documents are done there: one with more than t
of them has no partner.

Candidates of one signature are not paired with each other: each meets two pivots, first the member that
shares the most with others, verified links are merged into components, and only signatures whose members
still differ in component go on, to further pivots while these help, and last in pairs. What a member has
in common with the first pivot bounds what two of them can have in common, so few pairs are left. Every
pair of the same signature is thus verified, already connected, or can't be alike enough.

Defined results: null and blank texts have an empty set and are linked with nothing; fewer than five
words are one shingle; repeated rows are one class; null doc_ids never name a component; an empty
table gives no rows; columns beside doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import input_bytes, quoted, settle, trim, written
from terrace.llm.components import components
from terrace.llm.key_counts import common_keys
from terrace.llm.words import LOWER, slices, word_codes

WORDS_A_SHINGLE = 5
LIKE = 75
#: Shingles in up to so many classes are rare and indexed alone; up to the next bound in pairs; others in threes.
RARE, FREQUENT = 32, 1024
#: Under this band (sets of less than 2**BAND shingles) all are indexed alone.
BAND = 4
#: A set of a band has one subclass for so many shingles of the band's least size. From 2**BAND shingles on,
#: even if all are frequent, n - n / 4 - 2 * n / 6 resisted misses exceed the n / 4 + 1 that are needed.
SHARE = {2: 4, 3: 6}
#: Rounds of pivots end when the pairs left are at most so many times the members left, when a round leaves more than so much of
#: them, or after so many rounds.
FEW_PAIRS, SLOW, MOST_ROUNDS = 64, 0.8, 8
#: What is known of a signature's member.
MEMBER = ("id", "n", "c", "x", "alone", "low", "high", "root")
BUCKET_BYTES = 12 << 20
SLICE_BYTES = 4 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
#: Shingle hashes keep their upper 56 bits; the lower ones are zero and cost nothing in an exchange.
SPARE = np.uint64(8)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS_A_SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for _, some in slices(texts, SLICE_BYTES):
        codes, bounds, distinct = word_codes(some, LOWER)
        of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
        w = of_word[codes] if len(codes) else np.zeros(0, np.uint64)
        n = len(w) - words + 1
        h = np.zeros(max(0, n), np.uint64)
        for k in range(words):
            h = h * _K + w[k : k + n] if n > 0 else h
        h = mix(h) >> SPARE << SPARE
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b - a >= words:
                yield np.unique(h[a : b - words + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for x in w[a:b]:
                    whole = whole * _K + x
                yield mix(whole) >> SPARE << SPARE
            else:
                yield np.zeros(0, np.uint64)


def _name(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


def _sets(docs: DataFrame, with_keys: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                sets = list(shingle_sets(texts))
                names = [_name(x) for x in sets]
                if with_keys:
                    # A class that this task has sent is not sent again.
                    fresh = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
                    if len(seen) > 200_000:
                        seen.clear()
                    columns = [pa.array([names[i] for i in fresh], pa.binary()), pa.array([sets[i].tobytes() for i in fresh], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "keys"])
                else:
                    columns = [batch["doc_id"].slice(lo, len(texts)), batch["text_hash"].slice(lo, len(texts)), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "name"])
                del sets
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "name binary, keys binary" if with_keys else "doc_id long, text_hash long, n long, name binary")


def most_missed(n: int, like: int = LIKE) -> int:
    """How many of n shingles a partner may lack."""
    return n - -(-n * like // 100)


def signatures(n: int, keys: np.ndarray, counts: np.ndarray, like: int = LIKE) -> tuple[set[int], set[int]]:
    """Signatures of a set of n shingles, of one and of several; keys: those that other classes have too, with the numbers of classes."""
    need = most_missed(n, like) + 1 - (n - len(keys))
    if need <= 0:
        return set(), set()
    order = np.lexsort((keys, counts))
    ordered, times = keys[order].tolist(), counts[order].tolist()
    alone: set[int] = set()
    several: set[int] = set()
    for band in {n.bit_length() - 1, (-(-n * like // 100)).bit_length() - 1}:
        width, groups, units = 1 << band, {}, 0
        for key, c in zip(ordered, times, strict=True):
            k = 1 if c <= RARE or band < BAND else 2 if c <= FREQUENT else 3
            if k == 1:
                alone.add(key)
                units += 1
            else:
                group = groups.setdefault((k, (key >> int(SPARE)) % (width // SHARE[k])), [])
                group.append(key)
                units += len(group) >= k
            if units >= need:
                break
        for (k, _), group in groups.items():
            if len(group) >= k:
                picked = np.array(list(combinations(sorted(group), k)), np.uint64)
                h = np.full(len(picked), (band << 8) + k, np.uint64)
                for column in picked.T:
                    h = h * _K + column
                several.update(mix(h).tolist())
    return alone, several


def _index(held: DataFrame, like: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for id_, n, keys, counts in zip(*(batch[c].to_pylist() for c in ("id", "n", "found", "counts")), strict=True):
                times = np.frombuffer(counts, np.uint32)
                # Who shares a rare shingle with a class has that signature too, so a combination's members need only be held against frequent ones.
                low, high = packed_cells(np.frombuffer(keys, np.uint64)[times > RARE])
                for one, own, c in zip((True, False), signatures(n, np.frombuffer(keys, np.uint64), times, like), (len(times), int((times > RARE).sum())), strict=True):
                    columns[0].append(np.fromiter(own, np.uint64).view(np.int64))
                    for column, value in zip(columns[1:], (id_, n, c, one, low, high), strict=True):
                        column.append(np.full(len(own), value))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["sig", "id", "n", "c", "alone", "low", "high"])

    return held.select("id", "n", "found", "counts").mapInArrow(run, "sig long, id long, n long, c long, alone boolean, low long, high long")


def verified(pairs: DataFrame, held: DataFrame, like: int = LIKE) -> DataFrame:
    """Of pairs a, b of class ids: common (shingles in both), frequent (those of them that aren't rare), linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, frequent, linked = [], [], []
            for x, counts, y, m, n in zip(batch["x"], batch["counts"], batch["y"], batch["m"].to_pylist(), batch["n"].to_pylist(), strict=True):
                _, at, _ = np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True, return_indices=True)
                common.append(len(at))
                frequent.append(int((np.frombuffer(counts.as_buffer(), np.uint32)[at] > RARE).sum()))
                linked.append(100 * len(at) >= like * (m + n - len(at)))
            columns = [batch["a"], batch["b"], pa.array(common, pa.int64()), pa.array(frequent, pa.int64()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "frequent", "linked"])

    left = held.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("found").alias("x"), "counts")
    right = held.select(F.col("id").alias("b"), "n", F.col("found").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "m", "n", "x", "counts", "y")
    return both.mapInArrow(run, "a long, b long, common long, frequent long, linked boolean")


def packed_cells(frequent: np.ndarray) -> tuple[int, int]:
    """How many of the keys fall into each of 16 cells of the hash, a byte a cell; -1, -1 where a byte doesn't hold that."""
    counts = np.bincount((frequent >> SPARE & np.uint64(15)).astype(np.int64), minlength=16)
    if counts.max(initial=0) > 255:
        return -1, -1
    low, high = counts.astype(np.uint8).view(np.int64).tolist()
    return low, high


def _in_cells(*sides: tuple[Column, Column]) -> Column:
    """What two classes can have in common cell by cell; null where one has no cells."""
    known = (sides[0][0] != -1) | (sides[0][1] != -1), (sides[1][0] != -1) | (sides[1][1] != -1)
    byte = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(255)
    return F.when(known[0] & known[1], sum((F.least(byte(sides[0][half], k), byte(sides[1][half], k)) for half in range(2) for k in range(8)), F.lit(0)))


def _may_link(like: int) -> Column:
    """Whether members (n, c, x) and (m, d, y) of a signature can be alike enough. n: shingles; c: those that they can have in common
    with members; x: those that they have in common with the signature's first pivot, so that others are at most c - x; members of a
    combination have no rare shingle in common, and of frequent ones no more than cell by cell."""
    most = F.least("c", "d")
    through = F.least("x", "y") + F.least(F.col("c") - F.col("x"), F.col("d") - F.col("y"))
    cells = F.when(~F.col("alone"), _in_cells((F.col("low"), F.col("high")), (F.col("low2"), F.col("high2"))))
    return (F.least("m", "n") * 100 >= F.greatest("m", "n") * like) & (F.least(most, F.coalesce(through, most), F.coalesce(cells, most)) * (100 + like) >= (F.col("m") + F.col("n")) * like)


def links(index: DataFrame, held: DataFrame, like: int = LIKE) -> DataFrame:
    """Verified pairs a, b that connect all classes which a chain of links connects."""
    rows = index.withColumn("root", F.col("id")).withColumn("x", F.lit(None).cast("long"))
    found, before = None, None
    for turn in range(MOST_ROUNDS):
        member = F.struct("id", "n", "c", "x", "low", "high", "root")
        # Who shares the most with others is compared with all first: near copies mostly link to it. So does the last root's
        # member, which mostly stands outside of a large component.
        chosen = F.array_distinct(F.array(F.max_by(member, F.struct(F.col("c") / F.col("n"), "id")), F.max_by(member, F.struct("root", "id"))))
        groups = rows.groupBy("sig").agg(chosen.alias("pivots"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"))
        # The signatures in question; a later round reads these rows alone.
        held_rows = written(rows.join(groups.where("lo < hi").select("sig", "pivots", "least"), "sig"), "mixed")
        pairs = held_rows.select(*MEMBER, F.explode("pivots").alias("p")).where("root <> p.root").select(*MEMBER, F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("m"), F.col("p.c").alias("d"), F.col("p.x").alias("y"), F.col("p.low").alias("low2"), F.col("p.high").alias("high2"))
        told = written(verified(pairs.where(_may_link(like)).select("a", "b").distinct(), held, like), "told")
        new = told.where("linked").select("a", "b")
        found = new if found is None else found.union(new)
        roots = components(found).select(F.col("node").alias("id"), F.col("root").alias("now"))
        rows = held_rows.join(roots, "id", "left").withColumn("root", F.coalesce("now", "root"))
        if turn == 0:
            first = F.col("pivots")[0]["id"]
            rows = rows.join(told.select(F.col("a").alias("p"), F.col("b").alias("id"), "common", "frequent").withColumn("pivot", F.struct("p", "id")).drop("p", "id"), F.struct(first.alias("p"), F.col("id")) == F.col("pivot"), "left")
            rows = rows.withColumn("x", F.when(F.col("id") == first, F.col("c")).when(F.col("alone"), F.col("common")).otherwise(F.col("frequent")))
        # Pivots are done, and so is who can't be alike enough to any member.
        fine = ~F.exists("pivots", lambda p: p["id"] == F.col("id")) & (F.col("c") * (100 + like) >= (F.col("n") + F.col("least")) * like)
        rows = written(rows.where(fine).select("sig", *MEMBER), "rows")
        settle(index.sparkSession)
        per_root = rows.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("k"))
        open_ = per_root.groupBy("sig").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("k").alias("k")).where("pairs > 0")
        pairs_left, rows_left = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        if pairs_left <= FEW_PAIRS * rows_left or before is not None and pairs_left > SLOW * before:
            break
        before = pairs_left
    still = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    mine = written(rows.join(still, "sig"), "rest")
    other = mine.select("sig", F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("x").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("root").alias("root2"))
    pairs = mine.join(other, "sig").where((F.col("root") != F.col("root2")) & (F.col("id") < F.col("b"))).where(_may_link(like)).select(F.col("id").alias("a"), "b")
    told = written(verified(pairs.distinct(), held, like), "told")
    return found.union(told.where("linked").select("a", "b"))


def clusters(docs: DataFrame, like: int = LIKE) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with an equal set), text_hash of every row."""
    members = written(_sets(docs, False), "members")
    classes = members.where("n > 0").groupBy("name").agg(F.max("n").alias("n"), F.min("doc_id").alias("class_id"))
    buckets = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    common = common_keys(_sets(docs, True), buckets)
    # A partner has at least this many of a set's shingles.
    enough = F.octet_length("found") / 8 >= F.ceil(F.col("n") * like / 100)
    # From here on a class that may have partners is a number, fixed by writing it.
    held = written(common.join(classes.select("name", "n"), "name").where("n > 2").where(enough).withColumn("id", F.monotonically_increasing_id()), "held")
    settle(docs.sparkSession)
    index = written(_index(held, like), "index")
    roots = components(links(index, held, like))
    named = held.select("id", "name").join(roots.withColumnRenamed("node", "id"), "id").select("name", "root")
    rooted = classes.join(named, "name", "left")
    # A class without links is a component of its own.
    least = rooted.where("root is not null").groupBy("root").agg(F.min("class_id").alias("least"))
    named = rooted.join(least, "root", "left").select("name", "class_id", F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("least")).alias("component_id"))
    out = members.join(named, "name", "left")
    own = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id"), own("class_id"), "text_hash")


def one_of_each(docs: DataFrame, like: int = LIKE) -> DataFrame:
    """The row of docs that names its component, once; all columns stay. Groups without any doc_id stay whole."""
    found = clusters(docs, like).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias("key")).distinct()
    # The row as a struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h")).alias("key"), F.struct(*map(quoted, docs.columns)).alias("row"))
    once = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).where("place = 1")
    return once.join(kept, "key", "left_semi").select("row.*")
