"""Phrase collocations from depth-limited count tries.

Each share of the corpus becomes a trie of word windows: the windows of up to DEPTH words that begin at
each word, sorted, with equal ones counted. A node is a run of windows with a common beginning, and its
count is the sum over that run. A trie is cut at the edges of prefix ranges and each part serialised in
its order: for each leaf how many words it shares with the one before, then the words that differ. Parts
of a range are merged in one pass over their blocks, which arrive ordered by their first windows: what
lies before the next block's first window is complete.

A node's left parts lie on the walk from the root to it. Its right parts are found by suffix links, from
a phrase to the phrase without its first words. Phrases below `least` have no part in any result (parts
of a phrase are at least as frequent as it is), so only the others leave the merge; nodes that an edge
cuts through leave it as partial counts from each side and are added up: at most DEPTH a range.

Defined results: null text is empty, null label is `und`; a text without words adds nothing; repeated
rows count each; ties are broken by the count, then the phrase in byte order; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import dropped, input_bytes, partitions_for, text_or_empty, trim, written
from terrace.llm.key_counts import pack, unpack
from terrace.llm.words import cut_array, raw, slices

#: Words of a phrase at most; the least count; the share (of a hundred) from which a longer phrase replaces one.
DEPTH, LEAST, SHARE, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Text bytes of a trie, Parquet bytes of a prefix range, and leaves of a serialised block.
TRIE_BYTES, RANGE_BYTES, BLOCK_LEAVES = 8 << 20, 12 << 20, 1 << 16
#: Leaves that are merged at a time.
MERGE_LEAVES = 1 << 20
#: Edges of ranges come from about so many documents, drawn by a hash; they balance the work and have no part in the results.
SAMPLE_DOCUMENTS = 2000
#: Ranges at most; beyond that ranges grow, and a range is merged block by block.
MOST_RANGES = 1 << 16

#: Words to lower case; blank and tab part words, the marks of the split and line breaks part pieces as well.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[65:91] += 32
BLANK, BREAK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

Key = tuple[str, tuple[bytes, ...]]


class Leaves:
    """Sorted distinct windows (codes of words from 1 on, ascending as the words do; 0 after a window's end) and their counts."""

    def __init__(self, words: list[bytes], windows: np.ndarray, counts: np.ndarray):
        self.words, self.windows, self.counts = words, windows, counts

    @classmethod
    def sorted(cls, words: list[bytes], windows: np.ndarray, counts: np.ndarray) -> Leaves:
        pairs = windows.astype(np.uint64)
        high, low = pairs[:, 0] << np.uint64(32) | pairs[:, 1], pairs[:, 2] << np.uint64(32) | pairs[:, 3]
        del pairs
        order = np.argsort(low, kind="stable")
        order = order[np.argsort(high[order], kind="stable")]
        high, low = high[order], low[order]
        starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
        return cls(words, windows[order[starts]], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0])

    def key(self, i: int) -> tuple[bytes, ...]:
        return tuple(self.words[c - 1] for c in self.windows[i].tolist() if c)

    def find(self, key: tuple[bytes, ...]) -> int:
        """The first leaf at or after the key."""
        lo, hi = 0, len(self.windows)
        for d in range(DEPTH):
            if d == len(key):
                break
            code = bisect_left(self.words, key[d])
            column = self.windows[lo:hi, d]
            if code == len(self.words) or self.words[code] != key[d]:
                return lo + int(np.searchsorted(column, code + 1))
            lo, hi = lo + int(np.searchsorted(column, code + 1)), lo + int(np.searchsorted(column, code + 1, "right"))
        return lo

    def shared(self) -> np.ndarray:
        """How many first words each leaf shares with the one before it."""
        same = np.cumprod(self.windows[1:] == self.windows[:-1], axis=1, dtype=np.uint8)
        return np.concatenate([[0], same.sum(1, dtype=np.uint8)]).astype(np.uint8)

    def dump(self, lo: int, hi: int) -> tuple[bytes, bytes, bytes, bytes]:
        """(words, shared depths, differing words level by level, counts) of the leaves from lo to hi."""
        used = np.unique(self.windows[lo:hi])
        used = used[used > 0]
        part = Leaves([], np.searchsorted(used, self.windows[lo:hi]) + (self.windows[lo:hi] > 0), self.counts[lo:hi])
        depths = part.shared()
        width = np.uint16 if len(used) < 1 << 16 else np.uint32
        levels = np.concatenate([part.windows[depths <= d, d] for d in range(DEPTH)]).astype(width)
        words = b"\n".join([self.words[c - 1] for c in used.tolist()])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return squeeze(words), squeeze(depths.tobytes()), pack(levels), pack(part.counts.astype(np.uint64))

    @classmethod
    def load(cls, words: bytes, depths: bytes, levels: bytes, counts: bytes) -> Leaves:
        expand = zstandard.ZstdDecompressor().decompress
        own = expand(words).split(b"\n")
        shared = np.frombuffer(expand(depths), np.uint8)
        codes, at = unpack(levels, "u2" if len(own) < 1 << 16 else "u4"), 0
        windows = np.empty((len(shared), DEPTH), np.uint32)
        for d in range(DEPTH):
            fresh = shared <= d
            n = int(fresh.sum())
            windows[:, d] = codes[at : at + n][np.cumsum(fresh) - 1]
            at += n
        return cls(own, windows, unpack(counts, "u8").astype(np.int64))

    def slice(self, lo: int, hi: int) -> Leaves:
        return Leaves(self.words, self.windows[lo:hi], self.counts[lo:hi])

    @classmethod
    def merged(cls, parts: list[Leaves]) -> Leaves:
        """One trie of several."""
        all_words = pa.concat_arrays([pa.array(p.words, pa.binary()) for p in parts])
        coded = all_words.dictionary_encode()
        words = coded.dictionary.to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(1, len(words) + 1)
        codes, at, windows = place[coded.indices.to_numpy()], 0, []
        for p in parts:
            table = np.concatenate([np.zeros(1, np.uint32), codes[at : at + len(p.words)]])
            windows.append(table[p.windows])
            at += len(p.words)
        return cls.sorted([words[i] for i in order], np.concatenate(windows), np.concatenate([p.counts for p in parts]))


def windows_of(texts: pa.Array) -> Leaves:
    """The sorted leaves of some texts of one label; null counts as empty."""
    body, offsets = raw(texts)
    mapped = BYTES[body]
    stop = BREAK[mapped]
    gap = stop | BLANK[mapped]
    edge = np.zeros(len(mapped) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
    ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    if not len(starts):
        return Leaves([], np.zeros((0, DEPTH), np.uint32), np.zeros(0, np.int64))
    # Words and what parts them alternate in these bounds.
    bounds = np.column_stack([starts, ends]).ravel()
    coded = pc.dictionary_encode(cut_array(mapped[: ends[-1]], bounds, pa.large_binary()).take(pa.array(np.arange(0, len(bounds) - 1, 2))))
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(1, len(words) + 1)
    codes = place[coded.indices.to_numpy()]
    # Words of one piece have as many stops and text edges before them.
    piece = np.cumsum(stop)[starts].astype(np.int64) + np.searchsorted(offsets, starts, "right")
    windows = np.zeros((len(codes), DEPTH), np.uint32)
    for d in range(DEPTH):
        n = len(codes) - d
        if n > 0:
            windows[:n, d] = np.where(piece[:n] == piece[d:], codes[d:], 0)
    return Leaves.sorted([words[i] for i in order], windows, np.ones(len(codes), np.int64))


def _tries(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, Leaves]]:
    """(label, trie) of each share: texts of one label, some megabytes at a time."""
    for batch in batches:
        labels = batch["lang"].dictionary_encode()
        codes = labels.indices.to_numpy()
        for k, label in enumerate(labels.dictionary.to_pylist()):
            for _, texts in slices(batch["text"].filter(pa.array(codes == k)), limit):
                trie = windows_of(texts)
                if len(trie.counts):
                    yield label, trie
                del trie
                trim()


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().cast("string").alias("text"))


def edges(docs: DataFrame, ranges: int) -> list[Key]:
    """Keys between prefix ranges of about equal numbers of leaves, from a bounded sample of documents."""
    if ranges < 2:
        return []
    rows = docs.count()
    drawn = docs.sample(min(1.0, SAMPLE_DOCUMENTS / max(1, rows)), 1)
    each = 16 * ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, trie in _tries(batches, 1 << 20):
            some = np.unique(np.linspace(0, len(trie.counts) - 1, min(len(trie.counts), max(64, each // 64))).astype(np.int64)).tolist()
            keys = [b" ".join(trie.key(i)) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array([int(trie.counts.sum()) / len(keys)] * len(keys), pa.float64())], ["lang", "key", "weight"])

    found = sorted(((r["lang"].encode(), tuple(bytes(r["key"]).split(b" "))), r["weight"]) for r in _labelled(drawn).mapInArrow(run, "lang string, key binary, weight double").collect())
    sums = np.cumsum([w for _, w in found])
    picked = np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges).tolist() if found else []
    return [(lang.decode(), key) for lang, key in sorted({found[i][0] for i in picked if i < len(found)})]


#: Order of windows as bytes: what parts words is less than any byte of a word. Bytes 9 to 13 and 32 are in no word.
ORDER = bytes([*range(1, 10), 0, *range(10, 256)])


def _sent(docs: DataFrame, cuts: list[Key], limit: int) -> DataFrame:
    """range, first (the order of blocks), lang and a serialised block: each share's trie, cut at the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_label: dict[str, list[tuple[int, tuple[bytes, ...]]]] = {}
        for i, (label, key) in enumerate(cuts, 1):
            of_label.setdefault(label, []).append((i, key))
        labels = [label.encode() for label, _ in cuts]
        for label, trie in _tries(batches, limit):
            # Range i holds what lies from edge i on; a label without edges lies in the range of the last edge before it.
            at = [(bisect_left(labels, label.encode()), 0)] + [(i, trie.find(key)) for i, key in of_label.get(label, [])]
            columns: list[list] = [[] for _ in range(6)]
            for (number, lo), hi in zip(at, [*(x[1] for x in at[1:]), len(trie.counts)], strict=True):
                for a in range(lo, hi, BLOCK_LEAVES):
                    first = b"\t".join(trie.key(a)).translate(ORDER)
                    for column, value in zip(columns, (number, first, *trie.dump(a, min(hi, a + BLOCK_LEAVES))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([label] * len(columns[0]), pa.string()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["range", "lang", "first", "words", "depths", "levels", "counts"])

    return _labelled(docs).mapInArrow(run, "range int, lang string, first binary, words binary, depths binary, levels binary, counts binary")


def nodes(leaves: Leaves, least: int) -> Iterator[tuple[bytes, int, int, list[int | None], bool]]:
    """(phrase, depth, count, counts of its first 1, 2, ... words, open) of the nodes of some leaves that no other leaves stand between.

    Nodes on the first and the last path may go on elsewhere: these are open, and given whatever their count.
    """
    shared = leaves.shared()
    yield b"", 0, int(leaves.counts.sum()), [], True
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(DEPTH):
        starts = np.flatnonzero(shared <= d)
        sums = np.add.reduceat(leaves.counts, starts)
        edge = np.zeros(len(starts), bool)
        edge[[0, -1]] = True
        kept = np.flatnonzero((leaves.windows[starts, d] > 0) & (edge | (sums >= least)))
        above = [(s[x := np.searchsorted(begun, starts[kept], "right") - 1].tolist(), x.tolist(), len(begun) - 1) for begun, s in levels]
        levels.append((starts, sums))
        for n, (i, row) in enumerate(zip(kept.tolist(), leaves.windows[starts[kept]].tolist(), strict=True)):
            lefts = [None if at[n] in (0, last) else counts[n] for counts, at, last in above]
            yield b" ".join([leaves.words[c - 1] for c in row[: d + 1]]), d + 1, int(sums[i]), lefts, bool(edge[i])


def _merge(sent: DataFrame, partitions: int, least: int, merge_leaves: int) -> DataFrame:
    """lang, phrase, depth, a, lefts and open, the blocks of each range merged in their order."""
    schema = "lang string, phrase string, depth int, a long, lefts array<long>, open boolean"

    def batch_of(label: str, leaves: Leaves) -> pa.RecordBatch:
        phrases, depths, counts, lefts, edge = zip(*nodes(leaves, least), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([label] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(depths, pa.int32()), pa.array(counts, pa.int64()), pa.array(lefts, pa.list_(pa.int64())), pa.array(edge, pa.bool_())], ["lang", "phrase", "depth", "a", "lefts", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size = None, [], 0
        for batch in batches:
            for number, label, *block in zip(*(batch[c].to_pylist() for c in ("range", "lang", "words", "depths", "levels", "counts")), strict=True):
                leaves = Leaves.load(*block)
                if held and place != (number, label):
                    yield batch_of(place[1], Leaves.merged(held))
                    held, size = [], 0
                    trim()
                if size >= merge_leaves:
                    whole = Leaves.merged(held)
                    # What lies before the next block's first window is complete; blocks come in their order.
                    if cut := whole.find(leaves.key(0)):
                        yield batch_of(label, whole.slice(0, cut))
                    held = [whole.slice(cut, len(whole.counts))] if cut < len(whole.counts) else []
                    size = sum(len(x.counts) for x in held)
                    trim()
                place = (number, label)
                held.append(leaves)
                size += len(leaves.counts)
        if held:
            yield batch_of(place[1], Leaves.merged(held))
        trim()

    return sent.repartition(partitions, "range", "lang").sortWithinPartitions("range", "lang", "first").mapInArrow(run, schema)


def phrase_counts(docs: DataFrame, least: int = LEAST, trie_bytes: int = TRIE_BYTES, ranges: int | None = None, merge_leaves: int = MERGE_LEAVES) -> DataFrame:
    """lang, phrase, depth, a (all occurrences within pieces) and lefts (of its first words, null where an edge cuts that node) of all
    phrases of up to DEPTH words with a >= least, and one row of depth 0 a label whose a is the number of its words. A written table."""
    partitions = partitions_for(docs, RANGE_BYTES)
    if ranges is None:
        ranges = min(MOST_RANGES, max(partitions, 3 * -(-input_bytes(docs) // RANGE_BYTES)))
    merged = written(_merge(_sent(docs, edges(docs, ranges), trie_bytes), partitions, least, merge_leaves), "tries")
    cut = merged.where("open").groupBy("lang", "phrase", "depth").agg(F.sum("a").alias("a"))
    cut = cut.where((F.col("a") >= least) | (F.col("depth") == 0)).withColumn("lefts", F.expr("if(depth > 1, array_repeat(cast(null as bigint), depth - 1), array())"))
    out = written(merged.where(~F.col("open")).drop("open").unionByName(cut.select("lang", "phrase", "depth", "a", "lefts")), "phrases")
    dropped(merged)
    return out


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each label's first phrases of two words or more."""
    counted = phrase_counts(docs, least, **sizes)
    phrases = counted.where("depth > 0")
    words = F.split("phrase", " ")
    candidates = phrases.where("depth > 1").withColumn("w", words)
    # The walk has most left parts; those that an edge cuts through are few, and joined.
    cuts = candidates.select("lang", "phrase", "a", F.posexplode("lefts").alias("k", "l"), "w").select("lang", "phrase", "a", (F.col("k") + 1).alias("k"), "l", F.expr("array_join(slice(w, 1, k + 1), ' ')").alias("left"), F.expr("array_join(slice(w, k + 2, size(w)), ' ')").alias("rest"))
    parts = phrases.where(f"depth < {DEPTH}").select("lang", "phrase", "a", F.expr("forall(lefts, x -> x is null)").alias("edge"))
    lefts = parts.where("edge").select("lang", F.col("phrase").alias("left"), F.col("a").alias("joined"))
    known = cuts.where("l is not null").drop("left").unionByName(cuts.where("l is null").drop("l").join(lefts, ["lang", "left"]).drop("left").withColumnRenamed("joined", "l"))
    both = known.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    scored = both.withColumn("score", F.expr("(2000000 * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every phrase tells its greatest count to the phrases within it.
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = candidates.where("depth > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * cast(longer as decimal(19, 0)) < {share} * cast(a as decimal(19, 0))"))
    ranked = kept.select("lang", "phrase", "a", "best.score", "best.l", "best.r").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    totals = counted.where("depth = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
