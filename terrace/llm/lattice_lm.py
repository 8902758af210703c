"""LM scoring by subword lattice likelihood.

The pieces are an existing tokenizer's vocabulary, byte pieces included, so every word has at least
one segmentation. A word's lattice probability is the sum over all segmentations of the products of
their pieces' probabilities: a forward recursion in log space over each distinct word. The file's
scores are merge ranks; taken as a power law they start the piece probabilities, which a few rounds of
expectation and maximisation fit to the distinct training words, since the lattice is there for words
that are rare or new.

Words seen in training get an absolute discount of their count, and what is taken off goes to all words
by the lattice. Training documents fall into classes by a label (their language); a class mixes its own
counts with that mean. Around its class's mean a document has a word distribution of its own with a
Dirichlet prior, so a word that it repeats costs less each time. The score is the marginal over class
and distribution; labels are never read when a document is scored. The number of words is geometric, up
to one end. The prior's weight is the best of CONCENTRATIONS for the training documents, each word's
count taken without the document's own.

Words meet their counts in buckets by hash: a task sends a blob a bucket with the distinct words of its
slice and their counts. For scoring, rows are dealt into chunks; a chunk asks each bucket for its
distinct words and gets their lattice probabilities and counts in the same order. What crosses the
shuffle follows the words, not documents times buckets; the model is as large as the vocabulary.

Defined results: null text counts as empty and has the end token alone; rows equal in doc_id and text
have equal results and each counts in training; a null doc_id counts as empty text in the split;
without training rows counts are 0 and pieces keep their first scores; without a label column there is
one class; words of any length are scored whole; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import input_bytes, quoted, text_or_empty, trim, written
from terrace.llm.key_counts import pack, unpack
from terrace.llm.words import LOWER, slices, word_codes

ROUNDS = 4
#: Weights of the prior that are tried, in words.
CONCENTRATIONS = (30, 60, 120, 240, 480, 960, 3840, 15360)
#: Pseudo-counts of a piece, so that none vanishes.
PRIOR = 0.01
#: Classes kept apart, the most frequent; other labels share one. Weight of the common mean within a class, in words.
CLASSES, SHARED = 12, 2000.0
#: Words of more bytes are taken one by one, in the pieces' fit as in the scores.
LONG = 256
BUCKET_BYTES = 8 << 20
LINE = 32  # the byte that stands for a word's start; no word holds a blank
_K = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Pieces:
    """Vocabulary pieces as bytes: hashes in ascending order, and the number of each single byte. begun: hashes of the pieces and
    of what they begin with, ascending, each with its piece in whole (-1: a beginning only)."""

    hashes: np.ndarray
    number: np.ndarray
    byte: np.ndarray
    longest: int
    begun: np.ndarray
    whole: np.ndarray
    first: np.ndarray  # probabilities from the file's ranks

    @classmethod
    def of(cls, path: str) -> Pieces:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, weights = [], []
        for i in range(file.get_piece_size()):
            if file.is_byte(i):
                texts.append(bytes([int(file.id_to_piece(i)[3:5], 16)]))
            elif file.is_control(i) or file.is_unknown(i) or file.is_unused(i):
                continue
            else:
                texts.append(file.id_to_piece(i).replace("▁", " ").encode())
            weights.append(1.0 / (2.0 - file.get_score(i)))
        best: dict[bytes, float] = {}
        for t, w in zip(texts, weights, strict=True):
            best[t] = max(w, best.get(t, 0.0))
        best[b" "] = best.get(b" ", 1e-6)
        texts = sorted(best)
        hashes = np.array([cls.hash_of(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        known = {t[:n]: -1 for t in texts for n in range(1, len(t))} | {t: i for i, t in enumerate(texts)}
        begun, whole = np.array([cls.hash_of(t) for t in known], np.uint64), np.array(list(known.values()), np.int64)
        by_hash = np.argsort(begun)
        byte = np.zeros(256, np.int64)
        for i, t in enumerate(texts):
            if len(t) == 1:
                byte[t[0]] = i
        p = np.array([best[t] for t in texts])
        return cls(hashes[order], order, byte, max(map(len, texts)), begun[by_hash], whole[by_hash], p / p.sum())

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes a piece has or begins with, the piece of each of these or -1)."""
        at = np.minimum(np.searchsorted(self.begun, h), len(self.begun) - 1)
        known = np.flatnonzero(self.begun[at] == h)
        return known, self.whole[at[known]]

    @staticmethod
    def hash_of(text: bytes) -> int:
        h = 0
        for b in text:
            h = (h * int(_K) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the words of one length, their bytes as a matrix), each with the start byte before it."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, (1 << 20) // (int(size) + 1))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            matrix = np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), size)
            yield some, np.concatenate([np.full((len(some), 1), LINE, np.uint8), matrix], axis=1)


def arcs(pieces: Pieces, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, piece of each) of all pieces in the rows, by ascending `to` within a `from`."""
    n, size = matrix.shape
    rows = np.arange(n)
    for i in range(size):
        yield i, i + 1, rows, pieces.byte[matrix[:, i]]
        live, h = rows, matrix[:, i].astype(np.uint64) + np.uint64(1)
        for j in range(i + 2, min(size, i + pieces.longest) + 1):
            h = h * _K + matrix[live, j - 1] + np.uint64(1)
            known, piece = pieces.found(h)
            live, h, hit = live[known], h[known], piece >= 0
            if not len(live):
                break
            if hit.any():
                yield i, j, live[hit], piece[hit]


def forward(found: list, logs: np.ndarray, n: int, size: int) -> np.ndarray:
    a = np.full((size + 1, n), -np.inf)
    a[0] = 0.0
    for i, j, rows, piece in found:
        a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + logs[piece])
    return a


def long_word_arcs(pieces: Pieces, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, piece) of all pieces in one word, found at all its places at once; by ascending `to`."""
    text = np.concatenate([np.array([LINE], np.uint8), np.frombuffer(word, np.uint8)])
    starts, ends, found = [np.arange(len(text))], [np.arange(1, len(text) + 1)], [pieces.byte[text]]
    live, h = starts[0], text.astype(np.uint64) + np.uint64(1)
    for size in range(2, min(len(text), pieces.longest) + 1):
        inside = live + size <= len(text)
        live = live[inside]
        h = h[inside] * _K + text[live + size - 1] + np.uint64(1)
        known, piece = pieces.found(h)
        live, h, hit = live[known], h[known], piece >= 0
        starts.append(live[hit])
        ends.append(live[hit] + size)
        found.append(piece[hit])
    start, end, piece = (np.concatenate(x) for x in (starts, ends, found))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], piece[order]


def place_by_place(into: np.ndarray, other: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Log sums at the places 0 to size: 0 at the first, then those of the arcs into a place (ascending) from their other places."""
    bounds = np.searchsorted(into, np.arange(1, size + 2)).tolist()
    other, weight = other.tolist(), weight.tolist()
    a = [0.0] * (size + 1)
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        parts = [a[other[k]] + weight[k] for k in range(lo, hi)]
        most = max(parts)
        a[i] = most + log(sum(exp(x - most) for x in parts))
    return np.array(a)


def long_word_log(pieces: Pieces, logs: np.ndarray, word: bytes) -> float:
    """As word_logs() of one long word."""
    start, end, piece = long_word_arcs(pieces, word)
    return float(place_by_place(end, start, logs[piece], len(word) + 1)[-1])


def long_word_uses(pieces: Pieces, logs: np.ndarray, word: bytes) -> np.ndarray:
    """As expected() of one long word that occurs once."""
    start, end, piece = long_word_arcs(pieces, word)
    size = len(word) + 1
    a = place_by_place(end, start, logs[piece], size)
    back = np.argsort(-start, kind="stable")
    b = place_by_place(size - start[back], size - end[back], logs[piece[back]], size)[::-1]
    return np.bincount(piece, np.exp(a[start] + logs[piece] + b[end] - a[-1]), len(logs))


def word_logs(pieces: Pieces, logs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural logarithm of each word's probability, all segmentations together."""
    out = np.zeros(len(words))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for at, matrix in by_length([words[i] for i in short]):
        out[np.array(short)[at]] = forward(list(arcs(pieces, matrix)), logs, *matrix.shape)[-1]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_word_log(pieces, logs, w)
    return out


def expected(pieces: Pieces, logs: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur counts times."""
    out = np.zeros(len(logs))
    short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
    for i, w in enumerate(words):
        if len(w) > LONG:
            out += counts[i] * long_word_uses(pieces, logs, w)
    for at, matrix in by_length([words[i] for i in short]):
        at = short[at]
        n, size = matrix.shape
        found = list(arcs(pieces, matrix))
        a = forward(found, logs, n, size)
        b = np.full((size + 1, n), -np.inf)
        b[size] = 0.0
        for i, j, rows, piece in reversed(found):
            b[i, rows] = np.logaddexp(b[i, rows], logs[piece] + b[j, rows])
        for i, j, rows, piece in found:
            share = np.exp(a[i, rows] + logs[piece] + b[j, rows] - a[size, rows]) * counts[at[rows]]
            out += np.bincount(piece, share, len(logs))
    return out


def _stirling(x: np.ndarray) -> np.ndarray:
    """ln of gamma(x) for x of 8 or more."""
    y = 1.0 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def rising_rest(p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """ln of (p + 1) ... (p + times - 1): all but the first factor, which doesn't hang on times. Quickest where times descend."""
    if (times[1:] > times[:-1]).any():
        order, out = np.argsort(-times, kind="stable"), np.empty(len(p))
        out[order] = rising_rest(p[order], times[order])
        return out
    more = np.searchsorted(-times, -np.arange(9))  # how many have more than k
    out = np.ones(len(p))
    for k in range(1, 8):
        out[: more[k]] *= p[: more[k]] + k
    out = np.log(out)
    far = slice(0, more[8])
    out[far] += _stirling(p[far] + times[far]) - _stirling(p[far] + 8)
    return out


@dataclass
class Discount:
    """Mean probabilities of words: discounted counts, the rest by the lattice. n words, v of them distinct."""

    n: int
    v: int
    once: int
    twice: int

    sizes: np.ndarray  # training words of each class

    def mean(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        if not self.n:
            return lattice
        d = self.once / (self.once + 2 * self.twice) if self.once else 0.5
        return np.maximum(np.maximum(counts - d, 0) / self.n + d * self.v / self.n * lattice, 1e-300)

    def of_class(self, k: int, counts: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return (counts + SHARED * mean) / (self.sizes[k] + SHARED)


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def _ordered(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(number of each word of all texts, bounds of the texts, the distinct words by bucket and then bytes, bounds of the buckets)."""
    codes, bounds, words = word_codes(texts, LOWER)
    words = words.cast(pa.large_binary())
    first = pc.sort_indices(words).to_numpy()
    by_bytes = words.take(pa.array(first)).to_pylist()
    bucket = np.array([xxhash.xxh3_64_intdigest(w) for w in by_bytes], np.uint64) % np.uint64(buckets)
    then = np.argsort(bucket, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[first[then]] = np.arange(len(first))
    edges = np.searchsorted(bucket[then], np.arange(buckets + 1, dtype=np.uint64))
    return rank[codes] if len(codes) else codes.astype(np.int64), bounds, [by_bytes[i] for i in then], edges


def _sent(words: list[bytes], edges: np.ndarray, **more: np.ndarray) -> dict[str, list]:
    """Columns of a row a bucket that has words."""
    some = [b for b in range(len(edges) - 1) if edges[b] < edges[b + 1]]
    cut = lambda x, b: x[edges[b] : edges[b + 1]]
    return {"bucket": some, "words": [b" ".join(cut(words, b)) for b in some]} | {k: [pack(cut(v, b).ravel()) for b in some] for k, v in more.items()}


def _word_table(rows: DataFrame, buckets: int, classes: int) -> DataFrame:
    """train (0: held out, else the class from 1 on), text -> one row a bucket: training words, their counts by class, totals."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch["text"]):
                train = np.array(batch["train"].slice(lo, len(texts)).to_pylist(), np.int64)
                codes, bounds, words, edges = _ordered(texts, buckets)
                of_class = np.repeat(train, np.diff(bounds))
                counts = np.bincount(codes * (classes + 1) + of_class, minlength=len(words) * (classes + 1)).reshape(-1, classes + 1)[:, 1:]
                out = _sent(words, edges, counts=counts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["words"], pa.binary()), pa.array(out["counts"], pa.binary())], ["bucket", "words", "counts"])
            trim()

    def meet(table: pa.Table) -> pa.Table:
        coded = pa.array([w for x in table["words"].to_pylist() for w in x.split(b" ")], pa.binary()).dictionary_encode()
        counts = np.concatenate([unpack(x, "i8").reshape(-1, classes) for x in table["counts"].to_pylist()])
        number = coded.indices.to_numpy()
        merged = np.stack([np.bincount(number, counts[:, k], len(coded.dictionary)).astype(np.int64) for k in range(classes)], axis=1)
        known = np.flatnonzero(merged.any(axis=1))
        merged, total = merged[known], merged[known].sum(axis=1)
        words = coded.dictionary.take(pa.array(known)).to_pylist()
        totals = {k: pa.array([int(f.sum())]) for k, f in (("distinct", total > 0), ("once", total == 1), ("twice", total == 2))}
        out = {"bucket": table["bucket"].slice(0, 1).combine_chunks(), "words": pa.array([b" ".join(words)], pa.binary()), "counts": pa.array([pack(merged.ravel())], pa.binary()), "tokens": pa.array([merged.sum(axis=0).tolist()], pa.list_(pa.int64()))}
        return pa.table(out | totals)

    sent = rows.select("train", "text").mapInArrow(send, "bucket int, words binary, counts binary")
    return written(sent.groupBy("bucket").applyInArrow(meet, "bucket int, words binary, counts binary, tokens array<long>, distinct long, once long, twice long"), "words")


def fit(table: DataFrame, pieces: Pieces, documents: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, fitted to the words and counts of table."""
    p = pieces.first
    for _ in range(rounds if documents else 0):
        sent = table.sparkSession.sparkContext.broadcast((pieces, np.log(p)))  # as large as the vocabulary

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, logs = sent.value
            total = np.zeros(len(logs))
            for batch in batches:
                for words, counts in zip(batch["words"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                    words = words.split(b" ") if words else []
                    if not words:
                        continue
                    counts = unpack(counts, "i8").reshape(len(words), -1).sum(axis=1)
                    some = np.flatnonzero(counts).tolist()
                    total += expected(own, logs, [words[i] for i in some], np.ones(len(some)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        uses = np.full(len(p), PRIOR)
        for r in table.select("words", "counts").mapInArrow(step, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row a piece
            uses[r["piece"]] += r["uses"]
        p = uses / uses.sum()
        sent.unpersist()
    return np.log(p)


def scores(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, label: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"), (F.coalesce(F.col(quoted(label)).cast("string"), F.lit("")) if label in docs.columns else F.lit("")).alias("label")).withColumn("held_out", held_out())
    learned = rows.where(~F.col("held_out"))
    frequent = learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(CLASSES)
    labels = sorted(r["label"] for r in frequent.collect())  # CLASSES rows at most
    classes, training = len(labels) + 1, learned.count()
    place = F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col("label")), F.lit(0)) if labels else F.lit(0)
    buckets = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    rows = rows.select("doc_id", "held_out", "text", F.when(F.col("held_out"), 0).when(place == 0, classes).otherwise(place).cast("int").alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("chunk"))
    table = _word_table(rows, buckets, classes)
    total = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "once", "twice")), *(F.coalesce(F.sum(F.col("tokens")[k]), F.lit(0)).alias(f"c{k}") for k in range(classes))).first()
    sizes = np.array([total[f"c{k}"] for k in range(classes)], np.int64)
    in_words = int(sizes.sum())
    n, v = in_words + training, total["distinct"] + (training > 0)
    mean = Discount(in_words, total["distinct"], total["once"], total["twice"], sizes)
    prior = np.log((sizes + 1) / (sizes + 1).sum())
    stop = training / (in_words + training) if training and in_words else 0.5
    pieces = Pieces.of(vocabulary)
    logs = fit(table, pieces, training, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, logs))  # as large as the vocabulary

    def ask(chunk: pa.Table) -> pa.Table:
        _, _, words, edges = _ordered(chunk["text"].combine_chunks(), buckets)
        out = _sent(words, edges)
        number = chunk["chunk"][0].as_py()
        trim()
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array([number] * len(out["bucket"]), pa.int32()), "words": pa.array(out["words"], pa.binary())})

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "lattice": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        own, model = sent.value
        parts = [x.split(b" ") for x in asked["words"].to_pylist()]
        mine = [w for x in known["words"].to_pylist() if x for w in x.split(b" ")]
        coded = pa.array(mine + [w for x in parts for w in x], pa.binary()).dictionary_encode()
        number = coded.indices.to_numpy()
        counts = np.zeros((len(coded.dictionary), classes), np.int64)
        if mine:
            counts[number[: len(mine)]] = unpack(known["counts"][0].as_py(), "i8").reshape(-1, classes)
        lattice = word_logs(own, model, coded.dictionary.to_pylist())
        at, told, times = len(mine), [], []
        for x in parts:
            some = number[at : at + len(x)]
            told.append(lattice[some].tobytes())
            times.append(pack(counts[some].ravel()))
            at += len(x)
        trim()
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "lattice": pa.array(told, pa.binary()), "counts": pa.array(times, pa.binary())})

    def score(chunk: pa.Table, told: pa.Table) -> pa.Table:
        texts, told = chunk["text"].combine_chunks(), told.sort_by("bucket")
        codes, bounds, words, _ = _ordered(texts, buckets)
        size = len(texts)
        words_of = np.diff(bounds)
        lattice = np.exp(np.frombuffer(b"".join(told["lattice"].to_pylist()), float)) if len(words) else np.zeros(0)
        counts = np.concatenate([unpack(x, "i8").reshape(-1, classes) for x in told["counts"].to_pylist()]) if len(words) else np.zeros((0, classes), np.int64)
        pairs, times = np.unique(np.repeat(np.arange(size), words_of) * max(1, len(words)) + codes, return_counts=True)
        doc, word = np.divmod(pairs, max(1, len(words)))
        summed = lambda x: np.bincount(doc, x, size).astype(float)
        every = counts.sum(axis=1)
        p = mean.mean(every, lattice)
        by_class = [mean.of_class(k, counts[:, k], p) for k in range(classes)]
        kind = np.array(chunk["train"].to_pylist(), np.int64)
        mine = np.flatnonzero(kind[doc] > 0)
        k, w, m = kind[doc[mine]] - 1, word[mine], times[mine]
        left = mean.of_class(k, counts[w, k] - m, mean.mean(every[w] - m, lattice[w]))
        ends = words_of * np.log1p(-stop) + np.log(stop)
        out = {"doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "words": pa.array(words_of.astype(np.int64)), "known": pa.array(summed((every[word] > 0) * times)), "base": pa.array(summed(np.log10(every[word] + 1.0) * times))}
        # A word's first factor is a * q, so its logarithms are summed once for all weights; only repeated words need each weight.
        repeated, again = (np.argsort(-x, kind="stable")[: np.count_nonzero(x > 1)] for x in (times, m))
        distinct, distinct_left = np.bincount(doc, minlength=size), np.bincount(doc[mine], minlength=size)
        first, first_left = [prior[c] + summed(np.log(q)[word]) for c, q in enumerate(by_class)], np.bincount(doc[mine], np.log(left), size)
        for i, a in enumerate(CONCENTRATIONS):
            length = np.array([lgamma(a) - lgamma(a + x) for x in words_of])
            rest = lambda q, a=a: np.bincount(doc[repeated], rising_rest(a * q[word[repeated]], times[repeated]), size)
            each = np.stack([first[c] + np.log(a) * distinct + rest(q) for c, q in enumerate(by_class)])
            most = each.max(axis=0)
            out[f"s{i}"] = pa.array(most + np.log(np.exp(each - most).sum(axis=0)) + length + ends)
            gain = first_left + np.log(a) * distinct_left + np.bincount(doc[mine[again]], rising_rest(a * left[again], m[again]), size)
            out[f"l{i}"] = pa.array(np.where(kind > 0, gain + length, 0.0))
        trim()
        return pa.table(out)

    asks = rows.select("doc_id", "held_out", "text", "train", "chunk").groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, words binary")
    told = asks.groupBy("bucket").cogroup(table.select("bucket", "words", "counts").groupBy("bucket")).applyInArrow(reply, "chunk int, bucket int, lattice binary, counts binary")
    fields = [f"{c}{i} double" for i in range(len(CONCENTRATIONS)) for c in "sl"]
    scored = rows.select("doc_id", "held_out", "text", "train", "chunk").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, ", ".join(["doc_id long, held_out boolean, words long, known double, base double", *fields]))
    scored = written(scored, "scored")
    best = scored.agg(*(F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in range(len(CONCENTRATIONS)))).first()
    i = max(range(len(CONCENTRATIONS)), key=lambda j: best[f"l{j}"])
    tokens = F.col("words") + 1
    base = F.col("base") + float(np.log10(training + 1)) - tokens * float(np.log10(n + v + 1))
    known = F.round("known").cast("long") + (1 if training else 0)
    return scored.select("doc_id", "held_out", tokens.alias("n_tokens"), known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col(f"s{i}") / float(np.log(10))).alias("score"))
