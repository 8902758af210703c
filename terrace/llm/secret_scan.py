"""Secret scans: three plain patterns, and character Markov models that add what these miss.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers,
are trained from labelled strings: generated random ones in common alphabets, and the words of all
documents. Runs under LEAST_RUN characters, too short for a key, make the first ordinary model,
alone and joined as identifiers join words; the longer runs that this model calls ordinary join them, so
that keys in the documents neither train the model nor move the threshold.

Of a run of LEAST_RUN characters or more, a segment of at least so many is a secret when its mean
log-likelihood ratio exceeds a threshold between the tails of the ordinary and the generated strings; the
one that exceeds it most is taken, widened to the next separators, and what lies left and right of it is
looked at again. Runs are scored whole, plain spans included, and a segment's parts outside of plain
spans are added.

Defined results: null text counts as empty and has no spans; an added span never overlaps a plain
one; repeated rows get equal spans; an empty table trains on the generated strings alone; a column
``spans`` of the input is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import by_arrow, trim
from terrace.llm.words import ragged, raw, slices

# The plain patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "markov")

SLICE_BYTES = 4 << 20
#: Characters of the shortest run that is scored and of the shortest random string.
LEAST_RUN = 12
ANY_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_RUN},}}")
#: What is ordinary by its form: UUIDs, and words between separators that are too short to be scored by themselves.
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
WORD_PIECE = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z0-9])")
SEPARATORS = "+/_.=-"
#: Characters of the shortest run that trains.
LEAST_WORD = 4
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
START = len(ALPHABET)
SIZE = START + 1
SEPARATED = ALPHABET.index(SEPARATORS[0])  # codes from here on are separators, or the start
CODE_OF_BYTE = np.concatenate([CODE, np.full(128, START)])
LOWERED, RAISED = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
RAISED[97:123] -= 32

#: Generated strings: the random class, whatever the documents are.
RANDOM_STRINGS = 4000
#: Histogram of ratios a character of ordinary runs' best segments, and the share of them that the threshold leaves above it.
RATIO_BINS = np.linspace(-4, 4, 801)
TAIL = 1e-4
#: The share of generated strings that lie below their tail.
RANDOM_TAIL = 0.01
#: Where the threshold lies between the ordinary tail (0) and the random one (1): a key that is missed costs more than a word.
ABOVE_ORDINARY = 0.25
#: The most that one pair counts, in nats.
MOST_GAIN = 2.0
#: No threshold is lower; in nats a character.
LEAST_RATIO = 0.25


def assignments(text: str) -> Iterator[re.Match]:
    """ASSIGN.finditer(text), tried only where one of its names begins."""
    low = text.lower()
    if len(low) != len(text):  # a letter that has no lower case of its length
        yield from ASSIGN.finditer(text)
        return
    at, last = [], 0
    for name in NAMES:
        place = low.find(name)
        while place >= 0:
            at.append(place)
            place = low.find(name, place + 1)
    for place in sorted(at):
        if place >= last and (m := ASSIGN.match(text, place)):
            last = m.end()
            yield m


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in assignments(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if ANY_RUN.search(text):
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        for run in ANY_RUN.finditer(text):
            found += [(m.start() + run.start(), m.end() + run.start(), 2) for m in HEX.finditer(run[0]) if m.end() - m.start() >= LEAST["hex"]]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def random_strings() -> list[str]:
    """The labelled random class: digits of SHA-256 in the alphabets that keys are written in."""
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:26], ALPHABET[:52])
    out = []
    for i in range(RANDOM_STRINGS):
        digest = hashlib.sha256(f"random string {i}".encode()).digest() * 2
        letters = alphabets[i % len(alphabets)]
        out.append("".join(letters[b % len(letters)] for b in digest[: LEAST_RUN + i % 33]))
    return out


def strung(strings: list[str]) -> np.ndarray:
    """The strings' bytes, a zero before each."""
    return np.frombuffer("".join(f"\0{x}" for x in strings).encode("ascii"), np.uint8)


def pair_counts(flat: np.ndarray) -> np.ndarray:
    """Counts of (character before, character) in strung strings, from a start symbol on."""
    codes = CODE[flat]
    counts = np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    counts[:, START] = 0
    return counts


@dataclass
class Markov:
    """Log-likelihood ratios of pairs, random over ordinary, and the threshold a character."""

    ratios: np.ndarray
    threshold: float

    def gains(self, run: str) -> np.ndarray:
        """The ratio of each character after the one before; odd pairs and separators don't make a run random by themselves."""
        words = list(WORD_PIECE.finditer(run))
        # Capitals alone are a word's letters like any: text has few, so that they tell nothing.
        told = list(run)
        for m in words:
            if m[0].isupper():
                told[m.start() : m.end()] = m[0].lower()
        codes = CODE[np.frombuffer(("\0" + "".join(told)).encode("ascii"), np.uint8)]
        gains = np.minimum(self.ratios[codes[:-1], codes[1:]], MOST_GAIN)
        seam = codes >= SEPARATED
        gains = np.where(seam[:-1] | seam[1:], np.minimum(gains, 0.0), gains)
        for m in words:
            if len(m[0]) < LEAST_RUN:
                gains[m.start() : m.end()] = np.minimum(gains[m.start() : m.end()], 0.0)
        for m in UUID.finditer(run):
            gains[m.start() : m.end()] = -MOST_GAIN
        return gains

    def all_gains(self, flat: np.ndarray) -> np.ndarray:
        """gains() of many strung strings at once; 0 at the zeros before them."""
        codes = CODE[flat]
        letter = codes < SEPARATED
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        upper = (flat >= 65) & (flat <= 90)
        told, tame = flat, np.zeros(len(flat), bool)
        if len(starts):
            # A part goes to the next one's start; separators in it count as nothing and are no gain anyway.
            total = lambda x: np.add.reduceat(x, starts, dtype=np.int64)
            size, digits, capitals = total(letter), total((flat >= 48) & (flat <= 57)), total(upper)
            shout = (digits == 0) & (capitals == size)
            word = (digits == 0) & ((capitals == 0) | shout | ((capitals == 1) & upper[starts]))
            spans = np.diff(np.append(starts, len(flat)))
            tame[starts[0] :] = np.repeat(word & (size < LEAST_RUN), spans)
            if shout.any():
                told = flat.copy()
                told[starts[0] :] = np.where(np.repeat(shout, spans), LOWERED[flat[starts[0] :]], flat[starts[0] :])
                codes = CODE[told]
        gains = np.zeros(len(flat))
        gains[1:] = np.minimum(self.ratios.ravel()[codes[:-1] * SIZE + codes[1:]], MOST_GAIN)
        tame[1:] |= (codes[:-1] >= SEPARATED) | (codes[1:] >= SEPARATED)
        gains[tame] = np.minimum(gains[tame], 0.0)
        if np.count_nonzero(flat == ord("-")) >= 4:
            for m in UUID.finditer(flat.tobytes().decode("ascii")):
                gains[m.start() : m.end()] = -MOST_GAIN
        gains[flat == 0] = 0.0
        return gains

    def segments(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the run's random segments, widened to separators, in ascending order."""
        gains, found, todo = self.gains(run), [], [(0, len(run))]
        while todo:
            lo, hi = todo.pop()
            over, a, b = best_segment(gains[lo:hi] - self.threshold)
            if over > 0:
                a, b = lo + a, lo + b
                while a > lo and run[a - 1] not in SEPARATORS and run[a] not in SEPARATORS:
                    a -= 1
                while b < hi and run[b] not in SEPARATORS and run[b - 1] not in SEPARATORS:
                    b += 1
                found.append((a, b))
                todo += [(lo, a), (b, hi)]
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Plain spans and those the models add."""
        base = plain_spans(text)
        added = []
        for m in ANY_RUN.finditer(text):
            for a, b in self.segments(m[0]):
                a, b = m.start() + a, m.start() + b
                for x, y, _ in base:
                    if x < b and a < y:
                        added += [(a, x, "markov")] if a < x else []
                        a = max(a, y)
                added += [(a, b, "markov")] if a < b else []
        return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]))) if added else base


def best_segment(gains: np.ndarray) -> tuple[float, int, int]:
    """(sum, start, end) of the segment of LEAST_RUN or more with the greatest sum; a sum of -inf where gains are fewer."""
    if len(gains) < LEAST_RUN:
        return -np.inf, 0, 0
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    least = np.minimum.accumulate(sums[: len(sums) - LEAST_RUN])
    b = int(np.argmax(sums[LEAST_RUN:] - least)) + LEAST_RUN
    a = int(np.argmin(sums[: b - LEAST_RUN + 1]))
    return float(sums[b] - sums[a]), a, b


def best_mean(gains: np.ndarray) -> float:
    """The greatest mean of a segment of LEAST_RUN or more; one of twice LEAST_RUN has a half that is no worse."""
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    return max((float((sums[n:] - sums[:-n]).max()) / n for n in range(LEAST_RUN, min(2 * LEAST_RUN, len(sums)))), default=-np.inf)


def best_means(gains: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """best_mean() of each gains[starts[i] : starts[i] + sizes[i]]."""
    out = np.full(len(starts), -np.inf)
    order = np.argsort(sizes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        size = int(sizes[at[0]])
        sums = np.zeros((len(at), size + 1))
        np.cumsum(gains[starts[at][:, None] + np.arange(size)], axis=1, out=sums[:, 1:])
        for n in range(LEAST_RUN, min(2 * LEAST_RUN, size + 1)):
            out[at] = np.maximum(out[at], (sums[:, n:] - sums[:, :-n]).max(axis=1) / n)
    return out


def ratios_of(ordinary: np.ndarray) -> np.ndarray:
    def logs(counts: np.ndarray) -> np.ndarray:
        smooth = counts + 0.5
        smooth[:, START] = 0
        return np.log(np.maximum(smooth / smooth.sum(axis=1, keepdims=True), 1e-12))

    return logs(pair_counts(strung(random_strings())).astype(float)) - logs(ordinary.astype(float))


class Runs:
    """The runs of a slice of texts that no plain span touches, as bytes."""

    def __init__(self, texts: pa.Array):
        _, offsets = raw(texts)
        text = "\n".join(x or "" for x in texts.to_pylist()).encode()  # no run and no plain span goes beyond a line
        self.body = np.frombuffer(text, np.uint8)
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = CODE_OF_BYTE[self.body] < START
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        some = ends - starts >= LEAST_WORD
        starts, ends = starts[some], ends[some]
        spans = plain_spans(text.decode("latin-1"))
        first, last = np.sort(np.array([a for a, _, _ in spans], np.int64)), np.sort(np.array([b for _, b, _ in spans], np.int64))
        free = np.searchsorted(first, ends) == np.searchsorted(last, starts, "right")
        self.starts, self.sizes = starts[free], (ends - starts)[free]
        self.texts = offsets[:-1] + np.arange(len(offsets) - 1)

    def strung(self, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Strings made of parts, each (places, sizes) in bytes(), a zero before each."""
        zero = (np.full(len(parts[0][0]), 3 * len(self.body)), np.ones(len(parts[0][0]), np.int64))
        starts, sizes = (np.stack([x[k] for x in (zero, *parts)], axis=1).ravel() for k in (0, 1))
        return ragged(self.bytes(), starts, sizes)

    def bytes(self) -> np.ndarray:
        """The texts, the same in lower case and in capitals, a zero and a low line."""
        return np.concatenate([self.body, LOWERED[self.body], RAISED[self.body], np.frombuffer(b"\0_", np.uint8)])

    def words(self) -> np.ndarray:
        short = self.sizes < LEAST_RUN
        return self.strung((self.starts[short], self.sizes[short]))

    def identifiers(self) -> np.ndarray:
        """Identifiers join words; the pairs at their seams are ordinary too. Of four words of a text two are joined by
        a capital and two by a low line."""
        short = self.sizes < LEAST_RUN
        starts, sizes, n = self.starts[short], self.sizes[short], len(self.body)
        text = np.searchsorted(self.texts, starts, "right") - 1
        place = (np.arange(len(starts)) - np.searchsorted(starts, self.texts)[text]) % 4
        joins = np.zeros(len(starts), bool)
        joins[:-1] = text[:-1] == text[1:]
        a, c = np.flatnonzero(joins & (place == 0)), np.flatnonzero(joins & (place == 2))
        one = np.ones(len(a), np.int64)
        camel = self.strung((starts[a], sizes[a]), (2 * n + starts[a + 1], one), (n + starts[a + 1] + 1, sizes[a + 1] - 1))
        snake = self.strung((starts[c], sizes[c]), (np.full(len(c), 3 * n + 1), np.ones(len(c), np.int64)), (starts[c + 1], sizes[c + 1]))
        return np.concatenate([camel, snake])

    def long(self, model: Markov) -> np.ndarray:
        """Runs as long as keys that the model calls ordinary in every segment."""
        at = self.sizes >= LEAST_RUN
        starts, sizes = self.starts[at], self.sizes[at]
        flat = self.strung((starts, sizes))
        ordinary = best_means(model.all_gains(flat), *cut(flat)) < 0
        return self.strung((starts[ordinary], sizes[ordinary]))


def cut(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes) of strung strings."""
    zeros = np.flatnonzero(flat == 0)
    return zeros + 1, np.diff(np.append(zeros, len(flat))) - 1


def train(docs: DataFrame) -> Markov:
    """Both models, from generated strings and from all texts of docs, counted on the executors."""
    rows = docs.select(F.col("text").cast("string").alias("text"))

    def counted(runs_of: Callable[[Runs], np.ndarray], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(size, np.int64)
            for batch in batches:
                for _, texts in slices(batch["text"], SLICE_BYTES):
                    counts += runs_of(Runs(texts)).ravel()
            at = np.flatnonzero(counts)
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

        return count

    def summed(runs_of: Callable[[Runs], np.ndarray], size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for r in rows.mapInArrow(counted(runs_of, size), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
            out[r["at"]] = r["n"]
        return out

    def pairs(runs_of: Callable[[Runs], np.ndarray]) -> np.ndarray:
        return summed(runs_of, SIZE * SIZE).reshape(SIZE, SIZE)

    short = pairs(lambda runs: pair_counts(runs.words()) + pair_counts(runs.identifiers()))
    first = Markov(ratios_of(short), 0.0)
    ratios = ratios_of(short + pairs(lambda runs: pair_counts(runs.long(first))))

    def tail(runs: Runs) -> np.ndarray:
        model, counts = Markov(ratios, 0.0), np.zeros(len(RATIO_BINS) + 1, np.int64)
        for flat in (runs.identifiers(), runs.long(first)):
            gains, (starts, sizes) = model.all_gains(flat), cut(flat)
            some = sizes >= LEAST_RUN
            # Means below LEAST_RATIO needn't be told apart: those that can't reach it all count in the lowest bin.
            gained = np.concatenate([[0.0], np.cumsum(np.maximum(gains, 0.0))])
            near = some & (gained[starts + sizes] - gained[starts] > (LEAST_RATIO - 1e-3) * LEAST_RUN)
            counts += np.bincount(np.digitize(best_means(gains, starts[near], sizes[near]), RATIO_BINS), minlength=len(counts))
            counts[0] += some.sum() - near.sum()
        return counts

    counts = summed(tail, len(RATIO_BINS) + 1)
    above = np.cumsum(counts[::-1])[::-1]
    over = np.flatnonzero(above > TAIL * max(1, counts.sum()))
    ordinary = max(LEAST_RATIO, float(RATIO_BINS[min(len(RATIO_BINS) - 1, over[-1])]) if len(over) else LEAST_RATIO)
    model = Markov(ratios, ordinary)
    # Between the tails of both classes, or where they meet the lower one, so that no documents hide all keys.
    generated = float(np.quantile([best_mean(model.gains(x)) for x in random_strings()], RANDOM_TAIL))
    return Markov(ratios, max(LEAST_RATIO, ordinary + (generated - ordinary) * ABOVE_ORDINARY if generated > ordinary else generated))


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, model: Markov) -> DataFrame:
    """docs with a column spans; the other columns stay."""
    kept = [c for c in docs.columns if c != "spans"]

    def work(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
        for lo, some in slices(texts, SLICE_BYTES):
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in model.spans(t.as_py())] if t.is_valid else [] for t in some]
            yield lo, len(some), {"spans": pa.array(found, _SPANS)}

    return by_arrow(docs, kept, "text", T.StructType.fromDDL(f"spans {SPANS}"), work)


def redacted(docs: DataFrame, model: Markov, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text, overlapping ones together, replaced by mark; rows and columns stay."""
    def clean(text: str | None) -> str | None:
        spans = model.spans(text) if text else []
        out, last = [], 0
        for a, b, _ in spans:
            if b > last:
                out += [text[last:a], mark] if a >= last else []
                last = b
        return "".join([*out, text[last:]]) if spans else text

    def work(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
        for lo, some in slices(texts, SLICE_BYTES):
            yield lo, len(some), {"text": pa.array([clean(t.as_py()) for t in some], texts.type)}

    return by_arrow(docs, docs.columns, "text", T.StructType([docs.schema["text"]]), work)


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the plain kinds, a digest of the plain spans and all spans as text."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs)).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return rows.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
