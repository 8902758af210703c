"""Language ID by interpolated Kneser-Ney character models.

A bounded sample of labelled documents is counted on the executors as four-grams of code points of a
language. From these the models of all orders follow on the driver: the highest order discounts counts,
lower orders discount the numbers of distinct characters before an n-gram, the lowest mixes with a
uniform share. Each order is a sorted array of hashed n-grams with its weights; whole code points go into
the hash, so no script is cut down to an alphabet. A text goes to the language of the lowest cross-entropy
a character; it is rejected when that exceeds what held-back training documents of the language reach.

Defined results: null text and text without letters is `und`, with score 0; ties go to the lesser
name; a null doc_id counts as empty text in the split; without any labelled row all is `und`; repeated
rows are counted as often as they occur; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import by_arrow, trim
from terrace.llm.ngram_join import mix
from terrace.llm.words import slices

ORDER = 4
DISCOUNT = 0.75
#: About so many documents of a language are learned from; one in five of them sets the threshold instead.
SAMPLE_DOCUMENTS = 1200
HOLD_BACK = 5
#: Rejection: the held-back quantile, and what is granted beyond it (nats a character; nats over the root of the length).
QUANTILE, SLACK, SHORT = 0.999, 0.75, 6.0
#: Characters that count for the score at most.
SCORED = 50
#: Texts that are worked on at a time; their windows, hashes and codes take about forty times as much for a moment.
SLICE_BYTES = 512 << 10
POINTS = 0x110000

_K = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(POINTS)])


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, 0 for what is no letter (one for a run), and the n + 1 bounds of the texts."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    points = np.where(letters()[points], points, 0)
    keep = (points != 0) | np.concatenate([[True], points[:-1] != 0])[: len(points)]
    return points[keep].astype(np.uint32), np.concatenate([[0], np.cumsum(keep)])[at]


def windows(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(characters, ORDER): each character and those before it, the nearest first; 0 stands before a text's first."""
    place = np.arange(len(points)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.zeros((len(points), ORDER), np.uint32)
    for k in range(ORDER):
        out[k:, k] = points[: len(points) - k]
        out[place < k, k] = 0
    return out


def hashed(grams: np.ndarray, order: int, context: bool = False) -> np.ndarray:
    """Of the last `order` characters of each row of grams, or of these without the last one."""
    h = np.full(len(grams), 2 * order + context, np.uint64)
    for k in range(order - 1, int(context) - 1, -1):
        h = mix(h * _K + grams[:, k] + np.uint64(1))
    return h


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct gram, the number of each row's gram)."""
    coded = pc.dictionary_encode(pa.array(hashed(grams, ORDER)))
    number = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return grams[first], number


class HashArray:
    """Numbers by hashed n-gram in ascending order of the hash; absent: 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        at = np.argsort(keys)
        self.keys, self.values = keys[at], values[at]

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class KneserNey:
    """Interpolated, of one language; its distinct four-grams, their counts, and the number of characters known in all."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, characters: int):
        self.grams, self.contexts, self.uniform = {}, {}, 1.0 / characters
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # distinct characters before each n-gram
                keys, first, counts = np.unique(hashed(grams, n), return_index=True, return_counts=True)
                grams = grams[first]
            else:
                keys = hashed(grams, n)
            of, total = np.unique(hashed(grams, n, True), return_inverse=True)
            sums, kinds = np.bincount(total, counts), np.bincount(total)
            self.grams[n] = HashArray(keys, np.maximum(counts - DISCOUNT, 0) / sums[total])
            self.contexts[n] = HashArray(of, DISCOUNT * kinds / sums)

    def log_probabilities(self, keys: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """keys: for each order the hashes of grams and of their contexts."""
        p = self.uniform
        for n in range(1, ORDER + 1):
            own, context = keys[n]
            back = self.contexts[n].get(context)
            p = self.grams[n].get(own) + np.where(back > 0, back, 1.0) * p  # an unseen context has no share: all falls back
        return np.log(p)


def keys_of(grams: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {n: (hashed(grams, n), hashed(grams, n, True)) for n in range(1, ORDER + 1)}


@dataclass
class Identifier:
    names: list[str]
    models: list[KneserNey]
    limits: np.ndarray

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies (text, language) in nats a character, and characters; none: no letter."""
        points, bounds = characters(texts)
        n = np.diff(bounds)
        has = np.add.reduceat(np.append(points != 0, 0).astype(np.int64), bounds[:-1])[: len(n)] if len(n) else n
        has = np.where(n > 0, has, 0)
        out = np.full((len(n), len(self.names)), np.inf)
        if not len(points):
            return out, np.zeros(len(n), np.int64)
        grams, at = distinct(windows(points, bounds))
        keys, full = keys_of(grams), n > 0
        for k, model in enumerate(self.models):
            sums = np.add.reduceat(model.log_probabilities(keys)[at], bounds[:-1][full])
            out[full, k] = -sums / n[full]
        return out, np.where(has > 0, n, 0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, cross-entropy)."""
        if not self.names:
            return [("und", 0.0, True, None)] * len(texts)
        e, n = self.entropies(texts)
        best = e.argmin(axis=1)
        least = e[np.arange(len(e)), best]
        with np.errstate(invalid="ignore"):
            score = 1 / np.exp(-(e - least[:, None]) * np.minimum(n, SCORED)[:, None]).sum(axis=1)
            rejected = least > self.limits[best] + SHORT / np.sqrt(np.maximum(n, 1))
        return [(self.names[b], float(s), bool(r), float(x)) if m else ("und", 0.0, True, None) for b, s, r, x, m in zip(best, score, rejected, least, n, strict=True)]


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame) -> Identifier:
    """Models of every language among the rows of docs that are not held out."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    names, whole = sorted(counts), 1 << 30
    if not names:
        return Identifier([], [], np.zeros(0))
    share = F.create_map(*(x for k in names for x in (F.lit(k), F.lit(min(whole, int(SAMPLE_DOCUMENTS / counts[k] * whole))))))
    draw = F.xxhash64("doc_id")
    sample = rows.where(F.pmod(draw, F.lit(whole)) < share[F.col("lang")]).withColumn("back", F.pmod(F.shiftright(draw, 40), F.lit(HOLD_BACK)) == 0)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                points, bounds = characters(texts.to_pylist())
                of_text = np.array([names.index(x) for x in batch["lang"].slice(lo, len(texts)).to_pylist()])
                every, of_gram = windows(points, bounds), np.repeat(of_text, np.diff(bounds))
                for k in np.unique(of_gram):
                    grams, number = distinct(every[of_gram == k])
                    older, newer = (grams[:, b].astype(np.int64) << 21 | grams[:, a] for a, b in ((2, 3), (0, 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k)), pa.array(older), pa.array(newer), pa.array(np.bincount(number))], ["lang", "older", "newer", "n"])
            trim()

    # Distinct four-grams of the sample, which SAMPLE_DOCUMENTS bounds.
    counted = sample.where(~F.col("back")).select("lang", "text").mapInArrow(count_grams, "lang long, older long, newer long, n long")
    table = counted.groupBy("lang", "older", "newer").agg(F.sum("n").alias("n")).orderBy("lang", "older", "newer").toArrow()
    lang, older, newer, n = (table[c].to_numpy() for c in ("lang", "older", "newer", "n"))
    low = (1 << 21) - 1
    grams = np.stack([newer & low, newer >> 21, older & low, older >> 21], axis=1).astype(np.uint32)
    size = len(np.unique(grams[:, 0])) + 1
    nothing = np.zeros((1, ORDER), np.uint32), np.ones(1, np.int64)
    models = [KneserNey(*((grams[lang == k], n[lang == k]) if (lang == k).any() else nothing), size) for k in range(len(names))]
    found = Identifier(names, models, np.full(len(names), np.inf))

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                e, n = found.entropies(texts.to_pylist())
                of = np.array([names.index(x) for x in batch["lang"].slice(lo, len(texts)).to_pylist()])
                own = e[np.arange(len(of)), of] - SHORT / np.sqrt(np.maximum(n, 1))
                keep = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(of[keep]), pa.array(own[keep])], ["lang", "e"])
            trim()

    reached = sample.where("back").select("lang", "text").mapInArrow(entropies, "lang long, e double").toArrow()
    of, e = reached["lang"].to_numpy(), reached["e"].to_numpy()
    for k in range(len(names)):
        if (own := e[of == k]).size:
            found.limits[k] = np.quantile(own, QUANTILE) + SLACK
    return found


RESULTS = {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()), "rejected": (T.BooleanType(), pa.bool_()), "entropy": (T.DoubleType(), pa.float64())}


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs with lang_pred, score, rejected and entropy; the other columns stay."""
    kept = [c for c in docs.columns if c not in RESULTS]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def work(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
        for lo, some in slices(texts, SLICE_BYTES):
            got = list(zip(*sent.value.predict(some.to_pylist()), strict=True))
            yield lo, len(some), {c: pa.array(x, t) for (c, (_, t)), x in zip(RESULTS.items(), got, strict=True)}

    return by_arrow(docs, kept, "text", T.StructType([T.StructField(c, t) for c, (t, _) in RESULTS.items()]), work)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, entropy of every row."""
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", *RESULTS)
