"""Suffix dedup of repetitive text by prefix-free parsing.

A rolling hash over GRAM bytes triggers where it is least within a window of positions, so equal text
gets equal triggers. A trigger with the ENTRY bytes after it is an entry of the dictionary, and a document
parses into the entries of its triggers. An entry's occurrences are counted over the corpus; only where
two entries that lie within the `length` bytes from a start both occur twice can that string repeat, and text that
repeats nowhere is done there.

Occurrences of an entry that goes on meet in its bucket, which sorts them in the order of the corpus
suffixes: by entry, then by what follows it. The longest common prefixes of neighbours in this suffix array
say to which depth suffixes agree; for each start before the trigger, the suffixes that agree to the depth it
needs form runs, within which starts with equal bytes before the trigger are equal strings. Bytes are compared
as they are; an entry is told by 96 bits. A trigger's answer is one bit for each start before it.

Every start whose `length` bytes also start elsewhere covers its bytes, and covered bytes are removed.
Texts that are equal as a whole, by 128 bits of their SHA-256, count as one with copies. Beside that each text tells its longest stretch of
entries that occur elsewhere, which catches passages under `length`.

Defined results: null text counts as empty; texts shorter than `length` lose nothing; matches lie
within one document, the same document may hold both; repeated rows are copies of each other; an
empty table gives no rows; columns beside doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import input_bytes, settle, text_or_empty, trim, written
from terrace.llm.key_counts import NAME, common_keys, pack, unpack
from terrace.llm.ngram_join import mix
from terrace.llm.words import ragged, raw, slices

LENGTH = 400
GRAM = 16
#: Positions among which a trigger is the least; a power of two, at most 64 for the bits of an answer.
WINDOW = 64
#: Bytes of an entry; at most half of `length` is used.
ENTRY = 200
BASE, BASE2 = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
SLICE_BYTES = 1 << 20
BUCKET_BYTES = 12 << 20
#: Occurrences that a task sends at a time, and those whose bytes are gathered or compared side by side (with all of the last key's).
CHUNK, SIDE = 50_000, 8_000

#: A fixed odd 64-bit number for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _power(n: int, base: int = BASE) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _power(done, base)
        done += more
    return out


class Hashes:
    """Hashes of the strings of any length that start at each byte: differences of prefix sums, shifted to power 0."""

    def __init__(self, body: np.ndarray, base: int = BASE):
        # Powers come in a few sizes, so that they are found again.
        room = 1 << max(SLICE_BYTES + 1, len(body) + 1).bit_length()
        self.shift = _powers(pow(base, -1, 1 << 64), room)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTE[body] * _powers(base, room)[: len(body)], out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.shift[:n]


def least_of(values: np.ndarray, window: int) -> np.ndarray:
    """For each position the leftmost place of the least value (by its upper half) among `window` from it on."""
    least, n = values & np.uint64(0xFFFFFFFF00000000) | np.arange(len(values), dtype=np.uint64), 1
    while n < window:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int32)


class Parsed:
    """A run of texts: their triggers and, at each byte, the hash of the entry that starts there."""

    def __init__(self, texts: pa.Array, length: int):
        self.body, self.at = raw(texts)
        self.length, self.entry, self.window = length, min(ENTRY, length // 2), WINDOW
        while self.window > 1 and self.window > length - self.entry:
            self.window //= 2
        # Where a start's second entry is sought: it ends within the string, too.
        self.second = length - self.entry - (self.window - 1)
        self.places = None
        if len(self.body) >= length:
            hashes = Hashes(self.body)
            self.places = least_of(mix(hashes.of(GRAM)), self.window)
            self.entries = mix(hashes.of(self.entry))

    def triggers(self, i: int) -> np.ndarray:
        """Of text i, those with a whole entry."""
        a, b = int(self.at[i]), int(self.at[i + 1])
        last = b - self.entry
        places = self.places[a : max(a, b - GRAM - self.window + 2)] if self.places is not None else np.zeros(0, np.int32)
        out = np.unique(places)
        return out[out <= last]

    def dictionary_keys(self, i: int) -> np.ndarray:
        return self.entries[t] if len(t := self.triggers(i)) else np.zeros(0, np.uint64)

    def known(self, places: np.ndarray, found: np.ndarray) -> np.ndarray:
        own = self.entries[places]
        return found[np.minimum(np.searchsorted(found, own), len(found) - 1)] == own

    def occurrences(self, i: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(trigger, first start, last start) of text i, over starts whose two entries are in found (ascending)."""
        a, b = int(self.at[i]), int(self.at[i + 1]) - self.length + 1
        if b <= a or not len(found):
            return (np.zeros(0, np.int64),) * 3
        first, second = self.places[a:b], self.places[a + self.second : b + self.second]
        used, number = np.unique(np.concatenate([first, second]), return_inverse=True)
        hit = self.known(used, found)[number]
        starts = np.flatnonzero(hit[: b - a] & hit[b - a :])
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        of = first[starts].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        return of[edge], a + starts[edge], a + starts[np.append(edge[1:], len(starts)) - 1]

    def longest(self, i: int, found: np.ndarray) -> int:
        """Bytes of the longest stretch of entries that are in found."""
        t = self.triggers(i)
        if not len(t) or not len(found):
            return 0
        t = t[self.known(t, found)].astype(np.int64)
        if not len(t):
            return 0
        edge = np.flatnonzero(np.concatenate([[True], np.diff(t) > self.entry]))
        return int((t[np.append(edge[1:], len(t)) - 1] + self.entry - t[edge]).max())


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes lie in a string of `length` from one of starts (ascending)."""
    edges = np.zeros(n + 1, np.int32)
    edges[starts] += 1
    edges[starts + length] -= 1
    return np.cumsum(edges[:-1]) > 0


SPANS = "array<struct<start:long,end:long>>"


def _first_level(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                parsed = Parsed(texts, length)
                keys = [parsed.dictionary_keys(i).tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch["name"].slice(lo, len(texts)), pa.array(keys, pa.binary())], ["name", "keys"])
            trim()

    return common_keys(docs.select("name", "text").mapInArrow(run, "name binary, keys binary"), buckets, distinct=False).select("name", F.col("found").alias("found1"))


#: A bucket's share of a chunk: columns of occurrences as packed arrays, their bytes one after the other, and the names.
SENT = {"steps": "u8", "check": "u4", "rows": "u4", "place": "u4", "before": "u1", "after": "u1"}


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """data[starts[i] : starts[i] + sizes[i]] of every i, one after the other, SIDE at a time."""
    return b"".join([ragged(data, starts[i : i + SIDE], sizes[i : i + SIDE]).tobytes() for i in range(0, len(starts), SIDE)])


def beside(rows: int, width: int, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Each row's bytes of data from column shift on, zeros around them."""
    out = np.zeros((rows, width), np.uint8)
    for i in range(0, rows, SIDE):
        own, at = sizes[i : i + SIDE], np.arange(i, min(rows, i + SIDE)) * width + shift[i : i + SIDE]
        out.ravel()[np.repeat(at - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] = ragged(data, starts[i : i + SIDE], own)
    return out


def _sent(parts: list[tuple], names: list[bytes], buckets: int) -> Iterator[dict]:
    key, check, row, place, before, after = (np.concatenate(x) for x in zip(*(p[:6] for p in parts), strict=True))
    sizes = before.astype(np.int64) + after
    data = np.concatenate([p[6] for p in parts])
    order = np.argsort(key, kind="stable")
    starts = np.cumsum(sizes) - sizes
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    bounds = [0, *np.searchsorted(key[order], edges).tolist(), len(key)]
    packer = zstandard.ZstdCompressor(level=3)
    for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if lo < hi:
            own = order[lo:hi]
            used, number = np.unique(row[own], return_inverse=True)
            columns = {"steps": np.diff(key[own], prepend=np.uint64(0)), "check": check[own], "rows": number.astype(np.uint32), "place": place[own], "before": before[own], "after": after[own]}
            yield {"bucket": b, "names": b"".join([names[i] for i in used]), "data": packer.compress(gathered(data, starts[own], sizes[own]))} | {k: pack(v) for k, v in columns.items()}


def repeated_starts(key: np.ndarray, check: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of each occurrence of an entry (key, check), a bit for each start that many bytes before it: whether that string is there twice.

    left: the bytes before the entry, the nearest last, `before` of them; right: those after it, `after` of them and then zeros. A
    start n bytes before needs n of the left and all but n of the right. The suffix array of the occurrences and the common prefixes
    of its neighbours make the runs of suffixes that agree so far.
    """
    wide = right.shape[1]
    text = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), check.astype(">u4").view(np.uint8).reshape(-1, 4), right], axis=1)
    order = np.argsort(np.ascontiguousarray(text).view(f"S{text.shape[1]}").ravel(), kind="stable")
    text = text[order]
    apart = text[1:] != text[:-1]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), text.shape[1]) - 12
    left, before, after = left[order], before[order].astype(np.int64), after[order].astype(np.int64)
    bits, h = np.zeros(len(order), np.uint64), np.zeros(len(order), np.uint64)
    for n in range(WINDOW):
        if n:
            h = h * np.uint64(BASE2) + _BYTE[left[:, left.shape[1] - n]]
        need = wide - n
        # The first start is `before` bytes before the entry, the last one as far as the right side still reaches.
        some = np.flatnonzero((n <= before) & (need <= after))
        if len(some) < 2:
            continue
        run = np.concatenate([[0], np.cumsum(common < need)])[some].astype(np.uint64)
        own = mix(run * np.uint64(BASE) + mix(h[some] + np.uint64(n)))
        _, number, times = np.unique(own, return_inverse=True, return_counts=True)
        bits[some[times[number] > 1]] |= np.uint64(1 << n)
    out = np.empty_like(bits)
    out[order] = bits
    return out


def _second_level(held: DataFrame, length: int, buckets: int) -> DataFrame:
    """name, places, bits: for triggers of a text, by their place in it, the starts before them whose strings repeat."""
    entry = min(ENTRY, length // 2)
    wide = length - entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names, count = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, names, count
            out = pa.RecordBatch.from_pylist(list(_sent(parts, names, buckets)), schema)
            parts, names, count = [], [], 0
            trim()
            return out

        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                parsed, second = None, None
                for i, found in enumerate(batch["found1"].slice(lo, len(texts))):
                    if not found.is_valid:
                        continue
                    parsed = parsed or Parsed(texts, length)
                    t, first, last = parsed.occurrences(i, np.frombuffer(found.as_buffer(), np.uint64))
                    if not len(t):
                        continue
                    if second is None:
                        second = mix(Hashes(parsed.body, BASE2).of(entry))
                    before, after = t - first, last + length - t - entry
                    # What stands before the entry and what follows it, one occurrence after the other.
                    at = np.stack([first, t + entry], axis=1).ravel()
                    data = ragged(parsed.body, at, np.stack([before, after], axis=1).ravel())
                    parts.append((parsed.entries[t], (second[t] >> np.uint64(32)).astype(np.uint32), np.full(len(t), len(names), np.int64), (t - int(parsed.at[i])).astype(np.uint32), before.astype(np.uint8), after.astype(np.uint8), data))
                    names.append(batch["name"][lo + i].as_py())
                    count += len(t)
                    if count >= CHUNK:
                        yield flush()
            trim()
        if count:
            yield flush()

    schema = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("data", pa.binary()), *((k, pa.binary()) for k in SENT)])

    def meet(table: pa.Table) -> pa.Table:
        names = [x.as_py() for x in table["names"]]
        coded = pa.Array.from_buffers(pa.binary(NAME), sum(map(len, names)) // NAME, [None, pa.py_buffer(b"".join(names))]).dictionary_encode()
        of_name = coded.indices.to_numpy()
        columns: dict[str, list] = {k: [] for k in SENT}
        bodies, base = [], 0
        for r in range(len(table)):
            for k, dtype in SENT.items():
                columns[k].append(unpack(table[k][r].as_py(), dtype))
            columns["steps"][-1] = np.cumsum(columns["steps"][-1], dtype=np.uint64)
            columns["rows"][-1] = of_name[base + columns["rows"][-1].astype(np.int64)]
            base += len(names[r]) // NAME
            bodies.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(table["data"][r].as_py()), np.uint8))
        key, check, row, place, before, after = (np.concatenate(columns[k]) for k in SENT)
        data = np.concatenate(bodies)
        sizes = before.astype(np.int64) + after
        starts = np.cumsum(sizes) - sizes
        bits = np.zeros(len(key), np.uint64)
        # By ranges of the key, so that only a key's own occurrences have to be held side by side.
        order = np.argsort(key, kind="stable")
        cut = 0
        while cut < len(order):
            end = min(len(order), cut + SIDE)
            while end < len(order) and key[order[end]] == key[order[end - 1]]:
                end += 1
            own = order[cut:end]
            n_left, n_right = before[own].astype(np.int64), after[own].astype(np.int64)
            left = beside(len(own), WINDOW, data, starts[own], n_left, WINDOW - n_left)
            right = beside(len(own), wide, data, starts[own] + n_left, n_right, np.zeros(len(own), np.int64))
            bits[own] = repeated_starts(key[own], check[own], left, right, before[own], after[own])
            cut = end
        some = np.flatnonzero(bits)
        to = np.frombuffer(coded.dictionary.buffers()[1], np.uint64)[2 * coded.dictionary.offset : 2 * (coded.dictionary.offset + len(coded.dictionary)) : 2] % np.uint64(buckets)
        some = some[np.lexsort((row[some], to[row[some]]))]
        out = {"to": [], "names": [], "sizes": [], "places": [], "bits": []}
        for dest in np.unique(to[row[some]]).tolist():
            own = some[to[row[some]] == dest]
            used, number = np.unique(row[own], return_counts=True)
            out["to"].append(dest)
            out["names"].append(b"".join(coded.dictionary.take(pa.array(used)).cast(pa.binary()).to_pylist()))
            out["sizes"].append(number.astype(np.uint32).tobytes())
            out["places"].append(pack(place[own]))
            out["bits"].append(pack(bits[own]))
        trim()
        return pa.table({"to": pa.array(out["to"], pa.int32())} | {k: pa.array(out[k], pa.binary()) for k in ("names", "sizes", "places", "bits")})

    def tell(table: pa.Table) -> pa.Table:
        names = table["names"].to_pylist()
        coded = pa.Array.from_buffers(pa.binary(NAME), sum(map(len, names)) // NAME, [None, pa.py_buffer(b"".join(names))]).dictionary_encode()
        sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in table["sizes"].to_pylist()])
        number = np.repeat(coded.indices.to_numpy(), sizes)
        order = np.argsort(number, kind="stable")
        places, bits = (np.concatenate([unpack(x, d) for x in table[k].to_pylist()])[order] for k, d in (("places", "u4"), ("bits", "u8")))
        at = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(coded.dictionary)))]).tolist()
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.table({"name": coded.dictionary.cast(pa.binary()), "places": cut(places), "bits": cut(bits)})

    # The same columns as in the last step, and no filter: both then read one exchange of the texts.
    sent = held.select("name", "text", "copies", "found1").mapInArrow(run, "bucket int, names binary, data binary, " + ", ".join(f"{k} binary" for k in SENT))
    met = sent.groupBy("bucket").applyInArrow(meet, "to int, names binary, sizes binary, places binary, bits binary")
    return met.groupBy("to").applyInArrow(tell, "name binary, places binary, bits binary")


def _removed(rows: DataFrame, length: int) -> DataFrame:
    """name, n_bytes, longest, spans (removed runs of bytes) and kept (the other bytes) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                body, at = raw(texts)
                parsed, spans, kept, longest = None, [], [], []
                for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                    own, copies, found, bits = body[a:b], batch["copies"][lo + i].as_py(), batch["found1"][lo + i], batch["bits"][lo + i]
                    gone, most = np.full(b - a, copies > 1 and b - a >= length), b - a if copies > 1 else 0
                    if copies == 1 and found.is_valid:
                        parsed = parsed or Parsed(texts, length)
                        most = parsed.longest(i, np.frombuffer(found.as_buffer(), np.uint64))
                    if copies == 1 and bits.is_valid:
                        flags = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        which, n = np.nonzero(flags)
                        places = np.frombuffer(batch["places"][lo + i].as_buffer(), np.uint32).astype(np.int64)
                        gone = covered(b - a, places[which] - n, length)
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                    spans.append([{"start": x, "end": y} for x, y in edges.tolist()])
                    kept.append(own[~gone].tobytes())
                    longest.append(most)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch["name"].slice(lo, len(texts)), pa.array(np.diff(at)), pa.array(longest, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["name", "n_bytes", "longest", "spans", "kept"])
            trim()

    return rows.select("name", "text", "copies", "found1", "places", "bits").mapInArrow(run, f"name binary, n_bytes long, longest long, spans {SPANS}, kept binary")


def _name(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * NAME))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """name (128 bits of the text's SHA-256), n_bytes, longest, spans, kept of each distinct text."""
    rows = docs.select(text_or_empty().cast("string").alias("text")).withColumn("name", _name(F.col("text")))
    texts = rows.groupBy("name").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    buckets = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    dictionary = written(_first_level(rows, length, buckets), "dictionary")
    settle(docs.sparkSession)
    held = texts.join(dictionary, "name", "left")
    return _removed(held.join(_second_level(held, length, buckets), "name", "left"), length)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_repeat of every row."""
    found = repeats(docs, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = found.select("name", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("longest").alias("longest_repeat"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _name(text_or_empty().cast("string")).alias("name")).join(found, "name").drop("name")
