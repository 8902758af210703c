"""How often each 64-bit key occurs in the corpus, told to those rows that share a key with others.

Exploding keys into rows would shuffle some 25 bytes each. Instead every task sorts the keys of a
chunk of rows, cuts them by value into buckets, and sends one compressed blob a bucket: sorted keys as
differences in byte planes, and the rows they came from as numbers into the chunk's list of row names.
A bucket holds a share of the key space, whatever its keys' counts, so no key makes a task heavy by
more than one entry a row. Rows get back only the keys that occur often enough,
again as blobs, one for each bucket and share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from terrace.llm.common import trim

#: Keys that a task sorts and sends at a time.
CHUNK = 2_000_000
#: Keys of a bucket that are sorted at a time.
RANGE = 1_000_000
NAME = 16


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def _blobs(names: list[bytes], keys: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    flat = np.concatenate(keys)
    rows = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    bounds = [0, *np.searchsorted(flat, edges).tolist(), len(flat)]
    all_names = np.frombuffer(b"".join(names), f"V{NAME}")
    for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if lo < hi:
            used, number = np.unique(rows[lo:hi], return_inverse=True)
            small = number.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
            steps = np.diff(flat[lo:hi], prepend=np.uint64(0))
            yield b, pack(steps), pack(small), small.dtype.itemsize, all_names[used].tobytes()


def _common(parts: list[tuple[np.ndarray, np.ndarray]], least: int, distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row's number, count) of the keys that occur often enough, each row's once, by key."""
    keys, number = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(keys):
        return keys, number, np.zeros(0, np.uint32)
    order = np.lexsort((number, keys))
    keys, number = keys[order], number[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    once = fresh | np.concatenate([[True], number[1:] != number[:-1]])
    if distinct:
        keys, number, fresh, once = keys[once], number[once], fresh[once], np.ones(int(once.sum()), bool)
    counts = np.diff(np.append(np.flatnonzero(fresh), len(keys)))
    times = np.repeat(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), counts)
    once &= times >= least
    return keys[once], number[once], times[once]


def common_keys(rows: DataFrame, buckets: int, least: int = 2, distinct: bool = True) -> DataFrame:
    """name binary(16), keys binary (uint64) -> name, found binary (uint64, ascending), counts binary (uint32), one row a name.

    found: the keys of the row that at least `least` names have (distinct) or that occur as often in all rows.
    Rows of equal names are taken as one with distinct; a row without such keys is not returned.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, keys, held
            columns = list(zip(*_blobs(names, keys, buckets), strict=True))
            names, keys, held = [], [], 0
            trim()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], ["bucket", "steps", "rows", "width", "names"])

        for batch in batches:
            for name, data in zip(batch["name"].to_pylist(), batch["keys"], strict=True):
                own = np.frombuffer(data.as_buffer(), np.uint64) if data.is_valid else ()
                if len(own):
                    names.append(name)
                    keys.append(own)
                    held += len(own)
                    if held >= CHUNK:
                        yield flush()
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        names = [x.as_py() for x in table["names"]]
        coded = pa.Array.from_buffers(pa.binary(NAME), sum(map(len, names)) // NAME, [None, pa.py_buffer(b"".join(names))]).dictionary_encode()
        of_name, at, total, parts = coded.indices.to_numpy(), 0, 0, []
        for steps, rows, width, own in zip(table["steps"], table["rows"], table["width"].to_pylist(), names, strict=True):
            number = unpack(rows.as_py(), f"u{width}")
            parts.append((np.cumsum(unpack(steps.as_py(), "u8"), dtype=np.uint64), of_name[at : at + len(own) // NAME].astype(np.uint32)[number]))
            at, total = at + len(own) // NAME, total + len(number)
        # A bucket is worked on in turn by ranges of the key.
        cuts = -(-total // RANGE)
        lo, hi = (int(f(int(k[i]) for k, _ in parts)) for f, i in ((min, 0), (max, -1)))
        edges = np.array([lo + (hi - lo) * c // cuts for c in range(1, cuts)], np.uint64)
        bounds = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k, _ in parts]
        got = [_common([(k[b[c] : b[c + 1]], n[b[c] : b[c + 1]]) for (k, n), b in zip(parts, bounds, strict=True)], least, distinct) for c in range(cuts)]
        keys, number, times = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(number, kind="stable")
        keys, number, times = keys[order], number[order], times[order]
        # By the destination of the row's name, then by row.
        to = np.frombuffer(coded.dictionary.buffers()[1], np.uint64)[2 * coded.dictionary.offset : 2 * (coded.dictionary.offset + len(coded.dictionary)) : 2] % np.uint64(buckets)
        order = np.argsort(to[number], kind="stable")
        keys, number, times = keys[order], number[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        sizes, names = np.diff(np.append(starts, len(number))).astype(np.uint32), coded.dictionary.take(pa.array(number[starts])).cast(pa.binary()).to_pylist()
        where = to[number[starts]]
        edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(where)).astype(np.int64)
        first = np.append(starts, len(number))
        out = pa.table(
            {
                "to": pa.array(where[edges].astype(np.int32)),
                "bucket": pa.array([table["bucket"][0].as_py()] * len(edges), pa.int32()),
                "names": pa.array([b"".join(names[a:b]) for a, b in zip(edges, ends, strict=False)], pa.binary()),
                "sizes": pa.array([sizes[a:b].tobytes() for a, b in zip(edges, ends, strict=False)], pa.binary()),
                "found": pa.array([keys[first[a] : first[b]].tobytes() for a, b in zip(edges, ends, strict=False)], pa.binary()),
                "counts": pa.array([pack(times[first[a] : first[b]]) for a, b in zip(edges, ends, strict=False)], pa.binary()),
            }
        )
        del parts, got
        trim()
        return out

    def tell(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")  # keys ascend with the bucket
        names = table["names"].to_pylist()
        coded = pa.Array.from_buffers(pa.binary(NAME), sum(map(len, names)) // NAME, [None, pa.py_buffer(b"".join(names))]).dictionary_encode()
        sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in table["sizes"].to_pylist()])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()])
        times = np.concatenate([unpack(x, "u4") for x in table["counts"].to_pylist()])
        number = np.repeat(coded.indices.to_numpy(), sizes)
        order = np.argsort(number, kind="stable")
        keys, times = keys[order], times[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(coded.dictionary)))]).tolist()
        data, told = keys.tobytes(), times.tobytes()
        out = {"name": coded.dictionary.cast(pa.binary()), "found": pa.array([data[8 * a : 8 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary()), "counts": pa.array([told[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())}
        return pa.table(out)

    sent = rows.select("name", "keys").mapInArrow(send, "bucket int, steps binary, rows binary, width int, names binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "to int, bucket int, names binary, sizes binary, found binary, counts binary")
    return met.groupBy("to").applyInArrow(tell, "name binary, found binary, counts binary")
