"""Cutting a batch of texts into pieces and numbering the distinct ones, outside Python's loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time.
SLICE_BYTES = 12 << 20

#: A-Z to lower case, and the white space of words to a blank; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32
#: A-Z to lower case and line feeds to a blank.
LOWER_LINES = np.arange(256, dtype=np.uint8)
LOWER_LINES[65:91] += 32
LOWER_LINES[10] = 32


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and their n + 1 offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return body, at - at[0] if len(at) else np.zeros(1, np.int64)


def cut_array(body: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """body between offsets as an Arrow array of large strings or binaries, without copies."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(body))])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about limit bytes, one text at least: (first index, texts)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(texts)
    while lo < n:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def word_codes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of the words of all texts in turn, n + 1 offsets into them, the distinct words). table maps bytes first."""
    body, offsets = raw(texts)
    mapped = table[body]
    blank = mapped == 32
    # A word starts where a text does or after a blank, and ends before a blank or at its text's end.
    edge = np.zeros(len(mapped) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), bounds, pa.array([], pa.large_string())
    pieces = cut_array(mapped, np.concatenate([starts, [ends[-1]]]), pa.large_binary())
    # Each piece runs to the next word's start; trailing blanks are cut off.
    coded = pc.dictionary_encode(pieces)
    words = pc.ascii_rtrim(coded.dictionary.cast(pa.large_string()), " ")
    again = pc.dictionary_encode(words)
    codes = again.indices.to_numpy()[coded.indices.to_numpy()]
    return codes, bounds, again.dictionary


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] of every i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
