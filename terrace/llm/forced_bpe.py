"""Byte-level BPE by forced-boundary splitting.

A byte pair that stands inside no vocabulary token can never be joined by a merge, so the place
between its bytes is a certain cut: what lies on either side is encoded on its own and the ids are
concatenated. Three kinds of places are left alone, since the pre-tokenizer's pattern looks further
than a pair there: after white space, before an apostrophe, and inside a character. Equal fragments
are encoded once; the library sees many new fragments in one call, and the tokens' byte lengths tell
which ids are whose.

Defined results: null text counts as empty and has no ids; a text with a special token's string goes
to the library whole; repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import trim
from terrace.llm.words import cut_array, raw, slices

#: Bytes of fragments and ids that a worker's table holds; it is emptied when it is full, and at a task's end.
KEPT_BYTES = 24 << 20
#: What an entry takes besides these bytes.
ENTRY_BYTES = 250
SLICE_BYTES = 4 << 20
#: Contractions of the pre-tokenizer's pattern; a cut inside one would change its match.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as code points from 256 on, in turn."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBPE:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        to_byte = byte_of_char()
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        inside = np.zeros(1 << 16, bool)
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = data = bytes(map(to_byte.__getitem__, token))
            self._mark(inside, data)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        for text in CONTRACTIONS:
            self._mark(inside, text.encode())
        self.never = ~inside
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.held = 0

    @staticmethod
    def _mark(inside: np.ndarray, data: bytes) -> None:
        for a, b in zip(data, data[1:], strict=False):
            inside[a << 8 | b] = True

    def cuts(self, body: np.ndarray) -> np.ndarray:
        """Positions of body before which a cut is certain."""
        if len(body) < 2:
            return np.zeros(0, np.int64)
        left, right = body[:-1], body[1:]
        cut = self.never[left.astype(np.uint16) << 8 | right] & (right & 0xC0 != 0x80) & (right != 0x27)
        cut &= ~((left == 32) | (left - 9 < 5) | (left - 0x1C < 4))
        # White space of two and three bytes: U+0085, U+00A0; U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
        at = np.flatnonzero(cut & (left >= 0x80)) + 1
        some = at[(body[at - 1] == 0x85) | (body[at - 1] == 0xA0) | (body[at - 1] <= 0x8A) | np.isin(body[at - 1], (0x9F, 0xA8, 0xA9, 0xAF))]
        data = body.tobytes() if len(some) else b""
        for i in some.tolist():
            if bytes(data[max(0, i - 3) : i]).decode("utf-8", "ignore")[-1:].isspace():
                cut[i - 1] = False
        return np.flatnonzero(cut) + 1

    def _learn(self, new: list[bytes]) -> None:
        joined = [x for x in new if x[:1] == b" " and self.never[x[-1] << 8 | 32] and not x[-1:].isspace() and x[-1] < 0x80]
        for lo in range(0, len(joined), 1000):
            some = joined[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode(b"".join(some).decode(), add_special_tokens=False).ids)
            ends = np.searchsorted(np.cumsum(self.length_of[ids]), np.cumsum([len(x) for x in some])) + 1
            for x, a, b in zip(some, [0, *ends.tolist()], ends.tolist(), strict=False):
                self._keep(x, ids[a:b].tolist())
        rest = list(set(new).difference(joined))
        for x, e in zip(rest, self.tokenizer.encode_batch([x.decode() for x in rest], add_special_tokens=False), strict=True):
            self._keep(x, e.ids)

    def _keep(self, fragment: bytes, ids: list[int]) -> None:
        back = b"".join([self.bytes_of[i] for i in ids])
        shown = ",".join(map(str, ids)).encode()
        self.known[fragment] = (shown, fragment if back == fragment else back, len(ids))
        self.held += len(fragment) + len(shown) + ENTRY_BYTES

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by commas, the bytes they decode to) of each text."""
        for _, some in slices(texts, SLICE_BYTES):
            body, offsets = raw(some)
            at = np.unique(np.concatenate([self.cuts(body), offsets]))
            pieces = pc.dictionary_encode(cut_array(body, at, pa.large_binary()))
            fragments = pieces.dictionary.to_pylist()
            if self.held > KEPT_BYTES:
                self.forget()
            if new := [x for x in fragments if x not in self.known]:
                self._learn(new)
            got = [self.known[x] for x in fragments]
            codes, bounds = pieces.indices.to_numpy(), np.searchsorted(at, offsets)
            counts = np.array([x[2] for x in got], np.int64)
            totals = np.concatenate([[0], np.cumsum(counts[codes])]) if len(codes) else np.zeros(1, np.int64)
            words, backs = [x[0] for x in got], [x[1] for x in got]
            special = {i for s in self.special for i in np.flatnonzero(pc.fill_null(pc.match_substring(some, s), False).to_numpy(zero_copy_only=False)).tolist()}
            codes = codes.tolist()
            for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                if i in special:
                    ids = self.tokenizer.encode(some[i].as_py(), add_special_tokens=False).ids
                    yield len(ids), ",".join(map(str, ids)).encode(), b"".join([self.bytes_of[j] for j in ids])
                else:
                    own = codes[a:b]
                    yield int(totals[b] - totals[a]), b",".join([words[j] for j in own]), b"".join([backs[j] for j in own])


@lru_cache(2)
def forced_bpe(path: str) -> ForcedBPE:
    """One coder a worker: it outlives the tasks."""
    trim()
    coder = ForcedBPE(path)
    trim()
    return coder


def encode_decode(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", keep: bool = True) -> DataFrame:
    """key, n_tokens, ids (decimal, joined by commas) and decoded (the text that the ids give back) of every row.
    keep: a worker's coder outlives the task; without, no idle worker holds one beside other operators' tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = forced_bpe(tokenizer_file) if keep else ForcedBPE(tokenizer_file)
        for batch in batches:
            for lo, texts in slices(batch["text"], SLICE_BYTES):
                rows = list(coder.encode(texts))
                decoded = [x[2].decode("utf-8", "replace") for x in rows]
                yield pa.RecordBatch.from_arrays([batch[key].slice(lo, len(texts)), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1].decode() for x in rows], pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids", "decoded"])
                del rows, decoded
            trim()
        coder.forget()
        del coder
        trim()

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, tokenizer_file: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text."""
    coded = encode_decode(docs, tokenizer_file, keep=keep)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
