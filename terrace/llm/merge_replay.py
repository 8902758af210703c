"""Byte-level BPE by replaying the merges over all distinct words of a share of the corpus at once.

A task takes some megabytes of text, cuts them by the pre-tokenizer's pattern, and lays the bytes of
its distinct words out in one chain of symbols. An inverted index leads from each pair of neighbouring
symbols, by the rank of the token that they form, to the places where it stands. The ranks are then
applied in ascending order: every place of a rank is merged, and only the two pairs with the symbols
beside it are looked up anew and indexed. A word's result is that of the usual encoder, which takes the
least rank of the word first and the leftmost of equal ones, since at any moment no place of a smaller
rank is left in any word: when a merge makes a pair of smaller rank, the replay goes back to that.

Shares are independent, so nothing is shuffled and a lost executor costs its own tasks alone.

Defined results: null text counts as empty and has no ids; no string is special; repeated rows give
equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import trim
from terrace.llm.words import slices

#: Text bytes whose distinct words are merged together, and bytes of words in one chain of symbols.
SHARE_BYTES, CHAIN_BYTES = 12 << 20, 4 << 20
#: From so many places on, those of a rank are merged by array operations; the result is the same.
MANY = 40
#: Words that a worker keeps from share to share: those that came more than once.
KEPT = 120_000
#: Pairs are looked up by left << SHIFT | right.
SHIFT = 20


class MergeReplay:
    """Ranks of a file of base64 tokens, and the pattern that cuts words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        if len({bytes([b]) for b in range(256)} & set(self.ranks)) < 256:
            raise ValueError("a rank for each single byte is needed")
        # This engine's \s is the property White_Space, as the encoder's is.
        self.find = regex.compile(pattern).findall
        self.most = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.most
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.shown = [str(i) for i in range(self.most)]
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: Every way to make a token of two: the pair's key to the token's rank.
        self.pairs = {a << SHIFT | b: rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.kept: dict[str, tuple[int, str, bytes]] = {}
        self.byte_pairs = np.full((256, 256), self.most, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def replay(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word."""
        lo = 0
        while lo < len(words):
            hi, size = lo + 1, len(words[lo])
            while hi < len(words) and size + len(words[hi]) <= CHAIN_BYTES:
                size += len(words[hi])
                hi += 1
            yield from self._chain(words[lo:hi])
            lo = hi

    def _chain(self, words: list[bytes]) -> Iterator[list[int]]:
        sizes = np.array([len(w) for w in words], np.int64)
        body = np.frombuffer(b"".join(words), np.uint8)
        # Symbols of word w begin at starts[w]; a gap of one place parts it from the next word.
        ends = np.cumsum(sizes + 1)
        at = np.arange(len(body)) + np.repeat(np.arange(len(words)), sizes) + 1
        symbols = np.full(int(ends[-1]) + 2 if len(ends) else 2, -1, np.int32)
        symbols[at] = self.byte_rank[body]
        here = at[:-1][at[1:] == at[:-1] + 1] if len(at) else at
        first = np.zeros(len(symbols), np.uint8)
        first[at] = body
        rank_of = self.byte_pairs[first[here], first[here + 1]]
        here, rank_of = here[rank_of < self.most], rank_of[rank_of < self.most]
        order = np.argsort(rank_of, kind="stable")
        here, rank_of = here[order], rank_of[order]
        cuts = np.flatnonzero(np.diff(rank_of, prepend=-1)) if len(rank_of) else np.zeros(0, np.int64)
        index: dict[int, list[int] | np.ndarray] = dict(zip(rank_of[cuts].tolist(), np.split(here, cuts[1:]), strict=True)) if len(cuts) else {}
        symbol, after, before = array("i", symbols.tobytes()), array("i", np.arange(1, len(symbols) + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, len(symbols) - 1, dtype=np.int32).tobytes())
        merged, rank = self.pairs.get, 0
        while rank < self.most:
            places = index.pop(rank, None)
            if places is None:
                rank += 1
                continue
            if len(places) >= MANY and self._merge_many(rank, np.unique(np.asarray(places, np.int64)), symbol, after, before, index):
                rank += 1
                continue
            places = places.tolist() if isinstance(places, np.ndarray) else sorted(places)
            back = rank
            for n, left in enumerate(places):
                a, right = symbol[left], after[left]
                b = symbol[right]
                if a < 0 or b < 0 or merged(a << SHIFT | b) != rank:
                    continue
                symbol[left], symbol[right] = rank, -2
                after[left] = beyond = after[right]
                before[beyond] = left
                c, d = symbol[before[left]], symbol[beyond]
                for where, key in ((before[left], c << SHIFT | rank if c >= 0 else -1), (left, rank << SHIFT | d if d >= 0 else -1)):
                    made = merged(key)
                    if made is not None:
                        self._add(index, made, [where])
                        back = min(back, made)
                if back < rank:
                    # The smaller rank comes first in this word; what is left here waits.
                    if rest := places[n + 1 :]:
                        self._add(index, rank, rest)
                    break
            rank = back if back < rank else rank + 1
        flat = np.frombuffer(symbol, np.int32)
        alive = np.flatnonzero(flat >= 0)
        bounds = np.searchsorted(alive, np.concatenate([[0], ends])).tolist()
        ids = flat[alive].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]

    @staticmethod
    def _add(index: dict, rank: int, places: list[int]) -> None:
        held = index.get(rank)
        if held is None:
            index[rank] = list(places)
        elif isinstance(held, list):
            held.extend(places)
        else:
            index[rank] = [*held.tolist(), *places]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of symbols makes, self.most for none."""
        keys = left.astype(np.int64) << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], self.most)

    def _merge_many(self, rank: int, places: np.ndarray, *held) -> bool:
        """All places of a rank at once. Not done, and False, where places overlap or a smaller rank comes up on the way."""
        symbol, after, before = (np.frombuffer(x, np.int32) for x in held[:3])
        index = held[3]
        right = after[places]
        fits = self._ranks(symbol[places], symbol[right]) == rank if len(self.pair_keys) else np.zeros(len(places), bool)
        places, right = places[fits], right[fits]
        if not len(places):
            return True
        if (right[:-1] == places[1:]).any():
            return False
        beyond, ahead = after[right], before[places]
        joined = np.concatenate([[False], ahead[1:] == right[:-1]])  # right behind the place before
        new = np.full(len(places), rank, np.int32)
        ahead = np.where(joined, np.concatenate([[0], places[:-1]]), ahead)
        lefts = self._ranks(np.where(joined, rank, symbol[ahead]), new)
        rights = self._ranks(new, symbol[beyond])
        if lefts.min() < rank or rights.min() < rank:
            return False
        symbol[places], symbol[right] = rank, -2
        after[places] = beyond
        before[beyond] = places
        rights = np.where(np.concatenate([joined[1:], [False]]), self.most, rights)
        where, made = np.concatenate([ahead, places]), np.concatenate([lefts, rights])
        where, made = where[made < self.most], made[made < self.most]
        if not len(made):
            return True
        order = np.argsort(made, kind="stable")
        where, made = where[order].tolist(), made[order]
        cuts = np.flatnonzero(np.diff(made, prepend=-1)).tolist()
        for a, b, r in zip(cuts, [*cuts[1:], len(where)], made[cuts].tolist(), strict=True):
            self._add(index, r, where[a:b])
        return True

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, decimal ids joined by a blank, the bytes they decode to) of each text."""
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        coded = [np.fromiter(map(numbers.__getitem__, self.find(text)), np.int32) if text else () for text in (x.as_py() for x in texts)]
        words, seen = list(numbers), np.bincount(np.concatenate([c for c in coded if len(c)] or [np.zeros(0, np.int32)]), minlength=len(numbers))
        numbers.clear()
        fresh = self.replay([w.encode() for w in words if w not in self.kept])
        found = [self.kept.get(w) or self._told(next(fresh)) for w in words]
        if len(self.kept) > KEPT:
            self.kept.clear()
        self.kept.update((words[i], found[i]) for i in np.flatnonzero(seen > 1)[:KEPT].tolist())
        sizes, shown, decoded = np.array([x[0] for x in found], np.int64), [x[1] for x in found], [x[2] for x in found]
        for own in coded:
            codes = own.tolist() if len(own) else []
            yield int(sizes[own].sum()) if codes else 0, " ".join([shown[i] for i in codes]), b"".join([decoded[i] for i in codes])

    def _told(self, ids: list[int]) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and what they decode to."""
        return len(ids), " ".join([self.shown[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])


@lru_cache(2)
def merge_replay(path: str, pattern: str) -> MergeReplay:
    """One table of ranks a worker: it outlives the tasks."""
    coder = MergeReplay(path, pattern)
    trim()
    return coder


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (decimal, joined by a blank) and decoded (the bytes that the ids give back) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_replay(ranks_file, pattern)
        for batch in batches:
            for lo, texts in slices(batch["text"], SHARE_BYTES):
                rows, first, held = [], lo, 0

                def part() -> pa.RecordBatch:
                    columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.binary()))]
                    return pa.RecordBatch.from_arrays([batch["key"].slice(first, len(rows)), *columns], ["key", "n_tokens", "ids", "decoded"])  # noqa: B023

                for row in coder.encode(texts):
                    rows.append(row)
                    held += len(row[1]) + len(row[2])
                    if held > SHARE_BYTES:
                        yield part()
                        first, rows, held = first + len(rows), [], 0
                if rows:
                    yield part()
                del rows
                trim()

    inside = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return inside.mapInArrow(run, "key long, n_tokens long, ids string, decoded binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded bytes."""
    coded = encode_decode(docs, ranks_file, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
