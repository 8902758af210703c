"""Encoding with a tokenizers file whose words end at white space, each distinct word encoded once.

The pre-tokenizer of such a file drops white space and never joins across it, and its normaliser maps
characters one by one, so a text's ids are those of its words in turn. Arrow numbers
the distinct words of a batch; ASCII words are cut once more into the letter runs, digits and sign runs
that the file's pattern makes, since these repeat much more often, and a bounded table holds their ids.
Texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from terrace.llm.words import LOWER_LINES, ragged, slices, word_codes

#: Entries that a worker keeps from one slice of text to the next: words that came more than once, and pieces of words.
KEPT, KEPT_PIECES = 150_000, 350_000
#: The pattern of the file's pre-tokenizer, and the same over lower-case ASCII.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT_PATTERN = regex.compile(FILE_PATTERN)
#: Marks, and letters whose lower case has marks or depends on what follows.
CHANGING = regex.compile(r"[\p{M}\u0130\u03A3]")
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0da-z0-9]+")


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x["content"] for x in spec["added_tokens"]]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = steps[0].get("pattern") == {"Regex": FILE_PATTERN} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = spec["model"]["end_of_word_suffix"] or "</w>"
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        # The fast call keeps no offsets, which nobody needs here.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, new: list[str]) -> None:
        """Letter runs go to the library many at a time: each one's last id, and no other, ends a word. Where that fails, by halves."""
        for lo in range(0, len(new), 1000):
            some = new[lo : lo + 1000]
            ids = self._library(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data, at = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
                self.pieces.update((p, data[a:b]) for p, a, b in zip(some, [0, *at], at, strict=False))
            elif len(some) == 1:
                self.pieces[some[0]] = ids.tobytes()
            else:
                self._learn(some[: len(some) // 2])
                self._learn(some[len(some) // 2 :])

    @staticmethod
    def _cut(word: str) -> tuple[str, ...] | list[str]:
        """The pieces that the file's pattern makes of a word; one that normalising may change across pieces stays whole."""
        if word.isascii():
            return (word,) if word.isalpha() else ASCII_PATTERN.findall(word)
        if word.isalpha() or CHANGING.search(word) or not unicodedata.is_normalized("NFC", word):
            return (word,)
        return CUT_PATTERN.findall(word)

    def _ids(self, words: list[str], times: np.ndarray) -> list[bytes]:
        """The ids of each distinct word, which came so many times."""
        out = list(map(self.words.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if not missing:
            return out
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        cut = [self._cut(words[i]) for i in missing]
        new = {p for ps in cut for p in ps if p not in self.pieces}
        runs = [p for p in new if p.isalpha()]
        self._learn([p for p in runs if p.isascii()])
        self._learn([p for p in runs if not p.isascii()])
        self.pieces.update((p, self._library(p).tobytes()) for p in new.difference(runs))
        get = self.pieces.__getitem__
        for i, ps in zip(missing, cut, strict=True):
            out[i] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))
        # Words that come once would only push out those that come again.
        again = np.flatnonzero(times > 1)[:KEPT].tolist()
        if len(self.words) + len(again) > 2 * KEPT:
            self.words.clear()
        self.words.update((words[i], out[i]) for i in again)
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        out: list[bytes] = []
        for _, some in slices(texts):
            if self.by_word:
                codes, bounds, words = word_codes(some, LOWER_LINES)
                ids = self._ids(words.to_pylist(), np.bincount(codes, minlength=len(words)))
                sizes = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
                flat = np.frombuffer(b"".join(ids), self.dtype)
                of_word = sizes[codes] if len(codes) else np.zeros(0, np.int64)
                data = ragged(flat, (np.cumsum(sizes) - sizes)[codes] if len(codes) else of_word, of_word).tobytes()
                at = (np.concatenate([[0], np.cumsum(of_word)])[bounds] * self.dtype.itemsize).tolist()
                got = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
                # Texts with special strings, and with marks that join lower-case letters but not the capitals that stand there.
                whole = [pc.match_substring(some, x) for x in self.special] + [pc.match_substring_regex(some, r"[A-Z]\p{M}")]
                for i in {i for x in whole for i in np.flatnonzero(pc.fill_null(x, False).to_numpy(zero_copy_only=False)).tolist()}:
                    got[i] = self._library(some[i].as_py()).tobytes()
            else:
                got = [self._library(x or "").tobytes() for x in some.to_pylist()]
            out += got
        return out


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker: it outlives the tasks."""
    return WordEncoder(path)
