"""Fill-in-middle, merge replay and phrase tries against plain versions and SQL."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from terrace.llm import fim_split, merge_replay, phrase_tries
from terrace.llm.queries import ORACLES, QUERIES, tokenizer_path


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def fim_rows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c\n.\U0001f600é漢\U0001d4b31 <P>S") for _ in range(rng.choice([0, 1, 2, 5, 50, 511, 512, 513, 1025]))) for _ in range(120)]
    texts += ["".join(rng.choice("ab c\n.\U0001f600é") for _ in range(n)) for n in (65535, 65536, 65537, 200001)]
    return [*enumerate(texts), (None, None), (5, "x"), (7, "a<S>b"), (7, "a<S>b")]


@pytest.fixture(scope="module")
def fim_docs(spark, fim_rows):
    return spark.createDataFrame([(*r, "own", 1.5) for r in fim_rows], "doc_id long, text string, suffix string, `a``b` double")


def cuts(key, n):
    h = [int(sha(f"1:{'' if key is None else key}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    return *sorted((h[0] % (n + 1), h[1] % (n + 1))), h[2] % 100, h[3] % 100


def test_fim_digests(fim_docs, fim_rows):
    expected = []
    for key, text in fim_rows:
        t = text or ""
        a, b, rate, spm = cuts(key, len(t))
        if not t or re.search("<[PSM]>", t) or rate >= 90:
            expected.append((key, len(t), "plain", None, None, sha(t), sha(t)))
        else:
            out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if spm < 20 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
            expected.append((key, len(t), "spm" if spm < 20 else "psm", a, b - a, sha(out), sha(t)))
    assert sorted(map(tuple, fim_split.digests(fim_docs).collect()), key=repr) == sorted(expected, key=repr)
    assert fim_split.digests(fim_docs.where("false")).count() == 0


@pytest.mark.parametrize(("grammar", "pattern"), [("words", r"(?<=[ \t-\r])(?=[^ \t-\r])"), ("lines", r"(?<=\n)(?=[\s\S])"), ("sentences", r"(?<=[.!?\n])(?=[ \t-\r])")])
def test_fim_units_of_other_grammars(fim_docs, grammar, pattern):
    done = fim_split.transformed(fim_docs, grammar)
    assert done.columns == ["doc_id", "text", "a`b", "n", "form", "prefix", "middle", "suffix", "output"]
    for r in done.collect():
        units = re.split(pattern, r.text) if r.text else []
        assert r.n == len(units)
        if r.form != "plain":
            a, b, *_ = cuts(r.doc_id, len(units))
            assert (r.prefix, r.middle, r.suffix) == ("".join(units[:a]), "".join(units[a:b]), "".join(units[b:]))


def test_replay_is_the_librarys_encoding(spark):
    import public_tokenizers
    import tiktoken

    rng = random.Random(3)
    odd = [chr(c) for c in (*range(300), 0x85, 0xA0, 0x1C, 0x2003, 0x3000, 0x200B, 0x4E2D, 0x1F600, 0x301, 0x660, 0xFEFF)]
    texts = ["".join(rng.choice(odd) for _ in range(rng.choice([1, 5, 30, 300]))) for _ in range(300)]
    texts += ["".join(rng.choice("aab eelnst'") for _ in range(rng.choice([1, 5, 30, 3000]))) for _ in range(200)]
    texts += ["a" * 50000, " " * 20000 + "x", "\n" * 3001, "", None, "<|endoftext|> it's I'LL", "=-" * 9000, "one", "one"]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = tokenizer_path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        expected = []
        for i, t in enumerate(texts):
            ids = coder.encode_ordinary(t or "")
            expected.append((i if i % 50 else None, len(ids), " ".join(map(str, ids)), (t or "").encode()))
        got = merge_replay.encode_decode(docs, path, public_tokenizers.PATTERN)
        assert sorted(((*r[:3], bytes(r[3])) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    digests = merge_replay.digests(docs, path, public_tokenizers.PATTERN)
    assert {(r.ids_sha256, r.decoded_sha256) for r in digests.collect()} == {(sha(e[2]), sha(e[3])) for e in expected}
    assert merge_replay.digests(docs.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_replay_goes_back_to_a_smaller_rank():
    # "xyz" is made of x + yz only, and ranks below "yz", which has to come first; then "ab" again in the same word.
    coder = merge_replay.MergeReplay.__new__(merge_replay.MergeReplay)
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"yz": 257, b"xyzxyz": 258}
    coder.most, coder.ranks = 259, ranks
    import numpy as np

    coder.byte_rank, coder.byte_pairs = np.arange(256, dtype=np.int32), np.full((256, 256), 259, np.int32)
    coder.byte_pairs[ord("y"), ord("z")] = 257
    coder.pairs = {a << merge_replay.SHIFT | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
    assert list(coder.replay([b"xyz", b"", b"yzyz", b"xyzxyzxyz"])) == [[256], [], [257, 257], [258, 256]]


def phrases_by_name(rows, least, share, top):
    counts, total, out = {}, Counter(), []
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    for lang, c in counts.items():
        candidates, longer, found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, Counter(), []
        for p, a in candidates.items():
            for x in {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}:
                longer[x] = max(longer[x], a)
        for p, a in candidates.items():
            if 100 * longer[p] < share * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(2)
    words = ["The", "a", "b\x01", "b", "ç", "née", "of", "x1", "\x00z", "漢", "A"]
    rows = [(i, rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.choice([0, 1, 3, 40, 400])))) for i in range(200)]
    return [*rows, (None, "en", None), (1, "zz", "x y"), (1, "und", "a b c"), (2, "en", "to be " * 30000), (2, "en", "to be " * 30000)]


@pytest.mark.parametrize("sizes", [{}, {"ranges": 7, "trie_bytes": 2000}, {"ranges": 40, "trie_bytes": 500, "merge_leaves": 10}, {"ranges": 1, "trie_bytes": 700, "merge_leaves": 50}])
def test_phrases(spark, phrase_rows, sizes):
    docs = spark.createDataFrame([(*r, "own") for r in phrase_rows], "doc_id long, lang string, text string, phrase string")
    got = sorted(map(tuple, phrase_tries.collocations(docs, least=5, top=30, **sizes).collect()))
    assert got == phrases_by_name([r[1:] for r in phrase_rows], 5, 80, 30)
    if not sizes:
        assert phrase_tries.collocations(docs.where("false")).count() == 0


def test_trie_parts_come_back_whole():
    rng = random.Random(5)
    trie = phrase_tries.windows_of(pa.array([" ".join(rng.choice(["a", "b", "cc", "é"]) for _ in range(500)), None, "", "x. y", "z"]))
    keys = [trie.key(i) for i in range(len(trie.counts))]
    assert keys == sorted(set(keys)) and int(trie.counts.sum()) == 503
    for lo, hi in ((0, len(keys)), (3, 40), (len(keys) - 1, len(keys))):
        part = phrase_tries.Leaves.load(*trie.dump(lo, hi))
        assert [part.key(i) for i in range(hi - lo)] == keys[lo:hi] and part.counts.tolist() == trie.counts[lo:hi].tolist()
    for key in [*keys, (b"a",), (b"bb", b"a"), (b"", b""), (b"zz",)]:
        assert trie.find(key) == sum(k < key for k in keys)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    folder = "/root/testdata/sf0.01" if name == "op13_phrase_tries" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert len(got) > 100 and sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)
