"""The thirteen operators and the pipeline as queries of the driver, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm.common import documents


def tokenizer_path(name: str) -> str:
    """The public vocabulary files are read where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.token_files import token_files

    return token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.ngram_join import clusters

    return clusters(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.lattice_lm import scores

    return scores(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.pareto_mix import report

    return report(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.secret_scan import digests

    return digests(documents(spark, sf_dir))


def op6_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.forced_bpe import digests

    return digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.langid import report

    return report(documents(spark, sf_dir))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.cws import report

    return report(documents(spark, sf_dir))


def op9_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.pfp_dedup import report

    return report(documents(spark, sf_dir))


def op10_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.mjpeg import media_digests

    return media_digests(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.fim_split import digests

    return digests(documents(spark, sf_dir))


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrace.llm.merge_replay import digests

    return digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.phrase_tries import collocations

    return collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_ngram_join, op3_lattice_lm, op4_pareto_mix, op5_secret_scan, op6_forced_bpe, op7_language_id, op8_weighted_fingerprints, op9_pfp_dedup, op10_mjpeg, op11_fill_in_middle, op12_merge_replay, op13_phrase_tries)}

#: The n-gram join by comparing all texts that share a shingle; components by a recursive union.
OP2 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS set FROM s), c AS (SELECT set, min(doc_id) AS class, min(n) AS n FROM k WHERE n > 0 GROUP BY set),
x AS (SELECT c.class, c.n, unnest(s.g) AS g FROM c JOIN s ON s.doc_id = c.class),
p AS (SELECT a.class AS a, b.class AS b FROM x a JOIN x b ON a.g = b.g AND a.class < b.class GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(node, seen) AS (SELECT class, class FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), m AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(m.root, k.doc_id) AS component_id, coalesce(c.class, k.doc_id) AS class_id FROM k LEFT JOIN c ON c.set = k.set AND k.n > 0 LEFT JOIN m ON m.node = c.class"""

#: The cuts are prefixes by code points; the forms follow the hash of the id.
OP11 = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS u FROM h),
c AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR u[3] % 100 >= 90 THEN 'plain' WHEN u[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: All phrases of one to four words counted by name; parts by self-joins.
OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))))) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, phrase HAVING count(*) >= 30), c AS (SELECT * FROM f WHERE len(w) > 1),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a) // (x.a + y.a) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))))) AS phrase FROM c),
o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a)
SELECT t.lang, t.rank::BIGINT AS rank, t.phrase, t.a::BIGINT AS a, t.l::BIGINT AS l, t.r::BIGINT AS r, n.n, t.score::BIGINT AS score FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000"""
ORACLES: dict[str, str] = {"op2_ngram_join": OP2, "op11_fill_in_middle": OP11, "op13_phrase_tries": OP13}
