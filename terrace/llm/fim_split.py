"""Fill-in-middle transformation by lookaround splitting.

A unit grammar names where one unit ends and the next begins by the classes of the two neighbouring
characters. It is translated to a zero-width regular expression, a lookbehind for the left class and a
lookahead for the right one, and Spark's split() at it keeps every character in one piece or another.
Since such a boundary looks at one character on either side, a text is split block by block: block b
gets the character before it as context, and its boundaries are those of the whole text. Only counts
are kept of most blocks; the two in which the prefix and the middle end are split again for their
place. So no array of all pieces of a text exists at any time, however long the text is.

Defined results: null and empty texts have no units and are plain; null ids hash as an empty string;
repeated rows give equal rows; an empty table gives no rows; other columns pass through untouched
unless they are named like a new one, which then takes their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import quoted

#: Unit grammars: pairs of (class before the boundary, class after it).
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "chars": [(r"(?s:.)", r"(?s:.)")],
    "words": [(r"[ \t-\r]", r"[^ \t-\r]")],
    "lines": [(r"\n", r"(?s:.)")],
    "sentences": [(r"[.!?\n]", r"[ \t-\r]")],
    "scripts": [(r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"\P{L}", r"\p{L}"), (r"\P{N}", r"\p{N}")],
}
#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a block, and of the chunks that blocks are cut from.
BLOCK, CHUNK = 512, 1 << 16
#: Shares of a hundred: texts that are transformed, and those of them with the suffix first.
RATE, SPM_RATE, SEED = 90, 20, 1

NEW = ("n", "form", "prefix", "middle", "suffix", "output")


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width boundary of a grammar, named or given as pairs of classes."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<={left})(?={right})" for left, right in pairs)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _piece(text: str, b: str, size: int, context: str) -> str:
    """SQL: piece b of `size` code points with the character before it, if there is one; context: whether text itself begins with such a character."""
    return f"substring({text}, greatest({b} * {size} + {context}, 1), {size} + if({b} > 0, 1, {context}))"


def counts(text: str, pattern: str) -> str:
    """SQL: how many units begin in each block, the first unit in block 0. Chunks keep the work linear in long texts."""
    blocks = f"""transform(sequence(0, (char_length(t) - if(o > 0, 2, 1)) div {BLOCK}), b ->
        size(split({_piece("t", "b", BLOCK, "if(o > 0, 1, 0)")}, {_sql(pattern)}, -1)) - if(o > 0 OR b > 0, 1, 0))"""
    return f"flatten(transform(sequence(0, (char_length({text}) - 1) div {CHUNK}), o -> transform(array({_piece(text, 'o', CHUNK, '0')}), t -> {blocks})[0]))"


def place(text: str, pattern: str, begun: str, units: str, total: str) -> str:
    """SQL: code points before unit number `units` (from 0; the text's length where it is the total). begun: units that begin in each block."""
    # The last block before which no more than `units` units began holds the beginning of that unit.
    block = f"""aggregate({begun}, named_struct('sum', 0L, 'next', 0, 'block', 0, 'before', 0L),
        (a, x) -> if(a.sum <= {units}, named_struct('sum', a.sum + x, 'next', a.next + 1, 'block', a.next, 'before', a.sum), a))"""
    inside = f"""transform(array({block}), f -> greatest(f.block * {BLOCK} - 1, 0) + aggregate(slice(split({_piece(text, "f.block", BLOCK, "0")}, {_sql(pattern)}, -1),
        1, cast({units} - f.before + if(f.block > 0, 1, 0) as int)), 0, (a, x) -> a + char_length(x)))[0]"""
    return f"CASE WHEN {units} <= 0 THEN 0 WHEN {units} >= {total} THEN char_length({text}) ELSE {inside} END"


def _hash(k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the row's hash, as an unsigned integer."""
    return F.conv(F.substring("__hash", 8 * k - 7, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, grammar: str | list[tuple[str, str]] = "chars", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and n (units of the text), form (plain, psm, spm), prefix, middle, suffix (null if plain) and output.

    The cuts lie after the smaller and the larger of two hashed numbers of units; a text that holds a
    sentinel, an empty one and the share beyond `rate` stay as they are.
    """
    p, s, m = SENTINELS
    pattern = boundary(grammar)
    kept = [F.col(quoted(c)) for c in docs.columns if c not in NEW]
    rows = docs.select(*kept, F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("__text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))), 256).alias("__hash"))
    rows = rows.withColumn("__counts", F.expr(f"if(__text = '', array(), {counts('__text', pattern)})"))
    rows = rows.withColumn("n", F.expr("aggregate(__counts, 0L, (a, x) -> a + x)"))
    plain = (F.col("__text") == "") | F.col("__text").rlike("|".join(SENTINELS)) | (_hash(3) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_hash(4) % 100 < spm_rate, "spm").otherwise("psm"))
    one, two = _hash(1) % (F.col("n") + 1), _hash(2) % (F.col("n") + 1)
    rows = rows.withColumn("__low", F.least(one, two)).withColumn("__high", F.greatest(one, two))
    for cut, units in (("__a", "__low"), ("__b", "__high")):
        rows = rows.withColumn(cut, F.expr(f"if(form = 'plain', null, {place('__text', pattern, '__counts', units, 'n')})"))
    rows = rows.withColumn("prefix", F.expr("substring(__text, 1, __a)")).withColumn("middle", F.expr("substring(__text, __a + 1, __b - __a)")).withColumn("suffix", F.expr("substring(__text, __b + 1)"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(*kept, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from an output and its form alone: no sentinel stands inside a piece, so splitting at them is unambiguous."""
    parts = F.split(F.col(output), "|".join(SENTINELS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: n, form, lengths of prefix and middle, digests of the output and of the text rebuilt from it."""
    done = transformed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return done.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
