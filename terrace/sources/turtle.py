"""Turtle: a reader for one document at a time in parallel over files, and a writer, subject by subject."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.plans.graph import QUAD, GraphContext, checkpointed, value_lists

TOKEN = re.compile(
    r'(?P<space>[ \t\r\n]+|#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|\'(?:[^\'\\\n]|\\.)*\')'
    r"|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<hats>\^\^)|(?P<number>[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)(?:[eE][+-]?[0-9]+)?(?![\w:]))|(?P<name>(?:[A-Za-z_][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?|a(?![\w:])|true\b|false\b|PREFIX\b|BASE\b|prefix\b|base\b)|(?P<sign>[;,.\[\]()])",
    re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


#: Triples that are handed over at a time.
ROWS = 50_000


class TurtleError(ValueError):
    pass


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text)


def parse(text: str, scope: str = "d") -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_dt, o_lang) of a document; blank nodes are named within `scope`."""
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unreadable at {at}: {text[at : at + 30]!r}")
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    prefixes: dict[str, str] = {}
    out: list[tuple] = []
    state = {"at": 0, "blank": 0, "base": ""}

    def peek() -> tuple[str, str]:
        return tokens[state["at"]]

    def take(want: str | None = None) -> tuple[str, str]:
        token = tokens[state["at"]]
        if want and token[1] != want:
            raise TurtleError(f"{want!r} expected, {token[1]!r} found")
        state["at"] += 1
        return token

    def blank() -> tuple:
        state["blank"] += 1
        return (f"_:{scope}{state['blank']}", "bnode", None, None)

    def iri(value: str) -> tuple:
        inner = _unescape(value[1:-1])
        return (inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else state["base"] + inner, "iri", None, None)

    def term() -> tuple:
        kind, value = take()
        if kind == "iri":
            return iri(value)
        if kind == "text":
            size = 3 if value[:3] in ('"""', "'''") else 1
            body, kind2 = _unescape(value[size:-size]), peek()[0]
            if kind2 == "hats":
                take()
                return (body, "lit", term()[0], None)
            return (body, "lit", None, take()[1][1:]) if kind2 == "at" else (body, "lit", None, None)
        if kind == "number":
            return (value, "lit", t.XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if value in ("true", "false"):
            return (value, "lit", t.XSD + "boolean", None)
        if value == "a":
            return (t.TYPE, "iri", None, None)
        if value == "[":
            node = blank()
            if peek()[1] != "]":
                facts(node)
            take("]")
            return node
        if value == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take(")")
            rest: tuple = (t.RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = blank()
                out.append((*node[:2], t.RDF + "first", *item))
                out.append((*node[:2], t.RDF + "rest", *rest))
                rest = node
            return rest
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix == "_":
                return (f"_:{scope}.{local}", "bnode", None, None)
            if prefix not in prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return (prefixes[prefix] + local, "iri", None, None)
        raise TurtleError(f"{value!r} is no term")

    def facts(subject: tuple) -> None:
        while True:
            predicate = term()
            while True:
                out.append((*subject[:2], predicate[0], *term()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
                if peek()[1] in (".", "]", ";"):
                    continue
                break
            else:
                return
            if peek()[1] in (".", "]"):
                return

    while peek()[0] != "end":
        kind, value = peek()
        if value.lower().lstrip("@") in ("prefix", "base"):
            take()
            if value.lower().endswith("prefix"):
                name = take()[1].removesuffix(":")
                prefixes[name] = iri(take()[1])[0]
            else:
                state["base"] = iri(take()[1])[0]
            if value.startswith("@"):
                take(".")
            continue
        subject = term()
        if peek()[1] != ".":
            facts(subject)
        take(".")
    return list(dict.fromkeys(out))


def read_turtle(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Quads of all Turtle files under a path as one layer; a file is one unit of work. Blank nodes are a file's own, or those of the
    document that a first line `# document <id>` tells it to be a part of."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.ttl,part-*.txt}").load(path).select("path", F.col("content").cast("string").alias("text"))
    return parse_column(files, prefix)


def parse_column(files: DataFrame, prefix: str) -> DataFrame:
    """(path, text) -> quads."""
    columns = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                part = re.match(r"# document (\w+)\n", text)
                scope = part[1] if part else hashlib.md5(path.encode()).hexdigest()[:8] + "n"
                rows = parse(text, scope)
                for lo in range(0, len(rows), ROWS):
                    fields = list(zip(*rows[lo : lo + ROWS], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in fields] + [pa.array([f"urn:graph:{prefix}"] * len(fields[0]), pa.string())], [*columns, "g"])

    return files.select("path", "text").mapInArrow(run, QUAD)


def parse_layer(spark: SparkSession, text: str, prefix: str) -> DataFrame:
    """Quads of one Turtle text that is at hand, such as an upload; TurtleError before anything is made of it."""
    return spark.createDataFrame([(*row, f"urn:graph:{prefix}") for row in parse(text, f"{prefix}n")], QUAD)


def load_layer(ctx: GraphContext, prefix: str, text: str) -> GraphContext:
    """ctx with a layer read from Turtle text added or replaced; what can't be read leaves ctx as it is."""
    return ctx.with_layer(prefix, parse_layer(ctx.spark, text, prefix))


#: Lists of up to so many values are written as collections; longer ones, and such as other triples reach into, cell by cell.
MOST_INLINE = 200


def _shown(value: Column, kind: Column, dt: Column, lang: Column, prefixes: dict[str, str]) -> Column:
    """A term in Turtle."""
    short = [F.when(value.startswith(ns) & F.substring(value, len(ns) + 1, 1 << 30).rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{p}:"), F.substring(value, len(ns) + 1, 1 << 30))) for p, ns in prefixes.items()]
    escaped = value
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(mark))
    bare = ((dt == t.XSD + "integer") & value.rlike("^[+-]?[0-9]+$")) | ((dt == t.XSD + "decimal") & value.rlike(r"^[+-]?[0-9]*\.[0-9]+$")) | ((dt == t.XSD + "boolean") & value.isin("true", "false"))
    typed = F.coalesce(*(F.when(dt == t.XSD + x, F.lit(f"^^xsd:{x}")) for x in ("string", "date", "dateTime", "integer", "decimal", "boolean", "double")), F.concat(F.lit("^^<"), dt, F.lit(">")))
    literal = F.when(bare, value).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), F.coalesce(typed, F.concat(F.lit("@"), lang), F.lit(""))))
    # A name has neither white space nor signs that end it.
    iri = F.concat(F.lit("<"), F.regexp_replace(value, '[\\x00-\\x20<>"{}|^`\\\\]', ""), F.lit(">"))
    return F.when(kind == "lit", literal).when(kind == "bnode", F.concat(F.lit("_:"), F.regexp_replace(F.regexp_replace(value, "^_:", ""), "[^A-Za-z0-9_]", "_"))).otherwise(F.coalesce(*short, iri))


def _inlined(rows: DataFrame) -> DataFrame:
    """rows (with shown objects) in which lists of their own stand as collections in the place of their first cells; one within another stays."""
    cells = checkpointed(value_lists(rows.where(F.col("s_kind") == "bnode")).select("head", F.col("place").alias("at"), "node"))
    facts = rows.join(cells.withColumnRenamed("node", "s"), "s")
    about = facts.groupBy("head").agg(F.count(F.lit(1)).alias("facts"), F.count_if((F.col("p") == t.RDF + "rest") & (F.col("o") == t.RDF + "nil")).alias("ends"))
    reached = rows.join(cells.select(F.col("node").alias("o"), "head"), "o").groupBy("head").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("p") == t.RDF + "first").alias("nested"))
    sound = about.join(reached, "head").join(cells.groupBy("head").agg(F.count(F.lit(1)).alias("n")), "head").where(f"n <= {MOST_INLINE} and facts = 2 * n and reached = n and nested = 0 and ends = 1").select("head")
    inner = facts.where(F.col("p") == t.RDF + "first").join(sound, "head").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("at", "o_text"))).alias("items"))
    lists = inner.select(F.col("head").alias("o"), F.concat(F.lit("( "), F.array_join(F.transform("items", lambda x: x["o_text"]), " "), F.lit(" )")).alias("list"))
    gone = cells.join(sound, "head").select(F.col("node").alias("s"))
    return rows.join(gone, "s", "left_anti").join(lists, "o", "left").withColumn("o_text", F.coalesce("list", "o_text"))


def to_turtle(triples: DataFrame, prefixes: dict[str, str], sections: tuple[str, ...] = ()) -> DataFrame:
    """value: the lines of a Turtle document a partition, subject by subject, in the order of the sections (if triples have such a
    column) and then of their names; o_dt and o_lang may lack. A subject's facts may lie in neighbouring partitions, so that none is
    too large, and all partitions are parts of one document, within which blank nodes keep their names."""
    prefixes = t.STANDARD | prefixes
    none = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in triples.columns else none
    s_kind = F.coalesce(column("s_kind"), F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"))
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section")) if sections and "section" in triples.columns else F.lit(0)
    rows = triples.select(place.cast("int").alias("place"), "s", s_kind.alias("s_kind"), "p", "o", "o_kind", column("o_dt").alias("o_dt"), column("o_lang").alias("o_lang")).distinct()
    rows = rows.withColumn("o_text", _shown(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), prefixes))
    rows = _inlined(checkpointed(rows))
    p_text = F.when(F.col("p") == t.TYPE, "a").otherwise(_shown(F.col("p"), F.lit("iri"), none, none, prefixes))
    shown = rows.select("place", _shown(F.col("s"), F.col("s_kind"), none, none, prefixes).alias("s"), F.when(F.col("p") == t.TYPE, 0).otherwise(1).alias("first"), p_text.alias("p"), F.col("o_text").alias("o"))
    head = [f"# document {uuid.uuid4().hex}", *(f"@prefix {p}: <{ns}> ." for p, ns in prefixes.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject = predicate = None
        for batch in batches:
            lines = [] if subject is not None else list(head)
            for s, p, o in zip(*(batch[c].to_pylist() for c in ("s", "p", "o")), strict=True):
                if s != subject:
                    lines += ["."] if subject is not None else []
                    lines.append(f"{s} {p} {o}")
                else:
                    lines.append(f"  , {o}" if p == predicate else f"  ; {p} {o}")
                subject, predicate = s, p
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if subject is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["."], pa.string())], ["value"])

    return shown.repartitionByRange("place", "s", "first", "p", "o").sortWithinPartitions("place", "s", "first", "p", "o").mapInArrow(run, "value string")


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, sections: tuple[str, ...] = ()) -> None:
    """Part files *.ttl under a path, which read_turtle() takes as one document."""
    to_turtle(triples, prefixes or {}, sections).write.mode("overwrite").format("text").option("compression", "none").save(path)


def reread(triples: DataFrame, path: str, prefix: str, prefixes: dict[str, str] | None = None, sections: tuple[str, ...] = ()) -> DataFrame:
    """The triples as they come back from their Turtle text: what can't be parsed fails, and more or fewer triples do too."""
    write_turtle(triples, path, prefixes, sections)
    back = checkpointed(read_turtle(triples.sparkSession, path, prefix))
    kinds = [c for c in ("s", "p", "o", "o_kind", "o_dt", "o_lang") if c in triples.columns]
    if (n := back.count()) != (m := triples.select(*kinds).distinct().count()):
        raise TurtleError(f"{m} triples were written and {n} read back")
    return back
