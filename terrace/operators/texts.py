"""Queries as text: a folder of Spark SQL files, one query each, which is extended by adding a file.

    -- What the query answers; the first comment tells it.
    SELECT m.term, l.o AS label FROM {matches} m JOIN {triples} l ON l.s = m.term AND l.p = :rdfs_label WHERE startswith(m.term, :VENDOR)

In braces stand relations of the graph: triples(s, s_kind, p, o, o_kind), quads (with o_dt, o_lang, g), matches(term, match, obj),
verdicts(term, verdict), vendors(ns), layers(prefix, ns), and below_<prefix>_<name>(obj) for what subClassOf leads down to from a
class. Names after a colon are parameters: in capitals those of the caller, as <prefix>_<name> terms of a vocabulary or layer (the
name may be empty, which gives the namespace). All are bound as literals, never pasted. namespace(), local_name() and short_name()
are functions of the text. Spark's own parser reads the rest, so what it can't read is told with its line and place.
"""

from __future__ import annotations

import os
import re
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators.compare import matches, objects_under, verdicts
from terrace.plans.graph import GraphContext, vendors

FOLDER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "queries_sql")
#: What a parameter's name can't stand in: comments and quoted text.
ASIDE = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", re.S)
PARAMETER = re.compile(r"(?<![:\w]):([A-Za-z]\w*)")
RELATIONS = ("triples", "quads", "matches", "verdicts", "vendors", "layers")


class TextError(ValueError):
    """A query text that names what isn't there, with its place."""


@dataclass(frozen=True)
class QueryText:
    name: str
    text: str
    about: str
    params: tuple[str, ...] = ()  # the caller's, sorted
    terms: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()


def _where(text: str, piece: str) -> str:
    at = text.find(piece)
    return f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}" if at >= 0 else "the end"


def read_text(name: str, text: str) -> QueryText:
    about = re.search(r"--\s*(.+)", text)
    bare = ASIDE.sub(" ", text)
    if not re.match(r"\s*(SELECT|WITH|VALUES|FROM)\b", bare, re.I):
        raise TextError(f"{name}: a query begins with SELECT or WITH, not with {bare.split()[:1]}")
    try:
        relations = sorted({x for _, x, _, _ in string.Formatter().parse(bare) if x is not None})
    except ValueError as e:
        raise TextError(f"{name}: {e}") from e
    for x in relations:
        if x not in RELATIONS and not re.fullmatch(r"below_[A-Za-z0-9]+_\w+", x):
            raise TextError(f"{name}: no relation {{{x}}} at {_where(text, '{' + x)}; there are {', '.join(RELATIONS)} and below_<prefix>_<name>")
    names = sorted(set(PARAMETER.findall(bare)))
    given = tuple(x for x in names if re.fullmatch(r"[A-Z][A-Z0-9_]*", x))
    return QueryText(name, text, about[1].strip() if about else "", given, tuple(x for x in names if x not in given), tuple(relations))


def read_folder(spark: SparkSession, path: str = FOLDER) -> dict[str, QueryText]:
    """The queries of a folder's .sql files by name, which is the file's; any store that Spark reads will do."""
    if path == FOLDER:
        return _own()
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.sql").select(F.regexp_replace("_metadata.file_name", r"\.sql$", "").alias("name"), "value")
    return {r["name"]: read_text(r["name"], r["value"]) for r in sorted(files.collect())}


def _own() -> dict[str, QueryText]:
    """The library's own texts, read where the driver has them installed."""
    out = {}
    for file in sorted(x for x in os.listdir(FOLDER) if x.endswith(".sql")):
        with open(os.path.join(FOLDER, file), encoding="utf-8") as f:
            out[file.removesuffix(".sql")] = read_text(file.removesuffix(".sql"), f.read())
    return out


#: Functions of the texts, as column expressions over one string.
FUNCTIONS = {"namespace": "regexp_replace(x, '#.*$', '#')", "local_name": "regexp_replace(x, '^.*#', '')", "short_name": "regexp_replace(regexp_replace(regexp_replace(x, '#.*$', '#'), '^.*{before}', ''), '#$', '')"}


class TextEngine:
    """Runs a folder's queries over a graph."""

    def __init__(self, ctx: GraphContext, path: str = FOLDER):
        self.ctx = ctx
        self.queries = read_folder(ctx.spark, path)

    def list_queries(self) -> list[dict]:
        return [{"name": q.name, "params": list(q.params), "about": q.about} for _, q in sorted(self.queries.items())]

    def _relation(self, query: QueryText, name: str) -> DataFrame:
        ctx = self.ctx
        if name.startswith("below_"):
            return objects_under(ctx, self._term(query, name.removeprefix("below_"), "{" + name))
        make = {"triples": ctx.triples, "quads": ctx.quads, "matches": lambda: matches(ctx), "verdicts": lambda: verdicts(ctx), "vendors": lambda: vendors(ctx.triples()), "layers": lambda: ctx.spark.createDataFrame(list(ctx.namespaces.items()), "prefix string, ns string")}
        return make[name]()

    def _term(self, query: QueryText, name: str, shown: str) -> str:
        prefix, parted, local = name.partition("_")
        spaces = t.STANDARD | self.ctx.namespaces
        if not parted or prefix not in spaces:
            raise TextError(f"{query.name}: no vocabulary or layer {prefix!r} at {_where(query.text, shown)}; there are {', '.join(sorted(spaces))}")
        return spaces[prefix] + local

    def run(self, name: str, params: dict[str, str] | None = None) -> DataFrame:
        """KeyError for an unknown name, ValueError for missing parameters; others are ignored."""
        query, given = self.queries[name], params or {}
        if missing := [p for p in query.params if p not in given]:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        args = {p: given[p] for p in query.params} | {x: self._term(query, x, ":" + x) for x in query.terms}
        for function, body in FUNCTIONS.items():
            if function in query.text:
                self.ctx.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(x STRING) RETURNS STRING RETURN {body.replace('{before}', re.escape(self.ctx.short_before))}")
        return self.ctx.spark.sql(query.text, args=args, **{r: self._relation(query, r) for r in query.relations})
