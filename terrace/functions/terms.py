"""RDF terms as string columns: vocabularies, namespaces, short names, labels' normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
STANDARD = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "xsd": XSD}

TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
SUBCLASS, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "domain", RDFS + "range"
UNION = OWL + "unionOf"
CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY = OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty"

MATCHES = ("closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


def lexical(term: Column, kind: Column) -> Column:
    """STR(): blank nodes have none."""
    return F.when(kind != "bnode", term)


def namespace(iri: Column) -> Column:
    """Up to the first '#'; the whole where there is none."""
    return F.regexp_replace(iri, "#.*$", "#")


def namespace_last(iri: Column) -> Column:
    """Up to the last '#'."""
    return F.regexp_replace(iri, "#[^#]*$", "#")


def local_name(iri: Column) -> Column:
    """After the last '#'; the whole where there is none."""
    return F.regexp_replace(iri, "^.*#", "")


def short_prefix(iri: Column, before: str) -> Column:
    """The overlay's short name: what stands between `before` and the trailing '#' of the namespace."""
    return F.regexp_replace(F.regexp_replace(namespace(iri), f"^.*{before}", ""), "#$", "")


def graph_local(iri: Column) -> Column:
    """After the last '#', else the last path segment."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(F.rtrim(iri, F.lit("/")), "/", -1))


def curie(iri: Column, layers: dict[str, str]) -> Column:
    """prefix:local by the first namespace that fits, layers before standard vocabularies."""
    tries = [F.when(iri.startswith(ns), F.concat(F.lit(f"{p}:"), F.substring(iri, len(ns) + 1, 1 << 30))) for p, ns in [*layers.items(), *((p, ns) for p, ns in STANDARD.items() if p not in layers)] if ns]
    return F.coalesce(*tries, iri)


def pretty(value: Column, layers: dict[str, str]) -> Column:
    """Values that are IRIs in short form, others as they are."""
    return F.when(value.startswith("http"), curie(value, layers)).otherwise(value)


def layer_of(iri: Column, layers: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(iri.startswith(ns), F.lit(p)) for p, ns in layers.items()), F.lit("unknown"))


def is_match(predicate: Column) -> Column:
    """Any SKOS mapping predicate."""
    return predicate.startswith(SKOS) & predicate.contains("Match")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def literal(text: Column) -> Column:
    """A quoted Turtle string; line breaks become blanks."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), stripped(F.translate(escaped, "\r\n", "  ")), F.lit('"'))


def as_number(text: Column) -> Column:
    """A number as its shortest text: whole ones without a fraction, others from 1e-4 on in plain digits, smaller ones with an
    exponent of two digits at least; null for what is no finite number and for whole ones from 1e38 on."""
    value = stripped(text).try_cast("double")
    size, shown = F.abs(value), value.cast("string")
    whole = F.when(size < 9e18, value.cast("long").cast("string")).otherwise(value.try_cast("decimal(38, 0)").cast("string"))
    plain = F.regexp_replace(shown.try_cast("decimal(38, 22)").cast("string"), "0+$", "")
    small = F.concat(F.regexp_replace(F.substring_index(shown, "E", 1), "\\.0$", ""), F.lit("e-"), F.lpad(F.substring_index(shown, "E-", -1), 2, "0"))
    return F.when(value.isNotNull() & ~F.isnan(value) & (size < float("inf")), F.when((size >= 1e16) | (value == F.floor(value)), whole).when(size >= 1e-4, plain).otherwise(small))


def number_type(number: Column) -> Column:
    """The datatype that Turtle gives a number's text."""
    return F.when(number.contains("e"), XSD + "double").when(number.contains("."), XSD + "decimal").otherwise(XSD + "integer")


def norm(text: Column) -> Column:
    """Trimmed, without wrapping quotes, one blank for white space, lower case."""
    bare = F.regexp_replace(stripped(text), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    return F.lower(F.trim(F.regexp_replace(bare, "(?U)\\s+", " ")))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def local_iri(text: Column) -> Column:
    """A local name from free text: what follows '#', of one word what follows ':', several words joined in camel case, only word characters and '-'."""
    tail = F.substring_index(stripped(text), "#", -1)
    words = F.filter(F.split(tail, "(?U)\\s+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, lower_first(w)).otherwise(upper_first(w))), "")
    name = F.when(tail.contains(" "), joined).otherwise(F.regexp_replace(tail, "^[^:]*:", ""))
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "")


def class_iri(text: Column) -> Column:
    return upper_first(local_iri(text))


def reference_iri(text: Column) -> Column:
    """ref:… stays, other text gets the prefix."""
    trimmed = stripped(text)
    return F.when(trimmed.startswith("ref:"), trimmed).otherwise(F.concat(F.lit("ref:"), local_iri(trimmed)))


def yes(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "yes", F.lit(False))


def match_type(text: Column) -> Column:
    """The SKOS name of one of MATCHES written in any case and spacing; null if it is none."""
    bare = F.lower(F.replace(stripped(text), F.lit(" "), F.lit("")))
    return F.coalesce(*(F.when(bare == m.lower(), F.lit(m)) for m in MATCHES))


def identifier(text: Column, pascal: bool) -> Column:
    """Alphanumeric runs in Pascal or camel case."""
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: upper_first(w)), "")
    return joined if pascal else F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


# The named characters that markup itself needs and those usual in prose; the ampersand is last.
NAMED = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&middot;", "\u00b7"),
    ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&hellip;", "\u2026"), ("&amp;", "&"),
)


def unescaped(text: Column) -> Column:
    """Markup's named characters as themselves."""
    for name, character in NAMED:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def citation(vendor: Column, title: Column, source: Column) -> Column:
    head = F.when(F.coalesce(vendor, F.lit("")) != "", F.concat(vendor, F.lit(": "))).otherwise("")
    return F.concat(head, F.coalesce(title, F.lit("")), F.lit(" ("), F.coalesce(source, F.lit("")), F.lit(")"))


def without_fences(text: Column) -> Column:
    """JSON text out of a fenced block: its first line and last mark go, and a language's name before the text."""
    whole = stripped(text)
    inner = F.regexp_replace(F.regexp_replace(whole, "^[^\\n]*\\n", ""), "```$", "")
    return F.when(whole.startswith("```"), stripped(F.regexp_replace(inner, "(?U)^\\s*json", ""))).otherwise(whole)


def section_of(path: Column) -> Column:
    """A page's place: its path without a last index.html, or without .html in its last part."""
    head, last = F.regexp_extract(path, "^(.*/)?", 0), F.substring_index(path, "/", -1)
    return F.when(last == "index.html", F.regexp_replace(head, "/$", "")).otherwise(F.concat(head, F.replace(last, F.lit(".html"), F.lit(""))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """Of length one; a zero vector stays."""
    size = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
