"""Capture sheets to graph: row checks, verdicts, mappings, names, and the triples of every sheet.

Sheets are DataFrames with the capture headers in any case; `row` is the sheet's row number, the first data row being 2.
Triples are rows section, s, p, o, o_kind, o_dt with whole IRIs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import terms as t

# Fixed values of the capture contract.
VERDICTS = ("covered", "partial", "vendor-extension", "absent", "needs-verification")
DATATYPES = {"string": "string", "decimal": "decimal", "integer": "integer", "boolean": "boolean", "datetime": "dateTime"}
DATATYPE_WORDS = ("string", "text", "integer", "boolean", "decimal", "datetime")
TEMPLATE_VERSION = "1.0"
SHEETS = {
    "nodes": ("1. Nodes", "1. Data Objects"),
    "attributes": ("2. Data Properties", "2. Attributes"),
    "object properties": ("3. Object Properties",),
    "enums": ("4. Enums & Lookups",),
    "operations": ("5. Operations",),
    "context tables": ("5. Context Tables",),
    "context precedence": ("6. Context Precedence",),
}
REQUIRED = {
    "nodes": ("Layer", "Name", "IRI local name", "Type"),
    "attributes": ("Layer", "Data object", "Attribute", "IRI local name", "Datatype"),
    "object properties": ("Domain", "Property", "IRI local name", "Range"),
    "enums": ("Set name", "Kind", "Allowed values", "Layer"),
    "operations": ("Label",),
    "context tables": ("Layer", "Table name", "Field"),
    "context precedence": ("Layer", "Table name", "Order", "Key combination"),
}
LEGACY_REQUIRED = {"attributes": ("Data object", "Attribute", "IRI local name", "Datatype")}
#: Sheets whose names count as classes when a name is defined twice.
CLASS_SECTIONS = ("1. Data Objects", "4. Enums & Lookups", "5. Operations")
META_NAMES = (
    "DataObject", "ExternalReference", "PortalOperation", "operatesOn", "verdict", "sourceDoc", "operationKind", "confidence", "confirmsRefConcept", "promotionNote", "promotionEvidence",
    "UnresolvedReference", "ContextResolver", "ContextField", "PrecedenceTier", "resolvesTarget", "tableKind", "ofTable", "isKey", "isMandatory", "fieldComment", "keyField", "tierOrder",
)
SUBJECT_HEADERS = ("subject", "vendor concept", "opcenter evidence", "vendor evidence", "evidence", "source screen")
TARGET_HEADERS = ("ref concept", "target", "ref: target", "ref target")
NOTE_HEADERS = ("notes", "note", "recommendation", "rationale")

TRIPLE = "section string, s string, p string, o string, o_kind string, o_dt string"
ANNOTATION, ONTOLOGY, DATATYPE = t.OWL + "AnnotationProperty", t.OWL + "Ontology", t.RDFS + "Datatype"


class SheetError(ValueError):
    """A sheet or header that lacks, or names that collide."""


def sheet(df: DataFrame, required: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Headers trimmed and in lower case, cells trimmed text, blank rows dropped; SheetError for headers that lack."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    if missing := sorted({h.lower() for h in required}.difference(out.columns)):
        raise SheetError(f"missing headers: {', '.join(missing)}")
    cells = [c for c in out.columns if c != "row"]
    out = out.select(*([F.col("row")] if "row" in out.columns else []), *(F.coalesce(t.stripped(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in cells))
    return out.where(t.any_of([F.col(f"`{c}`") != "" for c in cells]))


def headers(sheets: dict[str, DataFrame], name: str) -> set[str]:
    """Lower-case headers of a sheet, whatever it requires; none where there is no such sheet."""
    return {c.strip().lower() for c in sheets[name].columns} - {"row"} if name in sheets else set()


def open_sheet(sheets: dict[str, DataFrame], kind: str, optional: bool = False) -> tuple[DataFrame, str] | None:
    """(sheet, name) of a kind by its present name or else an older one, which may require fewer headers."""
    found = next((n for n in SHEETS[kind] if n in sheets), None)
    if found is None:
        if optional:
            return None
        raise SheetError(f"no sheet {' or '.join(SHEETS[kind])} among {sorted(sheets)}")
    required = LEGACY_REQUIRED.get(kind, REQUIRED[kind]) if found != SHEETS[kind][0] else REQUIRED[kind]
    return sheet(sheets[found], required), found


def cell(rows: DataFrame, name: str) -> Column:
    """A cell's text; a column that lacks is empty."""
    return F.col(f"`{name.lower()}`") if name.lower() in rows.columns else F.lit("")


def template_version(cells: DataFrame) -> DataFrame:
    """Of (row, col, value) cells of a guide: version right of the first 'Template version', and warning where another is expected. No row: an older workbook."""
    along = Window.partitionBy("row").orderBy("col")
    after = F.when(F.lead("col").over(along) == F.col("col") + 1, F.lead("value").over(along))
    found = cells.withColumn("version", t.stripped(after)).where(F.lower(t.stripped(F.col("value"))) == "template version").orderBy("row", "col").limit(1)
    warning = F.when(F.col("version") != TEMPLATE_VERSION, F.concat(F.lit("template version "), F.col("version"), F.lit(f" where {TEMPLATE_VERSION} is expected")))
    return found.where(F.coalesce("version", F.lit("")) != "").select("version", warning.alias("warning"))


def in_layer(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of one layer; a sheet without that column is in scope as a whole."""
    return rows.where(t.norm(F.col("layer")) == t.norm(F.lit(prefix))) if "layer" in rows.columns else rows


def row_problems(rows: DataFrame, name: str, name_column: str = "name", mapping_column: str = "maps to neutral") -> DataFrame:
    """row, severity, problem: all problems of all rows of a sheet of nodes, attributes or object properties."""
    c = lambda x: cell(rows, x)
    known = lambda x: t.match_type(x).isNotNull()
    match, verdict, mapped, confidence = c("match type"), c("verdict"), c(mapping_column), c("confidence")
    second, second_match = c("secondary maps to neutral"), c("secondary match type")
    number = t.as_number(confidence).try_cast("double")
    say = lambda severity, when, text: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(f"{name}: {text}").alias("problem")))
    checks = [
        say("error", (c("layer") == "") if "layer" in rows.columns else F.lit(False), "Layer is empty"),
        say("error", (c(name_column) == "") & (c("iri local name") == ""), f"{name_column} and IRI local name are empty"),
        say("error", (match != "") & ~known(match), "unknown match type"),
        say("error", (verdict != "") & ~F.lower(verdict).isin(*VERDICTS), "unknown verdict"),
        say("error", (confidence != "") & (number.isNull() | ~number.between(0, 1)), "confidence is not within 0 and 1"),
        say("warning", (mapped != "") & (match == ""), "mapping without match type"),
        say("error", (second != "") & (second_match == ""), "secondary mapping without match type"),
        say("error", ~((second != "") & (second_match == "")) & (second_match != "") & ~known(second_match), "unknown secondary match type"),
    ]
    return rows.select("row", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("row", "x.severity", "x.problem")


def verdict_of(rows: DataFrame, mapping_column: str = "maps to neutral") -> Column:
    """The row's own verdict as written; else unmapped is an extension, close covered, another match partial; a mapping without a
    known match says nothing, nor does a sheet with neither column."""
    if "verdict" not in rows.columns and mapping_column not in rows.columns:
        return F.lit(None).cast("string")
    kind = t.match_type(cell(rows, "match type"))
    derived = F.when(cell(rows, mapping_column) == "", "vendor-extension").when(kind == "closeMatch", "covered").when(kind.isNotNull(), "partial")
    return F.coalesce(F.nullif(cell(rows, "verdict"), F.lit("")), derived)


def mapping_edges(rows: DataFrame, subject: str = "s", mapping_column: str = "maps to neutral") -> DataFrame:
    """subject, match, target of primary and secondary mappings."""
    pair = lambda target, match: F.struct(t.match_type(cell(rows, match)).alias("match"), F.when(cell(rows, target) != "", t.reference_iri(cell(rows, target))).alias("target"))
    edges = rows.select(subject, F.explode(F.array(pair(mapping_column, "match type"), pair("secondary maps to neutral", "secondary match type"))).alias("e"))
    return edges.select(subject, "e.match", "e.target").where("match is not null and target is not null")


def qualified_names(rows: DataFrame, owner: str, local: str) -> DataFrame:
    """Adds name: the local name, behind its owner's where several owners use it."""
    own = F.when((F.col(owner) != "") & (F.col(local) != ""), F.col(owner))
    by = Window.partitionBy(local)
    several = F.coalesce(F.min(own).over(by) != F.max(own).over(by), F.lit(False))
    return rows.withColumn("name", F.when(several, F.concat(t.local_iri(F.col(owner)), t.upper_first(F.col(local)))).otherwise(F.col(local)))


def known_names(nodes: DataFrame) -> DataFrame:
    """Of node rows with name, iri, row: n, iri by normal form of name and of iri, the last row's."""
    both = nodes.select(t.norm(F.col("name")).alias("n"), "iri", F.struct("row", F.lit(0).alias("k")).alias("at")).unionByName(nodes.select(t.norm(F.col("iri")).alias("n"), "iri", F.struct("row", F.lit(1).alias("k")).alias("at")))
    return both.groupBy("n").agg(F.max_by("iri", "at").alias("iri"))


ALTERNATIVES = "(?i)[|/]| or "


def resolve_classes(cells: DataFrame, known: DataFrame, column: str = "cell") -> DataFrame:
    """Adds iri, how to rows with a cell that names a class; known: n, iri as known_names() gives them.

    In turn: the name or IRI as it stands; without a trailing parenthesis; the first known of alternatives behind
    '|', '/' or ' or '; a datatype word or NEEDS VERIFICATION is unresolved; else a minted name. how says which:
    exact, bare, alternative, datatype, unverified, minted; alternative, datatype and unverified are worth a warning.
    """
    rows = cells.select(column).distinct()
    bare = t.stripped(F.regexp_replace(F.col(column), "(?U)\\s*\\([^)]*\\)\\s*$", ""))
    others = F.filter(F.split(bare, ALTERNATIVES), lambda x: t.stripped(x) != "")
    tries = F.concat(F.array(F.col(column), bare), F.when(bare.rlike(ALTERNATIVES), others).otherwise(F.array().cast("array<string>")))
    tries = rows.select(column, F.posexplode(tries).alias("place", "part")).withColumn("n", t.norm(F.col("part")))
    found = tries.join(known.withColumnRenamed("iri", "_iri"), "n").groupBy(column).agg(F.min_by("_iri", "place").alias("_found"), F.min("place").alias("_place"))
    datatype, unverified = F.lower(bare).isin(*DATATYPE_WORDS), F.upper(bare).startswith("NEEDS VERIFICATION")
    how = F.when(F.col("_place") == 0, "exact").when(F.col("_place") == 1, "bare").when(F.col("_place") > 1, "alternative").when(datatype, "datatype").when(unverified, "unverified").otherwise("minted")
    minted = t.class_iri(F.when(bare != "", bare).otherwise(F.col(column)))
    iri = F.coalesce("_found", F.when(datatype | unverified, "UnresolvedReference").otherwise(minted))
    return cells.join(rows.join(found, column, "left").select(column, iri.alias("iri"), how.alias("how")), column, "left")


def value_sets(rows: DataFrame) -> DataFrame:
    """set, iri, closed, place, value, notes of enums and lookups, one row a value and one with nulls for a set without any."""
    allowed = cell(rows, "allowed values")
    kind = F.lower(cell(rows, "kind"))
    values = F.filter(F.transform(F.split(allowed, "[;|]"), t.stripped), lambda x: x != "")
    closed = (kind == "enum") & (F.size(values) > 0) & ~F.lower(allowed).contains("extensible")
    out = rows.where(cell(rows, "set name") != "")
    return out.select("row", cell(rows, "set name").alias("set"), t.class_iri(cell(rows, "set name")).alias("iri"), closed.alias("closed"), cell(rows, "notes").alias("notes"), F.posexplode_outer(values).alias("place", "value"))


def attribute_ranges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds range, range_kind of attributes: a set that names a class is an object, a set of an enum or lookup a set, else a datatype."""
    own = cell(rows, "enum/lookup set")
    out = rows.join(known.select(F.col("n").alias("_n"), F.col("iri").alias("_iri")), (t.norm(own) == F.col("_n")) & (own != ""), "left")
    word = F.lower(cell(rows, "datatype"))
    typed = F.concat(F.lit("xsd:"), F.coalesce(*(F.when(word == k, F.lit(v)) for k, v in DATATYPES.items()), F.lit("string")))
    in_set = F.lower(cell(rows, "value kind")).isin("enum", "lookup") & (own != "")
    kind = F.when(F.col("_iri").isNotNull(), "object").when(in_set, "set").otherwise("datatype")
    return out.withColumn("range", F.coalesce("_iri", F.when(in_set, t.class_iri(own)), typed)).withColumn("range_kind", kind).drop("_n", "_iri")


def promotions(rows: DataFrame, prefix: str) -> DataFrame:
    """subject (a local name), target, evidence, note of a sheet whose headers have synonyms; SheetError without a target column."""
    pick = lambda names: next((h for h in names if h in rows.columns), None)
    subject, target, note = pick(SUBJECT_HEADERS), pick(TARGET_HEADERS), pick(NOTE_HEADERS)
    if target is None:
        raise SheetError(f"no column among {', '.join(TARGET_HEADERS)}")
    if subject is None:
        return rows.sparkSession.createDataFrame([], "subject string, target string, evidence string, note string")
    named = F.regexp_extract(cell(rows, subject), f"{prefix}:([A-Za-z0-9_.]+)", 1)
    own = F.when(named != "", t.class_iri(F.substring_index(named, ".", 1))).otherwise(t.class_iri(t.local_iri(cell(rows, target))))
    return rows.where(cell(rows, target) != "").select(own.alias("subject"), t.reference_iri(cell(rows, target)).alias("target"), cell(rows, subject).alias("evidence"), (cell(rows, note) if note else F.lit("")).alias("note"))


def context_fields(rows: DataFrame) -> DataFrame:
    """Rows of context tables with place (within the table) and first: whether the row is its table's first, which speaks for the table."""
    place = F.row_number().over(Window.partitionBy("table name").orderBy("row"))
    return rows.where(F.col("table name") != "").withColumn("place", place).withColumn("first", F.col("place") == 1)


def precedence(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Tiers by numeric order (others last): table, tier (the place within its table), number (over all tables), order, key, field_place
    (of the last of its table's fields with that name; null: unresolved), notes; a tier without keys has one row with nulls.

    fields: table name, field, place.
    """
    number = t.as_number(F.col("order")).try_cast("double")
    rows = rows.where(F.col("table name") != "").withColumn("tier", F.row_number().over(Window.partitionBy("table name").orderBy(number.asc_nulls_last(), "row")))
    # Tables in the order of their first rows; one row a table.
    tables = rows.groupBy("table name").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(tables.select("table name", before.alias("before")), "table name")
    keys = F.filter(F.transform(F.split("key combination", ";"), t.stripped), lambda x: x != "")
    notes = cell(rows, "notes").alias("notes")
    out = rows.select(F.col("table name").alias("table"), "tier", (F.col("before") + F.col("tier")).alias("number"), "order", notes, F.posexplode_outer(keys).alias("at", "key"))
    named = fields.where(F.col("field") != "").groupBy(F.col("table name").alias("table"), t.norm(F.col("field")).alias("n")).agg(F.max("place").alias("field_place"))
    return out.withColumn("n", t.norm(F.col("key"))).join(named, ["table", "n"], "left").select("table", "tier", "number", "order", "at", "key", "field_place", "notes")


def duplicate_definitions(defined: DataFrame) -> DataFrame:
    """(local, is_class): names defined more than once; among classes a warning, else an error."""
    out = defined.groupBy("local").agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_class").alias("classes")).where("n > 1")
    return out.select("local", "n", F.when(F.col("classes"), "warning").otherwise("error").alias("severity"))


def meta_clashes(defined: DataFrame) -> DataFrame:
    """Names of the sheets that the meta-schema has itself."""
    return defined.where(F.col("local").isin(*META_NAMES)).select("local").distinct()


@dataclass(frozen=True)
class Names:
    """The IRIs of one overlay."""

    prefix: str
    base: str

    @property
    def ns(self) -> str:
        return f"{self.base}{self.prefix}#"

    @property
    def ref(self) -> str:
        return f"{self.base}ref#"

    def own(self, local: Column | str) -> Column:
        return F.concat(F.lit(self.ns), local if isinstance(local, Column) else F.lit(local))

    def whole(self, curie: Column) -> Column:
        """ref:… as a whole IRI."""
        return F.concat(F.lit(self.ref), F.substring(curie, 5, 1 << 30))


def meta_schema(spark: SparkSession, names: Names) -> DataFrame:
    """The constant triples of every overlay."""
    p, ns = names.prefix, names.ns
    iri = lambda s, q, o: ("meta-schema", s, q, o, "iri", None)
    lit = lambda s, q, o: ("meta-schema", s, q, o, "lit", None)
    head = f"{names.base}{p}"
    rows = [iri(head, t.TYPE, ONTOLOGY), iri(head, t.OWL + "imports", f"{names.base}ref")]
    # Classes (name, parent, label, comment) and properties (name, kind, domain, range, label, comment) of the meta-schema.
    rows.append(lit(head, t.COMMENT, f"{p} vendor overlay. Deltas only: {p}: nodes plus SKOS mapping edges to the frozen ref: layer (imported, never restated). GENERATED from the capture workbook - do not hand-edit."))
    classes = (
        ("DataObject", None, f"{p} Data Object", None),
        ("ExternalReference", "DataObject", f"{p} External Reference", None),
        ("PortalOperation", None, f"{p} Portal Operation (action verb)", "Verb axis. Named PortalOperation so it cannot collide with a vendor data object called Operation."),
        ("UnresolvedReference", "ExternalReference", "Unresolved Reference", "Placeholder for a domain/range the master marks NEEDS VERIFICATION."),
        ("ContextResolver", "DataObject", f"{p} Context Resolver", "A table that resolves a target object at runtime from key field(s), rather than a static association."),
        ("ContextField", None, f"{p} Context Field", None),
        ("PrecedenceTier", None, f"{p} Context Precedence Tier", None),
    )
    properties = (
        ("operatesOn", t.OBJECT_PROPERTY, "PortalOperation", "DataObject", "operatesOn", None),
        ("verdict", ANNOTATION, None, None, None, None),
        ("sourceDoc", ANNOTATION, None, None, None, None),
        ("operationKind", ANNOTATION, None, None, None, None),
        ("confidence", t.DATATYPE_PROPERTY, None, "xsd:decimal", None, None),
        ("confirmsRefConcept", ANNOTATION, None, None, None, "Vendor independently confirms a ref: concept currently tagged Derived (Derived->Grounded signal)."),
        ("promotionNote", ANNOTATION, None, None, None, None),
        ("promotionEvidence", ANNOTATION, None, None, None, None),
        ("resolvesTarget", t.OBJECT_PROPERTY, "ContextResolver", None, "resolvesTarget", None),
        ("ofTable", t.OBJECT_PROPERTY, None, "ContextResolver", "ofTable", None),
        ("tableKind", ANNOTATION, None, None, None, None),
        ("isKey", t.DATATYPE_PROPERTY, "ContextField", "xsd:boolean", None, None),
        ("isMandatory", t.DATATYPE_PROPERTY, "ContextField", "xsd:boolean", None, None),
        ("fieldComment", ANNOTATION, None, None, None, None),
        ("keyField", t.OBJECT_PROPERTY, "PrecedenceTier", "ContextField", "keyField", None),
        ("tierOrder", t.DATATYPE_PROPERTY, "PrecedenceTier", "xsd:integer", None, None),
    )
    for name, parent, label, comment in classes:
        rows += [iri(ns + name, t.TYPE, t.CLASS), lit(ns + name, t.LABEL, label)]
        rows += [iri(ns + name, t.SUBCLASS, ns + parent)] if parent else []
        rows += [lit(ns + name, t.COMMENT, comment)] if comment else []
    for name, kind, domain, range_, label, comment in properties:
        rows.append(iri(ns + name, t.TYPE, kind))
        rows += [iri(ns + name, t.DOMAIN, ns + domain)] if domain else []
        rows += [iri(ns + name, t.RANGE, t.XSD + range_[4:] if range_.startswith("xsd:") else ns + range_)] if range_ else []
        rows += [lit(ns + name, t.LABEL, label)] if label else []
        rows += [lit(ns + name, t.COMMENT, comment)] if comment else []
    return spark.createDataFrame(rows, TRIPLE)


def _fact(p: str, o: Column | str | None, kind: str = "lit", dt: Column | str | None = None) -> Column:
    """One triple's p and o; an empty or null o is none."""
    value = o if isinstance(o, Column) else F.lit(o)
    as_col = dt if isinstance(dt, Column) else F.lit(dt).cast("string")
    return F.struct(F.lit(p).alias("p"), F.nullif(value, F.lit("")).alias("o"), F.lit(kind).alias("o_kind"), as_col.alias("o_dt"))


def _facts(rows: DataFrame, section: str, s: Column, facts: list[Column]) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), s.alias("s"), F.explode(F.array(*facts)).alias("x")).select("section", "s", "x.*").where("o is not null")


def _text(value: Column) -> Column:
    """A literal's text: line breaks are blanks."""
    return t.stripped(F.translate(value, "\r\n", "  "))


def _number(rows: DataFrame, names: Names) -> Column:
    number = t.as_number(cell(rows, "confidence"))
    return _fact(f"{names.ns}confidence", number, "lit", t.number_type(number))


def _comment(rows: DataFrame, *parts: tuple[str, str]) -> Column:
    """Notes behind what stands in other cells."""
    bits = [F.when(cell(rows, c) != "", F.concat(F.lit(before), cell(rows, c))) for c, before in (*parts, ("notes", ""))]
    return _fact(t.COMMENT, _text(F.concat_ws("; ", *bits)))


def _edges(rows: DataFrame, section: str, names: Names, mapping_column: str = "maps to neutral") -> DataFrame:
    edges = mapping_edges(rows, "s", mapping_column)
    return edges.select(F.lit(section).alias("section"), "s", F.concat(F.lit(t.SKOS), "match").alias("p"), names.whole(F.col("target")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))


def node_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """Node rows of a layer that have a name, with iri (the class's local name)."""
    rows = in_layer(rows, prefix).where(F.col("name") != "")
    return rows.withColumn("iri", t.class_iri(F.when(cell(rows, "iri local name") != "", cell(rows, "iri local name")).otherwise(F.col("name"))))


def node_triples(nodes: DataFrame, names: Names) -> DataFrame:
    """Of node_rows(): class, parent, label, verdict, source, confidence, comment, mappings."""
    rows = nodes.withColumn("s", names.own(F.col("iri")))
    parent = names.own(F.when(F.lower("type").contains("external"), "ExternalReference").otherwise("DataObject"))
    facts = [_fact(t.TYPE, t.CLASS, "iri"), _fact(t.SUBCLASS, parent, "iri"), _fact(t.LABEL, _text(F.col("name"))), _fact(f"{names.ns}verdict", _text(verdict_of(rows))), _fact(f"{names.ns}sourceDoc", _text(cell(rows, "source doc"))), _number(rows, names), _comment(rows)]
    return _facts(rows, "nodes", F.col("s"), facts).unionByName(_edges(rows, "nodes", names))


def set_triples(rows: DataFrame, names: Names) -> DataFrame:
    """Closed sets as datatypes with a list of their values, others as concept schemes with members."""
    values = value_sets(rows).withColumn("s", names.own(F.col("iri")))
    heads = values.where("coalesce(place, 0) = 0")
    shut, open_ = heads.where("closed"), heads.where(~F.col("closed"))
    node = lambda place: F.concat(F.lit("_:"), F.col("iri"), F.lit("_"), place.cast("string"))
    whole = F.concat(F.lit("_:"), F.col("iri"))
    notes = _fact(t.COMMENT, _text(F.col("notes")))
    parts = [
        _facts(shut, "enums", F.col("s"), [_fact(t.TYPE, DATATYPE, "iri"), _fact(t.LABEL, _text(F.col("set"))), notes, _fact(t.OWL + "equivalentClass", whole, "bnode")]),
        _facts(shut, "enums", whole, [_fact(t.TYPE, DATATYPE, "iri"), _fact(t.OWL + "oneOf", node(F.lit(0)), "bnode")]),
        _facts(open_, "enums", F.col("s"), [_fact(t.TYPE, t.SKOS + "ConceptScheme", "iri"), _fact(t.LABEL, _text(F.col("set"))), notes]),
    ]
    listed = values.where("closed").withColumn("last", F.col("place") == F.max("place").over(Window.partitionBy("row")))
    parts += [
        _facts(listed, "enums", node(F.col("place")), [_fact(t.RDF + "first", _text(F.col("value"))), _fact(t.RDF + "rest", F.when(~F.col("last"), node(F.col("place") + 1)), "bnode"), _fact(t.RDF + "rest", F.when(F.col("last"), F.lit(t.RDF + "nil")), "iri")]),
    ]
    member = values.where(~F.col("closed") & F.col("value").isNotNull() & ~F.lower("value").contains("extensible"))
    parts.append(_facts(member, "enums", F.concat(F.col("s"), F.lit("_"), t.local_iri(F.col("value"))), [_fact(t.TYPE, t.SKOS + "Concept", "iri"), _fact(t.SKOS + "inScheme", F.col("s"), "iri"), _fact(t.SKOS + "prefLabel", _text(F.col("value")))]))
    return reduce(DataFrame.unionByName, parts)


def _property_rows(rows: DataFrame, prefix: str, owner: str, label: str) -> DataFrame:
    """Rows in scope with an owner; iri: the local name, qualified where owners share it."""
    rows = in_layer(rows, prefix).where(cell(rows, owner) != "")
    rows = rows.withColumn("_owner", cell(rows, owner)).withColumn("_local", t.local_iri(F.when(cell(rows, "iri local name") != "", cell(rows, "iri local name")).otherwise(cell(rows, label))))
    return qualified_names(rows, "_owner", "_local").withColumnRenamed("name", "iri").drop("_owner", "_local")


def attribute_rows(rows: DataFrame, prefix: str, known: DataFrame) -> DataFrame:
    rows = attribute_ranges(_property_rows(rows, prefix, "data object", "attribute"), known)
    return resolve_classes(rows.withColumnRenamed("iri", "local"), known, "data object").withColumnsRenamed({"iri": "domain_iri", "how": "domain_how", "local": "iri"})


def attribute_triples(attributes: DataFrame, names: Names) -> DataFrame:
    """Of attribute_rows()."""
    rows = attributes.withColumn("s", names.own(F.col("iri")))
    kind = F.when(F.col("range_kind") == "object", t.OBJECT_PROPERTY).otherwise(t.DATATYPE_PROPERTY)
    range_ = F.when(F.col("range_kind") == "datatype", F.concat(F.lit(t.XSD), F.substring("range", 5, 100))).otherwise(names.own(F.col("range")))
    column = "maps to neutral attribute"
    facts = [_fact(t.TYPE, kind, "iri"), _fact(t.LABEL, _text(F.col("attribute"))), _fact(t.DOMAIN, names.own(F.col("domain_iri")), "iri"), _fact(t.RANGE, range_, "iri"), _fact(f"{names.ns}verdict", _text(verdict_of(rows, column))), _number(rows, names), _comment(rows, ("cardinality", "cardinality "), ("conditional on", "conditional on "))]
    return _facts(rows, "attributes", F.col("s"), facts).unionByName(_edges(rows, "attributes", names, column))


def object_property_rows(rows: DataFrame, prefix: str, known: DataFrame) -> DataFrame:
    rows = _property_rows(rows, prefix, "domain", "property").withColumnRenamed("iri", "local")
    rows = resolve_classes(rows, known, "domain").withColumnsRenamed({"iri": "domain_iri", "how": "domain_how"})
    return resolve_classes(rows, known, "range").withColumnsRenamed({"iri": "range_iri", "how": "range_how", "local": "iri"})


def object_property_triples(properties: DataFrame, names: Names) -> DataFrame:
    """Of object_property_rows()."""
    rows = properties.withColumn("s", names.own(F.col("iri")))
    facts = [_fact(t.TYPE, t.OBJECT_PROPERTY, "iri"), _fact(t.LABEL, _text(cell(rows, "property"))), _fact(t.DOMAIN, names.own(F.col("domain_iri")), "iri"), _fact(t.RANGE, names.own(F.col("range_iri")), "iri"), _fact(f"{names.ns}verdict", _text(verdict_of(rows))), _number(rows, names), _comment(rows, ("cardinality", "cardinality "), ("conditional on", "conditional on "))]
    return _facts(rows, "object properties", F.col("s"), facts).unionByName(_edges(rows, "object properties", names))


def operation_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Operations with iri, target (the operatesOn cell, whose header may go on) and target_iri."""
    rows = rows.where(F.col("label") != "")
    column = next((c for c in rows.columns if c.startswith("operateson")), "operateson")
    named = t.class_iri(F.when(cell(rows, "operation iri") != "", cell(rows, "operation iri")).otherwise(F.col("label")))
    rows = rows.withColumn("local", named).withColumn("target", cell(rows, column))
    return resolve_classes(rows, known, "target").withColumnsRenamed({"iri": "target_iri", "how": "target_how", "local": "iri"})


def operation_triples(operations: DataFrame, names: Names) -> DataFrame:
    """Of operation_rows()."""
    rows = operations
    facts = [_fact(t.TYPE, names.own("PortalOperation"), "iri"), _fact(t.LABEL, _text(F.col("label"))), _fact(f"{names.ns}operatesOn", F.when(F.col("target") != "", names.own(F.col("target_iri"))), "iri")]
    facts += [_fact(f"{names.ns}{p}", _text(cell(rows, c))) for c, p in (("kind", "operationKind"), ("verdict", "verdict"), ("source doc", "sourceDoc"))]
    return _facts(rows, "operations", names.own(F.col("iri")), [*facts, _number(rows, names), _comment(rows)])


def promotion_triples(rows: DataFrame, names: Names) -> DataFrame:
    own = promotions(rows, names.prefix)
    facts = [_fact(f"{names.ns}confirmsRefConcept", names.whole(F.col("target")), "iri"), _fact(f"{names.ns}promotionEvidence", _text(F.col("evidence"))), _fact(f"{names.ns}promotionNote", _text(F.col("note")))]
    return _facts(own, "promotions", names.own(F.col("subject")), facts)


def context_rows(rows: DataFrame, prefix: str, known: DataFrame) -> DataFrame:
    """Rows of context tables with iri (of the table), place, first and target_iri."""
    rows = context_fields(in_layer(rows, prefix))
    rows = rows.withColumn("local", t.class_iri(F.col("table name"))).withColumn("target", F.when(F.col("first"), cell(rows, "resolves (target)")).otherwise(""))
    return resolve_classes(rows, known, "target").withColumnsRenamed({"iri": "target_iri", "how": "target_how", "local": "iri"})


def context_triples(contexts: DataFrame, names: Names) -> DataFrame:
    """Of context_rows(): a resolver a table, told by its first row, and a node a field."""
    rows = contexts.withColumn("s", names.own(F.col("iri")))
    tables, fields = rows.where("first"), rows.where(F.col("field") != "")
    facts = [_fact(t.TYPE, names.own("ContextResolver"), "iri"), _fact(t.LABEL, _text(F.col("table name"))), _fact(f"{names.ns}resolvesTarget", F.when(F.col("target") != "", names.own(F.col("target_iri"))), "iri"), _fact(f"{names.ns}tableKind", _text(cell(rows, "table kind"))), _fact(f"{names.ns}verdict", _text(verdict_of(rows))), _fact(f"{names.ns}sourceDoc", _text(cell(rows, "source doc"))), _comment(rows)]
    truth = lambda c: F.when(t.yes(cell(rows, c)), "true").otherwise("false")
    of_field = [_fact(t.TYPE, names.own("ContextField"), "iri"), _fact(t.LABEL, _text(F.col("field"))), _fact(f"{names.ns}ofTable", F.col("s"), "iri"), _fact(f"{names.ns}isKey", truth("is key"), "lit", t.XSD + "boolean"), _fact(f"{names.ns}isMandatory", truth("is mandatory"), "lit", t.XSD + "boolean"), _fact(f"{names.ns}fieldComment", _text(cell(rows, "field comment")))]
    field = F.concat(F.col("s"), F.lit("_field"), F.col("place").cast("string"))
    return _facts(tables, "context tables", F.col("s"), facts).unionByName(_edges(tables, "context tables", names)).unionByName(_facts(fields, "context tables", field, of_field))


def precedence_triples(tiers: DataFrame, names: Names) -> DataFrame:
    """Of precedence(): a node a tier and its key fields."""
    table = names.own(t.class_iri(F.col("table")))
    local = t.local_iri(F.col("order"))
    s = F.concat(table, F.lit("_precedence"), F.when(local != "", local).otherwise(F.col("number").cast("string")))
    number = t.as_number(F.col("order"))
    facts = [_fact(t.TYPE, names.own("PrecedenceTier"), "iri"), _fact(f"{names.ns}ofTable", table, "iri"), _fact(f"{names.ns}tierOrder", number, "lit", t.number_type(number)), _fact(t.COMMENT, _text(F.col("notes")))]
    key = F.concat(table, F.lit("_field"), F.col("field_place").cast("string"))
    return _facts(tiers.where("coalesce(at, 0) = 0"), "context precedence", s, facts).unionByName(_facts(tiers, "context precedence", s, [_fact(f"{names.ns}keyField", key, "iri")]))


@dataclass(frozen=True)
class Overlay:
    """A workbook's triples; problems (sheet, row, severity, problem) of its rows; findings (severity, finding) of its names and references."""

    triples: DataFrame
    problems: DataFrame
    findings: DataFrame

    def checked(self) -> DataFrame:
        """The triples; SheetError if a row or a name is wrong. No triple is given for a workbook with errors."""
        wrong = self.problems.where("severity = 'error'").select(F.concat_ws(" ", "sheet", "row", "problem").alias("x")).unionByName(self.findings.where("severity = 'error'").select(F.col("finding").alias("x")))
        if found := [r["x"] for r in wrong.orderBy("x").limit(20).collect()]:
            raise SheetError("; ".join(found))
        return self.triples


def overlay(spark: SparkSession, sheets: dict[str, DataFrame], prefix: str, base: str) -> Overlay:
    """All triples of one layer's workbook, and what is wrong with it; rows of every layer are checked."""
    names = Names(prefix, base)
    (nodes, node_name), (attributes, attribute_name), (properties, property_name), (sets, set_name) = (open_sheet(sheets, k) for k in ("nodes", "attributes", "object properties", "enums"))
    own = node_rows(nodes, prefix)
    known = known_names(own)
    a, o = attribute_rows(attributes, prefix, known), object_property_rows(properties, prefix, known)
    triples = [meta_schema(spark, names), node_triples(own, names), set_triples(sets, names), attribute_triples(a, names), object_property_triples(o, names)]
    define = lambda rows, section: rows.select(F.col("iri").alias("local"), F.lit(section in CLASS_SECTIONS).alias("is_class"))
    defined = [define(own, node_name), define(value_sets(sets).where("coalesce(place, 0) = 0"), set_name), define(a, attribute_name), define(o, property_name)]
    told = lambda rows, column, how: rows.select(F.col(column).alias("cell"), F.col(how).alias("how"))
    referenced = [told(a, "data object", "domain_how"), told(o, "domain", "domain_how"), told(o, "range", "range_how")]
    unresolved = spark.createDataFrame([], "severity string, finding string")
    if found := open_sheet(sheets, "operations", True):
        rows = operation_rows(found[0], known)
        triples.append(operation_triples(rows, names))
        defined.append(define(rows, found[1]))
        referenced.append(told(rows.where("target <> ''"), "target", "target_how"))
    if name := next((n for n in sheets if "promotion" in n.lower()), None):
        triples.append(promotion_triples(sheet(sheets[name]), names))
    if found := open_sheet(sheets, "context tables", True):
        rows = context_rows(found[0], prefix, known)
        triples.append(context_triples(rows, names))
        defined.append(define(rows.where("first"), found[1]))
        referenced.append(told(rows.where("target <> ''"), "target", "target_how"))
    if found_tiers := open_sheet(sheets, "context precedence", True):
        fields = context_fields(in_layer(found[0], prefix)) if found else spark.createDataFrame([], "`table name` string, field string, place int")
        tiers = precedence(in_layer(found_tiers[0], prefix), fields)
        triples.append(precedence_triples(tiers, names))
        unresolved = tiers.where("key is not null and field_place is null").select(F.lit("warning").alias("severity"), F.concat(F.lit("unknown key field: "), "table", F.lit(", "), "key").alias("finding"))
    every = reduce(DataFrame.unionByName, defined)
    findings = [
        unresolved,
        duplicate_definitions(every).select("severity", F.concat(F.lit("defined more than once: "), "local").alias("finding")),
        meta_clashes(every).select(F.lit("error").alias("severity"), F.concat(F.lit("name of the meta-schema: "), "local").alias("finding")),
        reduce(DataFrame.unionByName, referenced).where(F.col("how").isin("alternative", "datatype", "unverified")).select(F.lit("warning").alias("severity"), F.concat(F.lit("reference taken as "), "how", F.lit(": "), "cell").alias("finding")),
    ]
    checks = [(nodes, node_name, "name", "maps to neutral"), (attributes, attribute_name, "attribute", "maps to neutral attribute"), (properties, property_name, "property", "maps to neutral")]
    problems = [row_problems(rows, name, column, mapping).withColumn("sheet", F.lit(name)) for rows, name, column, mapping in checks]
    return Overlay(reduce(DataFrame.unionByName, triples), reduce(DataFrame.unionByName, problems), reduce(DataFrame.unionByName, findings))


def validate(triples: DataFrame, ns: str, ref: str) -> DataFrame:
    """check, s, o: everything wrong with the triples (s, p, o, o_kind) of one overlay."""
    own = triples.select("s", "p", "o", "o_kind").distinct()
    inside = F.col("o").startswith(ns) & (F.col("o_kind") == "iri")
    typed = own.where(F.col("p") == t.TYPE)
    data = typed.where(F.col("o") == t.DATATYPE_PROPERTY).select("s")
    # A lookup's concept scheme may be a range as well.
    fine = typed.where(F.col("o").isin(DATATYPE, t.SKOS + "ConceptScheme")).select(F.col("s").alias("o"))
    pointing = own.where(F.col("p").isin(t.DOMAIN, t.RANGE, f"{ns}operatesOn") & inside)
    spark = triples.sparkSession
    counts = own.agg(F.count(F.when((F.col("p") == t.SUBCLASS) & F.col("o").isin(f"{ns}DataObject", f"{ns}ExternalReference") & ~F.col("s").isin(*(ns + n for n in META_NAMES)), 1)).alias("objects"), F.count(F.when(t.is_match(F.col("p")), 1)).alias("edges"))
    empty = counts.select(F.explode(F.array_compact(F.array(F.when(F.col("objects") == 0, "no data objects"), F.when(F.col("edges") == 0, "no mapping edges")))).alias("check"))
    found = {
        "mapping outside the reference": own.where(t.is_match(F.col("p")) & ~F.col("o").startswith(ref)),
        "reference as subject": own.where(F.col("s").startswith(ref) & (F.lit(ns) != ref)),
        "datatype property with class range": own.where((F.col("p") == t.RANGE) & inside).join(data, "s", "left_semi").join(fine, "o", "left_anti"),
        "annotation without quotes": own.where(F.col("p").isin(*(ns + n for n in ("verdict", "sourceDoc", "operationKind"))) & (F.col("o_kind") != "lit")),
        "dangling reference": pointing.join(typed.select(F.col("s").alias("o")).distinct(), "o", "left_anti"),
    }
    nothing = F.lit(None).cast("string")
    frames = [df.select(F.lit(k).alias("check"), "s", "o") for k, df in found.items()]
    return reduce(DataFrame.unionByName, [*frames, empty.select("check", nothing.alias("s"), nothing.alias("o"))])


SECTIONS = {"classes": t.CLASS, "object properties": t.OBJECT_PROPERTY, "datatype properties": t.DATATYPE_PROPERTY}


def section_counts(triples: DataFrame) -> DataFrame:
    """section, n: classes, properties, operations, mappings, verdicts, by triple."""
    typed = F.col("p") == t.TYPE
    kind = F.coalesce(*(F.when(typed & (F.col("o") == v), F.lit(k)) for k, v in SECTIONS.items()), F.when(typed & F.col("o").endswith("#PortalOperation"), "operations"), F.when(t.is_match(F.col("p")), "mappings"), F.when(F.col("p").endswith("#verdict"), "verdicts"), F.when(F.col("p").endswith("#operatesOn"), "operates on"))
    return triples.withColumn("section", kind).where("section is not null").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def is_empty_layer(triples: DataFrame) -> bool:
    """Whether no class or no mapping was made."""
    have = {r["section"] for r in section_counts(triples).collect()}
    return not {"classes", "mappings"} <= have
