"""The generator against Turtle worked out by hand from the capture rules, its findings, and the checks of its result."""

import pytest
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators import generate
from terrace.sources.turtle import parse

BASE = "https://kg.example.org/ns-"


def workbook(spark):
    frame = lambda header, *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 2)], ["row", *header])
    return {
        "1. Nodes": frame(
            ["Layer", "Name", "IRI local name", "Type", "Maps to neutral", "Match type", "VERDICT", "Secondary maps to neutral", "Secondary match type", "Confidence", "Source doc", "Notes"],
            ("V", "Lot Order (LO)", "lotOrder", "Data Object", "ref:Order", "Close Match", "", "Batch item", "relatedMatch", "0.90", "d/1", 'says "x"'),
            ("v ", "Ware house", "", "External System", "", "", "", "", "", "", "", ""),
            ("'v'", "Step", "", "Data Object", "Step", "broadMatch", "Needs-Verification", "", "", "1", "", ""),
            ("other", "Else", "", "Data Object", "", "", "", "", "", "", "", ""),
            ("", "", "", "", "", "", "", "", "", "", "", " "),
        ),
        "2. Attributes": frame(
            ["Data object", "Attribute", "IRI local name", "Datatype", "Value kind", "Enum/Lookup set", "Cardinality", "Conditional on", "Notes"],
            ("Lot Order (LO)", "due date", "", "DateTime", "", "", "1", "open", "n"),
            ("Step", "Name", "name", "text", "", "", "", "", ""),
            ("Ware house", "Name", "name", "string", "enum", "unit kind", "", "", ""),
            ("step (self)", "site", "", "string", "lookup", "Ware House", "", "", ""),
        ),
        "3. Object Properties": frame(["Domain", "Property", "IRI local name", "Range", "VERDICT"], ("Step", "runs at", "", "Nowhere / Ware house", ""), ("Step", "next", "v:nextStep", "NEEDS VERIFICATION (Step)", "partial")),
        "4. Enums & Lookups": frame(["Set name", "Kind", "Allowed values", "Layer", "Notes"], ("unit kind", "Enum", "a; b|", "z", ""), ("Colour", "Enum", "red; extensible", "v", "c")),
        "5. Operations": frame(["Label", "Kind", "operatesOn (v:)", "Confidence"], ("start lot", "write", "lotorder", "high")),
        "7. Promotions": frame(["Evidence", "Ref: target", "Note"], ("see v:step.Level (x)", "Process step", "why"), ("prose", "ref:Lot", "")),
        "5. Context Tables": frame(
            ["Layer", "Table name", "Field", "Table kind", "Resolves (target)", "Is key", "Is mandatory", "Field comment"],
            ("v", "Step Context", "Product", "smart", "Step", "Yes", "no", "c"), ("v", "Step Context", "", "", "", "", "", ""), ("v", "Step Context", "Line", "x", "", "", "YES", ""),
        ),
        "6. Context Precedence": frame(["Layer", "Table name", "Order", "Key combination", "Notes"], ("v", "Step Context", "2", "product", ""), ("v", "Step Context", "1", "PRODUCT; Line; Shift", "first"), ("v", "Step Context", "", "line", "")),
    }


EXPECTED = f"""@prefix v: <{BASE}v#> . @prefix ref: <{BASE}ref#> . @prefix owl: <{t.OWL}> . @prefix rdf: <{t.RDF}> . @prefix rdfs: <{t.RDFS}> . @prefix skos: <{t.SKOS}> . @prefix xsd: <{t.XSD}> .
v:LotOrder a owl:Class ; rdfs:subClassOf v:DataObject ; rdfs:label "Lot Order (LO)" ; v:verdict "covered" ; v:sourceDoc "d/1" ; v:confidence 0.9 ; rdfs:comment "says \\"x\\"" ; skos:closeMatch ref:Order ; skos:relatedMatch ref:batchItem .
v:WareHouse a owl:Class ; rdfs:subClassOf v:ExternalReference ; rdfs:label "Ware house" ; v:verdict "vendor-extension" .
v:Step a owl:Class ; rdfs:subClassOf v:DataObject ; rdfs:label "Step" ; v:verdict "Needs-Verification" ; v:confidence 1 ; skos:broadMatch ref:Step .
v:UnitKind a rdfs:Datatype ; rdfs:label "unit kind" ; owl:equivalentClass [ a rdfs:Datatype ; owl:oneOf ( "a" "b" ) ] .
v:Colour a skos:ConceptScheme ; rdfs:label "Colour" ; rdfs:comment "c" .
v:Colour_red a skos:Concept ; skos:inScheme v:Colour ; skos:prefLabel "red" .
v:dueDate a owl:DatatypeProperty ; rdfs:label "due date" ; rdfs:domain v:LotOrder ; rdfs:range xsd:dateTime ; rdfs:comment "cardinality 1; conditional on open; n" .
v:StepName a owl:DatatypeProperty ; rdfs:label "Name" ; rdfs:domain v:Step ; rdfs:range xsd:string .
v:wareHouseName a owl:DatatypeProperty ; rdfs:label "Name" ; rdfs:domain v:WareHouse ; rdfs:range v:UnitKind .
v:site a owl:ObjectProperty ; rdfs:label "site" ; rdfs:domain v:Step ; rdfs:range v:WareHouse .
v:runsAt a owl:ObjectProperty ; rdfs:label "runs at" ; rdfs:domain v:Step ; rdfs:range v:WareHouse ; v:verdict "vendor-extension" .
v:nextStep a owl:ObjectProperty ; rdfs:label "next" ; rdfs:domain v:Step ; rdfs:range v:UnresolvedReference ; v:verdict "partial" .
v:StartLot a v:PortalOperation ; rdfs:label "start lot" ; v:operatesOn v:LotOrder ; v:operationKind "write" .
v:Step v:confirmsRefConcept ref:processStep ; v:promotionEvidence "see v:step.Level (x)" ; v:promotionNote "why" .
v:Lot v:confirmsRefConcept ref:Lot ; v:promotionEvidence "prose" .
v:StepContext a v:ContextResolver ; rdfs:label "Step Context" ; v:resolvesTarget v:Step ; v:tableKind "smart" .
v:StepContext_field1 a v:ContextField ; rdfs:label "Product" ; v:ofTable v:StepContext ; v:isKey true ; v:isMandatory false ; v:fieldComment "c" .
v:StepContext_field3 a v:ContextField ; rdfs:label "Line" ; v:ofTable v:StepContext ; v:isKey false ; v:isMandatory true .
v:StepContext_precedence1 a v:PrecedenceTier ; v:ofTable v:StepContext ; v:tierOrder 1 ; rdfs:comment "first" ; v:keyField v:StepContext_field1 , v:StepContext_field3 .
v:StepContext_precedence2 a v:PrecedenceTier ; v:ofTable v:StepContext ; v:tierOrder 2 ; v:keyField v:StepContext_field1 .
v:StepContext_precedence3 a v:PrecedenceTier ; v:ofTable v:StepContext ; v:keyField v:StepContext_field3 .
"""


def plain(rows):
    """Triples without the names of blank nodes."""
    return sorted((s if not s.startswith("_:") else "_:", p, o if kind != "bnode" else "_:", kind, dt or None) for s, p, o, kind, dt in rows)


@pytest.fixture(scope="module")
def made(spark):
    return generate.overlay(spark, workbook(spark), "v", BASE)


def test_all_sheets_make_the_triples_worked_out_by_hand(made):
    got = plain((r.s, r.p, r.o, r.o_kind, r.o_dt) for r in made.checked().where("section <> 'meta-schema'").collect())
    assert got == plain((s, p, o, kind, dt) for s, _, p, o, kind, dt, _ in parse(EXPECTED))


def test_meta_schema(made):
    rows = {(r.s.removeprefix(BASE), r.p.rsplit("#")[-1], r.o.removeprefix(BASE)) for r in made.triples.where("section = 'meta-schema'").collect()}
    assert len(rows) == 57 and {("v#operatesOn", "domain", "v#PortalOperation"), ("v#UnresolvedReference", "subClassOf", "v#ExternalReference"), ("v#tierOrder", "range", t.XSD + "integer"), ("v", "imports", "ref")} <= rows
    assert {s.partition("#")[2] for s, p, _ in rows if p == "type" and "#" in s} == set(generate.META_NAMES)


def test_warnings_and_checks_of_a_sound_workbook(made):
    assert {(r.severity, r.finding) for r in made.findings.collect()} == {
        ("warning", "unknown key field: Step Context, Shift"), ("warning", "reference taken as alternative: Nowhere / Ware house"), ("warning", "reference taken as unverified: NEEDS VERIFICATION (Step)"),
    }
    assert made.problems.count() == 0 and not generate.is_empty_layer(made.triples)
    assert generate.validate(made.triples, f"{BASE}v#", f"{BASE}ref#").count() == 0


def test_wrong_rows_and_names_stop_the_triples(spark):
    sheets = workbook(spark)
    bad = spark.createDataFrame([(9, "v", "", "", "Data Object", "exactMatch", "x"), (10, "v", "Verdict", "verdict", "", "", ""), (11, "", "A", "", "", "", "")], ["row", "Layer", "Name", "IRI local name", "Type", "Match type", "Secondary maps to neutral"])
    sheets["1. Nodes"] = sheets["1. Nodes"].unionByName(bad, allowMissingColumns=True)
    out = generate.overlay(spark, sheets, "v", BASE)
    assert {(r.row, r.problem) for r in out.problems.collect()} == {
        (9, "1. Nodes: name and IRI local name are empty"), (9, "1. Nodes: unknown match type"), (9, "1. Nodes: secondary mapping without match type"), (11, "1. Nodes: Layer is empty"),
    }
    with pytest.raises(generate.SheetError):
        out.checked()
    clash = spark.createDataFrame([("Verdict", True), ("verdict", False), ("verdict", False)], "local string, is_class boolean")
    assert [r.local for r in generate.meta_clashes(clash).collect()] == ["verdict"]
    assert [(r.local, r.severity) for r in generate.duplicate_definitions(clash).collect()] == [("verdict", "error")]


def test_sheet_names_headers_and_versions(spark):
    sheets = workbook(spark)
    assert generate.open_sheet(sheets, "attributes")[1] == "2. Attributes" and generate.headers(sheets, "5. Operations") == {"label", "kind", "operateson (v:)", "confidence"}
    assert generate.headers(sheets, "none") == set() and generate.open_sheet({}, "operations", True) is None
    with pytest.raises(generate.SheetError):
        generate.open_sheet({"2. Data Properties": sheets["2. Attributes"]}, "attributes")
    with pytest.raises(generate.SheetError):
        generate.open_sheet({}, "nodes")
    with pytest.raises(generate.SheetError):
        generate.promotions(spark.createDataFrame([("a",)], "subject string"), "v")
    guide = lambda *cells: generate.template_version(spark.createDataFrame(list(cells), "row int, col int, value string")).collect()
    assert [(r.version, r.warning) for r in guide((1, 1, "x"), (2, 1, " Template Version"), (2, 2, "1.0"))] == [("1.0", None)]
    assert guide((2, 1, "template version"), (2, 2, "2"))[0].warning and guide((2, 1, "template version"), (2, 2, " ")) == [] == guide((1, 1, "a"))


def test_names_and_numbers(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    assert [one(t.local_iri(F.lit(x))) for x in ("Lot Order", "cm:Lot", "http://x/y#Lot", "a:b c", "Über-x", "")] == ["lotOrder", "Lot", "Lot", "abC", "ber-x", ""]
    assert [one(t.match_type(F.lit(x))) for x in ("Close Match", "broad", "exactMatch", "RELATEDMATCH")] == ["closeMatch", None, None, "relatedMatch"]
    assert [one(t.as_number(F.lit(x))) for x in ("1.0", " 0.25", "x", "nan", "")] == ["1", "0.25", None, None, None]
    assert one(t.norm(F.lit(" “Opc  x'"))) == "opc x" and one(t.reference_iri(F.lit("Lot Order"))) == "ref:lotOrder" and one(t.yes(F.lit(" YES "))) and not one(t.yes(F.lit("y")))
    assert one(t.without_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(t.without_fences(F.lit("plain"))) == "plain"
    assert one(t.section_of(F.lit("a/b/index.html"))) == "a/b" and one(t.section_of(F.lit("a/b.html"))) == "a/b"
    assert one(t.lexical(F.lit("b0"), F.lit("bnode"))) is None and one(t.lexical(F.lit("x"), F.lit("lit"))) == "x"
    assert one(t.graph_local(F.lit("http://a/b/"))) == "b" and one(t.pretty(F.lit(t.OWL + "Class"), {})) == "owl:Class" and one(t.pretty(F.lit("x"), {})) == "x"
