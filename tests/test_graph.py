"""Closure, set semantics, parameters and the Turtle reader on hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators import compare, generate, intake, trace
from terrace.plans.graph import QUAD, GraphContext, closure
from terrace.sources import records
from terrace.sources.turtle import TurtleError, parse, parse_layer, read_turtle, reread, value_lists, write_turtle

NS, V = "http://k/ns-ref#", "http://k/ns-v#"


def quads(spark, rows, g):
    full = [(s, "iri", p, o, k, None, None, f"urn:graph:{g}") for s, p, o, k in rows]
    return spark.createDataFrame(full, QUAD)


def context(spark, ref, own=()):
    layers = {"ref": (NS, quads(spark, ref, "ref"))}
    if own:
        layers["v"] = (V, quads(spark, own, "v"))
    return GraphContext(spark, layers)


def test_closure_ends_on_cycles_and_counts_a_diamond_once(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("e", "d")], "child string, parent string")
    got = {(r.node, r.depth) for r in closure(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("b", 1), ("c", 1), ("d", 2), ("a", 3), ("e", 3)}


REF = [(NS + "X", t.SUBCLASS, NS + "DataObject", "iri"), (NS + "X", t.LABEL, "x", "lit"), (NS + "Y", t.SUBCLASS, NS + "DataObject", "iri"), (NS + "Y", t.LABEL, "y", "lit")]


def test_no_overlay_gives_empty_vendor_columns_and_no_convergence(spark):
    ctx = context(spark, REF)
    assert {(r.obj, r.vendor, r.term) for r in compare.coverage_by_object(ctx).collect()} == {(NS + "X", None, None), (NS + "Y", None, None)}
    assert compare.convergence(ctx).count() == 0
    assert {r.other_vendors for r in compare.gap_by_vendor(ctx, V).collect()} == {""}


def test_bag_semantics_and_merged_layers(spark):
    own = [(V + "A", t.SKOS + "closeMatch", NS + "X", "iri"), (V + "A", V + "verdict", "covered", "lit"), (V + "A", V + "verdict", "partial", "lit"), (NS + "X", t.LABEL, "x", "lit")]
    ctx = context(spark, REF, own)
    rows = compare.coverage_by_object(ctx).where(F.col("term").isNotNull()).collect()
    assert sorted(r.verdict for r in rows) == ["covered", "partial"]
    assert [r.obj for r in compare.convergence(ctx).collect()] == [NS + "X"]
    assert [r.obj for r in compare.gap_by_vendor(ctx, V).collect()] == [NS + "Y"]


def test_runner_checks_names_and_parameters(spark):
    engine = compare.Engine(context(spark, REF))
    with pytest.raises(KeyError):
        engine.run("nothing")
    with pytest.raises(ValueError):
        engine.run("gap_by_vendor")
    assert engine.to_rows("coverage_by_object")[0]["obj"] == "ref:X"


TTL = """@prefix r: <http://k/ns-ref#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
# a comment
r:X a owl:Class ; r:note "a \\"q\\"", 'b'@en ; r:n 3, 2.5, true ; r:one [ owl:oneOf ( "u" "v" ) ] ."""


def test_turtle_terms_and_round_trip(spark, tmp_path):
    rows = parse(TTL)
    objects = {(o, kind, dt, lang) for _, _, _, o, kind, dt, lang in rows}
    assert {('a "q"', "lit", None, None), ("b", "lit", None, "en"), ("3", "lit", t.XSD + "integer", None), ("2.5", "lit", t.XSD + "decimal", None), ("true", "lit", t.XSD + "boolean", None)} <= objects
    assert [(r.place, r.value) for r in value_lists(parse_layer(spark, TTL, "ref")).orderBy("place").collect()] == [(0, "u"), (1, "v")]
    assert sum(p == t.RDF + "first" for _, _, p, *_ in rows) == 2
    with pytest.raises(TurtleError):
        parse("x:y a x:z .")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text(TTL)
    quads_ = read_turtle(spark, str(tmp_path / "in"), "ref")
    assert quads_.count() == len(rows)
    write_turtle(quads_, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert len(parse(text)) == len(rows)


HARD = """@prefix r: <http://k/ns-ref#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
r:X r:note "two\\nlines\\r\\t \\"q\\" \\\\ end", "x"@en-GB, "y"@de, "z"^^r:own, "2020-01-01"^^xsd:date, 3, -2.50, 1e3, true, "" ; r:one [ owl:oneOf ( "u" ( 1 2 ) r:Y ) ] ; r:empty () ; <http://k/odd.name> <http://k/ns-ref#odd.name> .
r:L r:list _:shared . r:M r:list _:shared . _:shared <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> 1 ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> () .
_:loop r:next _:loop ; r:self r:X ."""


def canonical(rows):
    """Triples with blank nodes named by what lies around them."""
    names = {}
    for _ in range(6):
        around = {}
        for s, _, p, o, kind, dt, lang in rows:
            if s.startswith("_:"):
                around.setdefault(s, []).append(("s", p, names.get(o, "") if kind == "bnode" else o, dt, lang))
            if kind == "bnode":
                around.setdefault(o, []).append(("o", p, names.get(s, "") if s.startswith("_:") else s, None, None))
        names = {k: str(hash(str(sorted(map(str, v))))) for k, v in around.items()}
    return sorted(map(str, ((names.get(s, s), p, names.get(o, o), kind, dt, lang) for s, _, p, o, kind, dt, lang in rows)))


def test_turtle_comes_back_as_it_was(spark, tmp_path):
    rows = parse(HARD)
    layer = parse_layer(spark, HARD, "ref").repartition(3)
    write_turtle(layer, str(tmp_path / "out"), {"r": "http://k/ns-ref#"})
    parts = [r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()]
    assert all(p.startswith("# document ") for p in parts)
    text = "".join(parts)
    assert '( "u" _:' in text and " r:Y )" in text and "\nr:X " in text and "-2.50" in text and "r:list ( " not in text and '\\nlines\\r\\t \\"q\\" \\\\ end"' in text
    back = read_turtle(spark, str(tmp_path / "out"), "ref").drop("g").collect()
    assert canonical([tuple(r) for r in back]) == canonical(rows) and len(back) == len(rows)
    assert reread(layer, str(tmp_path / "again"), "ref").count() == len(rows)
    with pytest.raises(Exception, match="expected|no term|unreadable"):
        reread(layer.withColumn("p", F.lit("")).withColumn("o_kind", F.lit("lit")).withColumn("o_lang", F.lit("not a tag")).limit(1), str(tmp_path / "bad"), "ref").count()
    assert read_turtle(spark, str(tmp_path / "again"), "w").where("g <> 'urn:graph:w'").count() == 0


def test_an_overlays_turtle_is_parsed_again(spark, tmp_path):
    from tests.test_generate import BASE, workbook

    made = generate.overlay(spark, workbook(spark), "v", BASE).checked()
    order = tuple(r.section for r in made.select("section").distinct().orderBy("section").collect())
    back = reread(made, str(tmp_path / "ttl"), "v", {"v": f"{BASE}v#", "ref": f"{BASE}ref#"}, order)
    assert generate.validate(back, f"{BASE}v#", f"{BASE}ref#").count() == 0
    lines = [r.value for r in spark.read.text(str(tmp_path / "ttl")).collect()]
    assert any("owl:oneOf ( " in x for x in lines) and "v:Step a owl:Class" in lines


def test_numbers_as_text(spark):
    given = ["1", "1.0", " 2.50 ", "0.00001", "1.5e-5", "1e15", "123456789.125", "1e22", "-0.5", "-3", "0.0001", "0.30000000000000004", "nan", "inf", "x", "", "9007199254740991"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", t.as_number(F.col("x")).alias("n"), t.number_type(t.as_number(F.col("x"))).alias("k")).orderBy("i").collect()

    def plain(x):
        try:
            f = float(x.strip())
            return repr(f) if f != int(f) else str(int(f))
        except (ValueError, OverflowError):
            return None

    assert [r.n for r in rows] == [plain(x) for x in given]
    assert [r.k.rsplit("#")[-1] for r in rows[:5]] == ["integer", "integer", "decimal", "double", "double"]


def test_unions_are_told_by_member(spark):
    text = f"""@prefix r: <{NS}> . @prefix owl: <{t.OWL}> . @prefix rdfs: <{t.RDFS}> .
    r:p a owl:DatatypeProperty ; rdfs:domain [ owl:unionOf ( r:A [ owl:unionOf ( r:B r:C ) ] ) ] . r:q a owl:DatatypeProperty ; rdfs:domain r:A ."""
    ctx = GraphContext(spark, {"ref": (NS, parse_layer(spark, text, "ref"))})
    told = trace.with_unions(ctx)
    of = lambda c, x: sorted(r.prop.removeprefix(NS) for r in trace.concept_attributes(c, NS + x).collect())
    assert [of(ctx, x) for x in "ABC"] == [["q"], [], []] and [of(told, x) for x in "ABC"] == [["p", "q"], ["p"], ["p"]]
    plain_ = context(spark, REF)
    assert trace.with_unions(plain_).triples().count() == plain_.triples().count()


def test_layers_are_swapped_only_when_they_can_be_read(spark):
    ctx = context(spark, REF)
    with pytest.raises(ValueError):
        ctx.with_layer("ref", quads(spark, REF, "v"))
    new = ctx.with_layer("w", quads(spark, [("http://k/ns-w#A", t.LABEL, "a", "lit")], "w"))
    assert new.namespaces["w"] == "http://k/ns-w#" and "w" not in ctx.layers


def test_questions_give_up_to_two_concepts(spark):
    ask = lambda q: spark.range(1).select(trace.extract_concepts(F.lit(q)).alias("x")).first().x
    assert ask("How is Route related to the Step?") == ["Route", "the Step"]
    assert ask(" tell me about Route and Step vs Lot?") == ["Route", "Step vs Lot"]
    assert ask("How does Route work?") == ["Route"] and ask("describe carrier") == ["carrier"]
    assert ask("What is a carrier?") == ["a carrier"] and ask("") == []


def test_records_of_a_page_and_of_a_broken_file():
    page = "<html><title>T</title><nav>n</nav><p>top</p><h2>H</h2><ul><li>a<p>b</p></li><li>c</li></ul><table><tr><th>k</th></tr><tr><td>v</td></tr></table></html>"
    r = records.html_record(page, "x/index.html")
    assert r["concept_name"] == "T" and r["section"] == "x" and r["tables"] == [{"headers": ["k"], "rows": [["v"]]}]
    assert [s["heading"] for s in r["sections"]] == ["(top)", "H"] and r["lists"] == [["a b", "c"]]
    assert records.read_one(b"no zip", "a.docx")["_read_error"]


def test_sheets_name_missing_headers_and_drop_blank_rows(spark):
    df = spark.createDataFrame([(" a ", None), ("", " ")], " Layer string, Name string")
    assert generate.sheet(df, ["layer"]).collect()[0].layer == "a" and generate.sheet(df).count() == 1
    with pytest.raises(ValueError):
        generate.sheet(df, ["Type"])


def test_unreadable_mapping_is_a_problem(spark):
    df = spark.createDataFrame([("```json\n{\"concept\": {\"name\": \"\", \"verdict\": \"odd\"}}\n```",), ("nonsense",)], "mapped_json string")
    got = [r.problems for r in intake.checked(df).collect()]
    assert got[0] == ["unknown verdict odd"] and got[1] == ["no readable mapping"]
