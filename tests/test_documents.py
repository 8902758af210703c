"""Readers, drafts, indexes, questions and layers that no query over the driver's tables reaches."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators import assistant, compare, intake, retrieve, trace
from terrace.plans.graph import GraphContext
from terrace.sources import records
from terrace.sources.turtle import TurtleError, load_layer, parse_layer

NS, V = "http://k/ns-ref#", "http://k/ns-v#"
REF_TTL = f"""@prefix ref: <{NS}> . @prefix owl: <{t.OWL}> . @prefix rdfs: <{t.RDFS}> .
ref:Route a owl:Class ; rdfs:subClassOf ref:DataObject ; rdfs:label "Route" ; rdfs:comment "a way" . ref:Step a owl:Class ; rdfs:subClassOf ref:DataObject ; rdfs:label "Step" .
ref:RouteContext a owl:Class ; rdfs:label "Route" ; rdfs:comment "rows" . ref:pr a owl:ObjectProperty ; rdfs:domain ref:RouteContext ; rdfs:range ref:Route ; rdfs:label "key route" . ref:ps a owl:ObjectProperty ; rdfs:domain ref:RouteContext ; rdfs:range ref:Step ; rdfs:label "step" ."""
OWN_TTL = f"""@prefix v: <{V}> . @prefix ref: <{NS}> . @prefix owl: <{t.OWL}> . @prefix rdfs: <{t.RDFS}> . @prefix skos: <{t.SKOS}> .
v:RouteContext a owl:Class ; rdfs:label "Route" . v:Path a owl:Class ; rdfs:subClassOf v:DataObject ; rdfs:label "Route" ; v:verdict "covered" ; skos:closeMatch ref:Route . v:Own a owl:Class ; rdfs:subClassOf v:DataObject ; v:verdict "vendor-extension" ."""


@pytest.fixture(scope="module")
def ctx(spark):
    base = GraphContext(spark, {"ref": (NS, parse_layer(spark, REF_TTL, "ref"))})
    return load_layer(base, "v", OWN_TTL)


def test_layers_from_text_replace_only_when_they_can_be_read(ctx):
    with pytest.raises(TurtleError):
        load_layer(ctx, "v", "v:a v:b")
    assert ctx.pattern(g="urn:graph:v").count() == 10 and ctx.namespaces["v"] == V
    assert load_layer(ctx, "v", OWN_TTL.replace("v:Own a owl:Class ;", "v:Own")).pattern(g="urn:graph:v").count() == 9


def test_contexts_give_way_when_a_phrase_is_resolved(ctx):
    best = [(r.iri, r.score, r.prefix) for r in trace.resolve_concept(ctx, "Route").collect()]
    assert best == [(V + "Path", 1, "v"), (NS + "Route", 2, "ref"), (NS + "RouteContext", 2, "ref"), (NS + "pr", 4, "ref"), (V + "RouteContext", 6, "v")]
    assert trace.resolve_concept(ctx, "route", "v").first().score == 0 and trace.resolve_concept(ctx, "rou", "v").first().score == 3


def test_unlabelled_extensions_are_left_out_and_comments_are_sampled(ctx):
    assert compare.extension_surface(ctx, "").count() == 0
    gap = {r.label: (r.note, r.other_vendors) for r in compare.gap_by_vendor(ctx, "http://none#").collect()}
    assert gap == {"Route": ("a way", "v:Path (closeMatch)"), "Step": (None, "")}
    assert [r.label for r in compare.data_objects(ctx).orderBy("label").collect()] == ["Route", "Step"]


def test_bridges_and_answers(ctx):
    (row,) = trace.context_bridge(ctx, NS + "Route", NS + "Step").collect()
    assert (row.ctx, row.label, row.comment, row.pa_label, row.pa_is_key, row.pb_is_key, row.is_context_table) == (NS + "RouteContext", "Route", "rows", "key route", True, False, True)
    facts = trace.answer(ctx, "How is Route related to Step?")
    assert facts["concepts"][1] == NS + "Step" and {"bridge", "direct", "two_hop"} <= set(facts)
    one = trace.answer(ctx, "explain Step")
    assert one["concepts"] == [NS + "Step"] and one["contexts"].count() == 1
    nodes, edges = trace.graph_nodes(ctx), trace.graph_edges(ctx)
    assert trace.without_operations(nodes.withColumn("type", F.when(F.col("id") == NS + "Route", "Operation").otherwise(F.col("type"))), edges)[1].count() == edges.count() - 2


def test_questions_reach_the_catalog(ctx):
    engine = compare.Engine(ctx)
    got = assistant.answer(engine, "What does v not map?")
    assert (got["query"], got["params"], got["count"]) == ("gap_by_vendor", {"VENDOR": V}, 1) and "1 rows" in got["answer"]
    assert assistant.answer(engine, "sing a song")["query"] is None
    assert assistant.answer(engine, "x", lambda *a: {"query": "gap_by_vendor", "params": {}})["answer"].startswith("That query needs")
    assert assistant.answer(engine, f"mappings of {NS}Route")["params"] == {"REF_CONCEPT": NS + "Route"}
    assert assistant.answer(engine, "x", lambda *a: 1 / 0)["routing"]["reason"].startswith("router error")
    assert engine.vendor_ns("v") == V and engine.list_queries()[0]["name"] == "completeness_guard"


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}{table}</w:body></w:document>')
    return out.getvalue()


def test_files_become_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.docx").write_bytes(docx(("Title", "Lot"), ("Normal", "intro"), ("Heading2", "Setup"), ("ListBullet", "one"), ("ListBullet", "two"), ("Normal", "end")))
    (tmp_path / "a" / "~$x.docx").write_bytes(b"lock")
    (tmp_path / "b.html").write_text("<title>T#</title><h1>H</h1><ul><li>a</li><li><p>b</p></li></ul><p>graph TD; x</p><aside>s</aside>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.source.rsplit("/", 1)[-1]: r for r in records.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"x.docx", "b.html", "c.pdf"} and got["c.pdf"]._read_error and got["b.html"].concept_name == "T"
    x, b = got["x.docx"], got["b.html"]
    assert (x.concept_name, [(s.heading, s.level, s.text) for s in x.sections], x.lists, x.tables[0].rows) == ("Lot", [("Lot", 1, "intro"), ("Setup", 2, "end")], [["one", "two"]], [["v"]])
    assert [(s.heading, s.level, s.text) for s in b.sections] == [("H", 1, "a b b")] and b.lists == [["a", "b"]]
    records.write_records(records.read_records(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_pages_by_their_own_structure():
    page = """<html><head><title>Order guide#</title><title>second</title></head><body><header><h1>Order#</h1></header><p>lead</p>
    <h2> Setup # </h2><p>one<p>two</p></p><h3> </h3><p>three <b>four</b>five</p><script>var x = 'no'</script><h4>Empty</h4>
    <ul><li>a<ul><li>b</li></ul></li><li>graph TD; c</li></ul><table><tr><th></th><th>k</th></tr><tr><td></td></tr><tr><td>v<table><tr><td>in</td></tr></table></td></tr></table>
    <nav><p>menu</p></nav>last</body></html>"""
    r = records.html_record(page, "d/order/index.html")
    assert (r["concept_name"], r["section"]) == ("Order guide", "d/order")
    assert [(s["heading"], s["level"], s["text"]) for s in r["sections"]] == [("(top)", 0, "lead"), ("Setup", 2, "one two two three four five"), ("Empty", 4, "a b b")]
    assert r["lists"] == [["a b"], ["b"]]
    assert r["tables"] == [{"headers": ["", "k"], "rows": [["v in", "in"], ["in"]]}, {"headers": ["in"], "rows": []}]
    assert r["prose"] == "Order guide# second lead Setup # one two three four five Empty a b graph TD; c k v in last"
    assert records.html_record(page.replace("<title>Order guide#</title><title>second</title>", ""), "x.html")["concept_name"] == "Order"
    assert records.html_record(page.replace("guide#", "guide - Docs"), "x.html", " - Docs")["concept_name"] == "Order guide"
    assert records.html_record("<p>x", "a/b.html")["concept_name"] == "b" and records.html_record("", "")["sections"] == []


def test_references_without_their_end_are_text(spark):
    """A title that was cut within a reference has the same name as a record and by itself."""
    titles = ["a &amp;&amp", "b &am", "c &", "d &quot;&quo", "e &amp;amp;x", "f&ampx; &amp; g", "h &copy;&mdash;&#39;#"]
    pages = [f"<title>{x}</title><script>a&&b</script><h1>{x}</h1><p>{x}</p><a href='?a=1&b=2'>y</a>" for x in titles]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").withColumn("url", F.lit("u"))
    want = {r.page_id: r.title for r in rows.select("page_id", retrieve.page_title(F.col("html")).alias("title")).collect()}
    got = {r.page_id: r for r in records.page_records(rows, "page_id", "html", "url").collect()}
    assert {k: r.concept_name for k, r in got.items()} == want
    assert [want[k] for k in range(len(titles))] == ["a &&amp", "b &am", "c &", 'd "&quo', "e &amp;x", "f&ampx; & g", "h ©—'"]
    assert all(got[k].sections[0].heading == x and got[k].sections[0].text.rstrip("#") == x for k, x in want.items())


def test_word_files_by_style_names():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    kinds = {"a": "heading 2", "b": "List Paragraph", "c": "My Bullets", "t": "Title", "n": "Normal", "h": "Heading"}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"{" w:default=\'1\'" if v == "Normal" else ""}><w:name w:val="{v}"/></w:style>' for k, v in kinds.items())
    para = lambda style, text: f'<w:p><w:pPr>{f"<w:pStyle w:val=\'{style}\'/>" if style else ""}</w:pPr>{text}</w:p>'
    run = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    cell = lambda x, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p>{run(x)}</w:p></w:tc>"
    table = f'<w:tbl><w:tr>{cell("", "<w:gridSpan w:val=\'2\'/>")}{cell("u")}</w:tr><w:tr>{cell("x")}{cell("y")}{cell("z", "<w:vMerge w:val=\'restart\'/>")}</w:tr><w:tr>{cell("")}{cell("")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    body = [para("n", run("lead --&gt;")), para("a", run("Setup")), para("", run("plain")), para("b", run("one")), para("n", ""), para("c", run("two")), para("ListBullet", run("no such style")), para("b", run("three")), table, para("h", run("loose") + "<w:hyperlink><w:r><w:tab/><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>")]

    def packed(body, title=None, **parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(body)}</w:body></w:document>')
            z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}">{styles}</w:styles>')
            if title is not None:
                z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
        return out.getvalue()

    r = records.docx_record(packed(body, " The Lot "), "d/x.docx")
    assert (r["concept_name"], r["section"]) == ("The Lot", "x")
    assert [(s["heading"], s["level"], s["text"]) for s in r["sections"]] == [("(top)", 0, "lead -->"), ("Setup", 2, "plain no such style loose link")]
    assert r["lists"] == [["one", "two"], ["three"]] and r["prose"] == "lead --> plain no such style loose link"
    assert r["tables"] == [{"headers": ["", "", "u"], "rows": [["x", "y", "z"], ["", "", "z"]]}]
    assert records.docx_record(packed(body), "d/x.docx")["concept_name"] == "Setup"
    assert records.docx_record(packed([para("b", run("only"))]), "d/x.docx") | {"lists": 0} == {"concept_name": "x", "source": "d/x.docx", "section": "x", "prose": "only", "sections": [], "lists": 0, "tables": [], "_read_error": None}


def test_texts_become_records(spark):
    rows = spark.createDataFrame([(1, "Route Setup\n- one\n\n2) two\nplain text here.\r\nÜBER Alles\nmore", "d/a.pdf", None), (2, " \n ", "d/scan.pdf", None), (3, "x y z", "c.pdf", " My  Title ")], "doc_id int, text string, source string, title string")
    got = {r.doc_id: r for r in intake.text_records(rows, title="title").collect()}
    assert (got[1].concept_name, got[1].lists, [(s.heading, s.level, s.text) for s in got[1].sections]) == ("Route Setup", [["one", "two"]], [("Route Setup", 2, "plain text here."), ("ÜBER Alles", 2, "more")])
    assert got[2].concept_name == "scan" and "OCR" in got[2]._read_error and got[3].concept_name == "My Title" and got[3].sections[0].heading == "(top)"


def test_long_texts_become_records_in_one_pass(spark):
    """Lists and sections at either end, runs that a heading or a body line parts; 20,000 lines with as many sections and lists as fit."""
    texts = ["- a\n\n* b\nbody,\n- c\nHead\n1. d\nHead Two\nlast.\n- e", "Head\n- a\nsome text.\n" * 20_000]
    df = intake.text_records(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit("s")))
    got = {r.doc_id: r for r in df.collect()}
    assert (got[0].lists, [(s.heading, s.level, s.text) for s in got[0].sections]) == ([["a", "b"], ["c"], ["d"], ["e"]], [("(top)", 1, "body,"), ("Head Two", 2, "last.")])
    assert (got[0].concept_name, got[1].concept_name, got[1].lists) == ("- a", "Head", [["a"]] * 20_000)
    assert [(s.heading, s.level, s.text) for s in got[1].sections] == [("Head", 2, "some text.")] * 20_000
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_drafts_of_mapped_records(spark, tmp_path):
    rows = intake.text_records(spark.createDataFrame([(1, "Route\ntext", "a.pdf"), (2, "Other\ntext", "b.pdf")], "doc_id int, text string, source string")).drop("doc_id")
    words = spark.createDataFrame([("DataObject", "route")], "kind string, name string")
    good, bad = intake.map_records(rows, lambda x: intake.label_mapper(x, words))
    sheets = intake.draft_sheets(good, "v")
    assert bad.count() == 0 and {(r.Name, r["Maps to neutral"], r["Low confidence"]) for r in sheets["nodes"].collect()} == {("Route", "route", False), ("Other", "", True)}
    intake.write_draft(sheets, str(tmp_path / "draft"))
    intake.write_draft(sheets, str(tmp_path / "draft"))
    assert spark.read.option("header", True).csv(str(tmp_path / "draft" / "nodes")).count() == 4


def test_indexes_resume_and_answer(spark, tmp_path):
    from terrace.streaming.incremental import index_stream

    pages = spark.createDataFrame([(i, f"u/{i}", f"<title>P{i}</title><p>{'word' + str(i)} other</p>") for i in range(4)], "page_id long, url string, html string")
    for some in ("page_id < 2", "page_id >= 2"):
        pages.where(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        index_stream(spark, str(tmp_path / "pages"), str(tmp_path / "index"), str(tmp_path / "state"), "v").awaitTermination()
    index = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r.id for r in index.collect()) == [0, 1, 2, 3] and {r.source for r in index.collect()} == {f"u/{i}" for i in range(4)}
    question = index.where("source = 'u/2'").first().vector
    hit = retrieve.cited(retrieve.top_k(index, question, vendor="v")).orderBy("rank").first()
    assert hit.source == "u/2" and hit.score == 1.0 and hit.citation == "v: P2 (u/2)"
    index.drop("vendor").coalesce(1).write.json(str(tmp_path / "json"))
    (part,) = (tmp_path / "json").glob("part-*.json")
    part.rename(tmp_path / "json" / "acme_index.json")
    assert {r.vendor for r in retrieve.read_index(spark, str(tmp_path / "json" / "*_index.json")).collect()} == {"acme"}
    assert sum(x * x for x in retrieve.hashed_vectors(spark.createDataFrame([(1, "")], "id int, text string")).first().vector) == 0
