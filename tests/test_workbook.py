"""Workbooks written by hand: scanned, generated from, and filled with drafts."""

import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from terrace.operators import generate, intake
from terrace.sources import workbook as wb
from terrace.sources.turtle import parse
from tests.test_generate import BASE, EXPECTED, plain
from tests.test_generate import workbook as frames

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"
STYLES = f'<styleSheet xmlns="{M}"><numFmts count="1"><numFmt numFmtId="170" formatCode="&quot;day&quot; yyyy"/></numFmts><fonts count="2"><font/><font><i/></font></fonts><fills count="2"><fill/><fill/></fills><cellXfs count="4"><xf fontId="0"/><xf numFmtId="14"/><xf fontId="1"/><xf numFmtId="170"/></cellXfs></styleSheet>'


def xlsx(sheets, styles=STYLES, shared=("shared",), **more):
    """sheets: title -> XML of its rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{P}">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">' + "".join(f"<si>{x if x.startswith('<') else f'<t>{escape(x)}</t>'}</si>" for x in shared) + "</sst>")
        z.writestr("xl/styles.xml", styles)
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{M}"><dimension ref="A1"/><sheetData>{rows}</sheetData><pageMargins left="1"/></worksheet>')
        for name, data in more.items():
            z.writestr(name, data)
    return out.getvalue()


def text_rows(rows):
    inline = lambda r, c, v: f'<c r="{wb.column_name(c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if v else ""
    return "".join(f'<row r="{r}">{"".join(inline(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))


def test_column_names():
    assert [wb.column_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(wb.column_number(wb.column_name(n) + "7") == n for n in range(1, 2000))


def test_cells_of_every_kind(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>3</v></c><c><v>2.50</v></c><c r="E3" t="b"><v>1</v></c><c r="F3" s="1"><v>45000.5</v></c><c r="G3" t="str"><f>A1</f><v>kept</v></c><c r="H3" s="3"><v>1</v></c><c r="I3" t="e"><v>#N/A</v></c><c r="J3"><f>1</f></c></row><row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row>'
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.xlsx").write_bytes(xlsx({"One & only": rows, "empty": ""}, shared=("first", "<r><t>se</t></r><rPh><t>no</t></rPh><r><t>cond</t></r>")))
    (tmp_path / "b" / "~$x.xlsx").write_bytes(b"lock")
    got = sorted((r.row, r.col, r.value) for r in wb.cells(spark, str(tmp_path)).where("sheet = 'One & only'").collect())
    assert got == [(1, 1, "first"), (1, 3, "second"), (3, 2, "3"), (3, 3, "2.5"), (3, 5, "True"), (3, 6, "2023-03-15 12:00:00"), (3, 7, "kept"), (3, 8, "1899-12-31 00:00:00"), (3, 9, "#N/A"), (4, 1, "inline")]
    sheet = wb.read_workbook(spark, str(tmp_path))["One & only"]
    assert sheet.columns == ["row", "first", "second"] and sorted(map(tuple, sheet.collect())) == [(3, None, "2.5"), (4, "inline", None)]
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match=r"bad\.xlsx is no readable workbook"):
        wb.cells(spark, str(tmp_path / "bad.xlsx")).count()


def test_a_workbook_of_every_sheet_becomes_the_triples_worked_out_by_hand(spark, tmp_path):
    sheets = {"0. Guide": text_rows([["Guide", "", ""], ["", "Template Version", "0.9"], ["Template version", "", "far"]])}
    for title, df in frames(spark).items():
        names = [c for c in df.columns if c != "row"]
        rows = {r["row"]: [r[c] or "" for c in names] for r in df.collect()} if "row" in df.columns else dict(enumerate(([r[c] or "" for c in names] for r in df.collect()), 2))
        sheets[title] = text_rows([names, *(rows.get(r, []) for r in range(2, max(rows) + 1))])
    (tmp_path / "w.xlsx").write_bytes(xlsx(sheets))
    made = generate.overlay(spark, wb.read_workbook(spark, str(tmp_path / "w.xlsx")), "v", BASE)
    got = plain((r.s, r.p, r.o, r.o_kind, r.o_dt) for r in made.checked().where("section <> 'meta-schema'").collect())
    assert got == plain((s, p, o, kind, dt) for s, _, p, o, kind, dt, _ in parse(EXPECTED))
    guide = wb.cells(spark, str(tmp_path)).where("sheet = '0. Guide'")
    assert [tuple(r) for r in generate.template_version(guide).collect()] == [("0.9", "template version 0.9 where 1.0 is expected")]
    assert generate.template_version(guide.where("row = 3")).count() == 0


@pytest.fixture(scope="module")
def drafted(spark):
    part = lambda name, **more: {"name": name, "maps_to_neutral": "", "match_type": None, "verdict": "covered", "confidence": 0.5, "source": "a.html", "notes": 'says "<x>" & more', **more}
    rows = [({"concept": part("Lot order", type="Data Object"), "attributes": [part("due date", datatype="string", value_kind="plain"), part("site", datatype="string", value_kind="", confidence=0.9)], "relationships": [part("runs at", target="Step")]},), ({"concept": part("Step", type="Operation", confidence=0.7), "attributes": [], "relationships": []},)]
    return intake.draft_sheets(spark.createDataFrame(rows, f"mapped struct<{intake.MAPPED}>".replace("struct<concept struct", "struct<concept:struct").replace(", attributes array", ", attributes:array").replace(", relationships array", ", relationships:array")), "v")


def template():
    heads = {"1. Nodes": ["Layer", "Name", "IRI local name", "Type", "Verdict", "Confidence", "Notes"], "2. Data Properties": ["Layer", "Data object", "Attribute", "Datatype", "Confidence"], "3. Object Properties": ["Domain", "Property", "Range", "Layer"]}
    sheets = {title: text_rows([names, ["kept" if title[0] == "2" else "cm", "example"]]) + ('<row r="3" ht="9"/>' if title[0] == "2" else '<row r="5"><c r="B5"><v>1</v></c></row>') for title, names in heads.items()}
    sheets["1. Nodes"] = sheets["1. Nodes"].replace('r="A2" ', 'r="A2" s="2" ')
    return xlsx({"0. Guide": text_rows([["read me"]]), **sheets}, **{"docProps/x.bin": bytes(range(256))})


def test_drafts_in_a_template(spark, drafted, tmp_path):
    given = template()
    books = wb.draft_workbooks(drafted, given)
    assert books.count() == 1
    (path,) = wb.save_workbooks(books, str(tmp_path / "out"))
    sheets = wb.read_workbook(spark, path)
    nodes = [tuple(r) for r in sheets["1. Nodes"].select("row", "Layer", "Name", "IRI local name", "Type", "Verdict", "Confidence", "Notes").orderBy("row").collect()]
    # The italic example is gone, what stood below it has moved up.
    assert nodes == [(2, "v", "Lot order", "LotOrder", "Data Object", "covered", "0.5", 'says "<x>" & more'), (3, "v", "Step", "Step", "Operation", "covered", "0.7", 'says "<x>" & more'), (4, None, "1", None, None, None, None, None)]
    assert [tuple(r) for r in sheets["2. Data Properties"].select("row", "Layer", "Attribute", "Confidence").orderBy("row").collect()] == [(2, "kept", None, None), (3, "v", "due date", "0.5"), (4, "v", "site", "0.9")]
    assert [(r.row, r.Domain, r.Property, r.Range) for r in sheets["3. Object Properties"].orderBy("row").collect()][1:2] == [(3, "Lot order", "runs at", "Step")]
    data = bytes(books.first().content)
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(io.BytesIO(given)) as before:
        assert z.namelist() == before.namelist() and z.read("docProps/x.bin") == bytes(range(256)) and z.read("xl/worksheets/s0.xml") == before.read("xl/worksheets/s0.xml")
        assert 's="4"' in z.read("xl/worksheets/s1.xml").decode() and 'fills count="3"' in z.read("xl/styles.xml").decode() and "FFFFE9B8" in z.read("xl/styles.xml").decode()
    # A second draft goes behind the first.
    again = wb.draft_workbooks(drafted, data)
    (path,) = wb.save_workbooks(again, str(tmp_path / "twice"))
    assert [r.Attribute for r in wb.read_workbook(spark, path)["2. Data Properties"].orderBy("row").collect()] == [None, "due date", "site", "due date", "site"]
    assert generate.sheet(wb.read_workbook(spark, path)["1. Nodes"], generate.REQUIRED["nodes"]).where("name = 'Step'").count() == 2
    assert wb.draft_workbooks(drafted, given, 1).select(F.count_distinct("file")).first()[0] <= 2
    with pytest.raises(ValueError, match="lacks 1. Nodes"):
        wb.Template(xlsx({"x": ""}))
