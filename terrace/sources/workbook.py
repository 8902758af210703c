"""Workbooks (SpreadsheetML): a scan to cells and sheets, and drafts put behind the rows of a template.

Files are read by Spark as binaries. A workbook is a zip of parts and thus one task; within it the cells of a sheet are streamed.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.plans.graph import checkpointed

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELL = "path string, sheet string, row int, col int, value string"
#: Cells that are held at a time, and workbook bytes of a template at most, since each task gets it.
BATCH, TEMPLATE_BYTES = 20_000, 8 << 20
#: Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Part names of the sheets by their titles, in order."""
    links = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {e.get("name", ""): posixpath.normpath(posixpath.join("/xl", links[e.get(LINKED)])).lstrip("/") for e in sheets if e.get(LINKED) in links}


def _strings(z: zipfile.ZipFile) -> list[str]:
    """Shared strings: the text of each one's runs, without readings."""
    out = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}si":
                    out.append(_rich(e))
                    e.clear()
    return out


def _rich(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for r in e for x in ([r] if r.tag == f"{MAIN}t" else r.findall(f"{MAIN}t") if r.tag == f"{MAIN}r" else []))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show numbers as dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(e.get("numFmtId", 0)) for e in root.iter(f"{MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")), re.I)}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, e in enumerate(formats if formats is not None else ()) if int(e.get("numFmtId", 0)) in DATE_FORMATS | own}


def _number(text: str, dated: bool) -> str:
    """As Python shows it: whole numbers as they stand, others as floats; days since the end of 1899 as a date and time."""
    if dated:
        return str(datetime.datetime(1899, 12, 30) + datetime.timedelta(milliseconds=round(float(text) * 86_400_000)))
    return str(int(text)) if re.fullmatch(r"[+-]?\d+", text) else repr(float(text))


def sheet_cells(z: zipfile.ZipFile, part: str, strings: list[str], dates: set[int]) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the cells that hold something; of formulas the kept result."""
    row = column = 0
    with z.open(part) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                if e.tag == f"{MAIN}row":
                    row, column = int(e.get("r", row + 1)), 0
                continue
            if e.tag == f"{MAIN}c":
                column = column_number(e.get("r", "")) or column + 1
                kind, value = e.get("t", "n"), e.findtext(f"{MAIN}v")
                if kind == "inlineStr" and (inline := e.find(f"{MAIN}is")) is not None:
                    value = _rich(inline)
                elif value is not None:
                    value = strings[int(value)] if kind == "s" else ("True" if value == "1" else "False") if kind == "b" else _number(value, int(e.get("s", 0)) in dates) if kind == "n" else value
                if value:
                    yield row, column, value
            if e.tag == f"{MAIN}row":
                e.clear()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col (from 1), value of every workbook under a path; a file that is none fails the scan with its name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike("/~\\$")).select("path", "content")
    names = ["path", "sheet", "row", "col", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        strings, dates, held = _strings(z), _date_styles(z), []
                        for sheet, part in sheet_parts(z).items():
                            for cell in sheet_cells(z, part, strings, dates):
                                held.append((file, sheet, *cell))
                                if len(held) == BATCH:
                                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)
                                    held = []
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
                    raise ValueError(f"{file} is no readable workbook: {e}") from e

    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())])
    return files.mapInArrow(run, CELL)


def sheets_of(found: DataFrame) -> dict[str, DataFrame]:
    """Cells of one workbook as frames by sheet: a column for each header of the first row, and row, the sheet's row number.

    Of equal headers the last counts; cells without a header go.
    """
    found = checkpointed(found)
    if found.select("path").distinct().count() > 1:
        raise ValueError("sheets of one workbook are wanted")
    headers: dict[str, dict[str, int]] = {r["sheet"]: {} for r in found.select("sheet").distinct().collect()}
    for r in found.where("row = 1").orderBy("sheet", "col").collect():
        headers[r["sheet"]][r["value"]] = r["col"]
    out = {}
    for sheet, columns in sorted(headers.items()):
        rows = found.where((F.col("sheet") == sheet) & (F.col("row") > 1)).groupBy("row")
        out[sheet] = rows.agg(*(F.max(F.when(F.col("col") == n, F.col("value"))).alias(name) for name, n in columns.items())) if columns else found.where("false").select("row")
    return out


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of one workbook file, as generate.overlay() takes them."""
    return sheets_of(cells(spark, path))


# The template's sheets by those of a draft, the columns whose cells are marked, and the fill of the mark.
DRAFT_SHEETS = {"nodes": "1. Nodes", "data properties": "2. Data Properties", "object properties": "3. Object Properties"}
MARKED = ("Confidence", "Name", "Attribute", "Property")
MARK = "FFFFE9B8"


# Headers of a draft's sheets.
HEADERS = {
    "nodes": ("Layer", "Name", "IRI local name", "Type", "Maps to neutral", "Match type", "Verdict", "Confidence", "Source doc", "Notes"),
    "data properties": ("Layer", "Data object", "Attribute", "IRI local name", "Datatype", "Value kind", "Maps to neutral attribute", "Match type", "Verdict", "Confidence", "Source doc", "Notes"),
    "object properties": ("Layer", "Property", "IRI local name", "Domain", "Range", "Maps to neutral", "Match type", "Verdict", "Confidence", "Source doc", "Notes"),
}


def plain_template() -> bytes:
    """A workbook of the three sheets with nothing but their headers, for want of a template."""
    space = MAIN[1:-1]
    rows = {kind: "".join(f'<c r="{column_name(c)}1" t="inlineStr"><is><t>{escape(x)}</t></is></c>' for c, x in enumerate(names, 1)) for kind, names in HEADERS.items()}
    kinds = list(enumerate(HEADERS, 1))
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{types}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{types}.worksheet+xml"/>' for i, _ in kinds) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="r1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{LINKED[1:-3]}"><sheets>' + "".join(f'<sheet name="{DRAFT_SHEETS[k]}" sheetId="{i}" r:id="r{i}"/>' for i, k in kinds) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="r{i}" Type="{links}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in kinds) + f'<Relationship Id="r9" Type="{links}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{space}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="1"><xf/></cellXfs></styleSheet>',
    } | {f"xl/worksheets/sheet{i}.xml": f'<worksheet xmlns="{space}"><sheetData><row r="1">{rows[k]}</row></sheetData></worksheet>' for i, k in kinds}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


class Template:
    """A workbook whose three sheets take a draft's rows; all other parts stay as they are, byte for byte."""

    def __init__(self, data: bytes):
        self.data = data
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts, strings = sheet_parts(z), _strings(z)
            if missing := [x for x in DRAFT_SHEETS.values() if x not in parts]:
                raise ValueError(f"the template lacks {', '.join(missing)}")
            self.parts = {kind: parts[title] for kind, title in DRAFT_SHEETS.items()}
            self.sheets = {kind: z.read(part).decode() for kind, part in self.parts.items()}
            grids = {kind: [(r, c, v) for r, c, v in sheet_cells(z, part, strings, set())] for kind, part in self.parts.items()}
            self.styles = z.read("xl/styles.xml").decode() if "xl/styles.xml" in z.namelist() else None
            italic = self._italic()
        self.headers = {kind: {v: c for r, c, v in grid if r == 1} for kind, grid in grids.items()}
        self.next = {}
        for kind, grid in grids.items():
            used = {r for r, c, _ in grid if c == 1 and r > 1}
            if 2 in used and self._example(kind, italic):
                self.sheets[kind] = self._without_row_two(self.sheets[kind])
                used = {r - 1 for r in used if r > 2}
            self.next[kind] = next(r for r in range(2, len(used) + 3) if r not in used)

    def _italic(self) -> set[int]:
        """Numbers of the cell styles in italics."""
        if self.styles is None:
            return set()
        root = ElementTree.fromstring(self.styles)
        fonts = [e.find(f"{MAIN}i") is not None and e.find(f"{MAIN}i").get("val", "1") not in ("0", "false") for e in root.iter(f"{MAIN}font")]
        formats = root.find(f"{MAIN}cellXfs")
        return {i for i, e in enumerate(formats if formats is not None else ()) if int(e.get("fontId", 0)) < len(fonts) and fonts[int(e.get("fontId", 0))]}

    def _example(self, kind: str, italic: set[int]) -> bool:
        """Whether the second row is the template's own example, which is written in italics."""
        cell = re.search(r'<c\b[^>]*\br="A2"[^>]*>', self.sheets[kind])
        style = re.search(r'\bs="(\d+)"', cell[0]) if cell else None
        return bool(style and int(style[1]) in italic)

    @staticmethod
    def _without_row_two(sheet: str) -> str:
        """Rows below move up by one."""
        sheet = re.sub(r'<row\b[^>]*\br="2"[^>]*?(?:/>|>.*?</row>)', "", sheet, count=1, flags=re.S)
        up = lambda m: f"{m[1]}{int(m[2]) - 1}" if int(m[2]) > 2 else m[0]
        return re.sub(r'(<(?:row|c)\b[^>]*?\br="[A-Z]*)(\d+)(?=")', up, sheet)

    def filled(self, rows: dict[str, list[dict[str, object]]]) -> bytes:
        """The template with rows (values by header, `Low confidence` marks) put into its first free rows."""
        marked = any(r.get("Low confidence") for part in rows.values() for r in part)
        styles, mark = self._with_mark() if marked and self.styles else (self.styles, None)
        changed = {self.parts[kind]: self._sheet(kind, part, mark) for kind, part in rows.items() if part}
        if styles is not None:
            changed["xl/styles.xml"] = styles
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(self.data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            for item in z.infolist():
                # An unchanging date keeps equal drafts equal.
                w.writestr(zipfile.ZipInfo(item.filename, (1980, 1, 1, 0, 0, 0)), changed.get(item.filename, self.sheets.get(next((k for k, p in self.parts.items() if p == item.filename), ""), None) or z.read(item.filename)), zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def _sheet(self, kind: str, rows: list[dict[str, object]], mark: int | None) -> str:
        sheet, lines = self.sheets[kind], []
        first = self.next[kind]
        for r, values in enumerate(rows, first):
            made = []
            for name, column in sorted(self.headers[kind].items(), key=lambda x: x[1]):
                value = values.get(name)
                style = f' s="{mark}"' if mark is not None and values.get("Low confidence") and name in MARKED else ""
                at = f'r="{column_name(column)}{r}"{style}'
                if isinstance(value, (int, float)):
                    made.append(f"<c {at}><v>{value!r}</v></c>")
                elif value not in (None, ""):
                    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
                    made.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
                elif style:
                    made.append(f"<c {at}/>")
            lines.append(f'<row r="{r}">{"".join(made)}</row>')
        # Rows of the template without a first cell, and blank ones that are only formatted, give way.
        taken = range(first, first + len(rows))
        sheet = re.sub(r'<row\b[^>]*\br="(\d+)"[^>]*?(?:/>|>.*?</row>)', lambda m: "" if int(m[1]) in taken else m[0], sheet, flags=re.S)
        sheet = re.sub(r"<sheetData\s*/>", "<sheetData></sheetData>", sheet)
        after = next((m.start() for m in re.finditer(r'<row\b[^>]*\br="(\d+)"', sheet) if int(m[1]) >= first), sheet.index("</sheetData>"))
        return re.sub(r"<dimension\b[^>]*/>", "", sheet[:after] + "".join(lines) + sheet[after:], count=1)

    def _with_mark(self) -> tuple[str, int]:
        """Styles with one more, which fills a cell; and its number."""
        root = ElementTree.fromstring(self.styles)
        fills, formats = root.find(f"{MAIN}fills"), root.find(f"{MAIN}cellXfs")
        if fills is None or formats is None:
            return self.styles, 0
        fill = f'<fill><patternFill patternType="solid"><fgColor rgb="{MARK}"/></patternFill></fill>'
        style = f'<xf numFmtId="0" fontId="0" fillId="{len(fills)}" borderId="0" applyFill="1"/>'
        text = re.sub(r"(<fills\b[^>]*?)(\s+count=\"\d+\")?(>.*?)</fills>", lambda m: f'{m[1]} count="{len(fills) + 1}"{m[3]}{fill}</fills>', self.styles, count=1, flags=re.S)
        text = re.sub(r"(<cellXfs\b[^>]*?)(\s+count=\"\d+\")?(>.*?)</cellXfs>", lambda m: f'{m[1]} count="{len(formats) + 1}"{m[3]}{style}</cellXfs>', text, count=1, flags=re.S)
        return text, len(formats)


def draft_workbooks(sheets: dict[str, DataFrame], template: bytes, concepts: int = 5_000) -> DataFrame:
    """file, content: workbooks made of a template and of a draft's sheets (intake.draft_sheets()), about so many concepts each.

    A concept's rows lie in one workbook, which its name's hash chooses; within it rows go by their concept's name, then their own.
    """
    if len(template) > TEMPLATE_BYTES:
        raise ValueError(f"a template of more than {TEMPLATE_BYTES} bytes")
    owner = {"nodes": ("Name", "Name"), "data properties": ("Data object", "Attribute"), "object properties": ("Domain", "Property")}
    files = -(-sheets["nodes"].count() // concepts) or 1
    parts = [F.pmod(F.xxhash64(F.coalesce(own, F.lit(""))), F.lit(files)).cast("int") for own in (F.col(f"`{c}`") for c, _ in owner.values())]
    rows = [sheets[kind].select(file.alias("file"), F.lit(kind).alias("kind"), F.col(f"`{c}`").alias("owner"), F.col(f"`{name}`").alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for file, (kind, (c, name)) in zip(parts, owner.items(), strict=True)]
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2])

    def fill(table: pa.Table) -> pa.Table:
        import json

        made: dict[str, list[dict]] = {kind: [] for kind in DRAFT_SHEETS}
        order = sorted(range(len(table)), key=lambda i: (table["owner"][i].as_py() or "", table["name"][i].as_py() or "", table["row"][i].as_py()))
        for i in order:
            made[table["kind"][i].as_py()].append(json.loads(table["row"][i].as_py()))
        return pa.table({"file": table["file"][:1], "content": pa.array([Template(template).filled(made)], pa.binary())})

    return whole.groupBy("file").applyInArrow(fill, "file int, content binary")


def save_workbooks(books: DataFrame, path: str) -> list[str]:
    """Workbooks as files draft-<n>.xlsx in a folder of any store, one after the other."""
    spark = books.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for r in books.orderBy("file").toLocalIterator():
        out.append(f"{path}/draft-{r['file']}.xlsx")
        stream = files.create(hadoop.Path(out[-1]), True)
        stream.write(bytearray(r["content"]))
        stream.close()
    return out
