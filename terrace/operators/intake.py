"""Structure of plain documents, prompts for a mapper, and checks of what a mapper returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import terms as t

RECORD = "concept_name string, source string, section string, prose string, sections array<struct<heading:string,level:int,text:string>>, lists array<array<string>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, _read_error string"
_PART = "struct<name:string,{}maps_to_neutral:string,match_type:string,verdict:string,confidence:double,source:string,notes:string>"
MAPPED = f"concept {_PART.format('type:string,')}, attributes array<{_PART.format('datatype:string,value_kind:string,')}>, relationships array<{_PART.format('target:string,')}>"
VERDICTS = ("covered", "partial", "vendor-extension", "absent", "needs-verification")
NODE_TYPES = ("Data Object", "Operation", "Capability")
PROMPT_CHARS = 12_000
LOW_CONFIDENCE = 0.6
#: Where lines end, in any script.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def is_bullet(line: Column) -> Column:
    return line.rlike("^[-*•·]") | line.rlike("(?U)^\\(?\\d+[.)]\\s")


def without_bullet(line: Column) -> Column:
    """Without the one mark or number that makes it a bullet."""
    return F.regexp_replace(line, "(?U)^\\(?\\d+[.)]\\s*|^[-*•·]\\s*", "")


def is_heading(line: Column) -> Column:
    """At most 80 characters and nine words, no closing mark, half of the words capitalised in any script."""
    words = F.filter(F.split(line, "(?U)\\s+"), lambda w: w != "")
    n = F.size(words)
    capital = F.size(F.filter(words, lambda w: w.rlike("^\\p{Lu}")))
    return (F.length(line) <= 80) & (n > 0) & (n <= 9) & ~line.rlike("[.,;:]$") & ~line.rlike("^[-*•·]") & (capital >= F.greatest(F.lit(1), F.floor(n / 2)))


def cleaned(line: Column) -> Column:
    return t.stripped(F.regexp_replace(line, "[ \\t]+", " "))


def kind_of(line: Column) -> Column:
    return F.when(is_bullet(line), "bullet").when(is_heading(line), "heading").otherwise("body")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 0), content, kind (heading, bullet, body), section (headings so far), list (number of the bullet's run, else null).

    Blank lines go and don't end a list; a heading or body line does.
    """
    rows = docs.select(key, F.posexplode(F.split(F.col(text), LINE_ENDS)).alias("line", "content"))
    rows = rows.withColumn("content", cleaned(F.col("content"))).where("content <> ''")
    rows = rows.withColumn("kind", kind_of(F.col("content")))
    ordered = Window.partitionBy(key).orderBy("line")
    rows = rows.withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(ordered))
    opens = (F.col("kind") == "bullet") & (F.coalesce(F.lag("kind").over(ordered), F.lit("")) != "bullet")
    rows = rows.withColumn("_opens", opens.cast("int"))
    return rows.withColumn("list", F.when(F.col("kind") == "bullet", F.sum("_opens").over(ordered))).drop("_opens")


def sections(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, heading ('(top)' before the first), level, text of body lines; headings without text go."""
    parts = rows.groupBy(key, "section").agg(
        F.max(F.when(F.col("kind") == "heading", F.col("content"))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct("line", "content")))), lambda x: x["content"]), " ").alias("text"),
    )
    top = F.col("section") == 0
    return parts.where("text <> ''").select(key, "section", F.when(top, "(top)").otherwise(F.col("heading")).alias("heading"), F.when(top, 1).otherwise(2).alias("level"), "text")


def text_records(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", title: str | None = None, error: str | None = None) -> DataFrame:
    """Concept records of texts without markup, such as a PDF's: name from the given title, else the first line that isn't blank, else
    the source's stem; sections and lists as of lines(); a text without words gets `_read_error`, since it needs OCR, unless it has an
    error of its own. A record is made of its row alone, so that texts are neither shuffled nor made twice."""
    given = lambda name: F.col(name) if name else F.lit(None).cast("string")
    rows = docs.select(F.col(key), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"), cleaned(given(title)).alias("title"), given(error).alias("error"))
    whole = F.filter(F.transform(F.split("text", LINE_ENDS), cleaned), lambda x: x != "")
    rows = rows.withColumn("lines", F.transform(whole, lambda x: F.struct(x.alias("content"), kind_of(x).alias("kind"))))
    kind = lambda i: F.coalesce(F.get("lines", i)["kind"], F.lit(""))
    places = lambda found: F.array_compact(F.transform("lines", lambda x, i: F.when(found(x["kind"], i), i)))
    bullet = F.lit("bullet")
    rows = rows.withColumn("heads", F.concat(F.array(F.lit(-1)), places(lambda own, i: own == "heading")))
    rows = rows.withColumn("opens", places(lambda own, i: (own == bullet) & (kind(i - 1) != bullet))).withColumn("ends", places(lambda own, i: (own == bullet) & (kind(i + 1) != bullet)))
    content = lambda some: F.transform(some, lambda x: x["content"])
    behind = lambda h, k: F.slice("lines", h + 2, F.coalesce(F.get("heads", k + 1), F.size("lines")) - h - 1)
    section = lambda h, k: F.struct(F.when(h < 0, "(top)").otherwise(F.get("lines", h)["content"]).alias("heading"), F.when(h < 0, 1).otherwise(2).alias("level"), F.array_join(content(F.filter(behind(h, k), lambda x: x["kind"] == "body")), " ").alias("text"))
    parts = F.filter(F.transform("heads", section), lambda x: x["text"] != "")
    listed = F.transform("opens", lambda s, k: F.transform(F.slice("lines", s + 1, F.get("ends", k) - s + 1), lambda x: without_bullet(x["content"])))
    stem = F.regexp_replace(F.regexp_replace("source", "^.*/", ""), "\\.[^.]*$", "")
    prose = cleaned(F.replace("text", F.lit("\n"), F.lit(" ")))
    typed = lambda c, name: c.cast(dict(x.split(" ", 1) for x in RECORD.split(", "))[name]).alias(name)
    told = F.coalesce("error", F.when(~F.col("text").rlike("(?U)\\S"), "no text layer (scanned?): needs OCR"))
    return rows.select(key, F.coalesce(F.nullif("title", F.lit("")), F.get("lines", F.lit(0))["content"], stem).alias("concept_name"), "source", stem.alias("section"), prose.alias("prose"), typed(parts, "sections"), typed(listed, "lists"), typed(F.array(), "tables"), told.alias("_read_error"))


def prompt_text(record: DataFrame) -> DataFrame:
    """A record as text for a mapper: sections or else prose, lists, table headers, cut at PROMPT_CHARS."""
    none = F.array().cast("array<string>")
    told = F.filter("sections", lambda s: F.coalesce(s["text"], F.lit("")) != "")
    sections = F.transform(told, lambda s: F.concat(F.lit("## "), F.coalesce(s["heading"], F.lit("")), F.lit("\n"), s["text"]))
    prose = F.when(F.coalesce("prose", F.lit("")) != "", F.array("prose")).otherwise(none)
    lists = F.transform(F.filter("lists", lambda x: F.size(x) > 0), lambda x: F.concat(F.lit("Constraints/List:\n- "), F.array_join(x, "\n- ")))
    tables = F.transform(F.filter("tables", lambda x: F.size(x["headers"]) > 0), lambda x: F.concat(F.lit("Table headers: "), F.array_join(x["headers"], " | ")))
    parts = F.concat(F.when(F.size(sections) > 0, sections).otherwise(prose), F.coalesce(lists, none), F.coalesce(tables, none))
    return record.withColumn("prompt", F.substring(F.array_join(parts, "\n\n"), 1, PROMPT_CHARS))


def label_mapper(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The offline mapper: a concept maps to the vocabulary entry of the same normal form (kind, name)."""
    names = vocabulary.groupBy(t.norm(F.col("name")).alias("_norm")).agg(F.min("name").alias("_name"))
    rows = records.join(names, t.norm(F.col("concept_name")) == F.col("_norm"), "left")
    found = F.col("_name").isNotNull()
    concept = F.struct(
        F.col("concept_name").alias("name"), F.lit("Data Object").alias("type"), F.coalesce("_name", F.lit("")).alias("maps_to_neutral"), F.when(found, "closeMatch").otherwise("").alias("match_type"),
        F.when(found, "covered").otherwise("vendor-extension").alias("verdict"), F.when(found, 0.9).otherwise(0.4).alias("confidence"), F.col("source").alias("source"), F.lit("").alias("notes"),
    )
    nothing = MAPPED.split(", attributes ")[1].split(", relationships ")
    return rows.select(*records.columns, F.to_json(F.struct(concept.alias("concept"), F.array().cast(nothing[0]).alias("attributes"), F.array().cast(nothing[1]).alias("relationships"))).alias("mapped_json"))


def problems_of(part: Column, of_concept: bool = False) -> Column:
    """What is wrong with one mapped part, as an array of messages; a concept's confidence is not looked at."""
    match, verdict, confidence = part["match_type"], part["verdict"], part["confidence"]
    checks = [
        F.when((F.coalesce(match, F.lit("")) != "") & ~match.isin(*t.MATCHES), F.concat(F.lit("unknown match type "), match)),
        F.when((F.coalesce(verdict, F.lit("")) != "") & ~verdict.isin(*VERDICTS), F.concat(F.lit("unknown verdict "), verdict)),
    ]
    if not of_concept:
        checks.append(F.when(confidence.isNotNull() & ~confidence.between(0, 1), "confidence is not within 0 and 1"))
    return F.array_compact(F.array(*checks))


def checked(mapped: DataFrame, column: str = "mapped_json") -> DataFrame:
    """Adds mapped (parsed) and problems; JSON that can't be read is one problem."""
    rows = mapped.withColumn("mapped", F.from_json(t.without_fences(F.col(column)), MAPPED))
    none = F.array().cast("array<string>")
    parts = lambda c: F.coalesce(F.flatten(F.transform(c, lambda x: problems_of(x))), none)
    own = F.concat(problems_of(F.col("mapped.concept"), True), parts("mapped.attributes"), parts("mapped.relationships"))
    kind = F.when(~F.coalesce(F.col("mapped.concept.type"), F.lit("")).isin("", *NODE_TYPES), F.array(F.lit("unknown node type"))).otherwise(F.array().cast("array<string>"))
    unread = F.col("mapped").isNull() | F.col("mapped.concept").isNull()
    return rows.withColumn("problems", F.when(unread, F.array(F.lit("no readable mapping"))).otherwise(F.array_compact(F.concat(F.coalesce(own, F.array().cast("array<string>")), kind))))


def map_records(records: DataFrame, mapper: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(good, failed): rows with problems go to the mapper once more, with the problems as `feedback`."""
    first = checked(mapper(records))
    good, bad = first.where(F.size("problems") == 0), first.where(F.size("problems") > 0)
    again = checked(mapper(bad.select(*records.columns, F.array_join("problems", "; ").alias("feedback"))))
    return good.unionByName(again.where(F.size("problems") == 0), allowMissingColumns=True), again.where(F.size("problems") > 0)


def write_draft(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as CSV with headers in a folder of its name, behind the rows that are there."""
    for name, rows in sheets.items():
        rows.write.mode("append").option("header", True).csv(f"{path}/{name}")


def draft_sheets(good: DataFrame, vendor: str) -> dict[str, DataFrame]:
    """Three sheets of mapped rows; rows of little confidence are flagged."""
    flag = lambda c: F.coalesce(F.col(c) < LOW_CONFIDENCE, F.lit(False)).alias("Low confidence")
    common = lambda p: [F.col(f"{p}.maps_to_neutral").alias("Maps to neutral"), F.col(f"{p}.match_type").alias("Match type"), F.col(f"{p}.verdict").alias("Verdict"), F.col(f"{p}.confidence").alias("Confidence"), F.col(f"{p}.source").alias("Source doc"), F.col(f"{p}.notes").alias("Notes"), flag(f"{p}.confidence")]
    layer = F.lit(vendor).alias("Layer")
    owner = F.col("mapped.concept.name")
    attributes = good.select(owner.alias("owner"), F.explode("mapped.attributes").alias("a"))
    relations = good.select(owner.alias("owner"), F.explode("mapped.relationships").alias("r"))
    return {
        "nodes": good.select(layer, owner.alias("Name"), t.identifier(owner, True).alias("IRI local name"), F.col("mapped.concept.type").alias("Type"), *common("mapped.concept")),
        "data properties": attributes.select(layer, F.col("owner").alias("Data object"), F.col("a.name").alias("Attribute"), t.identifier(F.col("a.name"), False).alias("IRI local name"), F.col("a.datatype").alias("Datatype"), F.col("a.value_kind").alias("Value kind"), *common("a")),
        "object properties": relations.select(layer, F.col("owner").alias("Domain"), F.col("r.name").alias("Property"), t.identifier(F.col("r.name"), False).alias("IRI local name"), F.col("r.target").alias("Range"), *common("r")),
    }
