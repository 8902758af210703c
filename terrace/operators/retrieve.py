"""Documents for retrieval: text and titles of pages, word windows, vectors, cosine top-k with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.plans.graph import checkpointed

SIZE, OVERLAP = 220, 40
#: White space of any script, the four separators of the control characters included.
BLANK = "[\\s\\x1C-\\x1F\\x85\\p{Z}]+"
#: Elements whose content is no text of a page.
DROPPED = ("script", "style", "nav", "header", "footer", "noscript")
#: Marks of windows that hold a diagram and no prose.
NOISE = r"(graph TD;|classDef |stroke-width:|fill:#)"


def page_title(html: Column, suffix: str = "") -> Column:
    """<title> without the site's suffix, else the first h1, else null."""
    inner = lambda tag: F.nullif(t.collapsed(t.unescaped(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))), F.lit(""))
    title = inner("title")
    if suffix:
        title = F.when(title.endswith(suffix), F.trim(F.substring(title, F.lit(1), F.length(title) - len(suffix)))).otherwise(title)
    return F.trim(F.rtrim(F.coalesce(F.nullif(title, F.lit("")), inner("h1")), F.lit("#")))


def page_text(html: Column) -> Column:
    """The text of a page: without dropped elements, comments and tags, white space collapsed."""
    bare = html
    for tag in DROPPED:
        bare = F.regexp_replace(bare, f"(?is)<{tag}[ >].*?</{tag}>", " ")
    bare = F.regexp_replace(bare, "(?s)<!--.*?-->", " ")
    return t.collapsed(t.unescaped(F.regexp_replace(bare, "<[^>]*>", " ")))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk, n_words, chunk_text: windows of `size` words, each `size - overlap` after the last; short noise goes."""
    words = F.filter(F.split(F.col(text), BLANK), lambda w: w != "")
    rows = docs.select(key, words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(size - overlap))
    # Cut within the row, so that a window's row carries its own words alone.
    windows = F.transform(starts, lambda s: F.slice("words", s + 1, size))
    rows = rows.select(key, F.posexplode(windows).alias("chunk", "own"))
    rows = rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.size("own").cast("long").alias("n_words"), F.array_join("own", " ").alias("chunk_text"))
    return rows.where(~((F.col("n_words") <= 60) & F.col("chunk_text").rlike(NOISE)))


def hashed_vectors(rows: DataFrame, key: str = "id", text: str = "text", dims: int = 64) -> DataFrame:
    """rows with vector, of length one: the offline default vectoriser, signed feature hashing of words; without words a zero vector."""
    words = rows.select(key, F.explode(F.filter(F.split(F.lower(F.col(text)), BLANK), lambda w: w != "")).alias("w")).select(key, F.xxhash64("w").alias("h"))
    sign = F.when(F.pmod(F.shiftright("h", 40), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = words.groupBy(key, F.pmod("h", F.lit(dims)).cast("int").alias("cell")).agg(F.sum(sign).alias("x"))
    sparse = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cell", "x"))).alias("cells"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.element_at("cells", d), F.lit(0.0)))
    out = rows.join(sparse, key, "left").withColumn("vector", F.transform(t.normalised(dense), lambda x: F.coalesce(x, F.lit(0.0)).cast("float")))
    return out.drop("cells")


def top_k(index: DataFrame, question: list[float], k: int = 4, least: float = 0.35, vendor: str | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows of the index nearest to a vector by cosine, ranked; ties by key."""
    length = sum(x * x for x in question) ** 0.5 or 1.0
    q = F.array(*(F.lit(float(x) / length) for x in question))
    rows = index.where(F.col("vendor") == vendor) if vendor else index
    rows = rows.withColumn("score", t.dot(t.normalised(F.col(vector)), q)).where(F.col("score") >= least)
    best = rows.orderBy(F.desc("score"), key).limit(k)
    # k rows: the window is small.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).withColumn("score", F.round("score", 3))


def cited(hits: DataFrame) -> DataFrame:
    return hits.withColumn("citation", t.citation(F.col("vendor"), F.col("title"), F.col("source")))


def vendors_indexed(index: DataFrame) -> DataFrame:
    return index.select("vendor").distinct().orderBy("vendor")


def read_index(spark, path: str) -> DataFrame:
    """Index files (JSON lines); unreadable ones are skipped, a missing vendor is the file's name before `_index`."""
    rows = spark.read.schema("id long, text string, title string, source string, vendor string, vector array<float>").option("mode", "DROPMALFORMED").json(path)
    name = F.regexp_extract(F.input_file_name(), "([^/]+)_index[^/]*$", 1)
    return rows.withColumn("vendor", F.coalesce(F.nullif("vendor", F.lit("")), name))


def indexed(chunked: DataFrame, done: DataFrame, vendor: str) -> DataFrame:
    """Index rows of chunks (source, title, chunk, text) whose source isn't done: id, text, title, source, vendor, vector."""
    rows = resume(chunked, done).withColumn("vendor", F.lit(vendor))
    return hashed_vectors(rows).select("id", "text", "title", "source", "vendor", "vector")


def resume(docs: DataFrame, done: DataFrame, source: str = "source") -> DataFrame:
    """Rows whose source isn't done; they are numbered from the highest id on, by source and chunk, without gaps."""
    fresh = docs.join(done.select(source).distinct(), source, "left_anti")
    top = done.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    # Sources are summed by ranges first, so that no task sees a row of every source.
    counts = checkpointed(fresh.groupBy(source).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(source).withColumn("_range", F.spark_partition_id()))
    ranges = counts.groupBy("_range").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", inside).join(ranges.select("_range", earlier.alias("earlier")), "_range").select(source, (F.col("before") + F.col("earlier")).alias("before"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("chunk"))
    return fresh.join(counts, source).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("before") + place).drop("top", "before")
