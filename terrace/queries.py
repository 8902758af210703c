"""Queries of the library's own operators over the driver's tables, each with the same in DuckDB's SQL over the rows themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators import assistant, compare, generate, intake, retrieve, texts, trace
from terrace.plans.fixture import BASE, REF, star_graph, stored_star
from terrace.plans.graph import GraphContext, shared_folder
from terrace.plans.store import GraphStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SK = t.SKOS
BLANK = retrieve.BLANK
#: The fixture's graph as relations.
WITH = f"""
WITH RECURSIVE n AS (SELECT count(*) AS c FROM supplier),
obj AS (SELECT '{REF}R' || r_regionkey AS obj, r_name AS label FROM region UNION ALL SELECT '{REF}N' || n_nationkey, n_name FROM nation UNION ALL SELECT '{REF}S' || s_suppkey, s_name FROM supplier),
cust AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, '{BASE}' || lower(c_mktsegment) || '#' AS vendor, '{BASE}' || lower(c_mktsegment) || '#C' || c_custkey AS term, c_name AS name,
  CASE WHEN c_custkey % 10 >= 7 THEN 'vendor-extension' WHEN c_custkey % 4 = 0 THEN 'covered' ELSE 'partial' END AS verdict, c_custkey % 10 < 7 AS mapped,
  ['closeMatch', 'broadMatch', 'narrowMatch', 'relatedMatch'][c_custkey % 4 + 1] AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN '{REF}S' || (c_custkey % n.c) ELSE '{REF}N' || c_nationkey END AS target FROM customer, n),
edge AS (SELECT term, '{SK}' || kind AS match, kind, target AS obj, vendor, seg, verdict, name, k FROM cust WHERE mapped),
linked AS (SELECT '{REF}P' || p_partkey AS prop, '{REF}Cap_' || p_type AS cap, p_type, '{REF}S' || (p_partkey % n.c) AS obj, CASE WHEN p_size % 2 = 0 THEN 'key ' || p_name ELSE p_name END AS label FROM part, n),
link AS (SELECT prop, cap AS domain, obj AS range, label FROM linked UNION ALL SELECT '{REF}locatedIn' || s_suppkey, '{REF}S' || s_suppkey, '{REF}N' || s_nationkey, 'located in' FROM supplier)
"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_graph(name: str, build: Callable, sql: str) -> None:
    query(name, WITH + sql)(lambda spark, d: build(stored_star(spark, d)))


on_graph("q1_coverage_by_object", compare.coverage_by_object, "SELECT o.obj, o.label, e.vendor, e.term, e.match, e.verdict FROM obj o LEFT JOIN edge e ON e.obj = o.obj")
on_graph("q2_coverage_by_capability", compare.coverage_by_capability, "SELECT c.cap AS capability, c.p_type AS capability_label, o.obj, o.label, e.term, e.match, e.verdict FROM (SELECT DISTINCT cap, p_type, obj FROM linked) c JOIN obj o ON o.obj = c.obj LEFT JOIN edge e ON e.obj = o.obj")
for _name, _vendor in (("q3_gap_by_vendor_building", f"{BASE}building#"), ("q3_gap_by_vendor_all", "")):
    on_graph(_name, lambda g, v=_vendor: compare.gap_by_vendor(g, v), f"SELECT o.obj, o.label, NULL::VARCHAR AS note, coalesce(string_agg(e.seg || ':C' || e.k || ' (' || e.kind || ')', ' | ' ORDER BY e.seg || ':C' || e.k || ' (' || e.kind || ')') FILTER (NOT starts_with(e.term, '{_vendor}')), '') AS other_vendors FROM obj o LEFT JOIN edge e ON e.obj = o.obj GROUP BY o.obj, o.label HAVING count(*) FILTER (starts_with(e.term, '{_vendor}')) = 0")
on_graph("q4_convergence", compare.convergence, "SELECT o.obj, o.label, count(DISTINCT e.vendor) AS vendors, string_agg(e.seg || ':C' || e.k, ' | ' ORDER BY e.seg || ':C' || e.k) AS terms FROM obj o JOIN edge e ON e.obj = o.obj WHERE e.kind = 'closeMatch' GROUP BY o.obj, o.label HAVING count(DISTINCT e.vendor) = (SELECT count(DISTINCT vendor) FROM cust)")
on_graph("q5_migration_building_machinery", lambda g: compare.migration_diff(g, f"{BASE}building#", f"{BASE}machinery#"), "SELECT o.obj, o.label, e.term, e.match FROM obj o JOIN edge e ON e.obj = o.obj AND e.seg = 'building' WHERE NOT EXISTS (SELECT 1 FROM edge x WHERE x.obj = o.obj AND x.seg = 'machinery')")
on_graph("q6_extension_surface_all", lambda g: compare.extension_surface(g, ""), "SELECT vendor, term, name AS label FROM cust WHERE NOT mapped")
on_graph("q6_extension_surface_building", lambda g: compare.extension_surface(g, f"{BASE}building#"), "SELECT vendor, term, name AS label FROM cust WHERE NOT mapped AND seg = 'building'")
on_graph("q7_drill_down", lambda g: compare.drill_down(g, f"{REF}N3"), "SELECT e.vendor, e.term, e.match, e.name AS label, e.verdict, 'order/' || f.first AS source_doc FROM edge e LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1) f ON f.o_custkey = e.k WHERE e.obj = '" + REF + "N3'")
on_graph("q8_completeness_guard", compare.completeness_guard, "SELECT vendor, count(DISTINCT obj) AS mapped_objects FROM edge GROUP BY 1")
on_graph("q9_vendors", compare.vendor_list, "SELECT DISTINCT vendor AS ns, seg AS prefix FROM cust")
query("q10_namespaces", WITH + f"""SELECT 'urn:graph:ref' AS g, '{REF}' AS ns, 4 + 3 * (SELECT count(*) FROM obj) + 3 * (SELECT count(DISTINCT p_type) FROM part) + 5 * (SELECT count(*) FROM linked) + 4 * (SELECT count(*) FROM supplier) + 4 * (SELECT count(*) FROM nation) AS n
UNION ALL SELECT 'urn:graph:' || seg, vendor, count(*) * 4 + count(*) FILTER (mapped) + count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = k)) FROM cust GROUP BY 1, 2""")(lambda spark, d: compare.namespace_list(star_graph(spark, d)))
on_graph("q11_status", compare.status, """SELECT 'urn:graph:ref' AS g, 4 + 3 * (SELECT count(*) FROM obj) + 3 * (SELECT count(DISTINCT p_type) FROM part) + 4 * (SELECT count(*) FROM linked) + (SELECT count(*) FROM (SELECT DISTINCT cap, obj FROM linked)) + 4 * (SELECT count(*) FROM supplier) + 4 * (SELECT count(*) FROM nation) AS triples, 8::BIGINT AS queries
UNION ALL SELECT 'urn:graph:' || seg, count(*) * 4 + count(*) FILTER (mapped) + count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = k)), 8::BIGINT FROM cust GROUP BY 1""")
on_graph("q12_coverage_buckets", compare.coverage_buckets, "SELECT o.obj, o.label, coalesce(string_agg(DISTINCT e.seg, ',' ORDER BY e.seg), '') AS covered_by, CASE WHEN count(DISTINCT e.seg) = 0 THEN 'none' WHEN count(DISTINCT e.seg) >= (SELECT count(DISTINCT seg) FROM cust) THEN 'all' ELSE 'some' END AS bucket FROM obj o LEFT JOIN edge e ON e.obj = o.obj GROUP BY 1, 2")
on_graph("q13_vocabulary", compare.vocabulary, "SELECT DISTINCT 'DataObject' AS kind, label AS name FROM obj UNION SELECT DISTINCT 'Capability', p_type FROM part")

#: The catalog's queries as text, each with the SQL of its builder, and texts that no builder has.
_GIVEN = {"VENDOR": f"{BASE}building#", "FROM": f"{BASE}building#", "TO": f"{BASE}machinery#", "REF_CONCEPT": f"{REF}N3"}
for _name, _same in (("coverage_by_object", "q1_coverage_by_object"), ("coverage_by_capability", "q2_coverage_by_capability"), ("gap_by_vendor", "q3_gap_by_vendor_building"), ("convergence", "q4_convergence"), ("migration_diff", "q5_migration_building_machinery"), ("extension_surface", "q6_extension_surface_building"), ("drill_down", "q7_drill_down"), ("completeness_guard", "q8_completeness_guard")):
    query(f"s4_text_{_name}", ORACLES[_same])(lambda spark, d, n=_name: texts.TextEngine(stored_star(spark, d)).run(n, _GIVEN))
on_graph("s4_text_match_kinds", lambda g: texts.TextEngine(g).run("match_kinds"), "SELECT vendor, kind, count(*) AS edges, count(*) FILTER (verdict = 'covered') AS covered FROM edge GROUP BY 1, 2")
on_graph("s4_text_undocumented_terms", lambda g: texts.TextEngine(g).run("undocumented_terms", {"VENDOR": ""}), "SELECT term, name AS label, verdict FROM cust WHERE k NOT IN (SELECT o_custkey FROM orders)")
on_graph("s4_text_vendor_overlap", lambda g: texts.TextEngine(g).run("vendor_overlap"), "SELECT a.vendor AS one, b.vendor AS other, count(*) AS objects FROM (SELECT DISTINCT vendor, obj FROM edge) a JOIN (SELECT DISTINCT vendor, obj FROM edge) b ON a.obj = b.obj AND a.vendor < b.vendor GROUP BY 1, 2")


@query("s2_replaced_layer", WITH + f"""SELECT 'urn:graph:' || seg AS g, p, count(*) AS n FROM (SELECT k, seg, unnest(list_filter(['{t.TYPE}', '{t.SUBCLASS}', '{t.LABEL}', vendor || 'verdict', CASE WHEN mapped THEN '{SK}' || kind END, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = k) THEN vendor || 'sourceDoc' END], lambda x: x IS NOT NULL)) AS p FROM cust)
WHERE seg = 'machinery' OR seg = 'building' AND k % 2 = 0 GROUP BY 1, 2""")
def _replaced(spark: SparkSession, d: str) -> DataFrame:
    """Two layers in a store of their own, one of them then replaced by the half of its terms."""
    quads = stored_star(spark, d).quads().where(F.col("g").isin("urn:graph:building", "urn:graph:machinery"))
    store = GraphStore(spark, f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}")
    store.load_all(quads)
    store.load("building", quads.where(F.col("g") == "urn:graph:building").where(F.regexp_extract("s", "#C([0-9]+)$", 1).cast("long") % 2 == 0))
    return store.context().quads().groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


on_graph("s3_pattern_scan", lambda g: g.pattern(p=t.SUBCLASS, o=f"{REF}R1", g="urn:graph:ref").select("s", "o"), f"SELECT '{REF}N' || n_nationkey AS s, '{REF}R1' AS o FROM nation WHERE n_regionkey = 1")

_N = f"{REF}N3"
on_graph("g1_resolve_concept", lambda g: trace.resolve_concept(g, "customer#00000001", "building", 200), f"SELECT iri, label, CASE WHEN starts_with(iri, '{BASE}building#') THEN 3 ELSE 4 END::INTEGER AS score, seg AS prefix FROM (SELECT term AS iri, name AS label, seg FROM cust WHERE contains(lower(name), 'customer#00000001') ORDER BY 1, 2 LIMIT 200)")
on_graph("g1_resolve_exact", lambda g: trace.resolve_concept(g, "ASIA"), "SELECT obj AS iri, label, CASE WHEN lower(label) = 'asia' THEN 2 ELSE 4 END::INTEGER AS score, 'ref' AS prefix FROM obj WHERE contains(lower(label), 'asia')")
on_graph("g2_concept_mappings", lambda g: trace.concept_mappings(g, _N), f"SELECT 'in' AS dir, match, term AS other, name AS label FROM edge WHERE obj = '{_N}'")
on_graph("g3_concept_attributes", lambda g: trace.concept_attributes(g, _N), f"SELECT '{REF}name' || n_nationkey AS prop, 'name' AS label, '{t.XSD}string' AS range FROM nation WHERE n_nationkey = 3")
on_graph("g4_links_out", lambda g: trace.links_out(g, f"{REF}S3"), f"SELECT l.prop, l.label, l.range AS other, o.label AS other_label FROM link l LEFT JOIN obj o ON o.obj = l.range WHERE l.domain = '{REF}S3'")
on_graph("g5_links_in", lambda g: trace.links_in(g, f"{REF}S3"), f"SELECT l.prop, l.label, l.domain AS other, replace(l.domain, '{REF}Cap_', '') AS other_label FROM link l WHERE l.range = '{REF}S3'")


def _united(spark: SparkSession, d: str) -> GraphContext:
    """The graph with a property a nation, whose domain is the union of that nation and its region."""
    ctx = stored_star(spark, d)
    nation = spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey", F.col("n_nationkey").cast("string").alias("k"))
    iri = lambda kind, key: F.concat(F.lit(f"{REF}{kind}"), key)
    cell = lambda name: F.concat(F.lit(f"_:{name}"), "k")
    facts = [
        (iri("code", F.col("k")), "iri", t.TYPE, F.lit(t.DATATYPE_PROPERTY), "iri"), (iri("code", F.col("k")), "iri", t.LABEL, F.lit("code"), "lit"), (iri("code", F.col("k")), "iri", t.DOMAIN, cell("u"), "bnode"), (cell("u"), "bnode", t.UNION, cell("a"), "bnode"),
        (cell("a"), "bnode", t.RDF + "first", iri("N", F.col("k")), "iri"), (cell("a"), "bnode", t.RDF + "rest", cell("b"), "bnode"), (cell("b"), "bnode", t.RDF + "first", iri("R", F.col("n_regionkey").cast("string")), "iri"), (cell("b"), "bnode", t.RDF + "rest", F.lit(t.RDF + "nil"), "iri"),
    ]
    more = nation.select(F.explode(F.array(*(F.struct(s.alias("s"), F.lit(sk).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(ok).alias("o_kind")) for s, sk, p, o, ok in facts))).alias("x")).select("x.*")
    return replace(ctx, merged=ctx.triples().unionByName(more), _held={})


@query("g14_answer_facts", WITH + f"SELECT '{_N}' AS concept, kind, n FROM (SELECT 'mappings' AS kind, (SELECT count(*) FROM edge WHERE obj = '{_N}') AS n UNION ALL SELECT 'attributes', (SELECT count(*) FROM nation WHERE n_nationkey = 3) UNION ALL SELECT 'links_out', (SELECT count(*) FROM link WHERE domain = '{_N}') UNION ALL SELECT 'links_in', (SELECT count(*) FROM link WHERE range = '{_N}'))")
def _answer_facts(spark: SparkSession, d: str) -> DataFrame:
    """A question about a nation by its name: the concept that it is taken for, and how many facts of each kind are gathered."""
    name = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 3").first()["n_name"]
    facts = trace.answer(stored_star(spark, d), f"What is {name}?")
    (concept,) = facts["concepts"]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(concept).alias("concept"), F.lit(kind).alias("kind"), "n") for kind, df in facts["traces"][0].items()]
    return reduce(DataFrame.unionByName, counts)


@query("n1_routed_question", ORACLES["q3_gap_by_vendor_building"])
def _routed(spark: SparkSession, d: str) -> DataFrame:
    """A question in words, routed to a query of the catalog and its parameters, then run."""
    engine = compare.Engine(stored_star(spark, d))
    overlays = [{"prefix": p, "namespace": ns} for p, ns in engine.ctx.namespaces.items() if p != engine.ctx.reference]
    routed = assistant.route("What does building not map?", engine.list_queries(), overlays)
    return engine.run(routed["query"], routed["params"])


query("g3_attributes_of_unions", f"SELECT '{REF}code' || n_nationkey AS prop, 'code' AS label, NULL::VARCHAR AS range FROM nation WHERE n_regionkey = 1")(lambda spark, d: trace.concept_attributes(trace.with_unions(_united(spark, d)), f"{REF}R1"))


def _path_ends(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """The first part's capability, the object that it ties that to, and what this lies in."""
    supplier = spark.read.parquet(f"{d}/supplier.parquet")
    first = spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").first()
    key = first["p_partkey"] % supplier.count()
    return f"{REF}Cap_{first['p_type']}", f"{REF}S{key}", f"{REF}N{supplier.where(F.col('s_suppkey') == key).first()['s_nationkey']}"


_FIRST = f", f AS (SELECT '{REF}Cap_' || p_type AS cap, '{REF}S' || s_suppkey AS obj, '{REF}N' || s_nationkey AS nation FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 1), n, supplier WHERE s_suppkey = p_partkey % n.c)"


def on_path(name: str, build: Callable, sql: str) -> None:
    query(name, WITH.rstrip() + _FIRST + "\n" + sql)(lambda spark, d: build(stored_star(spark, d), *_path_ends(spark, d)))


on_path("g6_direct_paths", lambda g, cap, obj, nation: trace.direct_paths(g, obj, cap), "SELECT 'b->a' AS dir, prop, label FROM link, f WHERE domain = f.cap AND range = f.obj")
on_path("g6_direct_path_out", lambda g, cap, obj, nation: trace.direct_paths(g, obj, nation), "SELECT 'a->b' AS dir, prop, label FROM link, f WHERE domain = f.obj AND range = f.nation")
on_path("g7_two_hop_paths", lambda g, cap, obj, nation: trace.two_hop_paths(g, cap, nation), "SELECT a.prop AS first, a.range AS mid, b.prop AS second FROM link a JOIN link b ON a.range = b.domain, f WHERE a.domain = f.cap AND b.range = f.nation ORDER BY 1, 2, 3 LIMIT 10")
on_graph("g8_context_bridge", lambda g: trace.context_bridge(g, f"{REF}S1", f"{REF}S3"), f"SELECT ctx, replace(ctx, '{REF}Cap_', '') AS label, NULL::VARCHAR AS comment, pa, pa_label, pa_is_key, pb, pb_label, pb_is_key, contains(lower(ctx), 'context') OR pa_is_key OR pb_is_key AS is_context_table FROM (SELECT DISTINCT a.domain AS ctx, a.prop AS pa, a.label AS pa_label, starts_with(lower(a.label), 'key') AS pa_is_key, b.prop AS pb, b.label AS pb_label, starts_with(lower(b.label), 'key') AS pb_is_key FROM link a JOIN link b ON a.domain = b.domain WHERE a.range = '{REF}S1' AND b.range = '{REF}S3') ORDER BY is_context_table DESC, ctx, pa, pb LIMIT 40")
on_graph("g9_contexts_keying_on", lambda g: trace.contexts_keying_on(g, f"{REF}S3"), f"SELECT domain AS ctx, coalesce(o.label, replace(domain, '{REF}Cap_', '')) AS ctx_label, prop, l.label FROM (SELECT * FROM link WHERE range = '{REF}S3' ORDER BY domain, prop LIMIT 60) l LEFT JOIN obj o ON o.obj = l.domain WHERE contains(lower(domain), 'context') OR starts_with(l.label, 'key')")
on_graph("g10_graph_layers", trace.graph_layers, "SELECT 'ref' AS layer UNION SELECT seg FROM cust")
_NODES = f"""SELECT obj AS id, label, 'ref' AS layer, 'DataObject' AS type, NULL::VARCHAR AS kind, NULL::VARCHAR AS verdict FROM obj UNION ALL SELECT DISTINCT '{REF}Cap_' || p_type, p_type, 'ref', 'Capability', NULL, NULL FROM part UNION ALL SELECT term, name, seg, 'Class', NULL, verdict FROM cust
UNION ALL SELECT '{REF}DataObject', 'Data Object', 'ref', 'Class', NULL, NULL UNION ALL SELECT '{REF}Capability', 'Capability', 'ref', 'Class', NULL, NULL"""
on_graph("g11_graph_nodes", trace.graph_nodes, _NODES)
on_graph("g11_graph_nodes_attributes", lambda g: trace.graph_nodes(g, attributes=True), _NODES + f" UNION ALL SELECT '{REF}name' || n_nationkey, 'name', 'ref', 'DatatypeProperty', 'datatype', NULL FROM nation")
#: One layer's view: its own classes, and the local names of what operations and its mappings reach.
on_graph("g11_graph_nodes_building", lambda g: trace.graph_nodes(g, "building"), f"""SELECT term AS id, name AS label, seg AS layer, 'Class' AS type, NULL::VARCHAR AS kind, verdict FROM cust WHERE seg = 'building'
UNION ALL SELECT id, string_split(id, '#')[2], 'ref', 'Class', NULL, NULL FROM (SELECT cap AS id FROM linked UNION SELECT obj FROM linked UNION SELECT obj FROM edge WHERE seg = 'building')""")


def _edges_of(sections: str) -> str:
    return f"SELECT source, target, label, match_type, true AS directed FROM (SELECT source, target, label, match_type, row_number() OVER (PARTITION BY source, target, coalesce(match_type, label) ORDER BY section, label) AS place FROM ({sections})) WHERE place = 1"


_OPERATES = "SELECT DISTINCT cap AS source, obj AS target, 'operatesOn' AS label, NULL AS match_type, 0 AS section FROM linked"
_EDGES = _edges_of(f"{_OPERATES} UNION ALL SELECT domain, range, label, NULL, 1 FROM link UNION ALL SELECT term, obj, kind, kind, 2 FROM edge")
on_graph("g12_graph_edges", trace.graph_edges, _EDGES)
on_graph("g12_graph_edges_attributes", lambda g: trace.graph_edges(g, attributes=True), _edges_of(f"{_OPERATES} UNION ALL SELECT domain, range, label, NULL, 1 FROM link UNION ALL SELECT term, obj, kind, kind, 2 FROM edge UNION ALL SELECT '{REF}N' || n_nationkey, '{REF}name' || n_nationkey, 'string', NULL, 3 FROM nation"))
on_graph("g12_graph_edges_building", lambda g: trace.graph_edges(g, "building"), _edges_of(f"{_OPERATES} UNION ALL SELECT domain, range, label, NULL, 1 FROM link WHERE domain IN (SELECT cap FROM linked) UNION ALL SELECT term, obj, kind, kind, 2 FROM edge WHERE seg = 'building'"))
on_graph("g13_neighbourhood", lambda g: trace.neighbourhood(trace.graph_nodes(g), trace.graph_edges(g), _N).select("id", "type"), f"SELECT id, CASE WHEN starts_with(id, '{REF}') THEN 'DataObject' ELSE 'Class' END AS type FROM (SELECT DISTINCT unnest([source, target]) AS id FROM ({_EDGES}) WHERE '{_N}' IN (source, target))")
on_graph("g13_layer_colours", lambda g: trace.graph_layers(g).select("layer", trace.colour_index(g, F.col("layer")).alias("colour")), "SELECT 'ref' AS layer, NULL::INTEGER AS colour UNION ALL SELECT seg, ((row_number() OVER (ORDER BY seg) - 1) % 4)::INTEGER FROM (SELECT DISTINCT seg FROM cust)")

_JAVA_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"


@query("d2_doc_chunks", f"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_JAVA_BLANK}'), lambda x: x <> '') AS words FROM documents), s AS (SELECT doc_id, words, unnest(range(0, len(words), 180)) AS start FROM w) SELECT doc_id, start // 180 AS chunk, least(220, len(words) - start)::BIGINT AS n_words, md5(array_to_string(words[start + 1 : start + 220], ' ')) AS digest FROM s WHERE NOT (len(words) - start <= 60 AND regexp_matches(array_to_string(words[start + 1 : start + 220], ' '), '(graph TD;|classDef |stroke-width:|fill:#)'))")
def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return retrieve.chunks(docs).select("doc_id", "chunk", "n_words", F.md5("chunk_text").alias("digest"))


_ANY_BLANK = "[\\s\\p{Z}]+"


def _unescaped(text: str) -> str:
    for name, character in t.NAMED:
        text = f"replace({text}, '{name}', {f"chr({ord(character)})"})"
    return text


def _sql_text(html: str) -> str:
    for tag in retrieve.DROPPED:
        html = f"regexp_replace({html}, '<{tag}[ >].*?</{tag}>', ' ', 'gis')"
    html = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
    return f"trim(regexp_replace({_unescaped(f"regexp_replace({html}, '<[^>]*>', ' ', 'g')")}, '{_ANY_BLANK}', ' ', 'g'))"


@query("d1_page_text", f"SELECT page_id, md5({_sql_text('html')}) AS digest, length({_sql_text('html')})::BIGINT AS n FROM pages")
def _page_text(spark: SparkSession, d: str) -> DataFrame:
    text = retrieve.page_text(F.col("html"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


def _inner(tag: str) -> str:
    return f"nullif(trim(regexp_replace({_unescaped("regexp_replace(regexp_extract(html, '(?is)<' || '{tag}' || '[^>]*>(.*?)</' || '{tag}' || '>', 1), '<[^>]*>', '', 'g')").replace('{tag}', tag)}, '{_ANY_BLANK}', ' ', 'g')), '')"


@query("r2_page_titles", f"SELECT page_id, trim(rtrim(coalesce({_inner('title')}, {_inner('h1')}), '#')) AS title FROM pages")
def _titles(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", retrieve.page_title(F.col("html")).alias("title"))


_PAGE = "regexp_replace(html, '<(script|style|nav|header|footer|noscript|aside)[ >].*?</(script|style|nav|header|footer|noscript|aside)>', '', 'gis')"


@query("r8_page_records", f"SELECT page_id, trim(rtrim(coalesce({_inner('title')}, {_inner('h1')}), '#')) AS concept_name, CASE WHEN suffix(url, '/index.html') THEN url[:-12] ELSE regexp_extract(url, '^(.*/)?', 0) || replace(regexp_extract(url, '([^/]*)$', 1), '.html', '') END AS section, len(regexp_extract_all({_PAGE}, '(?i)<(ul|ol)[ >]'))::INTEGER AS lists, len(regexp_extract_all({_PAGE}, '(?i)<table[ >]'))::INTEGER AS tables FROM pages")
def _records(spark: SparkSession, d: str) -> DataFrame:
    from terrace.sources.records import page_records

    rows = page_records(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html", "url")
    return rows.select("page_id", "concept_name", "section", F.size("lists").alias("lists"), F.size("tables").alias("tables"))


_CLEAN = f"trim(regexp_replace(x, '{_ANY_BLANK}', ' ', 'g'))"


@query("r3_html_sections", f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
c AS (SELECT doc_id, i, {_CLEAN} AS x, sum((i % 7 = 2)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
b AS (SELECT doc_id, section, max(x) FILTER (i % 7 = 2) AS heading, string_agg(x, ' ' ORDER BY i) FILTER (i % 7 NOT IN (2, 4) AND x <> '' AND NOT regexp_matches(x, '(graph TD;|classDef |stroke-width:|fill:#|-->)')) AS body FROM c GROUP BY doc_id, section)
SELECT doc_id, 'Document ' || doc_id AS concept_name, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1)::INTEGER AS place, CASE WHEN section = 0 THEN '(top)' ELSE heading END AS heading, CASE WHEN section = 0 THEN 0 ELSE 2 END AS level, md5(body) AS digest FROM b WHERE body IS NOT NULL""")
def _html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: the name in an h1 of the boilerplate, every seventh line a heading with a mark, some headings blank, some lines in lists."""
    from terrace.sources.records import page_records

    marked = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    wrap = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    line = lambda x, i: F.when(i % 7 == 2, wrap("<h2>", x, " #</h2>")).when(i % 7 == 4, F.lit("<h3> \n</h3>")).when(i % 7 == 5, wrap("<ul><li>", x, "</li></ul>")).otherwise(wrap("<p>", x, "</p>"))
    body = F.array_join(F.transform(F.split(marked, "\n"), line), "\n")
    pages = _docs(spark, d).select("doc_id", F.concat(F.lit("<html><header><h1>Document "), F.col("doc_id").cast("string"), F.lit("#</h1><p>menu</p></header>"), F.coalesce(body, F.lit("")), F.lit("</html>")).alias("html"), F.lit("d/page.html").alias("source"))
    rows = page_records(pages, "doc_id", "html", "source")
    return rows.select("doc_id", "concept_name", F.posexplode("sections").alias("place", "s")).select("doc_id", "concept_name", "place", "s.heading", "s.level", F.md5("s.text").alias("digest"))


_LINES = """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM (SELECT doc_id, regexp_replace(text, '\\r\\n|[\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g') AS text FROM documents)),
c AS (SELECT doc_id, line, regexp_replace(regexp_replace(raw, '[ \\t]+', ' ', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS content FROM l),
b AS (SELECT *, regexp_matches(content, '^[-*•·]') OR regexp_matches(content, '^\\(?\\p{Nd}+[.)][\\s\\p{Z}]') AS bullet, list_filter(string_split_regex(content, '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM c WHERE content <> ''),
k AS (SELECT doc_id, line, content, CASE WHEN bullet THEN 'bullet' WHEN length(content) <= 80 AND len(w) BETWEEN 1 AND 9 AND NOT regexp_matches(content, '[.,;:]$') AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}'))) >= greatest(1, len(w) // 2) THEN 'heading' ELSE 'body' END AS kind FROM b),
s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS section, kind = 'bullet' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line), '') <> 'bullet' AS opens FROM k),
x AS (SELECT doc_id, line, content, kind, section, CASE WHEN kind = 'bullet' THEN sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) END AS list FROM s)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("r7_text_lines", _LINES + " SELECT doc_id, line::BIGINT AS line, kind, section::BIGINT AS section, list::BIGINT AS list, md5(content) AS digest FROM x")
def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    return intake.lines(_docs(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), "kind", "section", "list", F.md5("content").alias("digest"))


@query("r7_text_sections", _LINES + " SELECT doc_id, section::BIGINT AS section, CASE WHEN section = 0 THEN '(top)' ELSE max(content) FILTER (kind = 'heading') END AS heading, CASE WHEN section = 0 THEN 1 ELSE 2 END AS level, md5(string_agg(content, ' ' ORDER BY line) FILTER (kind = 'body')) AS digest FROM x GROUP BY doc_id, section HAVING count(*) FILTER (kind = 'body') > 0")
def _text_sections(spark: SparkSession, d: str) -> DataFrame:
    return intake.sections(intake.lines(_docs(spark, d))).select("doc_id", "section", "heading", "level", F.md5("text").alias("digest"))


@query("r9_text_records", _LINES + """, f AS (SELECT doc_id, min_by(content, line) AS first, count(DISTINCT list)::INTEGER AS lists FROM x GROUP BY doc_id), h AS (SELECT doc_id, count(DISTINCT section)::INTEGER AS sections FROM x WHERE kind = 'body' GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.first, d.source) AS concept_name, coalesce(h.sections, 0)::INTEGER AS sections, coalesce(f.lists, 0)::INTEGER AS lists, f.first IS NULL AS needs_ocr FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN h USING (doc_id)""")
def _text_records(spark: SparkSession, d: str) -> DataFrame:
    return intake.text_records(_docs(spark, d)).select("doc_id", "concept_name", F.size("sections").alias("sections"), F.size("lists").alias("lists"), F.col("_read_error").isNotNull().alias("needs_ocr"))


_R9 = ORACLES["r9_text_records"]


@query("s10_pdf_records", _R9.replace("FROM documents)", "FROM (SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E\\n]', '?', 'g') AS text FROM documents))").replace("coalesce(f.first, d.source)", "coalesce(f.first, d.doc_id::VARCHAR)"))
def _pdf_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as PDF files, a line below the other with the lower ones written first, and their records."""
    from terrace.sources.pdf import pdf_records

    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E\\n]", "?"), "([()\\\\])", "\\\\$1")
    line = lambda x, i: F.concat(F.lit("1 0 0 1 72 "), (-12 * i).cast("string"), F.lit(" Tm ("), x, F.lit(") Tj"))
    content = F.concat(F.lit("BT /F1 10 Tf "), F.array_join(F.reverse(F.transform(F.split(plain, "\n"), line)), " "), F.lit(" ET"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Contents 4 0 R /Resources << /Font << /F1 << /Subtype /Type1 >> >> >> >> endobj 4 0 obj << /Length "
    whole = F.concat(F.lit(head), F.length(content).cast("string"), F.lit(" >> stream\n"), content, F.lit("\nendstream endobj trailer << /Root 1 0 R >>"))
    # Dealt out first: a table of few row groups would be few tasks.
    docs = _docs(spark, d).select("doc_id", "text").repartition("doc_id")
    files = docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), whole.cast("binary").alias("content"))
    rows = pdf_records(files)
    return rows.select(F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("doc_id"), "concept_name", F.size("sections").alias("sections"), F.size("lists").alias("lists"), F.col("_read_error").isNotNull().alias("needs_ocr"))


@query("k2_draft_workbooks", "SELECT sheet, sum(n)::BIGINT AS n, sum(v)::DOUBLE AS confidence FROM (SELECT '1. Nodes' AS sheet, count(*) AS n, sum(c_custkey % 100) AS v FROM customer UNION ALL SELECT '2. Data Properties', count(*), sum(o_custkey % 100) FROM orders UNION ALL SELECT '3. Object Properties', count(*), sum(c_custkey % 100) FROM customer) GROUP BY 1")
def _draft_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as concepts with their orders as attributes, drafted into workbooks and read from these again."""
    from terrace.sources import workbook

    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    blank = [F.lit("").alias(c) for c in ("maps_to_neutral", "match_type", "verdict")]
    rest = lambda key: [*blank, (F.col(key) % 100 / 100).alias("confidence"), F.lit("").alias("source"), F.lit("").alias("notes")]
    orders = table("orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.lit("string").alias("datatype"), F.lit("").alias("value_kind"), *rest("o_custkey"))).alias("attributes"))
    rows = table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    concept = F.struct(F.col("c_name").alias("name"), F.lit("Data Object").alias("type"), *rest("c_custkey"))
    relation = F.array(F.struct(F.lit("lies in").alias("name"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("target"), *rest("c_custkey")))
    good = rows.select(F.struct(concept.alias("concept"), "attributes", relation.alias("relationships")).alias("mapped"))
    path = f"{shared_folder(spark)}/drafts-{uuid.uuid4().hex}"
    workbook.save_workbooks(workbook.draft_workbooks(intake.draft_sheets(good, "v"), workbook.plain_template()), path)
    cells = workbook.cells(spark, path)
    heads = cells.where("row = 1 and value = 'Confidence'").select("path", "sheet", "col")
    found = cells.where("row > 1").join(heads, ["path", "sheet", "col"]).groupBy("sheet")
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double") * 100)).alias("confidence"))


@query("d4_resume", "WITH c AS (SELECT source, doc_id AS chunk FROM documents WHERE source NOT IN ('src0', 'src1')), t AS (SELECT coalesce(max(doc_id), -1) AS top FROM documents WHERE source IN ('src0', 'src1')) SELECT source, chunk, (top + row_number() OVER (ORDER BY source, chunk))::BIGINT AS id FROM c, t")
def _resume(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("source", F.col("doc_id").alias("chunk"))
    done = rows.where(F.col("source").isin("src0", "src1")).select("source", F.col("chunk").alias("id"))
    return retrieve.resume(rows, done).select("source", "chunk", "id")


@query("d5_vector_top_k", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q) SELECT vec_id, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (SELECT * FROM s WHERE score >= 0.35 ORDER BY score DESC, vec_id LIMIT 4)")
def _top_k(spark: SparkSession, d: str) -> DataFrame:
    index = spark.read.parquet(f"{d}/embeddings.parquet")
    question = index.where("vec_id = 7").first()["embedding"]
    return retrieve.top_k(index, question, key="vec_id", vector="embedding").select("vec_id", "score", "rank")


@query("f33_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first FROM embeddings")
def _norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(F.sqrt(t.dot(v, v)), 4).alias("norm"), F.round(t.normalised(v)[0], 4).alias("first"))


@query("d6_vendors_indexed", "SELECT DISTINCT source AS vendor FROM documents")
def _vendors_indexed(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.vendors_indexed(_docs(spark, d).select(F.col("source").alias("vendor")))


@query("f36_citations", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'v' || (page_id % 3) || ': ' END || url || ' (' || CASE WHEN suffix(url, '/index.html') THEN url[:-12] ELSE regexp_extract(url, '^(.*/)?', 0) || replace(regexp_extract(url, '([^/]*)$', 1), '.html', '') END || ')' AS citation FROM pages")
def _citations(spark: SparkSession, d: str) -> DataFrame:
    vendor = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("v"), (F.col("page_id") % 3).cast("string")))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.citation(vendor, F.col("url"), t.section_of(F.col("url"))).alias("citation"))


@query("f16_scalar_functions", r"""SELECT p_partkey, '"' || trim(replace(replace(p_name || ' "x"', '\', '\\'), '"', '\"')) || '"' AS lit, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS num, lower(trim(p_name)) AS norm, array_to_string([upper(w[1]) || w[2:] for w in string_split_regex(p_name, '[^A-Za-z0-9]+') if w <> ''], '') AS pascal, lower(trim(p_type)) = 'yes' AS yes FROM part""")
def _scalars(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", t.literal(F.concat("p_name", F.lit(' "x"'))).alias("lit"), t.as_number(F.col("p_retailprice").cast("string")).alias("num"), t.norm(F.concat(F.lit('" '), "p_name", F.lit(' "'))).alias("norm"), t.identifier(F.col("p_name"), True).alias("pascal"), t.yes(F.col("p_type")).alias("yes"))


KG = "urn:kg-"
NAMES = generate.Names("building", KG)
PP = generate.Names("pp", KG)
_OWN, _PP, _KREF = NAMES.ns, PP.ns, NAMES.ref


def node_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a capture sheet of nodes."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    kinds = F.get(F.array(F.lit("close match"), F.lit("BroadMatch"), F.lit("narrowMatch"), F.lit("exactMatch")), (k % 4).cast("int"))
    return generate.sheet(
        c.select(
            (k + 2).alias("row"), F.col("c_mktsegment").alias("Layer"), F.when(k % 17 != 0, F.col("c_name")).alias(" Name"), F.when(k % 34 == 0, F.concat(F.lit("x"), k.cast("string"))).alias("IRI local name"), F.when(k % 5 == 0, "External system").otherwise("Data Object").alias("Type"),
            F.when(k % 10 < 7, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("Maps to neutral"), F.when((k % 10 < 7) & (k % 13 != 0), kinds).alias("Match type"), F.when(k % 11 == 0, "Absent").alias("VERDICT"),
            F.when(k % 6 == 0, F.concat(F.lit("ref:R"), (k % 5).cast("string"))).alias("Secondary maps to neutral"), F.when(k % 12 == 0, "related match").when(k % 7 == 0, "near").alias("Secondary match type"), F.when(k % 9 == 0, "1.5").when(k % 9 == 1, "high").when(k % 9 == 2, "1.0").otherwise("0.5").alias("Confidence"),
            F.when(k % 8 == 0, "doc \"a\"").alias("Source doc"), F.when(k % 4 == 1, F.concat(F.lit("n "), k.cast("string"))).alias("Notes"),
        ),
        ["Layer", "Name", "Type"],
    )


_SHEET = """WITH s AS (SELECT c_custkey AS k, c_custkey + 2 AS row, lower(c_mktsegment) AS seg, c_name AS nm, c_custkey % 10 < 7 AS mapped, c_nationkey, CASE WHEN c_custkey % 10 < 7 AND c_custkey % 13 <> 0 THEN ['closeMatch', 'broadMatch', 'narrowMatch', 'odd'][c_custkey % 4 + 1] END AS m FROM customer),
v AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'Absent' WHEN NOT mapped THEN 'vendor-extension' WHEN m = 'closeMatch' THEN 'covered' WHEN m IS NOT NULL AND m <> 'odd' THEN 'partial' END AS verdict FROM s)"""


@query("t3_row_problems", _SHEET + """ SELECT row, 'error' AS severity, 'nodes: name and IRI local name are empty' AS problem FROM s WHERE k % 17 = 0 AND k % 34 <> 0 UNION ALL SELECT row, 'error', 'nodes: unknown match type' FROM s WHERE m = 'odd'
UNION ALL SELECT row, 'error', 'nodes: confidence is not within 0 and 1' FROM s WHERE k % 9 IN (0, 1) UNION ALL SELECT row, 'warning', 'nodes: mapping without match type' FROM s WHERE mapped AND m IS NULL
UNION ALL SELECT row, 'error', 'nodes: secondary mapping without match type' FROM s WHERE k % 6 = 0 AND k % 12 <> 0 AND k % 7 <> 0 UNION ALL SELECT row, 'error', 'nodes: unknown secondary match type' FROM s WHERE k % 12 <> 0 AND k % 7 = 0""")
def _row_problems(spark: SparkSession, d: str) -> DataFrame:
    return generate.row_problems(node_sheet(spark, d), "nodes")


@query("t5_verdicts", _SHEET + " SELECT row, verdict FROM v")
def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = node_sheet(spark, d)
    return rows.select("row", generate.verdict_of(rows).alias("verdict"))


@query("t6_mapping_edges", _SHEET + " SELECT row AS s, m AS match, 'ref:nation' || c_nationkey AS target FROM s WHERE m <> 'odd' UNION ALL SELECT row, 'relatedMatch', 'ref:R' || (k % 5) FROM s WHERE k % 12 = 0")
def _edges(spark: SparkSession, d: str) -> DataFrame:
    return generate.mapping_edges(node_sheet(spark, d).withColumn("s", F.col("row")))


def _sql_facts(table: str, section: str, s: str, facts: list[tuple[str, str, str, str]]) -> str:
    """A SELECT a fact: p, o, o_kind, o_dt as SQL expressions; facts whose o is null go."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {s} AS s, {p} AS p, {o} AS o, {kind} AS o_kind, {dt} AS o_dt FROM {table} WHERE ({o}) IS NOT NULL" for p, o, kind, dt in facts)


def _q(text: str) -> str:
    return f"'{text}'"


_I, _L, _NO = "'iri'", "'lit'", "NULL::VARCHAR"
_DEC, _INT, _BOOL = (_q(t.XSD + x) for x in ("decimal", "integer", "boolean"))


@query("t8_node_triples", _SHEET + f", r AS (SELECT *, '{_OWN}' || string_split(nm, '#')[2] AS iri FROM v WHERE seg = 'building' AND k % 17 <> 0) " + _sql_facts("r", "nodes", "iri", [
    (_q(t.TYPE), _q(t.CLASS), _I, _NO), (_q(t.SUBCLASS), f"'{_OWN}' || CASE WHEN k % 5 = 0 THEN 'ExternalReference' ELSE 'DataObject' END", _I, _NO), (_q(t.LABEL), "nm", _L, _NO), (_q(_OWN + "verdict"), "verdict", _L, _NO),
    (_q(_OWN + "sourceDoc"), "CASE WHEN k % 8 = 0 THEN 'doc \"a\"' END", _L, _NO), (_q(_OWN + "confidence"), "CASE k % 9 WHEN 0 THEN '1.5' WHEN 1 THEN NULL WHEN 2 THEN '1' ELSE '0.5' END", _L, f"CASE WHEN k % 9 = 2 THEN {_INT} ELSE {_DEC} END"), (_q(t.COMMENT), "CASE WHEN k % 4 = 1 THEN 'n ' || k END", _L, _NO),
    (f"'{t.SKOS}' || m", f"CASE WHEN m <> 'odd' THEN '{_KREF}nation' || c_nationkey END", _I, _NO), (_q(t.SKOS + "relatedMatch"), f"CASE WHEN k % 12 = 0 THEN '{_KREF}R' || (k % 5) END", _I, _NO),
]))
def _node_triples(spark: SparkSession, d: str) -> DataFrame:
    return generate.node_triples(generate.node_rows(node_sheet(spark, d), "building"), NAMES)


def _things(spark: SparkSession) -> DataFrame:
    """Five named classes."""
    return generate.known_names(spark.range(5).select(F.concat(F.lit("Thing "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("Thing"), F.col("id").cast("string")).alias("iri"), (F.col("id") + 2).alias("row")))


def attribute_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a capture sheet of data properties."""
    part, k, z = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey"), F.col("p_size")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    return generate.sheet(part.select(
        k.alias("row"), F.when(k % 10 < 9, "PP").otherwise("other").alias("Layer"), text("Thing ", z % 7).alias("Data object"), text("attr ", k).alias("Attribute"), F.when(k % 2 == 0, text("a", z % 5)).alias("IRI local name"), F.when(z % 3 == 0, "Decimal").when(z % 3 == 1, "DateTime").otherwise("?").alias("Datatype"),
        F.when(k % 3 == 1, "Enum").alias("Value kind"), F.when(k % 3 == 0, "thing 2").when(k % 3 == 1, "unit").alias("Enum/Lookup set"), F.when(k % 2 == 0, "0..1").alias("Cardinality"), F.when(k % 5 == 0, "x").alias("Conditional on"), F.when(k % 4 == 0, "Ref attr").alias("Maps to neutral attribute"), F.when(k % 8 == 0, "closeMatch").alias("Match type"),
        F.when(k % 6 == 0, " 0.25 ").when(k % 6 == 1, "1").alias("Confidence"), F.when(k % 3 == 0, "n").alias("Notes"),
    ), generate.REQUIRED["attributes"])


_ATTRIBUTES = f"""WITH a AS (SELECT p_partkey AS k, p_size AS z, 'thing' || (p_size % 7) AS owner, CASE WHEN p_partkey % 2 = 0 THEN 'a' || (p_size % 5) ELSE 'attr' || p_partkey END AS base FROM part WHERE p_partkey % 10 < 9),
c AS (SELECT base FROM a GROUP BY base HAVING count(DISTINCT owner) > 1), r AS (SELECT *, '{_PP}' || CASE WHEN base IN (SELECT base FROM c) THEN owner || upper(base[1]) || base[2:] ELSE base END AS iri FROM a) """


@query("t12_attribute_triples", _ATTRIBUTES + _sql_facts("r", "attributes", "iri", [
    (_q(t.TYPE), f"CASE WHEN k % 3 = 0 THEN '{t.OBJECT_PROPERTY}' ELSE '{t.DATATYPE_PROPERTY}' END", _I, _NO), (_q(t.LABEL), "'attr ' || k", _L, _NO), (_q(t.DOMAIN), f"'{_PP}Thing' || (z % 7)", _I, _NO),
    (_q(t.RANGE), f"CASE k % 3 WHEN 0 THEN '{_PP}Thing2' WHEN 1 THEN '{_PP}Unit' ELSE '{t.XSD}' || CASE z % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'dateTime' ELSE 'string' END END", _I, _NO),
    (_q(_PP + "verdict"), "CASE WHEN k % 8 = 0 THEN 'covered' WHEN k % 4 <> 0 THEN 'vendor-extension' END", _L, _NO), (_q(_PP + "confidence"), "CASE k % 6 WHEN 0 THEN '0.25' WHEN 1 THEN '1' END", _L, f"CASE WHEN k % 6 = 0 THEN {_DEC} ELSE {_INT} END"),
    (_q(t.COMMENT), "nullif(concat_ws('; ', CASE WHEN k % 2 = 0 THEN 'cardinality 0..1' END, CASE WHEN k % 5 = 0 THEN 'conditional on x' END, CASE WHEN k % 3 = 0 THEN 'n' END), '')", _L, _NO), (_q(t.SKOS + "closeMatch"), f"CASE WHEN k % 8 = 0 THEN '{_KREF}refAttr' END", _I, _NO),
]))
def _attribute_triples(spark: SparkSession, d: str) -> DataFrame:
    return generate.attribute_triples(generate.attribute_rows(attribute_sheet(spark, d), "pp", _things(spark)), PP)


@query("t13_object_property_triples", f"WITH r AS (SELECT s_suppkey AS k, '{_PP}s' || s_suppkey AS iri FROM supplier) " + _sql_facts("r", "object properties", "iri", [
    (_q(t.TYPE), _q(t.OBJECT_PROPERTY), _I, _NO), (_q(t.LABEL), "'s ' || k", _L, _NO), (_q(t.DOMAIN), f"'{_PP}Thing' || (k % 6)", _I, _NO), (_q(t.RANGE), f"'{_PP}' || ['Thing1', 'Thing2', 'UnresolvedReference', 'UnresolvedReference', 'NewThing'][k % 5 + 1]", _I, _NO),
    (_q(t.COMMENT), "CASE WHEN k % 2 = 0 THEN 'cardinality 1' END", _L, _NO), (_q(_PP + "verdict"), "CASE WHEN k % 3 = 0 THEN 'partial' ELSE 'vendor-extension' END", _L, _NO), (f"'{t.SKOS}broadMatch'", f"CASE WHEN k % 3 = 0 THEN '{_KREF}x' END", _I, _NO),
]))
def _object_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = k.cast("string")
    range_ = F.get(F.array(*map(F.lit, ("Thing 1", "Elsewhere | Thing 2 / x", "Integer (count)", "needs verification (Thing 1)", "new thing (self)"))), (k % 5).cast("int"))
    rows = generate.sheet(spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("row"), F.concat(F.lit("Thing "), (k % 6).cast("string"), F.lit(" (see map)")).alias("Domain"), F.concat(F.lit("s "), text).alias("Property"), F.concat(F.lit("pp:s"), text).alias("IRI local name"), range_.alias("Range"), F.when(k % 2 == 0, "1").alias("Cardinality"), F.when(k % 3 == 0, "ref:x").alias("Maps to neutral"), F.when(k % 3 == 0, "Broad Match").alias("Match type")), generate.REQUIRED["object properties"])
    return generate.object_property_triples(generate.object_property_rows(rows, "pp", _things(spark)), PP)


@query("t14_operation_triples", f"WITH r AS (SELECT n_nationkey AS k, '{_PP}' || CASE WHEN n_nationkey % 2 = 0 THEN 'DoIt' || n_nationkey ELSE n_name END AS iri, n_name FROM nation) " + _sql_facts("r", "operations", "iri", [
    (_q(t.TYPE), _q(_PP + "PortalOperation"), _I, _NO), (_q(t.LABEL), "n_name", _L, _NO), (_q(_PP + "operatesOn"), f"CASE WHEN k % 3 < 2 THEN '{_PP}Thing' || (k % 3) END", _I, _NO), (_q(_PP + "operationKind"), "'read'", _L, _NO), (_q(_PP + "verdict"), "CASE WHEN k % 2 = 0 THEN 'covered' END", _L, _NO), (_q(_PP + "sourceDoc"), "'d' || k", _L, _NO), (_q(t.COMMENT), "CASE WHEN k % 4 = 0 THEN 'a  b' END", _L, _NO),
]))
def _operations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = spark.read.parquet(f"{d}/nation.parquet").select(k.alias("row"), F.col("n_name").alias("Label"), F.when(k % 2 == 0, F.concat(F.lit("http://x#doIt"), k.cast("string"))).alias("Operation IRI"), F.lit("read").alias("Kind"), F.when(k % 3 < 2, F.concat(F.lit("Thing "), (k % 3).cast("string"))).alias("operatesOn (pp:)"), F.when(k % 2 == 0, "covered").alias("VERDICT"), F.concat(F.lit("d"), k.cast("string")).alias("Source doc"), F.when(k % 4 == 0, "a\r\nb").alias("Notes"))
    return generate.operation_triples(generate.operation_rows(generate.sheet(rows, ["Label"]), _things(spark)), PP)


@query("t15_promotion_triples", f"WITH r AS (SELECT r_regionkey AS k, '{_PP}' || CASE WHEN r_regionkey % 2 = 0 THEN 'Thing' || r_regionkey ELSE 'RefThing' || r_regionkey END AS iri FROM region) " + _sql_facts("r", "promotions", "iri", [
    (_q(_PP + "confirmsRefConcept"), f"'{_KREF}refThing' || k", _I, _NO), (_q(_PP + "promotionEvidence"), "CASE WHEN k % 2 = 0 THEN 'see pp:thing' || k || '.Level (x)' ELSE 'prose' END", _L, _NO), (_q(_PP + "promotionNote"), "CASE WHEN k < 3 THEN 'why' END", _L, _NO),
]))
def _promotions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    rows = spark.read.parquet(f"{d}/region.parquet").select(F.when(k % 2 == 0, F.concat(F.lit("see pp:thing"), k.cast("string"), F.lit(".Level (x)"))).otherwise("prose").alias("Vendor evidence"), F.concat(F.lit("Ref thing "), k.cast("string")).alias("Ref concept"), F.when(k < 3, "why").alias("Rationale"))
    return generate.promotion_triples(generate.sheet(rows), PP)


def context_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Orders as context tables, their lines as fields."""
    o, line = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    n, key = F.col("l_linenumber"), F.col("o_orderkey")
    rows = line.join(o, F.col("l_orderkey") == key)
    return generate.sheet(rows.select(
        (key * 1_000_000 + n * 100_000 + F.col("l_partkey") % 100_000).alias("row"), F.lit("pp").alias("Layer"), F.concat(F.lit("Table "), key.cast("string")).alias("Table name"), F.when(n % 5 != 0, F.concat(F.lit("f "), n.cast("string"))).alias("Field"), F.col("o_orderpriority").alias("Table kind"),
        F.when(key % 2 == 0, "Thing 3").alias("Resolves (target)"), F.when(n % 2 == 0, "YES").alias("Is key"), F.lit("no").alias("Is mandatory"), F.when(n % 3 == 0, "c").alias("Field comment"),
    ), generate.REQUIRED["context tables"])


_CONTEXTS = f"""WITH r AS (SELECT o_orderkey AS k, l_linenumber AS n, o_orderpriority AS kind, '{_PP}Table' || o_orderkey AS iri, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
h AS (SELECT * FROM r WHERE place = 1), f AS (SELECT * FROM r WHERE n % 5 <> 0) """


@query("t16_context_triples", _CONTEXTS + _sql_facts("h", "context tables", "iri", [
    (_q(t.TYPE), _q(_PP + "ContextResolver"), _I, _NO), (_q(t.LABEL), "'Table ' || k", _L, _NO), (_q(_PP + "resolvesTarget"), f"CASE WHEN k % 2 = 0 THEN '{_PP}Thing3' END", _I, _NO), (_q(_PP + "tableKind"), "kind", _L, _NO),
]) + " UNION ALL " + _sql_facts("f", "context tables", "iri || '_field' || place", [
    (_q(t.TYPE), _q(_PP + "ContextField"), _I, _NO), (_q(t.LABEL), "'f ' || n", _L, _NO), (_q(_PP + "ofTable"), "iri", _I, _NO), (_q(_PP + "isKey"), "CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END", _L, _BOOL), (_q(_PP + "isMandatory"), "'false'", _L, _BOOL), (_q(_PP + "fieldComment"), "CASE WHEN n % 3 = 0 THEN 'c' END", _L, _NO),
]))
def _contexts(spark: SparkSession, d: str) -> DataFrame:
    return generate.context_triples(generate.context_rows(context_sheet(spark, d), "pp", _things(spark)), PP)


@query("t10_set_triples", f"""WITH v AS (SELECT p_brand AS name, '{_PP}' || string_split(p_brand, '#')[2] AS iri, p_brand <> 'Brand#11' AS closed, p_type AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n, '_:' || string_split(p_brand, '#')[2] AS node FROM (SELECT DISTINCT p_brand, p_type FROM part)),
h AS (SELECT * FROM v WHERE place = 0), shut AS (SELECT * FROM h WHERE closed), open AS (SELECT * FROM h WHERE NOT closed), listed AS (SELECT * FROM v WHERE closed), member AS (SELECT * FROM v WHERE NOT closed) """ + " UNION ALL ".join([
    _sql_facts("shut", "enums", "iri", [(_q(t.TYPE), _q(t.RDFS + "Datatype"), _I, _NO), (_q(t.OWL + "equivalentClass"), "node", "'bnode'", _NO)]), _sql_facts("shut", "enums", "node", [(_q(t.TYPE), _q(t.RDFS + "Datatype"), _I, _NO), (_q(t.OWL + "oneOf"), "node || '_0'", "'bnode'", _NO)]),
    _sql_facts("open", "enums", "iri", [(_q(t.TYPE), _q(t.SKOS + "ConceptScheme"), _I, _NO)]), _sql_facts("h", "enums", "iri", [(_q(t.LABEL), "name", _L, _NO), (_q(t.COMMENT), "'note'", _L, _NO)]),
    _sql_facts("listed", "enums", "node || '_' || place", [(_q(t.RDF + "first"), "value", _L, _NO), (_q(t.RDF + "rest"), f"CASE WHEN place = n - 1 THEN '{t.RDF}nil' ELSE node || '_' || (place + 1) END", "CASE WHEN place = n - 1 THEN 'iri' ELSE 'bnode' END", _NO)]),
    _sql_facts("member", "enums", "iri || '_' || value", [(_q(t.TYPE), _q(t.SKOS + "Concept"), _I, _NO), (_q(t.SKOS + "inScheme"), "iri", _I, _NO), (_q(t.SKOS + "prefLabel"), "value", _L, _NO)]),
]))
def _set_triples(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), " ; ").alias("v"))
    sheet = rows.select(F.hash("p_brand").alias("row"), F.col("p_brand").alias("Set name"), F.when(F.col("p_brand") == "Brand#11", "Lookup").otherwise("Enum").alias("Kind"), F.when(F.col("p_brand") == "Brand#11", F.concat("v", F.lit(" | extensible"))).otherwise(F.col("v")).alias("Allowed values"), F.lit("x").alias("Layer"), F.lit("note").alias("Notes"))
    return generate.set_triples(generate.sheet(sheet, generate.REQUIRED["enums"]), PP)


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("owner"), F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("local"))


@query("t11_collisions", "WITH a AS (SELECT p_partkey, p_brand AS owner, 'a' || p_size AS local FROM part), m AS (SELECT local FROM a GROUP BY 1 HAVING count(DISTINCT owner) > 1) SELECT p_partkey, CASE WHEN local IN (SELECT local FROM m) THEN string_split(owner, '#')[2] || upper(local[1]) || local[2:] ELSE local END AS name FROM a")
def _collisions(spark: SparkSession, d: str) -> DataFrame:
    return generate.qualified_names(_attributes(spark, d), "owner", "local").select("p_partkey", "name")


@query("t18_duplicates", "SELECT 'a' || p_size AS local, count(*) AS n, CASE WHEN bool_and(p_partkey % 2 = 0) THEN 'warning' ELSE 'error' END AS severity FROM part GROUP BY 1 HAVING count(*) > 1")
def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return generate.duplicate_definitions(_attributes(spark, d).select("local", (F.col("p_partkey") % 2 == 0).alias("is_class")))


@query("t19_meta_clashes", "SELECT DISTINCT ['DataObject', 'verdict', 'keyField'][p_partkey % 3 + 1] AS local FROM part WHERE p_partkey % 50 = 0")
def _meta_clashes(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose names are those of the meta-schema here and there."""
    k = F.col("p_partkey")
    own = F.get(F.array(*map(F.lit, ("DataObject", "verdict", "keyField"))), (k % 3).cast("int"))
    return generate.meta_clashes(spark.read.parquet(f"{d}/part.parquet").select(F.when(k % 50 == 0, own).otherwise(F.concat(F.lit("a"), k.cast("string"))).alias("local")))


@query("t9_resolve_classes", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'N' || s_nationkey WHEN 1 THEN 'N' || s_nationkey WHEN 2 THEN 'N' || s_nationkey WHEN 3 THEN 'UnresolvedReference' WHEN 4 THEN 'UnresolvedReference' ELSE 'NewThing' || s_suppkey END AS iri, ['exact', 'bare', 'alternative', 'datatype', 'unverified', 'minted'][s_suppkey % 6 + 1] AS how FROM supplier""")
def _resolve(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet")
    supplier = spark.read.parquet(f"{d}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 6
    cell = F.when(k == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(k == 1, F.concat("n_name", F.lit(" (see map)"))).when(k == 2, F.concat(F.lit("Elsewhere OR "), F.col("n_name"), F.lit(" / x"))).when(k == 3, "integer (of it)").when(k == 4, "Needs verification: x").otherwise(F.concat(F.lit("new thing"), F.col("s_suppkey").cast("string")))
    known = generate.known_names(nation.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iri"), F.col("n_nationkey").alias("row")))
    return generate.resolve_classes(supplier.select("s_suppkey", cell.alias("cell")), known).select("s_suppkey", "iri", "how")


@query("t17_precedence", """WITH k AS (SELECT 'T' || o_custkey AS tbl, o_orderkey AS row, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END ASC NULLS LAST, o_orderkey)::INTEGER AS tier FROM orders),
b AS (SELECT tbl, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT tbl, min(row) AS first, count(*) AS n FROM k GROUP BY tbl))
SELECT tbl AS "table", tier, before + tier AS number, "at"::INTEGER AS "at", key, field_place::INTEGER AS field_place FROM (SELECT tbl, tier, 0 AS "at", 'Status' AS key, 2 AS field_place FROM k UNION ALL SELECT tbl, tier, 1, 'unknown', NULL FROM k) JOIN b USING (tbl)""")
def _precedence(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    table = F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("table name")
    rows = o.select(table, F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 7).cast("string")).otherwise("late").alias("order"), F.lit("Status; ;unknown").alias("key combination"))
    fields = o.select(table, F.explode(F.array(F.struct(F.lit(" status ").alias("field"), F.lit(1).alias("place")), F.struct(F.lit("STATUS").alias("field"), F.lit(2).alias("place")))).alias("x")).select("table name", "x.*").distinct()
    return generate.precedence(rows, fields).select("table", "tier", "number", "at", "key", "field_place")


@query("t17_precedence_triples", f"""WITH r AS (SELECT o_orderkey AS k, '{_PP}T' || o_custkey AS tbl, '{_PP}T' || o_custkey || '_precedence' || o_orderkey AS iri FROM orders) """ + _sql_facts("r", "context precedence", "iri", [
    (_q(t.TYPE), _q(_PP + "PrecedenceTier"), _I, _NO), (_q(_PP + "ofTable"), "tbl", _I, _NO), (_q(_PP + "tierOrder"), "k::VARCHAR", _L, _INT), (_q(_PP + "keyField"), "tbl || '_field2'", _I, _NO),
]))
def _precedence_triples(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    table = F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table name")
    rows = o.select(table, F.col("o_orderkey").alias("row"), F.concat("o_orderkey", F.lit(".0")).alias("order"), F.lit("Status;none").alias("key combination"))
    rows = rows.withColumn("order", F.col("row").cast("string"))
    fields = o.select(table, F.lit("status").alias("field"), F.lit(2).alias("place")).distinct()
    return generate.precedence_triples(generate.precedence(rows, fields), PP)


on_graph("v8_section_counts", lambda g: generate.section_counts(g.triples()), f"""SELECT 'classes' AS section, 2 + (SELECT count(*) FROM obj) + (SELECT count(DISTINCT p_type) FROM part) + (SELECT count(*) FROM cust) AS n UNION ALL SELECT 'mappings', count(*) FROM edge UNION ALL SELECT 'verdicts', count(*) FROM cust
UNION ALL SELECT 'object properties', count(*) FROM link UNION ALL SELECT 'datatype properties', count(*) FROM nation UNION ALL SELECT 'operates on', count(*) FROM (SELECT DISTINCT cap, obj FROM linked)""")
on_graph("v7_validate_building", lambda g: generate.validate(g.layers["building"][1], f"{BASE}building#", REF), "SELECT NULL::VARCHAR AS \"check\", NULL::VARCHAR AS s, NULL::VARCHAR AS o WHERE false")


def faulty_layer(spark: SparkSession, d: str) -> DataFrame:
    """Nations as an overlay with faults of every kind."""
    k = F.col("n_nationkey")
    iri = F.concat(F.lit(_OWN), "n_name")
    fact = lambda s, p, o, kind="iri": F.struct(s.alias("s"), F.lit(p).alias("p"), (o if isinstance(o, Column) else F.lit(o)).alias("o"), F.lit(kind).alias("o_kind"))
    facts = [
        fact(iri, t.TYPE, F.when(k % 3 == 0, t.DATATYPE_PROPERTY).otherwise(t.CLASS)), fact(iri, t.RANGE, F.when(k % 3 == 0, F.concat(F.lit(_OWN), F.lit("NATION_"), ((k + 1) % 25).cast("string")))), fact(F.concat(F.lit(_KREF), F.lit("x"), k.cast("string")), t.LABEL, F.when(k % 7 == 0, F.col("n_name")), "lit"),
        fact(iri, t.SKOS + "closeMatch", F.when(k % 4 == 0, F.concat(F.lit(_KREF), F.lit("r"))).when(k % 4 == 1, iri)), fact(iri, f"{_OWN}verdict", F.when(k % 5 == 0, F.lit("http://x"))), fact(iri, t.DOMAIN, F.when(k % 6 == 1, F.concat(F.lit(_OWN), F.lit("Gone"), k.cast("string")))),
    ]
    return spark.read.parquet(f"{d}/nation.parquet").select(F.explode(F.array(*facts)).alias("x")).select("x.*").where("o is not null")


@query("v7_faulty_layer", f"""WITH n AS (SELECT n_nationkey AS k, '{_OWN}' || n_name AS iri, n_name FROM nation) SELECT 'mapping outside the reference' AS "check", iri AS s, iri AS o FROM n WHERE k % 4 = 1 UNION ALL SELECT 'reference as subject', '{_KREF}x' || k, n_name FROM n WHERE k % 7 = 0
UNION ALL SELECT 'datatype property with class range', iri, '{_OWN}NATION_' || ((k + 1) % 25) FROM n WHERE k % 3 = 0 UNION ALL SELECT 'annotation without quotes', iri, 'http://x' FROM n WHERE k % 5 = 0 UNION ALL SELECT 'dangling reference', iri, '{_OWN}Gone' || k FROM n WHERE k % 6 = 1 UNION ALL SELECT 'no data objects', NULL, NULL""")
def _faulty(spark: SparkSession, d: str) -> DataFrame:
    return generate.validate(faulty_layer(spark, d), _OWN, _KREF)


def concept_records(spark: SparkSession, d: str) -> DataFrame:
    """Nations as concept records."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    nothing = intake.RECORD
    sections = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(F.col("n_name").alias("heading"), F.lit(1).alias("level"), F.lit("text").alias("text"))))
    types = dict(x.split(" ", 1) for x in nothing.split(", ") if " " in x)
    return n.select(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).otherwise(F.concat(F.lit("New "), F.col("n_name"))).alias("concept_name"), F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("prose here").alias("prose"), F.coalesce(sections, F.array().cast(types["sections"])).alias("sections"), F.array(F.array(F.lit("one"), F.lit("two"))).alias("lists"), F.array().cast(types["tables"]).alias("tables"))


@query("m1_prompts", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '## ' || n_name || chr(10) || 'text' ELSE 'prose here' END || chr(10) || chr(10) || 'Constraints/List:' || chr(10) || '- one' || chr(10) || '- two' AS prompt FROM nation")
def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return intake.prompt_text(concept_records(spark, d)).select(F.split("source", "/")[1].cast("int").alias("n_nationkey"), "prompt")


@query("m1_customer_prompts", """WITH r AS (SELECT c_custkey AS k, c_mktsegment AS seg, repeat(c_name || ' ', (c_custkey % 1000)::INTEGER) AS prose FROM customer),
p AS (SELECT k, substr(CASE WHEN k % 3 = 0 THEN '## ' || seg || chr(10) || 'k' || k || chr(10) || chr(10) WHEN prose <> '' THEN prose || chr(10) || chr(10) ELSE '' END || 'Table headers: ' || seg || ' | x', 1, 12000) AS prompt FROM r) SELECT k AS c_custkey, length(prompt)::BIGINT AS n, md5(prompt) AS digest FROM p""")
def _customer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of short and of overlong records, with sections or prose, and tables without rows."""
    types, k = dict(x.split(" ", 1) for x in intake.RECORD.split(", ") if " " in x), F.col("c_custkey")
    told = F.array(F.struct(F.col("c_mktsegment").alias("heading"), F.lit(1).alias("level"), F.concat(F.lit("k"), k.cast("string")).alias("text")), F.struct(F.lit("empty").alias("heading"), F.lit(2).alias("level"), F.lit("").alias("text")))
    none = lambda c: F.array().cast(types[c])
    tables = F.array(F.struct(F.array(F.col("c_mktsegment"), F.lit("x")).alias("headers"), F.array().cast("array<array<string>>").alias("rows")))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k, F.expr("repeat(concat(c_name, ' '), cast(c_custkey % 1000 as int))").alias("prose"), F.when(k % 3 == 0, told).otherwise(none("sections")).alias("sections"), none("lists").alias("lists"), tables.alias("tables"))
    return intake.prompt_text(rows).select("c_custkey", F.length("prompt").cast("long").alias("n"), F.md5("prompt").alias("digest"))


@query("m3_mapping_problems", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no readable mapping' ELSE concat_ws('; ', CASE WHEN c_custkey % 3 = 0 THEN 'unknown match type odd' END, CASE WHEN c_custkey % 4 = 0 THEN 'unknown verdict ' || c_mktsegment END,
CASE WHEN c_custkey % 7 = 0 THEN 'confidence is not within 0 and 1' END, CASE WHEN c_custkey % 5 = 0 THEN 'unknown node type' END) END AS problems FROM customer""")
def _mapping_problems(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a mapper's answers, some in fences, some wrong in one way or more, some no JSON."""
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    concept = text('{"concept": {"name": "', F.col("c_name"), '", "type": "', F.when(k % 5 == 0, "Widget").otherwise("Data Object"), '", "match_type": "', F.when(k % 3 == 0, "odd").otherwise("closeMatch"), '", "verdict": "', F.when(k % 4 == 0, F.col("c_mktsegment")).otherwise("covered"), '"}, "attributes": [{"name": "a", "confidence": ', F.when(k % 7 == 0, "1.5").otherwise("0.5"), '}], "relationships": []}')
    answer = F.when(k % 11 == 0, "sorry").when(k % 2 == 0, text("```json\n", concept, "\n```")).otherwise(concept)
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", answer.alias("mapped_json"))
    return intake.checked(rows).select("c_custkey", F.array_join("problems", "; ").alias("problems"))


@query("m3_mapped_records", "SELECT 'n/' || n_nationkey AS source, CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE '' END AS maps_to, CASE WHEN n_nationkey % 5 <> 0 THEN 'covered' ELSE 'vendor-extension' END AS verdict, n_nationkey % 5 = 0 AS low, 0::INTEGER AS problems FROM nation")
def _mapped(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spark.read.parquet(f"{d}/nation.parquet").select(F.lower("n_name").alias("kind"), F.col("n_name").alias("name"))
    rows = intake.checked(intake.label_mapper(concept_records(spark, d), vocabulary))
    return rows.select("source", F.col("mapped.concept.maps_to_neutral").alias("maps_to"), F.col("mapped.concept.verdict").alias("verdict"), (F.col("mapped.concept.confidence") < intake.LOW_CONFIDENCE).alias("low"), F.size("problems").alias("problems"))
