"""Tracing one or two concepts through a layered graph, and the graph as nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators.compare import matches, objects_under, values
from terrace.plans.graph import GraphContext, checkpointed, closure, value_lists


def resolve_concept(ctx: GraphContext, phrase: str, prefer: str | None = None, most: int = 200) -> DataFrame:
    """Labelled terms that contain the phrase, best first: iri, label, score, prefix.

    An exact label of the preferred overlay comes before one of another overlay and one of the reference, then partial
    labels of the preferred overlay and of any; contexts never count as exact of an overlay, contexts and operations come last.
    """
    exact = t.stripped(F.lower("label")) == phrase.strip().lower()
    ns, iri = t.namespace_last(F.col("iri")), F.lower("iri")
    mine = ns == ctx.namespaces.get(prefer or "", "")
    context = iri.contains("context")
    plain = ~context & ~iri.contains("operation") & ~iri.contains("manage")
    score = F.when(exact & mine & ~context, 0).when(exact & (ns != ctx.ref) & ~context, 1).when(exact & (ns == ctx.ref), 2).when(plain & mine, 3).when(plain, 4).otherwise(6)
    found = values(ctx, t.LABEL, "iri", "label").where(F.lower("label").contains(phrase.replace('"', "").lower())).orderBy("iri", "label").limit(most)
    return found.select("iri", "label", score.alias("score"), t.layer_of(F.col("iri"), ctx.namespaces).alias("prefix")).orderBy("score", "iri", "label")


def concept_mappings(ctx: GraphContext, concept: str) -> DataFrame:
    """Mapping edges out of and into a concept."""
    edges = matches(ctx)
    out = edges.where(F.col("term") == concept).select(F.lit("out").alias("dir"), "match", F.col("obj").alias("other"))
    into = edges.where(F.col("obj") == concept).select(F.lit("in").alias("dir"), "match", F.col("term").alias("other"))
    return out.unionByName(into).join(values(ctx, t.LABEL, "other", "label"), "other", "left").select("dir", "match", "other", "label")


def with_unions(ctx: GraphContext) -> GraphContext:
    """The graph with a domain or range that is a union told as each of its members as well; without unions it stays as it is.

    A union's members are the values of the list behind owl:unionOf; of unions within unions the inner ones are told too.
    """
    triples = ctx.triples()
    lists = triples.where(F.col("p").isin(t.UNION, t.RDF + "first", t.RDF + "rest"))
    edges = value_lists(lists).join(lists.where(F.col("p") == t.UNION).select(F.col("s").alias("union"), F.col("o").alias("head")), "head").select(F.col("value").alias("child"), F.col("union").alias("parent"))
    edges = checkpointed(edges.distinct())
    below = closure(edges, edges.select(F.col("parent").alias("root")).distinct()).select(F.col("root").alias("o"), F.col("node").alias("member"))
    kinds = triples.select(F.col("s").alias("member"), F.col("s_kind").alias("kind")).distinct()
    members = below.join(kinds, "member", "left").select("o", "member", F.coalesce("kind", F.lit("iri")).alias("kind"))
    told = triples.where(F.col("p").isin(t.DOMAIN, t.RANGE)).join(members, "o").select("s", "s_kind", "p", F.col("member").alias("o"), F.col("kind").alias("o_kind"))
    return replace(ctx, merged=triples.unionByName(checkpointed(told.join(triples, told.columns, "left_anti").distinct())), _held={})


def _with_domain(ctx: GraphContext, kind: str) -> DataFrame:
    """prop, domain of the properties of a kind."""
    of_kind = ctx.triples().where((F.col("p") == t.TYPE) & (F.col("o") == kind)).select(F.col("s").alias("prop"))
    return values(ctx, t.DOMAIN, "prop", "domain").join(of_kind, "prop", "left_semi")


def concept_attributes(ctx: GraphContext, concept: str) -> DataFrame:
    own = _with_domain(ctx, t.DATATYPE_PROPERTY).where(F.col("domain") == concept)
    return own.join(values(ctx, t.LABEL, "prop", "label"), "prop", "left").join(values(ctx, t.RANGE, "prop", "range"), "prop", "left").select("prop", "label", "range")


def object_links(ctx: GraphContext) -> DataFrame:
    """prop, domain, range of object properties: the class graph's edges."""
    return _with_domain(ctx, t.OBJECT_PROPERTY).join(values(ctx, t.RANGE, "prop", "range"), "prop")


def links_out(ctx: GraphContext, concept: str) -> DataFrame:
    rows = object_links(ctx).where(F.col("domain") == concept).select("prop", F.col("range").alias("other"))
    return _labelled(ctx, rows)


def links_in(ctx: GraphContext, concept: str) -> DataFrame:
    rows = object_links(ctx).where(F.col("range") == concept).select("prop", F.col("domain").alias("other"))
    return _labelled(ctx, rows)


def _labelled(ctx: GraphContext, rows: DataFrame) -> DataFrame:
    rows = rows.join(values(ctx, t.LABEL, "prop", "label"), "prop", "left")
    return rows.join(values(ctx, t.LABEL, "other", "other_label"), "other", "left").select("prop", "label", "other", "other_label")


def direct_paths(ctx: GraphContext, a: str, b: str) -> DataFrame:
    links = object_links(ctx)
    there = links.where((F.col("domain") == a) & (F.col("range") == b)).select(F.lit("a->b").alias("dir"), "prop")
    back = links.where((F.col("domain") == b) & (F.col("range") == a)).select(F.lit("b->a").alias("dir"), "prop")
    return there.unionByName(back).join(values(ctx, t.LABEL, "prop", "label"), "prop", "left").select("dir", "prop", "label")


def two_hop_paths(ctx: GraphContext, a: str, b: str, most: int = 10) -> DataFrame:
    links = object_links(ctx)
    first = links.where(F.col("domain") == a).select(F.col("prop").alias("first"), F.col("range").alias("mid"))
    second = links.where(F.col("range") == b).select(F.col("prop").alias("second"), F.col("domain").alias("mid"))
    return first.join(second, "mid").select("first", "mid", "second").orderBy("first", "mid", "second").limit(most)


def find_paths(ctx: GraphContext, a: str, b: str) -> tuple[DataFrame, DataFrame | None]:
    """Direct paths; two-hop ones only where there are none."""
    direct = direct_paths(ctx, a, b)
    return direct, two_hop_paths(ctx, a, b) if direct.isEmpty() else None


def context_bridge(ctx: GraphContext, a: str, b: str, most: int = 40) -> DataFrame:
    """Classes with an object property to each of two concepts; context tables first."""
    links = object_links(ctx)
    left = links.where(F.col("range") == a).select(F.col("domain").alias("ctx"), F.col("prop").alias("pa"))
    right = links.where(F.col("range") == b).select(F.col("domain").alias("ctx"), F.col("prop").alias("pb"))
    rows = left.join(right, "ctx").where(~F.col("ctx").isin(a, b)).dropDuplicates(["ctx", "pa", "pb"])
    label = lambda c: values(ctx, t.LABEL, c, f"{c}_label").groupBy(c).agg(F.min(f"{c}_label").alias(f"{c}_label"))
    comment = values(ctx, t.COMMENT, "ctx", "comment").groupBy("ctx").agg(F.min("comment").alias("comment"))
    for more in (label("pa"), label("pb"), label("ctx"), comment):
        rows = rows.join(more, more.columns[0], "left")
    starts = lambda c: F.coalesce(F.lower(c).startswith("key"), F.lit(False))
    rows = rows.withColumn("pa_is_key", starts("pa_label")).withColumn("pb_is_key", starts("pb_label"))
    table = F.lower("ctx").contains("context") | F.col("pa_is_key") | F.col("pb_is_key")
    out = rows.select("ctx", F.col("ctx_label").alias("label"), "comment", "pa", "pa_label", "pa_is_key", "pb", "pb_label", "pb_is_key", table.alias("is_context_table"))
    return out.orderBy(F.desc("is_context_table"), "ctx", "pa", "pb").limit(most)


def contexts_keying_on(ctx: GraphContext, concept: str, most: int = 60) -> DataFrame:
    rows = object_links(ctx).where(F.col("range") == concept).select(F.col("domain").alias("ctx"), "prop").orderBy("ctx", "prop").limit(most)
    rows = rows.join(values(ctx, t.LABEL, "prop", "label"), "prop", "left").where(F.lower("ctx").contains("context") | F.lower("label").startswith("key"))
    return rows.join(values(ctx, t.LABEL, "ctx", "ctx_label"), "ctx", "left").select("ctx", "ctx_label", "prop", "label")


def trace_concept(ctx: GraphContext, concept: str) -> dict[str, DataFrame]:
    """All facts about a concept, a frame a kind."""
    return {"mappings": concept_mappings(ctx, concept), "attributes": concept_attributes(ctx, concept), "links_out": links_out(ctx, concept), "links_in": links_in(ctx, concept)}


# What separates two concepts in a question, in the order in which it is looked for, and what stands around a concept.
SEPARATORS = (" related to ", " connected to ", " linked to ", " and ", " vs ", " versus ")
LEADING_TWO = r"(?i)^(how is|how are|how does|what is|explain|show me|tell me about)\s+"
LEADING_ONE = r"(?i)^(how does|how is|what is|explain|show me|tell me about|describe)\s+"
TRAILING_ONE = r"(?i)\s+(work|function|behave)$"


def extract_concepts(question: Column) -> Column:
    """Up to two phrases of a question, by rule."""
    bare = F.rtrim(t.stripped(question), F.lit("?"))
    low = F.lower(bare)
    single = t.stripped(F.regexp_replace(t.stripped(F.regexp_replace(bare, LEADING_ONE, "")), TRAILING_ONE, ""))
    out = F.array(single)
    for sep in reversed(SEPARATORS):
        at = F.instr(low, sep)
        left = t.stripped(F.regexp_replace(F.substring(bare, F.lit(1), at - 1), LEADING_TWO, ""))
        right = t.stripped(F.substring(bare, at + len(sep), F.length(bare)))
        out = F.when(at > 0, F.array(left, right)).otherwise(out)
    return F.filter(out, lambda x: x != "")


def answer(ctx: GraphContext, question: str) -> dict:
    """Resolve a question's concepts and gather their facts; frames are lazy."""
    low = question.lower()
    prefer = next((p for p in ctx.layers if p != ctx.reference and p.lower() in low), next((p for p in ctx.layers if p != ctx.reference), None))
    phrases = ctx.spark.range(1).select(extract_concepts(F.lit(question)).alias("x")).first()["x"]
    found = [r["iri"] for x in phrases if (r := resolve_concept(ctx, x, prefer).first()) is not None]
    facts: dict = {"concepts": found, "traces": [trace_concept(ctx, c) for c in found]}
    if len(found) == 1:
        facts["contexts"] = contexts_keying_on(ctx, found[0])
    elif len(found) == 2:
        facts["bridge"] = context_bridge(ctx, *found)
        facts["direct"], facts["two_hop"] = find_paths(ctx, *found)
    return facts


def graph_layers(ctx: GraphContext) -> DataFrame:
    """Prefixes with a class, the reference first."""
    classes = ctx.triples().where((F.col("p") == t.TYPE) & (F.col("o") == t.CLASS) & (F.col("s_kind") == "iri"))
    rows = classes.select(t.layer_of(F.col("s"), ctx.namespaces).alias("layer")).distinct().where("layer <> 'unknown'")
    return rows.orderBy(F.col("layer") != ctx.reference, "layer")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).where(F.col("id").startswith("http")).distinct()


@dataclass(frozen=True)
class _View:
    """What a view of the graph is made of, section by section: classes, then the ends of the edges that bring them in."""

    classes: DataFrame  # id, type
    operates: DataFrame  # source, target
    mapped: DataFrame  # source, target, match
    known: DataFrame  # id: nodes before mappings
    nodes: DataFrame  # id: nodes with the ends of mappings


def _view(ctx: GraphContext, layer: str | None) -> _View:
    """layer: None for all, else classes of this layer alone; operations of this and the reference layer, and this layer's mappings,
    bring in both their ends."""
    within = lambda c, *more: t.layer_of(F.col(c), ctx.namespaces).isin(layer, *more) if layer else F.lit(True)
    named = F.col("id").startswith("http")
    typed = ctx.triples().where((F.col("p") == t.TYPE) & (F.col("o") == t.CLASS)).select(F.col("s").alias("id"), F.lit(2).alias("rank"), F.lit("Class").alias("type"))
    kinds = [objects_under(ctx, f"{ctx.ref}{k}").select(F.col("obj").alias("id"), F.lit(n).alias("rank"), F.lit(k).alias("type")) for n, k in enumerate(("DataObject", "Capability"))]
    classes = reduce(DataFrame.unionByName, [*kinds, typed]).where(named & within("id")).groupBy("id").agg(F.min_by("type", "rank").alias("type"))
    operates = ctx.triples().where(F.col("p").endswith("#operatesOn")).select(F.col("s").alias("source"), F.col("o").alias("target")).where(within("source", ctx.reference))
    mapped = matches(ctx, "source", "match", "target").where(within("source"))
    known = classes.select("id").union(_ends(operates)).distinct()
    return _View(classes, operates, mapped, known, known.union(_ends(mapped)).distinct())


def graph_nodes(ctx: GraphContext, layer: str | None = None, attributes: bool = False) -> DataFrame:
    """id, label, layer, type, kind, verdict of the classes of a view and of what its edges bring in, which has neither label nor
    verdict of its own; with attributes, of the view's datatype properties. Of types DataObject, Capability, Class the first holds."""
    view = _view(ctx, layer)
    labels = values(ctx, t.LABEL, "id", "label").groupBy("id").agg(F.max("label").alias("label"))
    judged = ctx.triples().where(F.col("p").endswith("#verdict")).groupBy(F.col("s").alias("id")).agg(F.max("o").alias("verdict"))
    own = view.classes.join(labels, "id", "left").join(judged, "id", "left")
    nodes = view.nodes.join(own, "id", "left").withColumn("type", F.coalesce("type", F.lit("Class"))).withColumn("kind", F.lit(None).cast("string"))
    if attributes:
        more = _with_domain(ctx, t.DATATYPE_PROPERTY).where(F.col("prop").startswith("http")).join(view.nodes.withColumnRenamed("id", "domain"), "domain", "left_semi").select(F.col("prop").alias("id")).distinct().join(labels.withColumnRenamed("label", "named"), "id", "left")
        nodes = nodes.withColumn("here", F.lit(True)).join(more.withColumn("attribute", F.lit(True)), "id", "full")
        fresh = F.col("here").isNull()
        nodes = nodes.withColumn("type", F.when(fresh, "DatatypeProperty").otherwise(F.col("type"))).withColumn("kind", F.when(fresh, "datatype")).withColumn("label", F.coalesce("named", "label"))
    return nodes.select("id", F.coalesce("label", t.graph_local(F.col("id"))).alias("label"), t.layer_of(F.col("id"), ctx.namespaces).alias("layer"), "type", "kind", "verdict")


def graph_edges(ctx: GraphContext, layer: str | None = None, attributes: bool = False) -> DataFrame:
    """source, target, label, match_type, directed: operations, object properties between nodes, mappings, attributes; of edges with
    equal ends and match type or label the first section's."""
    view = _view(ctx, layer)
    none = F.lit(None).cast("string").alias("match_type")
    ends = lambda nodes, c: nodes.select(F.col("id").alias(c))
    links = object_links(ctx).join(ends(view.known, "domain"), "domain", "left_semi").join(ends(view.known, "range"), "range", "left_semi")
    name = t.local_name(F.col("match"))
    sections = [
        view.operates.select("source", "target", F.lit("operatesOn").alias("label"), none),
        links.join(values(ctx, t.LABEL, "prop", "name"), "prop", "left").select(F.col("domain").alias("source"), F.col("range").alias("target"), F.coalesce("name", t.graph_local(F.col("prop"))).alias("label"), none),
        view.mapped.select("source", "target", name.alias("label"), name.alias("match_type")),
    ]
    if attributes:
        own = _with_domain(ctx, t.DATATYPE_PROPERTY).join(ends(view.nodes, "domain"), "domain", "left_semi").join(values(ctx, t.RANGE, "prop", "range"), "prop", "left")
        sections.append(own.select(F.col("domain").alias("source"), F.col("prop").alias("target"), F.coalesce(t.graph_local(F.col("range")), F.lit("literal")).alias("label"), none))
    rows = reduce(DataFrame.unionByName, [s.withColumn("section", F.lit(k)) for k, s in enumerate(sections)])
    first = F.row_number().over(Window.partitionBy("source", "target", F.coalesce("match_type", "label")).orderBy("section", "label"))
    return rows.withColumn("place", first).where("place = 1").select("source", "target", "label", "match_type", F.lit(True).alias("directed"))


def without_operations(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hide operations and the edges that touch them."""
    kept = nodes.where("type <> 'Operation'")
    for end in ("source", "target"):
        edges = edges.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return kept, edges


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """A node and those one edge away."""
    near = edges.where((F.col("source") == node) | (F.col("target") == node)).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(near, "id", "left_semi")


def colour_index(ctx: GraphContext, layer: Column) -> Column:
    """Overlays take four colours in turn; the reference has none."""
    order = [p for p in ctx.layers if p != ctx.reference]
    return F.when(layer.isin(order), (F.array_position(F.array(*map(F.lit, order)), layer) - 1) % 4).cast("int") if order else F.lit(None).cast("int")
