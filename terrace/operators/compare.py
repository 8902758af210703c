"""The vetted comparison queries over a layered graph (coverage, gaps, convergence, differences), and their runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.plans.graph import GraphContext, closure, discover_namespaces, vendors


def objects_under(ctx: GraphContext, root: str) -> DataFrame:
    """obj of every class that subClassOf+ ties to the root, in any layer."""
    key = f"under {root}"
    if key not in ctx._held:
        edges = ctx.triples().where(F.col("p") == t.SUBCLASS).select(F.col("s").alias("child"), F.col("o").alias("parent"))
        ctx._held[key] = closure(edges, ctx.spark.createDataFrame([(root,)], "root string")).select(F.col("node").alias("obj"))
    return ctx._held[key]


def values(ctx: GraphContext, p: str, s: str, o: str) -> DataFrame:
    """Subjects and objects of one predicate under new names."""
    return ctx.triples().where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def matches(ctx: GraphContext, term: str = "term", match: str = "match", obj: str = "obj") -> DataFrame:
    """Mapping edges whose subject has a name of its own."""
    return ctx.triples().where(t.is_match(F.col("p")) & (F.col("s_kind") == "iri")).select(F.col("s").alias(term), F.col("p").alias(match), F.col("o").alias(obj))


def verdicts(ctx: GraphContext, term: str = "term") -> DataFrame:
    return ctx.triples().where(F.col("p").endswith("verdict")).select(F.col("s").alias(term), F.col("o").alias("verdict"))


def data_objects(ctx: GraphContext) -> DataFrame:
    """obj and label of every data object."""
    return objects_under(ctx, f"{ctx.ref}DataObject").join(values(ctx, t.LABEL, "obj", "label"), "obj")


def coverage_by_object(ctx: GraphContext) -> DataFrame:
    mapped = matches(ctx).join(verdicts(ctx), "term", "left")
    rows = data_objects(ctx).join(mapped, "obj", "left")
    return rows.select("obj", "label", t.namespace(F.col("term")).alias("vendor"), "term", "match", "verdict").orderBy("label", "vendor")


def coverage_by_capability(ctx: GraphContext) -> DataFrame:
    capability = objects_under(ctx, f"{ctx.ref}Capability").withColumnRenamed("obj", "capability").join(values(ctx, t.LABEL, "capability", "capability_label"), "capability")
    rows = capability.join(values(ctx, f"{ctx.ref}operatesOn", "capability", "obj"), "capability").join(values(ctx, t.LABEL, "obj", "label"), "obj")
    mapped = matches(ctx).join(verdicts(ctx), "term", "left")
    return rows.join(mapped, "obj", "left").select("capability", "capability_label", "obj", "label", "term", "match", "verdict").orderBy("capability_label", "label", "term")


def gap_by_vendor(ctx: GraphContext, vendor: str) -> DataFrame:
    """Objects that no term of the vendor maps to, with what other vendors have."""
    edges = matches(ctx)
    own = edges.where(F.col("term").startswith(vendor)).select("obj")
    rows = data_objects(ctx).join(own, "obj", "left_anti").join(values(ctx, t.COMMENT, "obj", "note"), "obj", "left")
    other = edges.where(~F.col("term").startswith(vendor)).select("obj", F.concat(t.short_prefix(F.col("term"), ctx.short_before), F.lit(":"), t.local_name(F.col("term")), F.lit(" ("), t.local_name(F.col("match")), F.lit(")")).alias("other"))
    grouped = rows.join(other, "obj", "left").groupBy("obj", "label").agg(F.min("note").alias("note"), F.array_join(F.sort_array(F.collect_list("other")), " | ").alias("other_vendors"))
    return grouped.orderBy("label")


def convergence(ctx: GraphContext) -> DataFrame:
    """Objects that every vendor maps closely."""
    total = vendors(ctx.triples()).agg(F.count(F.lit(1)).alias("vendors"))
    close = matches(ctx).where(F.col("match") == t.SKOS + "closeMatch")
    close = close.select("obj", t.namespace(F.col("term")).alias("vendor"), F.concat(t.short_prefix(F.col("term"), ctx.short_before), F.lit(":"), t.local_name(F.col("term"))).alias("shown"))
    found = data_objects(ctx).join(close, "obj").groupBy("obj", "label").agg(F.countDistinct("vendor").alias("n"), F.array_join(F.sort_array(F.collect_list("shown")), " | ").alias("terms"))
    # The total is one row.
    return found.join(F.broadcast(total), F.col("n") == F.col("vendors")).select("obj", "label", F.col("n").alias("vendors"), "terms").orderBy("label")


def migration_diff(ctx: GraphContext, source: str, target: str) -> DataFrame:
    edges = matches(ctx)
    have = edges.where(F.col("term").startswith(source))
    lack = edges.where(F.col("term").startswith(target)).select("obj")
    return data_objects(ctx).join(have, "obj").join(lack, "obj", "left_anti").select("obj", "label", "term", "match").orderBy("label", "term")


def extension_surface(ctx: GraphContext, vendor: str) -> DataFrame:
    """Labelled direct data objects of overlays judged extensions that map nowhere into the reference; '' means all vendors."""
    direct = values(ctx, t.SUBCLASS, "term", "parent").where(F.col("parent").endswith("#DataObject") & F.col("term").startswith(vendor)).select("term", "parent")
    judged = ctx.triples().where(F.col("p").endswith("verdict") & (F.col("o") == "vendor-extension")).select(F.col("s").alias("term"))
    inside = matches(ctx).where(F.col("obj").startswith(ctx.ref)).select("term")
    rows = direct.join(judged, "term").join(inside, "term", "left_anti").join(values(ctx, t.LABEL, "term", "label"), "term")
    return rows.select(t.namespace(F.col("term")).alias("vendor"), "term", "label").orderBy("vendor", "label")


def drill_down(ctx: GraphContext, concept: str) -> DataFrame:
    docs = ctx.triples().where(F.col("p").endswith("#sourceDoc")).select(F.col("s").alias("term"), F.col("o").alias("source_doc"))
    rows = matches(ctx).where(F.col("obj") == concept)
    rows = rows.join(values(ctx, t.LABEL, "term", "label"), "term", "left").join(verdicts(ctx), "term", "left").join(docs, "term", "left")
    return rows.select(t.namespace(F.col("term")).alias("vendor"), "term", "match", "label", "verdict", "source_doc").orderBy("vendor", "term")


def completeness_guard(ctx: GraphContext) -> DataFrame:
    """How many objects each vendor maps at all, to qualify gaps."""
    rows = objects_under(ctx, f"{ctx.ref}DataObject").join(matches(ctx), "obj").select(t.namespace(F.col("term")).alias("vendor"), "obj")
    return rows.groupBy("vendor").agg(F.countDistinct("obj").alias("mapped_objects")).orderBy("vendor")


def vendor_list(ctx: GraphContext) -> DataFrame:
    found = vendors(ctx.triples())
    return found.select("ns", t.layer_of(F.col("ns"), ctx.namespaces).alias("prefix")).orderBy("ns")


def namespace_list(ctx: GraphContext) -> DataFrame:
    return discover_namespaces(ctx.quads())


def status(ctx: GraphContext) -> DataFrame:
    """Triples of each layer and how many queries and vendors there are."""
    return ctx.quads().select("s", "p", "o", "o_kind", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("triples")).withColumn("queries", F.lit(len(CATALOG)).cast("long")).orderBy("g")


def coverage_buckets(ctx: GraphContext) -> DataFrame:
    """Per object whether all, some or no vendors map it."""
    total = vendors(ctx.triples()).agg(F.count(F.lit(1)).alias("vendors"))
    own = data_objects(ctx).join(matches(ctx), "obj", "left").groupBy("obj", "label").agg(F.sort_array(F.collect_set(t.short_prefix(F.col("term"), ctx.short_before))).alias("by"))
    n = F.size("by")
    bucket = F.when(n == 0, "none").when(n >= F.col("vendors"), "all").otherwise("some")
    return own.crossJoin(F.broadcast(total)).select("obj", "label", F.array_join("by", ",").alias("covered_by"), bucket.alias("bucket"))


def vocabulary(ctx: GraphContext) -> DataFrame:
    """Names that a mapper may use: labels, or local names, under the three roots."""
    out = None
    for kind in ("DataObject", "Operation", "Capability"):
        own = objects_under(ctx, f"{ctx.ref}{kind}").join(values(ctx, t.LABEL, "obj", "label"), "obj", "left")
        own = own.select(F.lit(kind).alias("kind"), F.coalesce("label", t.local_name(F.col("obj"))).alias("name")).distinct()
        out = own if out is None else out.unionByName(own)
    return out.orderBy("kind", "name")


@dataclass(frozen=True)
class QuerySpec:
    name: str
    params: tuple[str, ...]
    build: Callable[..., DataFrame]
    about: str


CATALOG = {
    s.name: s
    for s in (
        QuerySpec("coverage_by_object", (), coverage_by_object, "Which vendor terms map to each reference object?"),
        QuerySpec("coverage_by_capability", (), coverage_by_capability, "What do capabilities operate on, and who maps that?"),
        QuerySpec("gap_by_vendor", ("VENDOR",), gap_by_vendor, "What does a vendor not map?"),
        QuerySpec("convergence", (), convergence, "What do all vendors map closely?"),
        QuerySpec("migration_diff", ("FROM", "TO"), migration_diff, "What does one vendor map that another doesn't?"),
        QuerySpec("extension_surface", ("VENDOR",), extension_surface, "Which terms are a vendor's own?"),
        QuerySpec("drill_down", ("REF_CONCEPT",), drill_down, "All mappings of one concept."),
        QuerySpec("completeness_guard", (), completeness_guard, "How many objects does each vendor map?"),
    )
}


class Engine:
    """Runs the catalog's queries by name."""

    def __init__(self, ctx: GraphContext):
        self.ctx = ctx

    def list_queries(self) -> list[dict]:
        return [{"name": s.name, "params": sorted(s.params), "about": s.about} for _, s in sorted(CATALOG.items())]

    def run(self, name: str, params: dict[str, str] | None = None) -> DataFrame:
        """KeyError for an unknown name, ValueError for missing parameters; others are ignored."""
        spec = CATALOG[name]
        given = params or {}
        if missing := [p for p in spec.params if p not in given]:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        return spec.build(self.ctx, *(given[p] for p in spec.params))

    def vendor_ns(self, prefix: str) -> str:
        return self.ctx.namespaces[prefix]

    def to_rows(self, name: str, params: dict[str, str] | None = None, limit: int = 200) -> list[dict[str, str]]:
        """At most `limit` rows for display: all as text, IRIs in short form, nulls left out."""
        df = self.run(name, params)
        shown = df.select(*(t.pretty(F.col(c).cast("string"), self.ctx.namespaces).alias(c) for c in df.columns)).limit(limit)
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in shown.collect()]
