"""A layered graph out of the star schema: a direct mapping of rows to triples.

Regions, nations and suppliers are reference objects, part types capabilities, each market segment an
overlay whose customers map to reference objects.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.plans.graph import GraphContext, shared_folder
from terrace.plans.store import GraphStore

BASE = "https://kg.example.org/ns-"
SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")
REF = f"{BASE}ref#"


def _iri(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _rows(df: DataFrame, s: Column, p: Column | str, o: Column | str, kind: str = "iri") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(s.alias("s"), F.lit("iri").alias("s_kind"), lit(p).alias("p"), lit(o).alias("o"), F.lit(kind).alias("o_kind"))


def _quads(frames: list[DataFrame]) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return reduce(DataFrame.unionByName, frames).withColumn("o_dt", nothing).withColumn("o_lang", nothing)


def _class(df: DataFrame, s: Column, parent: Column | str, label: Column | str) -> list[DataFrame]:
    return [_rows(df, s, t.TYPE, t.CLASS), _rows(df, s, t.SUBCLASS, parent), _rows(df, s, t.LABEL, label, "lit")]


def _property(df: DataFrame, s: Column, kind: str, domain: Column, range_: Column | str, label: Column | str) -> list[DataFrame]:
    return [_rows(df, s, t.TYPE, kind), _rows(df, s, t.DOMAIN, domain), _rows(df, s, t.RANGE, range_), _rows(df, s, t.LABEL, label, "lit")]


def star_graph(spark: SparkSession, sf_dir: str) -> GraphContext:
    """The reference layer `ref` and one layer a market segment."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, supplier, part, customer, orders = map(table, ("region", "nation", "supplier", "part", "customer", "orders"))
    n = supplier.count()
    ref = lambda *parts: _iri(REF, *parts)
    one = spark.range(1)
    roots = [x for name, label in (("DataObject", "Data Object"), ("Capability", "Capability")) for x in (_rows(one, ref(name), t.TYPE, t.CLASS), _rows(one, ref(name), t.LABEL, label, "lit"))]
    types = part.select("p_type").distinct()
    cap = ref("Cap_", F.col("p_type"))
    object_of = ref("S", (F.col("p_partkey") % n).cast("string"))
    key = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("key "), F.col("p_name"))).otherwise(F.col("p_name"))
    reference = [
        *roots,
        *_class(region, ref("R", F.col("r_regionkey").cast("string")), f"{REF}DataObject", F.col("r_name")),
        *_class(nation, ref("N", F.col("n_nationkey").cast("string")), ref("R", F.col("n_regionkey").cast("string")), F.col("n_name")),
        *_class(supplier, ref("S", F.col("s_suppkey").cast("string")), ref("N", F.col("s_nationkey").cast("string")), F.col("s_name")),
        *_class(types, cap, f"{REF}Capability", F.col("p_type")),
        _rows(part, cap, f"{REF}operatesOn", object_of),
        *_property(part, ref("P", F.col("p_partkey").cast("string")), t.OBJECT_PROPERTY, cap, object_of, key),
        *_property(supplier, ref("locatedIn", F.col("s_suppkey").cast("string")), t.OBJECT_PROPERTY, ref("S", F.col("s_suppkey").cast("string")), ref("N", F.col("s_nationkey").cast("string")), "located in"),
        *_property(nation, ref("name", F.col("n_nationkey").cast("string")), t.DATATYPE_PROPERTY, ref("N", F.col("n_nationkey").cast("string")), t.XSD + "string", "name"),
    ]
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    mapped = F.col("c_custkey") % 10 < 7
    match = F.concat(F.lit(t.SKOS), F.get(F.array(*map(F.lit, t.MATCHES)), (F.col("c_custkey") % 4).cast("int")))
    target = F.when(F.col("c_custkey") % 3 == 0, ref("S", (F.col("c_custkey") % n).cast("string"))).otherwise(ref("N", F.col("c_nationkey").cast("string")))
    verdict = F.when(~mapped, "vendor-extension").when(F.col("c_custkey") % 4 == 0, "covered").otherwise("partial")
    ns = _iri(BASE, F.lower("c_mktsegment"), "#")
    term = F.concat(ns, F.lit("C"), F.col("c_custkey").cast("string"))
    overlays = [
        *_class(customer, term, F.concat(ns, F.lit("DataObject")), F.col("c_name")),
        _rows(customer, term, F.concat(ns, F.lit("verdict")), verdict, "lit"),
        _rows(customer.where(mapped), term, match, target),
        _rows(customer.join(first, customer.c_custkey == first.o_custkey), term, F.concat(ns, F.lit("sourceDoc")), F.concat(F.lit("order/"), F.col("first").cast("string")), "lit"),
    ]
    # A pattern's predicate is a constant of its branch, so that only the branches, and tables, that can have it are read.
    graph = F.concat(F.lit("urn:graph:"), F.regexp_extract("s", f"^{BASE}([^#]+)#", 1))
    whole = _quads([*reference, *overlays]).withColumn("g", graph)
    layers = {p: (f"{BASE}{p}#", whole.where(F.col("g") == f"urn:graph:{p}")) for p in ("ref", *SEGMENTS)}
    return GraphContext(spark, layers, whole=whole)


_GRAPHS: dict[tuple[str, str], GraphContext] = {}


def stored_star(spark: SparkSession, sf_dir: str) -> GraphContext:
    """star_graph() out of a store, which each application builds once for a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        store = GraphStore(spark, f"{shared_folder(spark)}/star-{uuid.uuid4().hex}")
        store.load_all(star_graph(spark, sf_dir).quads())
        _GRAPHS[key] = store.context()
    return _GRAPHS[key]
