"""The layered graph: quads by layer, their union as a set, and what is discovered from them."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import terms as t

QUAD = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, g string"


@dataclass(frozen=True)
class GraphContext:
    """Layers by prefix: (namespace, quads). reference: the prefix of the neutral layer."""

    spark: SparkSession
    layers: dict[str, tuple[str, DataFrame]]
    reference: str = "ref"
    short_before: str = "ns-"
    whole: DataFrame | None = None  # all layers in one frame, where they come so
    merged: DataFrame | None = None  # their union as a set, where a store keeps it so
    _held: dict = field(default_factory=dict, compare=False)

    @property
    def namespaces(self) -> dict[str, str]:
        return {p: ns for p, (ns, _) in self.layers.items()}

    @property
    def ref(self) -> str:
        return self.layers[self.reference][0]

    def quads(self) -> DataFrame:
        if self.whole is not None:
            return self.whole
        frames = [df for _, df in self.layers.values()]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def triples(self) -> DataFrame:
        """The union of all layers; the same triple in two layers is one. Filters on its columns go below the deduplication, so a
        pattern shuffles its own triples alone; a stored graph's are distinct as they are."""
        if self.merged is not None:
            return self.merged
        return self.quads().select("s", "s_kind", "p", "o", "o_kind").dropDuplicates(["s", "s_kind", "p", "o", "o_kind"])

    def pattern(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
        """Quads that fit the given terms."""
        out = self.quads()
        for column, value in (("s", s), ("p", p), ("o", o), ("g", g)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out

    def with_layer(self, prefix: str, quads: DataFrame) -> GraphContext:
        """A context with a layer added or replaced; the old one serves until then. The namespace is discovered."""
        if not prefix.isalnum() or prefix == self.reference:
            raise ValueError("a layer's prefix is alphanumeric and not the reference's")
        quads = quads.withColumn("g", F.lit(f"urn:graph:{prefix}"))
        found = discover_namespaces(quads).first()
        if found is None:
            raise ValueError("no subject with a namespace: the layer stays as it was")
        return replace(self, layers=self.layers | {prefix: (found["ns"], quads)}, whole=None, merged=None, _held={})


def discover_namespaces(quads: DataFrame) -> DataFrame:
    """Per layer the most frequent namespace of subjects (cut at the last '#'); ties by name."""
    counts = quads.where(F.col("s").contains("#")).groupBy("g", t.namespace_last(F.col("s")).alias("ns")).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "ns"))
    return counts.withColumn("place", first).where("place = 1").select("g", "ns", "n")


def vendors(triples: DataFrame) -> DataFrame:
    """Namespaces of subjects that carry a verdict."""
    return triples.where(F.col("p").endswith("#verdict")).select(t.namespace(F.col("s")).alias("ns")).distinct()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, shared by driver and executors; a local session without one gets a temporary folder."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrace-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Spark's reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _jumped(chain: DataFrame) -> DataFrame:
    """Every open pointer replaced by that of the node it points to."""
    next_ = chain.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("far").alias("far2"), F.col("open").alias("open2"))
    moved = chain.where("open").join(next_, "next").select("node", F.col("next2").alias("next"), (F.col("far") + F.col("far2")).alias("far"), F.col("open2").alias("open"))
    return moved.unionByName(chain.where("not open"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(child, parent) edges, roots(root) -> root, node, depth (the least) of every node that one step or more lead down to.

    Nodes with one parent point to it, and pointer jumping takes each to the next root or node with several or no parents, four
    times as far a round: a hierarchy of any depth needs a few rounds. What is left is a graph of roots and nodes with several
    parents, in which shorter ways are taken until there are none. Nodes that only a cycle leads to are below no root.
    """
    edges = checkpointed(edges.where("child is not null and parent is not null").select("child", "parent").distinct())
    tops = roots.select(F.col("root").alias("node")).distinct()
    single = edges.groupBy("child").agg(F.min("parent").alias("next"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("child").alias("node"), "next").join(tops, "node", "left_anti")
    chain = single.join(single.select(F.col("node").alias("next"), F.lit(True).alias("open")), "next", "left").select("node", "next", F.lit(1).alias("far"), F.coalesce("open", F.lit(False)).alias("open"))
    left, chain = -1, checkpointed(chain)
    while (now := chain.where("open").count()) not in (0, left):
        # Distances are contiguous along a chain: when nothing more is reached, only cycles are left.
        left, chain = now, checkpointed(_jumped(_jumped(chain)))
    ends = chain.where("not open").select("node", F.col("next").alias("top"), "far")
    inner = edges.join(chain.select(F.col("node").alias("child")), "child", "left_anti").join(chain.where("open").select(F.col("node").alias("parent")), "parent", "left_anti")
    ways = inner.join(ends.withColumnRenamed("node", "parent"), "parent", "left").groupBy(F.col("child").alias("node"), F.coalesce("top", "parent").alias("top")).agg(F.min(F.coalesce(F.col("far") + 1, F.lit(1))).alias("far"))
    ways = checkpointed(ways)
    seen = checkpointed(ways.join(tops.withColumnRenamed("node", "top"), "top", "left_semi").select(F.col("top").alias("root"), "node", F.col("far").alias("depth")))
    front = seen
    while not front.isEmpty():
        further = front.withColumnRenamed("node", "top").join(ways, "top").groupBy("root", "node").agg(F.min(F.col("depth") + F.col("far")).alias("depth"))
        known = seen.select("root", "node", F.col("depth").alias("known"))
        front = checkpointed(further.join(known, ["root", "node"], "left").where("known is null or depth < known").drop("known"))
        seen = checkpointed(seen.unionByName(front).groupBy("root", "node").agg(F.min("depth").alias("depth")))
    above = seen.select("root", F.col("node").alias("top"), "depth").unionByName(tops.select(F.col("node").alias("root"), F.col("node").alias("top"), F.lit(0).alias("depth")))
    below = above.join(ends, "top").select("root", "node", (F.col("depth") + F.col("far")).alias("depth"))
    return seen.unionByName(below).groupBy("root", "node").agg(F.min("depth").alias("depth"))


def value_lists(triples: DataFrame) -> DataFrame:
    """head, place, node, value of the cells of RDF lists."""
    first = triples.where(F.col("p") == t.RDF + "first").select(F.col("s").alias("node"), F.col("o").alias("value"))
    rest = triples.where(F.col("p") == t.RDF + "rest").select(F.col("s").alias("node"), F.col("o").alias("next"))
    heads = first.select("node").join(rest.select(F.col("next").alias("node")), "node", "left_anti").distinct()
    down = closure(rest.select(F.col("next").alias("child"), F.col("node").alias("parent")), heads.select(F.col("node").alias("root")))
    every = heads.select(F.col("node").alias("head"), "node", F.lit(0).alias("place")).unionByName(down.select(F.col("root").alias("head"), "node", F.col("depth").alias("place")))
    return every.join(first, "node").select("head", "place", "node", "value")
