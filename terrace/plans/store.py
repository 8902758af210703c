"""A stored layered graph: Parquet by layer and predicate, deduplicated when a layer is loaded, replaced layer by layer.

    store/quads/g=<graph>/version=<id>/p=<predicate>/…    quads without repetition; repeated: an earlier layer has the triple too
    store/current                                          which version of each layer holds

Loading writes a new version beside the old one, then puts a new `current` in place by a rename. Whatever fails before that
leaves the graph as it was; readers that began before it go on with the files they know. A pattern with a predicate reads that
predicate's files alone, one with a layer that layer's, and no query has to look for repetitions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.plans.graph import GraphContext, discover_namespaces

STORED = "s string, s_kind string, o string, o_kind string, o_dt string, o_lang string, repeated boolean, g string, version string, p string"
TRIPLE = ["s", "s_kind", "p", "o", "o_kind"]


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, reference: str = "ref"):
        self.spark, self.path, self.reference = spark, path.rstrip("/"), reference
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> dict[str, dict[str, str]]:
        """ns and version of each layer, the reference first, then by prefix."""
        if not self._files.exists(self._hadoop.Path(f"{self.path}/current")):
            return {}
        held = json.loads(self.spark.read.text(f"{self.path}/current", wholetext=True).first()["value"])
        return dict(sorted(held.items(), key=lambda x: (x[0] != self.reference, x[0])))

    def _place(self, prefix: str, version: str) -> str:
        return f"{self.path}/quads/g=urn%3Agraph%3A{prefix}/version={version}"

    def _read(self, layers: dict[str, dict[str, str]]) -> DataFrame:
        paths = [self._place(prefix, x["version"]) for prefix, x in layers.items()]
        reader = self.spark.read.schema(STORED)
        return reader.option("basePath", f"{self.path}/quads").parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def _write(self, rows: DataFrame) -> str:
        """A new version of the files of rows' layers, each file in order of its subjects; a frequent predicate is spread over tasks."""
        version = uuid.uuid4().hex
        rows = rows.withColumn("version", F.lit(version)).hint("rebalance", F.col("g"), F.col("p")).sortWithinPartitions("g", "version", "p", "s")
        rows.write.mode("append").partitionBy("g", "version", "p").parquet(f"{self.path}/quads")
        return version

    def _distinct(self, quads: DataFrame) -> DataFrame:
        """Each quad once; repeated: an earlier layer among them has the triple, or it differs from another in type or language alone."""
        rank = F.when(F.col("g") == f"urn:graph:{self.reference}", "").otherwise(F.col("g"))
        one = quads.groupBy(*TRIPLE).agg(F.sort_array(F.collect_set(F.struct(rank.alias("rank"), "o_dt", "o_lang", "g"))).alias("kinds"))
        return one.select(*TRIPLE, F.posexplode("kinds").alias("place", "kind")).select(*TRIPLE, "kind.o_dt", "kind.o_lang", "kind.g", (F.col("place") > 0).alias("repeated"))

    def _switch(self, layers: dict[str, dict[str, str]]) -> None:
        """The new list of versions, in one step."""
        fresh = self._hadoop.Path(f"{self.path}/current-{uuid.uuid4().hex}")
        out = self._files.create(fresh, True)
        out.write(bytearray(json.dumps(layers).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, self._hadoop.Path(f"{self.path}/current"), options)

    def load(self, prefix: str, quads: DataFrame) -> None:
        """Add a layer or replace it. ValueError for a prefix that isn't alphanumeric and for quads without a namespace."""
        if not prefix.isalnum():
            raise ValueError("a layer's prefix is alphanumeric")
        layers = self.current()
        old = {prefix: layers[prefix]} if prefix in layers else {}
        rank = lambda x: (x != self.reference, x)
        before = {k: v for k, v in layers.items() if rank(k) < rank(prefix)}
        after = {k: v for k, v in layers.items() if rank(k) > rank(prefix)}
        version = self._write(self._marked(self._distinct(quads.withColumn("g", F.lit(f"urn:graph:{prefix}"))), before))
        written = self._read({prefix: {"version": version}})
        found = discover_namespaces(written).first()
        if found is None:
            self._drop(prefix, version)
            raise ValueError("no subject with a namespace: the layer stays as it was")
        layers[prefix] = {"ns": found["ns"], "version": version}
        changed = self._read(old).unionByName(written).select(*TRIPLE)
        stale = [(prefix, x["version"]) for x in old.values()]
        for other, held in after.items():
            rows = self._read({other: held})
            # Layers rarely share triples; one that does is written anew with the marks that now hold.
            if not rows.join(changed, TRIPLE, "left_semi").isEmpty():
                ahead = {k: v for k, v in layers.items() if rank(k) < rank(other)}
                layers[other] = held | {"version": self._write(self._marked(self._distinct(rows), ahead))}
                stale.append((other, held["version"]))
        self._switch(layers)
        self._stale = stale

    def load_all(self, quads: DataFrame) -> None:
        """All layers that quads have, by their g, at once; whatever the store had is replaced."""
        stale = [(prefix, x["version"]) for prefix, x in self.current().items()]
        version = self._write(self._distinct(quads))
        place = self._hadoop.Path(f"{self.path}/quads/*/version={version}")
        made = [x.getPath().getParent().getName().rpartition("%3A")[2] for x in self._files.globStatus(place)]
        found = {r["g"].rpartition(":")[2]: r["ns"] for r in discover_namespaces(self._read({prefix: {"version": version} for prefix in made})).collect()}
        self._switch({prefix: {"ns": ns, "version": version} for prefix, ns in found.items()})
        self._stale = stale

    def _marked(self, rows: DataFrame, before: dict[str, dict[str, str]]) -> DataFrame:
        """rows, repeated where one of the layers has the triple."""
        if not before:
            return rows
        held = self._read(before).where("not repeated").select(*TRIPLE, F.lit(True).alias("held")).dropDuplicates(TRIPLE)
        return rows.join(held, TRIPLE, "left").withColumn("repeated", F.col("repeated") | F.coalesce("held", F.lit(False))).drop("held")

    def _drop(self, prefix: str, version: str) -> None:
        self._files.delete(self._hadoop.Path(self._place(prefix, version)), True)

    def clean(self) -> None:
        """Delete the versions that the last load of this object replaced, once no reader needs them."""
        for prefix, version in getattr(self, "_stale", []):
            self._drop(prefix, version)
        self._stale = []

    def context(self, short_before: str = "ns-") -> GraphContext:
        """The graph as it is now: later loads don't change it."""
        layers = self.current()
        whole = self._read(layers)
        quads = whole.select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "g")
        frames = {prefix: (x["ns"], quads.where(F.col("g") == f"urn:graph:{prefix}")) for prefix, x in layers.items()}
        return GraphContext(self.spark, frames, self.reference, short_before, whole=quads, merged=whole.where("not repeated").select(*TRIPLE))
