"""What the operators of this folder share: inputs, the shared work folder, sizes, hashing of words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words everywhere here: runs of characters other than blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Parquet bytes that one task of a Python stage is meant to hold.
TASK_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents table; other columns never reach the operators."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/terrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a written table that no later read needs."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished plans; it acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of texts that cross to a Python worker at once: the JVM, whose buffer doubles as it grows, and the worker both hold them.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session's plans, from now on, exceed BATCH_BYTES by more than a row; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def quoted(name: str) -> str:
    """A column's name for col() and expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def by_arrow(df: DataFrame, kept: list[str], source: str, fields: T.StructType, work: Callable[[pa.Array], Iterator[tuple[int, int, dict[str, pa.Array]]]]) -> DataFrame:
    """The kept columns of df and new fields that work() makes of the column source, as (first row, rows, columns by name) of each
    part of a batch; one named like the source takes its place. Columns are numbered on the way, so they may have any name."""
    places = {c: f"c{i}" for i, c in enumerate(kept)}
    inside = [F.col(quoted(c)).alias(p) for c, p in places.items()]
    given = [T.StructField(p, df.schema[c].dataType) for c, p in places.items()]
    new = [f for f in fields if f.name not in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, made in work(batch["source"]):
                columns = [made[c] if c in made else batch[p].slice(lo, n) for c, p in places.items()] + [made[f.name] for f in new]
                yield pa.RecordBatch.from_arrays(columns, [*places.values(), *(f"n{i}" for i in range(len(new)))])
            trim()

    schema = T.StructType([*given, *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new))])
    return df.select(*inside, F.col(quoted(source)).alias("source")).mapInArrow(run, schema).toDF(*kept, *(f.name for f in new))


def checkpointed(df: DataFrame) -> DataFrame:
    """For small frames: Spark's reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's bytes, for a scan the size of its files; where it has none, half the texts' bytes are counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50 or "text" not in df.columns:
        return known
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]) // 2


def partitions_for(df: DataFrame, per_task: int = TASK_BYTES) -> int:
    """Tasks for a shuffle that follows the input's size, never under the session's setting."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bytes_ = input_bytes(df)
    return max(least, min(1 << 17, -(-bytes_ // per_task))) if bytes_ < 1 << 50 else least


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


@lru_cache(1)
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to take every block of a megabyte or more from the system and to give it back when it is freed."""
    try:
        library = ctypes.CDLL("libc.so.6")
        library.mallopt(-3, 1 << 20)
    except (OSError, AttributeError):  # another C library
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return library


def trim() -> None:
    """Give freed memory of a Python worker back; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if (library := _allocator()) is not None:
        library.malloc_trim(0)
