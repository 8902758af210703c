"""Incremental indexing: new pages of a folder are cut into chunks and appended, each file once.

The stream's checkpoint remembers files, so a restart resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.operators.retrieve import chunks, indexed, page_text, page_title


def index_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint: str, vendor: str) -> StreamingQuery:
    """Parquet pages (page_id, url, html) -> chunks in out_dir; runs until what is there is done."""
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(pages_dir)

    def append(batch: DataFrame, epoch: int) -> None:
        text = batch.select(F.col("url").alias("source"), page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("text"))
        rows = chunks(text, "source").join(text.select("source", "title"), "source")
        # An epoch that is tried again writes over its own folder.
        rows = rows.select("source", "title", "chunk", F.col("chunk_text").alias("text"))
        earlier = "source string, id long, epoch long"
        done = spark.read.schema(earlier).parquet(out_dir).where(F.col("epoch") < epoch) if epoch else spark.createDataFrame([], earlier)
        indexed(rows, done, vendor).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
