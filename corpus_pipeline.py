"""A corpus pipeline of five of the training-data operators; each stage's table is written and read again.

Rows: documents without a recognised language go; one document of each near-duplicate group stays;
secrets are replaced by a mark; rows are repeated or left out as the source targets ask; the last stage
returns doc_id, n_tokens and digests of the ids and of the text that they decode to.

All stages share the executors' Python workers and memory: texts cross to them in small batches, a setting
that stays in the session since a stage's plan runs after the stage returns, and the last stage's coder goes
with its task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import forced_bpe, langid, ngram_join, pareto_mix, secret_scan
from terrace.llm.common import dropped, small_batches, written
from terrace.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identify(docs, langid.train(docs)).where(~F.col("rejected")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = secret_scan.redacted(docs, secret_scan.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pareto_mix.mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return forced_bpe.digests(docs, tokenizer_path("byte_bpe_50k.json"), keep=False)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("bpe", bpe),
]

#: The models and the vocabulary are out of SQL's reach; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, name)
            if held is not None:
                dropped(held)
            held = docs
    return docs
