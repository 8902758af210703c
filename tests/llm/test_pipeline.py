"""The pipeline against its stages done plainly on the smallest tables."""

import hashlib
import os
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import forced_bpe, langid, ngram_join, pareto_mix, secret_scan
from terrace.llm.queries import tokenizer_path
from terrace.llm.words import slices

DIR = "/root/testdata/sf0.001"


def test_pipeline_follows_its_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.train(docs)
    rows = [r for r, p in zip(docs.collect(), model.predict([r.text for r in docs.collect()]), strict=True) if not p[2]]
    kept = spark.createDataFrame(rows, docs.schema)
    heads = {r.doc_id for r in ngram_join.clusters(kept).collect() if r.doc_id == r.component_id}
    kept = spark.createDataFrame([r for r in rows if r.doc_id in heads], docs.schema)
    secrets = secret_scan.train(kept)
    clean = secret_scan.redacted(kept, secrets)
    copies = {r.doc_id: r.copies for r in pareto_mix.copies(clean).collect()}
    coder = forced_bpe.ForcedBPE(tokenizer_path("byte_bpe_50k.json"))
    expected = []
    for r in clean.collect():
        ids = coder.tokenizer.encode(r.text, add_special_tokens=False).ids
        expected += [(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * copies[r.doc_id]
    got = [tuple(r)[:3] for r in corpus_pipeline.run(spark, DIR).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 50


def test_stages_send_small_batches(spark):
    """A batch of texts takes memory in the JVM and in the worker; 10000 documents at once were a whole task's text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    docs = spark.range(64, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 24_000).alias("text"), F.lit("en").alias("lang"))
    sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            stage(spark, docs.withColumn("source", F.lit("web")), DIR)
            if stage is not corpus_pipeline.mix_sources:  # column functions only
                assert max(r.n for r in sizes.collect()) < 3 << 20, stage
        spark.conf.set(name, "1m")
        corpus_pipeline.bpe(spark, docs, DIR)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, held)


def test_coder_goes_with_its_task(spark):
    """A coder that stays in a worker takes memory from the stages of the next tables."""
    def calls(batches):
        for _ in batches:
            info = forced_bpe.forced_bpe.cache_info()
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([info.hits + info.misses])], ["pid", "n"])

    asked = lambda: {r.pid: r.n for r in spark.range(16, numPartitions=16).mapInArrow(calls, "pid long, n long").collect()}
    docs, before = spark.read.parquet(f"{DIR}/documents.parquet").repartition(8), asked()
    assert corpus_pipeline.bpe(spark, docs, DIR).count() == docs.count()
    assert all(n == before.get(pid, 0) for pid, n in asked().items())


def test_language_id_works_in_little_memory():
    """Two workers of an executor score texts at once, beside its JVM."""
    texts = pa.array([" ".join(f"wort{(i * 7919 + k) % 4096:x}" for k in range(8000)) for i in range(60)])
    points, bounds = langid.characters(texts.slice(0, 4).to_pylist())
    grams, at = langid.distinct(langid.windows(points, bounds))
    model = langid.Identifier(["de"], [langid.KneserNey(grams, np.bincount(at), 64)], np.full(1, 9.0))
    tracemalloc.start()
    try:
        got = [p for _, some in slices(texts, langid.SLICE_BYTES) for p in model.predict(some.to_pylist())]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 60 and texts.nbytes > 3 << 20 and peak < 40 << 20, peak
