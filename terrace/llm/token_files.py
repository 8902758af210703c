"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A document's ids are appended to one array; the boundaries (a non-decreasing sequence of
n_docs + 1 offsets) are stored as Elias-Fano: the low bits of each offset packed side by side, the
high bits in unary in a bit vector. ``select(i)`` starts from a sampled position of every 64th set bit
and counts from there, so an offset costs about 2 + log2(mean length) bits and no 64-bit table
exists. doc_ids, which ascend, are coded in the same way.

Each file holds one segment of at most SEGMENT_BYTES of ids (one document at least). Spark's writers
put the files in place, so a lost task leaves nothing behind and any Hadoop file system will do.

Defined results: null text counts as empty, and then holds the end id only; null doc_ids come first;
rows with the same doc_id keep their own entries, ordered by text; an empty table gives no files' rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import partitions_for, scratch
from terrace.llm.word_encoder import word_encoder
from terrace.llm.words import slices

SEGMENT_BYTES = 8 << 20
SAMPLE = 64
MAGIC = b"TEFT"
#: magic, partition, segment, ids before it in its partition, documents, null doc_ids, ids, bytes an id, least doc_id; big-endian.
HEAD = struct.Struct(">4sIIQIIQBq")


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        packed = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, packed, np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4"))

    def _lows(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[first // 8 : -(-last // 8)], "little")
        return (word >> first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = bit // 8, self.high[bit // 8] >> bit % 8 << bit % 8
        while left >= seen.bit_count():
            left -= seen.bit_count()
            byte += 1
            seen = self.high[byte]
        for _ in range(left):
            seen &= seen - 1
        position = 8 * byte + (seen & -seen).bit_length() - 1
        return (position - i) << self.low_bits | self._lows(i)

    def all(self) -> np.ndarray:
        """Every value at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        lows = (low.reshape(self.n, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | lows

    def dump(self) -> bytes:
        head = struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<IBIII", data, at)
        at += 17
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", n_samples, at)), at + 4 * n_samples


class Segment:
    """One file, read: ids of its documents by select, without other tables."""

    def __init__(self, data: bytes):
        magic, self.part, self.number, self.before, self.n_docs, self.n_null, self.n_ids, width, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds, at = EliasFano.load(data, HEAD.size)
        self.docs, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.docs.all().astype(np.int64) + self.least).tolist()


def segment_bytes(part: int, number: int, before: int, doc_ids: list[int | None], encoded: list[bytes], width: int) -> bytes:
    """A file's bytes; doc_ids ascend, nulls first."""
    bounds = np.concatenate([[0], np.cumsum([len(x) // width for x in encoded], dtype=np.int64)])
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    head = HEAD.pack(MAGIC, part, number, before, len(doc_ids), len(doc_ids) - len(known), int(bounds[-1]), width, least)
    return b"".join([head, EliasFano.of(bounds).dump(), EliasFano.of(known - least).dump(), *encoded])


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """doc_id, text -> token files under path, ascending doc_id over partitions and segments."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        part, number, before, ids, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize

        def flush() -> pa.RecordBatch:
            nonlocal number, before, ids, held, size
            data = segment_bytes(part, number, before, ids, held, width)
            number, before, ids, held, size = number + 1, before + size // width, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in batches:
            for lo, texts in slices(batch["text"]):
                some = batch.slice(lo, len(texts))
                for doc_id, code in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"]), strict=True):
                    if held and size + len(code) > SEGMENT_BYTES:
                        yield flush()
                    ids.append(doc_id)
                    held.append(code + end)
                    size += len(code) + width
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    # A binary cast to string keeps its bytes: the text writer thus writes raw files, a segment and a line end each.
    segments = ordered.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    segments.write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under path."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                seg = Segment(data.as_py())
                bounds = np.array([seg.bounds.select(i) for i in range(seg.n_docs + 1)], np.int64)
                ids = seg.ids.astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(seg.n_docs, seg.part, np.int64)), pa.array(seg.doc_ids(), pa.int64()), pa.array(bounds[:-1] + seg.before), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")  # noqa: E731  big-endian, from 1
    totals = files.select(number(5, 4).alias("part"), number(29, 8).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One row a partition of the writer: their number is a setting, not a property of the data.
    sums, base = [], 0
    for row in sorted(totals.collect()):
        sums.append((row.part, base))
        base += row.n
    bases = spark.createDataFrame(sums, "part long, base long")
    rows = files.select("content").mapInArrow(parse, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the files of docs and read them back."""
    path = path or scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_file, end_id)
    return read_token_files(docs.sparkSession, path)
