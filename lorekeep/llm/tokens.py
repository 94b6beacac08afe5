"""Token ids as Parquet list columns.

Texts are range-partitioned by document, encoded in Arrow batches, and written by Spark's own Parquet writer, so the
files can be in any store and the commit protocol covers lost executors. A file holds one range of documents in
ascending order: doc_id, shard, position in the shard, n_tokens, and ids as a list of dictionary-encoded integers
(bit-packed indexes) with delta encoding beyond the dictionary. Row groups are bounded by bytes and pages by bytes and
rows; the writer adds column and offset indexes, so a reader of a few documents or of the metadata columns alone skips
the rest. The position of a document in the whole corpus follows from the totals of the shards, one row each.

Cases: a null or empty text is only the end id. Rows repeated under one id are ordered by text, null first, and all
kept. An empty table gives no rows. Texts are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import work_path
from lorekeep.llm.encoding import encoder

STORED = "doc_id long, shard int, place long, first long, n_tokens long, ids array<int>"
#: Row groups of 32 MB, pages of 256 KB or 2,000 rows, dictionaries that hold any vocabulary of 64k ids.
ROW_GROUP_BYTES = 32 << 20
LAYOUT = {
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}
#: Bytes of ids in one outgoing Arrow batch, or else one document.
BATCH_BYTES = 2 << 20


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, place = TaskContext.get().partitionId(), 0, 0
        memo = encoder(path, word_level=False)
        names = ["doc_id", "shard", "place", "first", "n_tokens", "ids"]
        for batch in batches:
            row = 0
            for ids, begins in memo.parts(batch.column(1)):
                i, n = 0, len(begins) - 1
                while i < n:
                    j = max(i + 1, int(np.searchsorted(begins, begins[i] + BATCH_BYTES // 4, side="right")) - 1)
                    flat, ends = ids[begins[i] : begins[j]], (begins[i : j + 1] - begins[i]).astype(np.int32)
                    cols = [batch.column(0)[row + i : row + j], pa.array(np.full(j - i, shard, np.int32)), pa.array(np.arange(place + i, place + j)), pa.array(first + begins[i:j]), pa.array(np.diff(begins[i : j + 1]))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names)
                    i = j
                row, place, first = row + n, place + n, first + int(begins[-1])
                del ids, flat, cols  # before the next part is encoded

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Encode docs (doc_id, text) into the file format at path."""
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_encode(tokenizer_path), STORED).write.options(**LAYOUT, **{"parquet.block.size": str(row_group_bytes)}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What is stored, and start: the ids of all documents before. The shards are as many as the ranges written, so
    their totals are a table of that many rows at most, and broadcasting them is bounded by it."""
    stored = spark.read.schema(STORED).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return stored.join(F.broadcast(offsets), "shard").withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(2)
        flat, ends = np.asarray(ids.values).astype("<i4", copy=False), np.asarray(ids.offsets)
        n = np.diff(ends).astype(np.int64)
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, from files that were read back."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return digest(read_tokens(docs.sparkSession, path))
