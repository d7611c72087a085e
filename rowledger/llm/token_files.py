"""Token ids in Parquet files: list columns, controlled row groups, page indexes.

Layout: rows in ascending id order over all files; ``tokens`` is a list of INT32
without a dictionary (ids hardly repeat within a page), so the format's delta or
plain pages hold it, compressed; ``n_tokens``, ``part`` and ``start_in_part`` are
small columns of their own, so metadata reads leave the token pages alone; page
and column indexes on the id let a reader of few ids skip row groups and pages.

The place of a document among all ids is its place in its part plus what the
parts before hold: each part counts within its own write, and the totals are one
row for each part, so no shuffle follows the first.

Defined results: a null text counts as empty and holds the end id alone; rows
with equal ids stay, ordered by the text's hash; null ids come first; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordBpe, memo

BLOCK = 256
#: Up to so many parts, their totals are sent to all tasks.
FEW_PARTS = 100_000
#: Bytes of a row group and of a page: a selective read touches a few pages of one group.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#tokens.list.element": "false",
    "compression": "zstd",
}


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    return a.tobytes() if np.little_endian else np.asarray(a, "<u4").tobytes()


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, start_in_part, n_tokens, tokens), a part for each partition, in the partition's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, at, part = memo(WordBpe, tokenizer, pack_ids, b""), pack_ids([end_id]), 0, TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(k, BLOCK)
                blobs = [b"".join(known.values(t or "")) + end for t in rows.column(1).to_pylist()]
                n = np.array([len(b) // 4 for b in blobs], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(blobs))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(at + ends[:-1], pa.int64()), pa.array(n), lists], ["id", "part", "start_in_part", "n_tokens", "tokens"])
                at += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, part int, start_in_part long, n_tokens long, tokens array<int>").withColumnRenamed("id", id_col)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Write all documents in ascending id order. One shuffle, of the texts, by id range (with the
    text's hash, so that equal or null ids can be dealt out too)."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    d = d.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
    encode(d, tokenizer, end_id, id_col, text_col).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``, the ids of all documents before. Token pages are read only if selected."""
    files = spark.read.parquet(path)
    # one row for each part, whatever the number of documents
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    few = sums.limit(FEW_PARTS + 1).count() <= FEW_PARTS
    return files.join(F.broadcast(before) if few else before, "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part", "start_in_part", "part_start")


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ids_crc32, the unsigned crc32 of the ids as little-endian 32-bit integers, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), "start", "n_tokens", "tokens").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
