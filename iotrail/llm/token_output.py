"""Operator 1: token ids of whole documents as Parquet list columns.

The table has one row per document in ascending doc_id order (ties by text): doc_id, part, local_start,
n_tokens, ids. Ids are dictionary-coded, counts and positions delta-coded (Parquet v2 pages), row groups
and pages have set sizes and column indexes, so a reader that wants some documents or only the counts
touches only their pages. `part` numbers the writing task; documents of a lower part come before those
of a higher one, and local_start counts the ids before a document within its part.

Null texts are empty; an empty text has the end id alone. Repeated rows are kept as they are. Null
doc_ids come first. Other columns of the input are not read. An empty input gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoder, list_array, slices, texts_of, table, work_path

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> SCHEMA, range-partitioned and sorted by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, "text"):
                ids, n = encoder(tokenizer_path).encode(b.column("text").to_pylist(), end_id)
                before = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), list_array(ids, n, pa.int32())],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def write(tokens: DataFrame, path: str, row_group_mb: int = 32, page_kb: int = 256, page_rows: int = 2000) -> None:
    (
        tokens.write.option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with `start`, the number of ids of all documents before: doc_id, start, n_tokens, ids.

    The offsets have one row per writing task, so they are broadcast and summed in one small window.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    offsets = (
        rows.groupBy("part")
        .agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
        .select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    )
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str, first_id: int, last_id: int) -> DataFrame:
    """doc_id, n_tokens, ids of the documents from first_id to last_id: the range reaches the scan, where row groups and
    pages without such documents are passed over by their statistics."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "n_tokens", "ids")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens: no page of ids is read."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens")


def with_crc(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces the list column by ids_crc32 of its values as little-endian unsigned 32-bit integers."""
    kept = [c for c in df.columns if c != ids]
    schema = df.select(*kept).schema.add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            raw = memoryview(flat.tobytes())
            crc, a = [], 0
            for e in ends.tolist():
                crc.append(zlib.crc32(raw[4 * a : 4 * e]))
                a = e
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    return df.mapInArrow(run, schema)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "op1-tokens")
    write(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return with_crc(read(spark, path))
