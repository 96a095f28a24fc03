"""Operator 3: token counts by source, language and tokenizer version, kept up to date by signed deltas.

A ledger has one row per document and tokenizer version: doc_id, source, lang, version, n_tokens. `insert`, `delete`
and `revise` turn ledger rows into signed rows, `Rollup.commit` adds up a batch of them into one small delta per
group under the batch's own name, and `Rollup.totals` adds the deltas of all batches. A batch is written aside and
gets its name by one rename, so it counts whole or not at all; a name that has been committed stays as it is, so a
batch that is committed again (after a lost driver, or by mistake) counts once. `compact` adds up a list of batches
and writes the sum and the list together, by one rename as well: from then on the snapshot counts and they don't,
and neither can be seen without the other. Where a file system's rename isn't atomic, one writer at a time is assumed.

Null sources and languages are groups of their own; a null text has no tokens; a null doc_id is a document like
others. A null n_tokens counts as 0. Repeated rows each count. Groups without documents and tokens are left out of the
totals. An empty batch changes nothing; an empty rollup has empty totals. Columns of other names are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, materialise, slices, table, work_path

GROUP = ("source", "lang", "version")
DELTA = "source string, lang string, version string, documents long, tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str, digest: bool = False) -> DataFrame:
    """The ledger of docs(doc_id, source, lang, text) under one tokenizer; other columns are not read.

    digest: with the SHA-256 of each text as one column more."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    more = ("digest",) if digest else ()
    if digest:
        rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                _, n = encoder(tokenizer_path).encode(b.column("text").to_pylist())
                kept = ("doc_id", "source", "lang", *more)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array((n - 1).astype(np.int64))], names=[*kept, "n_tokens"])

    counted = rows.mapInArrow(run, f"doc_id long, source string, lang string, {'digest string, ' if digest else ''}n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens", *more)


def _signed(ledger: DataFrame, sign: int) -> DataFrame:
    return ledger.select(*GROUP, F.lit(sign).cast("long").alias("documents"), (F.coalesce("n_tokens", F.lit(0)) * sign).cast("long").alias("tokens"))


def insert(ledger: DataFrame) -> DataFrame:
    return _signed(ledger, 1)


def delete(ledger: DataFrame) -> DataFrame:
    return _signed(ledger, -1)


def revise(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose counts, source or language change: out with the rows before, in with those after."""
    return delete(before).unionByName(insert(after))


def _added(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0))


class Rollup:
    """A folder with batch=<id>/delta and snapshot=<id>/delta, /folded. What is not complete begins with a dot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[str]:
        fs, path = self._fs()
        root = path(self.path)
        return sorted(n for s in fs.listStatus(root) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(root) else []

    def _folded(self, names: list[str]) -> set[str]:
        lists = [f"{self.path}/{n}/folded" for n in names if n.startswith("snapshot=")]
        return {r["name"] for r in self.spark.read.schema("name string").parquet(*lists).collect()} if lists else set()  # names of batches, not rows

    def _publish(self, name: str, parts: dict[str, DataFrame]) -> None:
        fs, path = self._fs()
        aside = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        for part, rows in parts.items():
            rows.write.parquet(f"{aside}/{part}")
        if fs.exists(path(f"{self.path}/{name}")) or not fs.rename(path(aside), path(f"{self.path}/{name}")):
            fs.delete(path(aside), True)  # committed meanwhile

    def batches(self) -> list[str]:
        """Names of batches and snapshots that count: those folded into a snapshot are left out."""
        names = self._names()
        folded = self._folded(names)
        return [n for n in names if n not in folded]

    def commit(self, batch_id: str, signed: DataFrame) -> None:
        name = f"batch={batch_id}"
        names = self._names()
        if name not in names and name not in self._folded(names):
            self._publish(name, {"delta": _added(signed)})

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return _added(self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{n}/delta" for n in names)))

    def totals(self) -> DataFrame:
        return self._sum(self.batches())

    def compact(self, snapshot_id: str) -> None:
        """One snapshot instead of the batches that count now; batches committed meanwhile are not part of it."""
        names = self.batches()
        self._publish(f"snapshot={snapshot_id}", {"delta": self._sum(names), "folded": self.spark.createDataFrame([(n,) for n in names], "name string")})


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go in, later copies of a text go out (committed twice), and what is left is revised to count
    the id that closes a document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, work_path(spark, "op3-rollup"))
    ledger = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k", digest=True)
    ledger = materialise(ledger.withColumn("row", F.monotonically_increasing_id()), "op3-ledger")
    rollup.commit("1-insert", insert(ledger))
    first = ledger.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("x.row", F.lit(True).alias("first"))
    marked = materialise(ledger.drop("digest").join(first, "row", "left"), "op3-marked")
    copies, left = marked.where("first is null"), marked.where("first")
    rollup.commit("2-delete-copies", delete(copies))
    rollup.commit("2-delete-copies", delete(copies))
    rollup.commit("3-close", revise(left, left.withColumn("n_tokens", F.col("n_tokens") + 1)))
    return rollup.totals()
