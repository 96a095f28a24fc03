"""Windowed statistics of a stream as a table, and what came too late for them, counted to the row.

Each micro-batch writes one folder, batch=<number>, with its part of each window; a batch that runs again after a failure
overwrites its own folder, so nothing counts twice. The watermark is the latest time of all batches before, less `late`;
it is kept with the parts, not in the query's memory, so it is the same after a restart. Rows whose window had ended by
then are counted apart, in windows of their own, and their rows are kept as a table if that is asked for. Windows
are sums of parts, so no state grows with the stream; compact() sums up finished batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TYPES
from .stats import with_rates

PARTS = "start timestamp, end timestamp, late boolean, total long, latencies long, sum_latency double, min_latency double, max_latency double, " + ", ".join(f"n_{k} long" for k in TYPES) + ", last_ts timestamp"


def parts_of(events: DataFrame, resolution: str, mark: DataFrame, late: str) -> DataFrame:
    """PARTS of events(ts, kind, latency) that come after mark(last_ts), a row; one row without a window carries the mark on."""
    low = F.col("mark") - F.expr(f"interval {late}")
    rows = events.select(F.window("ts", resolution).alias("w"), "ts", "kind", "latency").crossJoin(F.broadcast(mark.select(F.col("last_ts").alias("mark"))))  # one row
    behind = F.coalesce(F.col("w.end") <= low, F.lit(False))
    parts = rows.groupBy(F.col("w.start").alias("start"), F.col("w.end").alias("end"), behind.alias("late")).agg(
        F.count(F.lit(1)).alias("total"), F.count("latency").alias("latencies"), F.sum("latency").alias("sum_latency"), F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TYPES), F.max("ts").alias("last_ts"),
    )
    return parts.unionByName(mark.withColumn("total", F.lit(0).cast("long")), allowMissingColumns=True)


def mark_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The latest time of all batches before: one row, null if there is none."""
    if batch == 0:
        return spark.createDataFrame([(None,)], "last_ts timestamp")
    return spark.read.schema(PARTS).parquet(f"{path}/parts/batch={batch - 1}").agg(F.max("last_ts").alias("last_ts"))


def write_batch(events: DataFrame, batch: int, path: str, resolution: str, late: str, keep_rows: bool = False) -> None:
    spark = events.sparkSession
    mark = mark_before(spark, path, batch)
    if keep_rows:
        last = mark.first().last_ts
        low = F.lit(last) - F.expr(f"interval {late}") if last else F.lit(None).cast("timestamp")
        behind = events.where(F.window("ts", resolution)["end"] <= low) if last else events.limit(0)
        behind.write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
    parts_of(events, resolution, mark, late).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts/batch={batch}")  # a row a window


def keep_history(events: DataFrame, path: str, checkpoint: str, resolution: str = "5 minutes", late: str = "1 minute", keep_rows: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """events(ts, kind, latency, ...), streaming -> a running query that fills the tables below path."""
    writer = events.writeStream.foreachBatch(lambda rows, n: write_batch(rows, n, path, resolution, late, keep_rows)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/parts").where("start is not null")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The windows so far, with the columns of stats.history(); rows that were late are not in them."""
    per = _parts(spark, path).where("not late").groupBy("start", "end").agg(
        F.sum("total").alias("total"), (F.sum("sum_latency") / F.nullif(F.sum("latencies"), F.lit(0))).alias("avg_latency"), F.min("min_latency").alias("min_latency"), F.max("max_latency").alias("max_latency"),
        *(F.sum(f"n_{k}").alias(f"n_{k}") for k in TYPES),
    )
    return with_rates(per)


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """start, end, total: how many rows came too late for each window."""
    return _parts(spark, path).where("late").groupBy("start", "end").agg(F.sum("total").alias("total"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows themselves, with the number of the batch that brought them."""
    return spark.read.parquet(f"{path}/late")


def compact(spark: SparkSession, path: str, batches: int) -> None:
    """Sums up the parts of all batches below `batches` into the folder of the last of them. Run it while the query stands
    still, or on batches well behind the running one."""
    last, root = batches - 1, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) <= last]
    if len(old) < 2:
        return
    parts = spark.read.schema(PARTS).parquet(*(p.toString() for p in old))
    sums = ("total", "latencies", "sum_latency", *(f"n_{k}" for k in TYPES))
    whole = parts.groupBy("start", "end", "late").agg(*(F.sum(c).alias(c) for c in sums), F.min("min_latency").alias("min_latency"), *(F.max(c).alias(c) for c in ("max_latency", "last_ts")))
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    fresh = Path(f"{path}/_compacted")
    whole.select(*(c.split()[0] for c in PARTS.split(", "))).coalesce(1).write.mode("overwrite").parquet(fresh.toString())
    for p in old:
        fs.delete(p, True)
    if not fs.rename(fresh, Path(f"{path}/parts/batch={last}")):
        raise RuntimeError(f"{fresh} could not be moved")
