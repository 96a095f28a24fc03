"""Live statistics, alerts, trends and anomalies. Event frames here have ts (timestamp), kind and latency (ms)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from ..schemas import BLOCK, CUSTOM, TYPES, UFS
from . import derive, tail

METRICS = ("entries_per_second", "avg_latency", "max_latency", "ufs_ratio", "block_ratio", "custom_ratio", "total")


def tail_logs(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parsed lines of log segments as they appear in a folder; each segment is read once, when it is complete, without an
    order of lines. For files that grow, and for line_ord, see tail.tail()."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse.parse_log(rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line")).where(F.col("line").rlike(r"\S")))


def follow(spark: SparkSession, path: str, state: str, kind: str, delay: float | None = None, expire: float | None = None, **options: int) -> DataFrame:
    """Derived events of a family from log files that grow, are renamed and replaced: tail, parse, derive. state: a folder
    of this query alone. options: those of the tail source."""
    events = parse.events(parse.parse_log(tail.tail(spark, path, state, **options)), kind)
    return derive.derive(events, kind, delay, expire)


def running(events: DataFrame) -> DataFrame:
    """One row over all so far (complete mode): totals, rate, latencies, counts by family."""
    span = F.max("ts").cast("double") - F.min("ts").cast("double")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TYPES]
    return events.agg(
        F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) / F.when(span > 0, span)).alias("entries_per_second"),
        F.avg("latency").alias("avg_latency"), F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"), *counts,
    )


def history(events: DataFrame, resolution: str = "5 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """The same per window of time. late: how far behind rows may come (streams); Spark drops what
    comes later without counting rows, history.keep_history() counts them."""
    rows = events.withWatermark("ts", late) if late else events
    per = rows.groupBy(F.window("ts", resolution, slide) if slide else F.window("ts", resolution)).agg(
        F.count(F.lit(1)).alias("total"), F.avg("latency").alias("avg_latency"), F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TYPES),
    )
    return with_rates(per.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in per.columns if c != "window")))


def with_rates(windows: DataFrame) -> DataFrame:
    """Counts of windows as a rate and as shares of families."""
    seconds = F.col("end").cast("double") - F.col("start").cast("double")
    ratio = lambda k: (F.col(f"n_{k}") / F.col("total")).alias(f"{'custom' if k == CUSTOM else k}_ratio")
    return windows.select(
        "start", "end", "total", (F.col("total") / seconds).alias("entries_per_second"), "avg_latency", "min_latency", "max_latency",
        ratio(UFS), ratio(BLOCK), ratio(CUSTOM),
    )


def by_metric(windows: DataFrame) -> DataFrame:
    """(start, end, metric, value): a window's metrics as rows."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    return windows.selectExpr("start", "end", f"stack({len(METRICS)}, {pairs}) as (metric, value)")


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    comparison: str
    threshold: float
    severity: str = "warning"


# The rules that hold unless others are given.
RULES = (
    Rule("high average latency", "avg_latency", ">", 100, "warning"),
    Rule("high latency", "max_latency", ">", 1000, "critical"),
    Rule("low rate", "entries_per_second", "<", 10, "info"),
    Rule("high rate", "entries_per_second", ">", 10_000, "warning"),
)


def alerts(windows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(start, end, rule, metric, value, threshold, severity) for each window that breaks a rule."""
    table = windows.sparkSession.createDataFrame([(r.name, r.metric, r.comparison, float(r.threshold), r.severity) for r in rules], "rule string, metric string, comparison string, threshold double, severity string")
    met = by_metric(windows).join(F.broadcast(table), "metric")
    c, v, t = F.col("comparison"), F.col("value"), F.col("threshold")
    broken = F.when(c == ">", v > t).when(c == "<", v < t).otherwise(v == t)
    return met.where(broken).select("start", "end", "rule", "metric", "value", "threshold", "severity")


def trend(values: DataFrame, points: int = 1000) -> DataFrame:
    """values(metric, start, value) -> per metric over its last `points`: slope a second, fit, direction."""
    rank = F.row_number().over(W.partitionBy("metric").orderBy(F.desc("start")))
    last = values.withColumn("__n", rank).where(F.col("__n") <= points).withColumn("x", F.col("start").cast("double"))
    base = W.partitionBy("metric")
    last = last.withColumn("x", F.col("x") - F.min("x").over(base))
    fit = last.groupBy("metric").agg(F.regr_slope("value", "x").alias("slope"), F.coalesce(F.regr_r2("value", "x"), F.lit(0.0)).alias("confidence"), F.count(F.lit(1)).alias("n"))
    way = F.when(F.col("slope") > 0, "rising").when(F.col("slope") < 0, "falling").otherwise("flat")
    return fit.withColumn("direction", way)


def anomalies(values: DataFrame, points: int = 100, least_z: float = 3.0) -> DataFrame:
    """values(metric, start, value) -> those at least least_z deviations from the `points` before them."""
    before = W.partitionBy("metric").orderBy("start").rowsBetween(-points, -1)
    z = (F.col("value") - F.avg("value").over(before)) / F.nullif(F.stddev_samp("value").over(before), F.lit(0.0))
    return values.withColumn("z", z).where(F.abs("z") >= least_z).select("metric", "value", "z", "start")


def recent(rows: DataFrame, n: int, kinds: tuple[str, ...] = (), column: str = "kind") -> DataFrame:
    """The last n rows by time, of some kinds (or severities) if given."""
    chosen = rows.where(F.col(column).isin(*kinds)) if kinds else rows
    return chosen.orderBy(F.desc("ts"), F.desc("line_ord")).limit(n)


def subscription(kinds: tuple[str, ...] = (), min_latency: float | None = None, max_latency: float | None = None, severities: tuple[str, ...] = ()) -> Column:
    p = F.lit(True)
    if kinds:
        p &= F.col("kind").isin(*kinds)
    if min_latency is not None:
        p &= F.col("latency") >= min_latency
    if max_latency is not None:
        p &= F.col("latency") <= max_latency
    if severities:
        p &= F.col("severity").isin(*severities)
    return p
