"""Exact percentiles of very many values without a map of all of them, or a sort of most of them, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import forget, materialise

COARSE = 16


def _below(cuts: Column, v: Column) -> Column:
    """How many of the ascending cuts are below v: whole runs of COARSE of them are passed over first."""
    under = lambda some: F.size(F.filter(some, lambda c: c < v))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(cuts) / COARSE).cast("int"), F.lit(1))), lambda k: F.get(cuts, k * COARSE - 1))
    passed = under(runs) * COARSE
    return passed + under(F.slice(cuts, passed + 1, F.lit(COARSE)))


def _wanted(shares: Sequence[float], n: Column) -> Column:
    """The ranks, from 0, that the shares of n values lie between."""
    h = [F.lit(float(s)) * (n - 1) for s in shares]
    return F.array_distinct(F.array(*(f(x).cast("long") for x in h for f in (F.floor, F.ceil))))


def narrow(rows: DataFrame, shares: Sequence[float], buckets: int = 256, most: int = 1_000_000) -> DataFrame:
    """rows(g, v), written -> g, n, lo, hi, before, c: ranges of values [lo, hi] that hold every rank the shares need, with
    how many values are below and within. Each holds `most` rows at most or one value alone.

    A range that holds more is cut anew by the quantiles of a sketch over its own values. A value that is itself a cut is
    a range of its own, so frequent values can't keep a range from shrinking; every other range is about 1/`buckets`
    of the one before, however the values are spread."""
    ranges = materialise(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("c")), "percentile-ranges", 1)
    wide = (F.col("c") > most) & (F.col("lo") < F.col("hi"))
    at = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    while not ranges.where(wide).isEmpty():
        packed = ranges.where(wide).groupBy("g").agg(F.first("n").alias("n"), F.collect_list(F.struct("lo", "hi", "before")).alias("of"))  # two a share at most
        mine = F.get(F.filter("of", lambda r: (r["lo"] <= F.col("v")) & (F.col("v") <= r["hi"])), F.lit(0))
        placed = rows.join(packed, "g").select("g", "n", "v", mine.alias("r")).where("r is not null").select("g", "n", "v", F.col("r.lo").alias("of"), F.col("r.before").alias("base"))
        cuts = materialise(placed.groupBy("g", "of").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", at, 10_000))).alias("cuts")), "percentile-cuts", 1)
        below = placed.join(cuts, ["g", "of"]).withColumn("k", _below(F.col("cuts"), F.col("v")))
        below = below.withColumn("k", F.col("k") * 2 + F.coalesce(F.get("cuts", F.col("k")) == F.col("v"), F.lit(False)).cast("int"))
        parts = below.groupBy("g", "of", "k").agg(F.first("n").alias("n"), F.first("base").alias("base"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("c"))
        parts = parts.withColumn("before", F.col("base") + F.sum("c").over(W.partitionBy("g", "of").orderBy("k")) - F.col("c"))
        held = F.exists(_wanted(shares, F.col("n")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
        old = ranges
        ranges = materialise(parts.where(held).select(*old.columns).unionByName(old.where(~wide)), "percentile-ranges", 1)
        forget(old, cuts)
    return ranges


def two_pass(df: DataFrame, group: str, value: str, shares: Sequence[float], buckets: int = 256, most: int = 1_000_000) -> DataFrame:
    """(group, share, result): linear interpolation between ranks, as percentile() does. Only ranges of values that hold a
    wanted rank are sorted, `most` rows at most each. NULLs don't count."""
    rows = materialise(df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")), "percentile-values")
    ranges = narrow(rows, shares, buckets, most)
    packed = ranges.where("lo < hi").groupBy("g").agg(F.collect_list(F.struct("lo", "hi", "before")).alias("of"))
    mine = F.get(F.filter("of", lambda r: (r["lo"] <= F.col("v")) & (F.col("v") <= r["hi"])), F.lit(0))
    some = rows.join(packed, "g").select("g", "v", mine.alias("r")).where("r is not null")
    counted = some.groupBy("g", F.col("r.lo").alias("lo"), F.col("r.before").alias("before"), "v").agg(F.count(F.lit(1)).alias("c"))
    till = F.col("before") + F.sum("c").over(W.partitionBy("g", "lo").orderBy("v"))
    values = counted.select("g", "v", (till - F.col("c")).alias("first"), till.alias("till"))
    values = values.unionByName(ranges.where("lo = hi").select("g", F.col("lo").alias("v"), F.col("before").alias("first"), (F.col("before") + F.col("c")).alias("till")))
    asked = ranges.select("g", "n").distinct().select("g", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"), "n").withColumn("h", F.col("share") * (F.col("n") - 1))
    holds = lambda rank: (rank >= F.col("first")) & (rank < F.col("till"))
    hit = asked.join(values, "g").where(holds(F.floor("h")) | holds(F.ceil("h")))
    low, high = F.max(F.when(holds(F.floor("h")), F.col("v"))), F.max(F.when(holds(F.ceil("h")), F.col("v")))
    result = hit.groupBy("g", "share").agg((low + (high - low) * (F.first("h") - F.floor(F.first("h")))).alias("result"))
    return result.select(F.col("g").alias(group), "share", "result")
