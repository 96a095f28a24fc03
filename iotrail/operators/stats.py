"""Statistics of events. All take any family's frame; as_items gives them common columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import is_aligned, item_type, phase_of
from ..plans.percentiles import two_pass
from ..schemas import BLOCK, CUSTOM, FLUSH_OPCODE, READ_OPCODE, UFS, WRITE_OPCODE, time_column
from ..work import forget, materialise

# The percentiles of the latency table and the default upper bounds of its histogram (ms).
PERCENTILES = {"p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999, "p99_999": 0.99999, "p99_9999": 0.999999}
RANGES = (0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0, 10000.0, 50000.0, 100000.0, 500000.0, 1000000.0)
DECIMALS = 3


def as_items(df: DataFrame, kind: str, align: str | int = "64KB", more: Sequence[Column] = ()) -> DataFrame:
    """item, phase, size, qd, dtoc, ctoc, ctod, continuous, aligned, and more columns if asked for."""
    aligned = F.col("aligned") if "aligned" in df.columns else is_aligned(kind, align)
    qd = F.col("start_qd" if kind == CUSTOM else "qd")
    return df.select(
        item_type(kind).alias("item"), phase_of(kind).alias("phase"), *([F.col("action")] if kind == BLOCK else []),
        "size", qd.alias("qd"), "dtoc", "ctoc", "ctod", F.col("continuous"), aligned.alias("aligned"), *more,
    )


# What counts as a request and as a completion of the block layer. If a log holds the first name anywhere, only
# that counts.
BLOCK_REQUESTS, BLOCK_COMPLETIONS = ("block_rq_issue", "Q"), ("block_rq_complete", "C")
SHARES = {"median": 0.5, **PERCENTILES}


def _who(kind: str) -> Column:
    if kind != BLOCK:
        return F.col("phase")
    return F.when(F.col("action").isin(*BLOCK_REQUESTS, *BLOCK_COMPLETIONS), F.col("action")).otherwise("X")


def _chosen(table: DataFrame, kind: str) -> tuple[DataFrame, Column, Column]:
    """A table of sums with `who`, and which of its rows are of requests and of completions. Which names a block log holds
    is seen from the sums, so what makes them runs once."""
    who = F.col("who")
    if kind != BLOCK:
        return table, who == "I", who == "C"
    table = materialise(table, "profile", 1)
    seen = {r.who for r in table.select("who").distinct().collect()}  # five at most
    pick = lambda names: who == next((n for n in names if n in seen), names[-1])
    return table, pick(BLOCK_REQUESTS), pick(BLOCK_COMPLETIONS)


def _place(v: Column, bounds: Sequence[float]) -> Column:
    place = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        place = F.when(v <= bounds[k], k).otherwise(place)
    return place


def _sums(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], quantiles, counts: dict[str, Column], whole: bool) -> DataFrame:
    """A row for each `by` and who: n, with `whole` what the summary needs, and what the latency tables need of metrics.
    Percentiles are made by an aggregation of their own, as with them all other sums would leave generated code."""
    out = [F.count(F.lit(1)).alias("n")]
    if whole:
        out += [F.max("qd").alias("max_qd"), F.sum("qd").alias("sum_qd"), *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("continuous", "aligned"))]
        for m in ("dtoc", "ctoc", "ctod"):
            v = F.col(m) if m == "dtoc" else F.when(F.col(m) > 0, F.col(m))
            out += [F.sum(v).alias(f"sum_{m}"), F.count(v).alias(f"n_{m}")]
        out += [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items() if n != "time"]
        if "time" in counts:
            out += [F.min(counts["time"]).alias("first_time"), F.max(counts["time"]).alias("last_time")]
    above = {m: F.when(F.col(m) > 0, F.col(m)) for m in metrics}
    for m, v in above.items():
        of = {"n": F.count(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0))}
        out += [c.alias(f"{m}_{n}") for n, c in of.items()]
    table = rows.groupBy(*by, "who").agg(*out)
    if not metrics:
        return table
    of_q = rows.groupBy(*by, "who").agg(*(quantiles(v, F.array(*map(F.lit, SHARES.values()))).alias(f"{m}_q") for m, v in above.items()))
    other = of_q.withColumnsRenamed({c: f"__{c}" for c in (*by, "who")})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "who")]
    table = table.join(other, same).drop(*(f"__{c}" for c in (*by, "who")))
    return table.select(*(c for c in table.columns if c.split("_")[0] not in metrics), *(F.struct(*(F.col(f"{m}_{n}").alias(n) for n in (*of, "q"))).alias(f"of_{m}") for m in metrics))


def _counts(rows: DataFrame, parts: Sequence[str], metrics: Sequence[str], ranges: Sequence[float]) -> DataFrame:
    """part, item, key, metric, who, n: parts size (key: the size) and ranges (key: the range, null for values not above 0).
    Rows are counted once by all that they are told apart by, and those counts are what each part adds up."""
    by = {f"__k_{m}": F.when(F.col(m) > 0, _place(F.col(m), ranges)) for m in metrics} if "ranges" in parts else {}
    counted = rows.groupBy("item", "who", *(["size"] if "size" in parts else []), *(c.alias(n) for n, c in by.items())).agg(F.count(F.lit(1)).alias("n"))
    one = lambda part, key, m=F.lit(None): F.struct(F.lit(part).alias("part"), key.cast("long").alias("key"), m.cast("string").alias("metric"))
    wanted = ([one("size", F.col("size"))] if "size" in parts else []) + [one("ranges", F.col(n), F.lit(n[4:])) for n in by]
    return counted.withColumn("x", F.explode(F.array(*wanted))).groupBy("x.part", "item", "x.key", "x.metric", "who").agg(F.sum("n").alias("n"))


def _profile(items: DataFrame, kind: str, parts: Sequence[str], metrics: Sequence[str] = (), ranges: Sequence[float] = RANGES, quantiles=F.percentile, counts: dict[str, Column] = {}) -> DataFrame:
    """All sums that the tables need: part, item, key, who, n and more. Parts: all, item (both in rows of the part `sums`), size,
    ranges. counts: more flags to be counted for the part `all`, and `time`, whose ends are kept. Items are gone through by up to three
    plain aggregations, none of which makes a row into several; if that is more than one, the caller writes them first."""
    rows, out = items.withColumn("who", _who(kind)).withColumn("item", F.col("item").cast("string")), []
    if "all" in parts or "item" in parts:
        sums = _sums(rows, ["item"] if "item" in parts else [], metrics if "item" in parts else (), quantiles, counts, "all" in parts)
        out.append(sums.withColumn("part", F.lit("sums")))
    if "size" in parts or "ranges" in parts:
        out.append(_counts(rows, parts, metrics, ranges))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)


def _summary(table: DataFrame, kind: str, request: Column, complete: Column) -> DataFrame:
    rows, total = table.where("part = 'sums'"), F.sum("n")
    mean = lambda m, who: F.sum(F.when(who, F.col(f"sum_{m}"))) / F.nullif(F.sum(F.when(who, F.col(f"n_{m}"))), F.lit(0))
    some = F.nullif(total, F.lit(0))
    return rows.agg(
        F.coalesce(total, F.lit(0).cast("long")).alias("n"), F.max("max_qd").alias("max_qd"), (F.sum("sum_qd") / some).alias("avg_qd"), mean("dtoc", complete).alias("avg_dtoc"), mean("ctoc", complete).alias("avg_ctoc"),
        mean("ctod", complete if kind == CUSTOM else request).alias("avg_ctod"), (F.sum("continuous") / some * 100).alias("continuous_pct"), (F.sum("aligned") / some * 100).alias("aligned_pct"),
    )


def _type_mix(table: DataFrame) -> DataFrame:
    per = table.where("part = 'sums'").groupBy("item").agg(F.sum("n").alias("n"))
    total = table.where("part = 'sums'").agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("item", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))  # one row


def _latency_table(table: DataFrame, metric: str, who: Column) -> DataFrame:
    rows = table.where("part = 'sums'").where(who).where(F.col(f"of_{metric}.n") > 0).select("item", f"of_{metric}.*")
    return _rounded(rows.select("*", *(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(SHARES))))


def _rounded(table: DataFrame) -> DataFrame:
    return table.select("item", "n", *(F.round(c, DECIMALS).alias(c) for c in ("avg", "min", "median", "max", "std", *PERCENTILES)))


def _histogram(table: DataFrame, metric: str, who: Column, bounds: Sequence[float]) -> DataFrame:
    counted = table.where("part = 'ranges' and key is not null").where(F.col("metric") == metric).where(who).groupBy("item", F.col("key").cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    labels = F.array(*(F.lit(x) for x in range_labels(bounds)))
    held = counted.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("held"))  # one entry a range
    every = held.select("item", "held", F.posexplode(labels).alias("bucket", "label"))
    return every.select("bucket", "label", "item", F.coalesce(F.try_element_at("held", F.col("bucket")), F.lit(0).cast("long")).alias("n"))


def _sizes(table: DataFrame, complete: Column) -> DataFrame:
    return table.where("part = 'size'").where(complete).select("item", F.col("key").alias("size"), "n")


def _latency_who(kind: str, metric: str, request: Column, complete: Column) -> Column:
    return complete if metric != "ctod" or kind == CUSTOM else request


def summary(items: DataFrame, kind: str) -> DataFrame:
    """One row: rows, greatest queue depth, mean latencies, shares of sequential and aligned rows (%)."""
    table, request, complete = _chosen(_profile(items, kind, ("all",)), kind)
    return _summary(table, kind, request, complete)


def type_mix(items: DataFrame) -> DataFrame:
    per = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = items.agg(F.count(F.lit(1)).alias("total"))
    return per.crossJoin(F.broadcast(total)).select("item", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))  # one row


def latency_table(items: DataFrame, kind: str, metric: str = "dtoc", mode: str = "exact", accuracy: int = 1_000_000) -> DataFrame:
    """Per item type: n, avg, min, median, max, std (0 for one value) and high percentiles, values above 0 only.

    mode: exact keeps a count per distinct value, approx a sketch, exact_two_pass sorts only what holds a rank."""
    if mode != "exact_two_pass":
        quantiles = F.percentile if mode == "exact" else lambda v, q: F.percentile_approx(v, q, accuracy)
        table, request, complete = _chosen(_profile(items, kind, ("item",), (metric,), quantiles=quantiles), kind)
        return _latency_table(table, metric, _latency_who(kind, metric, request, complete))
    v = F.when(F.col(metric) > 0, F.col(metric))
    rows = materialise(items.select("item", _who(kind).alias("who"), v.alias("v")), "latencies")
    base = rows.groupBy("item", "who").agg(F.count("v").alias("n"), F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))
    base, request, complete = _chosen(base, kind)
    who = _latency_who(kind, metric, request, complete)
    p = two_pass(rows.where(who), "item", "v", list(SHARES.values()))
    wide = p.groupBy("item").agg(*(F.max(F.when(F.abs(F.col("share") - s) < 1e-12, F.col("result"))).alias(n) for n, s in SHARES.items()))
    return _rounded(base.where(who).where("n > 0").join(wide, "item"))


def check_ranges(ranges: Sequence[float]) -> list[float]:
    bounds = [float(r) for r in ranges]
    if not bounds or bounds[0] < 0 or any(b <= a for a, b in zip(bounds, bounds[1:])):
        raise ValueError("ranges must not be negative and must ascend")
    return bounds


def range_labels(ranges: Sequence[float]) -> list[str]:
    b = [f"{x:g}" for x in ranges]
    return [f"≤ {b[0]}", *(f"{x} < v ≤ {y}" for x, y in zip(b, b[1:])), f"> {b[-1]}"]


def latency_histogram(items: DataFrame, kind: str, metric: str = "dtoc", ranges: Sequence[float] = RANGES) -> DataFrame:
    """bucket, label, item, n for every range and every item type that has a value, counts of 0 included."""
    bounds = check_ranges(ranges)
    table, request, complete = _chosen(_profile(items, kind, ("ranges",), (metric,), bounds), kind)
    return _histogram(table, metric, _latency_who(kind, metric, request, complete), bounds)


def size_distribution(items: DataFrame, kind: str) -> DataFrame:
    table, _, complete = _chosen(_profile(items, kind, ("size",)), kind)
    return _sizes(table, complete)


def _operations(kind: str) -> dict[str, Column]:
    if kind == BLOCK:
        is_ = [F.col("io_type").startswith("R"), F.col("io_type").startswith("W"), F.col("io_type").contains("S")]
    else:
        is_ = [F.col("opcode") == o for o in (READ_OPCODE, WRITE_OPCODE, FLUSH_OPCODE)]
    return dict(zip(("reads", "writes", "syncs"), is_))


def event_counts(df: DataFrame, kind: str) -> DataFrame:
    """One row: reads, writes, flushes and the first and last time."""
    time = time_column(kind)
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in _operations(kind).items()), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def quick_latency(df: DataFrame) -> DataFrame:
    return df.agg(F.min("dtoc").alias("min_dtoc"), F.max("dtoc").alias("max_dtoc"), F.avg("dtoc").alias("avg_dtoc"))


def report(df: DataFrame, kind: str, align: str | int = "64KB", ranges: Sequence[float] = RANGES) -> dict[str, DataFrame]:
    """The whole report of one family, table by table. The input is gone through once: the few columns that are needed
    are written, sums are made from them and written, and the tables are read from these."""
    bounds, latencies, time = check_ranges(ranges), ("dtoc", "ctoc", "ctod"), time_column(kind)
    flags = _operations(kind)
    more = [c.alias(f"__{n}") for n, c in flags.items()] + [F.col(time).alias("__time")]
    items = materialise(as_items(df, kind, align, more), "report-items")
    table = _profile(items, kind, ("all", "item", "size", "ranges"), latencies, bounds, counts={n: F.col(f"__{n}") for n in (*flags, "time")})
    table = materialise(table, "report", 1)
    forget(items)
    table, request, complete = _chosen(table, kind)
    out = {"summary": _summary(table, kind, request, complete), "types": _type_mix(table), "sizes": _sizes(table, complete)}
    out["counts"] = table.where("part = 'sums'").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), *(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in flags), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    for m in latencies:
        who = _latency_who(kind, m, request, complete)
        if kind != CUSTOM or m == "dtoc":
            out[f"latency_{m}"] = _latency_table(table, m, who)
        out[f"histogram_{m}"] = _histogram(table, m, who, bounds)
    return out
