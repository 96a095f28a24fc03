"""Queue depth, latencies and sequentiality of every event, as windows over buckets of each log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.events import OTHER, op_code, phase
from ..plans import scan
from ..schemas import BLOCK, CUSTOM, MILLISECONDS, UFS
from . import order

KEYS = ("source",)


def _ms(later: Column, earlier: Column) -> Column:
    return (later - earlier) * MILLISECONDS


def _step(p: Column) -> Column:
    return F.when(p == "I", 1).when(p == "C", -1).otherwise(0)


def _plain(df: DataFrame, drop: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nulls of "no value" become what stored files hold."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(False) if c == "continuous" else F.lit(0.0)))
    return df.drop(*drop, scan.BUCKET)


def ufs(df: DataFrame, keys: Sequence[str] = KEYS, buckets: int | None = None) -> DataFrame:
    """qd, dtoc, ctoc, ctod, continuous. A tag and opcode can be hot, so its state is carried over buckets too."""
    rows = order.with_rank(df, UFS).withColumn("__p", phase(F.col("action"))).drop("qd", "dtoc", "ctoc", "ctod", "continuous")
    trail = scan.Trail()
    rows = scan.bucketed(rows, keys, "time", buckets, trail)
    by = order.order_of(UFS)
    is_i, is_c = F.col("__p") == "I", F.col("__p") == "C"
    rows = scan.last_of_key(rows, keys, ("tag", "opcode"), by, "__pair", F.struct("__p", "time"), is_i | is_c, trail)
    rows = rows.withColumn("dtoc", F.when(is_c & (F.col("__pair")["__p"] == "I"), _ms(F.col("time"), F.col("__pair")["time"]))).drop("__pair")
    rows = scan.live(rows, keys, by, _step(F.col("__p")), {"__next": (F.struct((F.col("lba") + F.col("size")).alias("lba"), "opcode"), is_i)}, "time", trail)
    rows = rows.withColumn("ctoc", F.when(is_c, _ms(F.col("time"), F.col("__since"))))
    rows = rows.withColumn("ctod", F.when(is_i & (F.col("qd") == 1), _ms(F.col("time"), F.col("__idle"))))
    rows = rows.withColumn("continuous", is_i & (F.col("lba") == F.col("__next")["lba"]) & (F.col("opcode") == F.col("__next")["opcode"]))
    return _plain(rows, ("__rank", "__p", "__since", "__idle", "__next"), ("dtoc", "ctoc", "ctod", "continuous"))


def _queued() -> scan.Prior:
    pair = F.coalesce(F.col("action").isin("Q", "C"), F.lit(False))
    return scan.Prior(("devmajor", "devminor", "sector", "size", "comm"), F.struct((F.col("action") == "Q").alias("q"), "time"), pair)


def _queue_time(before: str) -> Column:
    return F.coalesce(F.when((F.col("action") == "C") & F.col(before)["q"], _ms(F.col("time"), F.col(before)["time"])), F.lit(0.0))


def qc_latency(df: DataFrame, keys: Sequence[str] = KEYS, buckets: int | None = None) -> DataFrame:
    """Block: dtoc of Q/C pairs by device, sector, size and command; 0 elsewhere."""
    trail, by, queued = scan.Trail(), order.order_of(BLOCK), _queued()
    rows = scan.bucketed(df, keys, "time", buckets, trail)
    rows = scan.prior(scan.met(rows, keys, scan.ahead(rows, keys, by, "__q", queued, trail), trail), keys, by, "__q", queued)
    return scan.alone(rows).withColumn("dtoc", _queue_time("__q")).drop("__q", scan.BUCKET)


def block(df: DataFrame, keys: Sequence[str] = KEYS, buckets: int | None = None, dedup: bool = True) -> DataFrame:
    """Pairs are matched by sector and class, and a log may hold few of them, so what they need is carried over buckets too.
    Reissued rows go before pairs are matched; what is carried for that is known from the rows as written."""
    rows = df.drop("qd", "dtoc", "ctoc", "ctod", "continuous")
    rows, trail, by = order.drop_empty_writes(rows) if dedup else rows, scan.Trail(), order.order_of(BLOCK)
    rows = scan.bucketed(rows, keys, "time", buckets, trail)
    rows = rows.withColumn("__p", phase(F.col("action"))).withColumn("__class", op_code(F.col("io_type")))
    queued, reissue, pair = _queued(), order.reissue(), scan.Prior(("sector", "__class"), F.struct((F.col("__p") == "I").alias("i"), "time"), F.col("__p") != "X")

    def kept(rows_ahead: dict[str, DataFrame]) -> DataFrame:
        met = scan.met(rows, keys, rows_ahead, trail)
        return order.without_reissued(scan.prior(met, keys, by, "__r", reissue), "__r") if dedup else met

    first = scan.ahead(rows, keys, by, "__r", reissue, trail) if dedup else {}
    left = scan.alone(kept(first))
    every = first | scan.ahead(left, keys, by, "__b", pair, trail)
    if trail.single or not rows.where(queued.when).isEmpty():  # most logs of several buckets hold no Q and C, which need a sort of their own
        rows = scan.prior(kept(every | scan.ahead(rows, keys, by, "__q", queued, trail)), keys, by, "__q", queued)
        rows = rows.withColumn("__d0", _queue_time("__q")).drop("__q")
    else:
        rows = kept(every).withColumn("__d0", F.lit(0.0))
    rows, known = scan.prior(rows, keys, by, "__b", pair), F.col("__class") != OTHER
    is_i, is_c = F.col("__p") == "I", F.col("__p") == "C"
    rows = scan.alone(rows).withColumn("dtoc", F.coalesce(F.when(is_c & F.col("__b")["i"], _ms(F.col("time"), F.col("__b")["time"])), "__d0")).drop("__b", "__d0")
    rows = scan.live(rows, keys, by, _step(F.col("__p")), {"__next": (F.struct((F.col("sector") + F.col("size")).alias("sector"), F.col("__class").alias("c")), is_i & known)}, "time", trail, left)
    rows = rows.withColumn("ctoc", F.when(is_c, _ms(F.col("time"), F.col("__since"))))
    rows = rows.withColumn("ctod", F.when(is_i, _ms(F.col("time"), F.col("__idle"))))
    rows = rows.withColumn("continuous", is_i & known & (F.col("sector") == F.col("__next")["sector"]) & (F.col("__class") == F.col("__next")["c"]))
    return _plain(rows, ("__p", "__class", "__since", "__idle", "__next"), ("dtoc", "ctoc", "ctod", "continuous"))


def custom(df: DataFrame, keys: Sequence[str] = KEYS, buckets: int | None = None) -> DataFrame:
    """start_qd and end_qd: requests as start and end events in time order, a request's start before its end. Starts among
    them are in the order of requests, so the one before a start tells ctoc, ctod and continuous in the same scan."""
    df = df.drop("ctoc", "ctod", "continuous", "start_qd", "end_qd")
    columns = df.columns
    ends = F.array(*(F.struct(F.col(t).alias("__t"), F.lit(k).alias("__k")) for k, t in enumerate(("start_time", "end_time"))))
    rows = df.select(*columns, F.explode(ends).alias("e")).select(*columns, "e.*")
    trail = scan.Trail()
    rows = scan.dealt(scan.bucketed(rows, keys, "__t", buckets, trail), keys, trail)
    by, start = ["__t", *order.order_of(CUSTOM), "__k"], F.col("__k") == 0
    before = F.struct("end_time", (F.col("lba") + F.col("size")).alias("lba"), "opcode")
    rows = scan.live(rows, keys, by, F.when(start, 1).otherwise(-1), {"__before": (before, start)}, "__t", trail)
    at = lambda k, c: F.max(F.when(F.col("__k") == k, F.col(c)))
    back = rows.groupBy(*keys, "line_ord").agg(F.first(F.struct(*columns)).alias("row"), at(0, "qd").alias("start_qd"), at(1, "qd").alias("end_qd"), F.first(F.when(start, F.col("__before")), ignorenulls=True).alias("__before"))
    rows = back.select("row.*", "start_qd", "end_qd", "__before")
    gap = lambda later: F.when(F.col("__before").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), later - F.col("__before")["end_time"]) * MILLISECONDS)
    rows = rows.withColumns({"ctoc": gap(F.col("end_time")), "ctod": gap(F.col("start_time"))})
    rows = rows.withColumn("continuous", (F.col("lba") == F.col("__before")["lba"]) & (F.col("opcode") == F.col("__before")["opcode"]))
    return _plain(rows, ("__before",), ("ctoc", "ctod", "continuous"))


def derive(df: DataFrame, kind: str, keys: Sequence[str] = KEYS, buckets: int | None = None) -> DataFrame:
    """keys = (source,) goes through each log as a whole; (source, iteration) starts anew each iteration."""
    return {UFS: ufs, BLOCK: block, CUSTOM: custom}[kind](df, keys, buckets)
