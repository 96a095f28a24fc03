"""Canonical order, repeated and reissued events, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.events import op_code
from ..plans import scan
from ..schemas import BLOCK, CUSTOM, UFS, time_column

# The order of events and the keys by which they repeat.
ORDER = {UFS: ("time", "__rank", "tag"), BLOCK: ("time", "sector", "size"), CUSTOM: ("start_time", "lba", "size")}
REPEATS = {UFS: ("time", "tag", "action", "opcode"), BLOCK: ("time", "sector", "size", "io_type"), CUSTOM: ("start_time", "lba", "size")}


def with_rank(df: DataFrame, kind: str) -> DataFrame:
    """UFS completions come before requests of the same time."""
    if kind != UFS:
        return df
    return df.withColumn("__rank", F.when(F.col("action").startswith("c"), 0).when(F.col("action").startswith("s"), 1).otherwise(2))


def order_of(kind: str) -> list[str]:
    return [*ORDER[kind], "line_ord"]


def drop_repeated(df: DataFrame, kind: str) -> DataFrame:
    """The first of each key in a log."""
    rank = F.row_number().over(W.partitionBy("source", *REPEATS[kind]).orderBy("line_ord"))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def drop_empty_writes(df: DataFrame) -> DataFrame:
    """Block: a flush is logged twice, once as a write completion of size 0."""
    return df.where(~F.coalesce((F.col("action") == "block_rq_complete") & F.col("io_type").startswith("W") & (F.col("size") == 0), F.lit(False)))


def reissue() -> scan.Prior:
    """Whether the issue or completion before was an issue, of the same sector, class and size (a column __class)."""
    ends = F.coalesce(F.col("action").isin("block_rq_issue", "block_rq_complete"), F.lit(False))
    return scan.Prior(("sector", "__class", "size"), F.coalesce(F.col("action") == "block_rq_issue", F.lit(False)), ends)


def without_reissued(df: DataFrame, before: str) -> DataFrame:
    again = (F.col("action") == "block_rq_issue") & F.col(before)
    return df.where(~F.coalesce(again, F.lit(False))).drop(before)


def drop_reissued(df: DataFrame, keys: Sequence[str] = ("source",), buckets: int | None = None) -> DataFrame:
    """Block: an issue goes while one of the same sector, class and size is outstanding; run after drop_empty_writes."""
    trail, by = scan.Trail(), order_of(BLOCK)
    rows = scan.bucketed(df, keys, "time", buckets, trail).withColumn("__class", op_code(F.col("io_type")))
    rows = scan.prior(scan.met(rows, keys, scan.ahead(rows, keys, by, "__r", reissue(), trail), trail), keys, by, "__r", reissue())
    return scan.alone(without_reissued(rows, "__r")).drop("__class", scan.BUCKET)


def head(df: DataFrame, kind: str, n: int) -> DataFrame:
    """The first n rows in order with a running index and the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    first = with_rank(df, kind).orderBy("source", *order_of(kind)).limit(n)
    index = F.row_number().over(W.orderBy("source", *order_of(kind))) - 1
    return first.withColumn("index", index).drop("__rank").crossJoin(F.broadcast(total))  # n rows by one


def by_latency(df: DataFrame) -> DataFrame:
    return df.orderBy("dtoc", "source", "line_ord")
