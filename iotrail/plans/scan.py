"""Running state over one long ordered log without one long task.

A log is cut at times into buckets, which windows go through on their own; one row per bucket then carries
what later buckets must know. Results equal those of one window over the whole log. Cuts are a function of
time alone, so equal times stay together, and they are written once, so retried tasks agree.

The input is written once to the shared folder, and cuts, carried state and rows are read from there, so nothing before a
scan ever runs twice. live() carries all that a derivation needs in one state a bucket, without writing more; last_before()
and running_sum() are for single values, and write the rows that their window has gone through. If every log is small
enough for one bucket, nothing is carried; results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import forget, materialise

BUCKET = "__bucket"
AHEAD = "__ahead"
FINEST = 1 << 14  # quantiles of a log that are looked at, and so its most buckets


class Trail:
    """What one derivation has written: each step deletes the tables that it has read and leaves its own."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.single = False  # every log has one bucket
        self.tasks = 1

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        rows = materialise(df, name)
        forget(*self.tables)
        self.tables = [rows]
        return rows


def bucketed(df: DataFrame, keys: Sequence[str], time: str, buckets: int | None, trail: Trail, rows_a_bucket: int = 250_000) -> DataFrame:
    """df, written, with a column __bucket, ascending with time in each log.

    Each log has as many buckets as its rows need, FINEST at most; `buckets` sets a number for all, 1 for many small
    logs. A log with few distinct times has fewer. Only logs of several buckets are looked at for cuts, at eight times as
    many quantiles as the largest of them has buckets; a row finds its bucket by bisection."""
    if buckets == 1:
        trail.single = True
        return df.withColumn(BUCKET, F.lit(0))
    df = trail.settle(df, "scan-rows")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    largest, total = (x or 0 for x in counts.agg(F.max("__n"), F.sum("__n")).first())
    most, trail.tasks = buckets or -(-largest // rows_a_bucket), max(2 * (buckets or 1), 2 * -(-total // rows_a_bucket))
    if most <= 1:
        trail.single = True
        return df.withColumn(BUCKET, F.lit(0))
    fine = min(FINEST, max(64, 1 << (8 * most - 1).bit_length()))
    shares = F.expr(f"array({', '.join(f'{k / fine!r}D' for k in range(1, fine))})")
    long = df if buckets else df.join(counts.where(F.col("__n") > rows_a_bucket), list(keys), "left_semi")
    per = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(F.col(time).cast("double"), shares, max(10_000, 4 * fine)).alias("__all"))
    want = F.lit(min(buckets, fine)) if buckets else F.least(F.lit(fine), F.ceil(F.col("__n") / rows_a_bucket)).cast("int")
    chosen = F.when(want > 1, F.transform(F.sequence(F.lit(1), F.greatest(want - 1, F.lit(1))), lambda j: F.get(F.col("__all"), F.floor(j * fine / want).cast("int") - 1)))
    cuts = F.filter(F.array_distinct(F.coalesce(chosen, F.array().cast("array<double>"))), lambda c: c.isNotNull())
    cuts = materialise(per.select(*keys, cuts.alias("__cuts")), "scan-cuts", 1)
    if cuts.where(F.size("__cuts") > 0).isEmpty():
        trail.single = True
        return df.withColumn(BUCKET, F.lit(0))
    placed, step = df.join(cuts, list(keys), "left").withColumn(BUCKET, F.lit(0)), fine // 2
    while step:  # how many cuts are at most the row's time
        # Steps are powers of two, so bits are set where numbers would be added, which checks for overflow at each.
        passed = F.coalesce(F.get("__cuts", F.col(BUCKET).bitwiseOR(step - 1)) <= F.col(time), F.lit(False))
        placed, step = placed.withColumn(BUCKET, F.col(BUCKET).bitwiseOR(F.when(passed, step).otherwise(0))), step // 2
    return placed.drop("__cuts")


def dealt(df: DataFrame, keys: Sequence[str], trail: Trail) -> DataFrame:
    """Rows by bucket, over about two tasks a bucket: a number that is named is kept, where Spark would put buckets together
    by their compressed size, and a task would sort all of them."""
    return df if trail.single else df.repartition(trail.tasks, *keys, BUCKET)


def _local(keys: Sequence[str], order: Sequence[Column | str]):
    return W.partitionBy(*keys, BUCKET).orderBy(*order)


def live(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, lasts: dict[str, tuple[Column, Column]], time: str, trail: Trail, state: DataFrame | None = None) -> DataFrame:
    """All running state of a log at once: a counter `qd` that moves by step at each row and never goes below 0, after
    each row; `__since`, the time of the last row before that went down or that brought the counter to 1; `__idle`, that of the
    last one before that went down to 0; and for each name of lasts the value at the last row before where its
    condition holds.

    What rows of a bucket need to know of those before is one state: the counter q. With s the sum of steps in the
    bucket up to a row and m the least of 0 and all such sums, the counter is max(q + s, s - m). So a row goes down to 0
    where s = m and m <= -q, and brings it to 1 where s = m + 1 and m <= -q; as m never rises, only the last row of either
    kind has to be kept, with its m. States of buckets are put together in a window of one row a bucket; they are made in
    a pass of their own over the columns that they need, so the rows themselves are sorted once and written nowhere. `state`:
    the same rows made without what these columns don't need, for that pass."""
    upto, prior = (_local(keys, order).rowsBetween(W.unboundedPreceding, k) for k in (0, -1))
    down, up, mark = F.col("__d") < 0, F.col("__d") > 0, F.struct(F.col(time).alias("t"), F.col("__m").alias("m"))
    kept = {
        "done": F.when(down, F.struct(F.col(time).alias("t"))), "low": F.when(down & (F.col("__s") == F.col("__m")), mark), "first": F.when(up & (F.col("__s") == F.col("__m") + 1), mark),
        **{n: F.when(when, F.struct(value.alias("x"))) for n, (value, when) in lasts.items()},
    }

    def summed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__d", step).withColumn("__s", F.sum("__d").over(upto)).withColumn("__m", F.least(F.lit(0), F.min("__s").over(upto)))
        return rows.withColumns({f"__v_{n}": c for n, c in kept.items()})

    rows = summed(df)
    holds = lambda c, q: F.when(c["m"] <= -q, c["t"])
    local = rows.select("*", *(F.last(f"__v_{n}", ignorenulls=True).over(prior).alias(f"__l_{n}") for n in kept))
    if trail.single:
        q, carried = F.lit(0), {}
    else:
        rank = F.struct(*order)
        last = lambda n: F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), rank)).alias(f"b_{n}")
        per = (rows if state is None else summed(state)).groupBy(*keys, BUCKET).agg(F.sum("__d").alias("t"), F.min("__m").alias("m"), *(last(n) for n in kept))
        before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
        per = per.withColumn("__off", F.coalesce(F.sum("t").over(before), F.lit(0)))
        per = per.withColumn("__q", F.col("__off") - F.least(F.lit(0), F.coalesce(F.min(F.col("__off") + F.col("m")).over(before), F.lit(0))))
        per = per.withColumns({"b_since": F.greatest(F.col("b_done")["t"], holds(F.col("b_first"), F.col("__q"))), "b_idle": holds(F.col("b_low"), F.col("__q"))})
        per = per.select(*keys, BUCKET, "__q", *(F.last(f"b_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in ("since", "idle", *lasts)))
        local = local.join(per, [*keys, BUCKET])
        q, carried = F.col("__q"), {n: F.col(f"__c_{n}") for n in ("since", "idle", *lasts)}
    known = lambda n, here: F.coalesce(here, carried[n]) if n in carried else here
    out = {
        "qd": F.greatest(q + F.col("__s"), F.col("__s") - F.col("__m")).cast("long"),
        "__since": known("since", F.greatest(F.col("__l_done")["t"], holds(F.col("__l_first"), q))),
        "__idle": known("idle", holds(F.col("__l_low"), q)),
        **{n: known(n, F.col(f"__l_{n}"))["x"] for n in lasts},
    }
    return local.withColumns(out).drop("__d", "__s", "__m", "__q", *(f"__{p}_{n}" for p in "vl" for n in kept), *(f"__c_{n}" for n in carried))


def last_of_key(df: DataFrame, keys: Sequence[str], within: Sequence[str], order: Sequence[str], name: str, value: Column, when: Column, trail: Trail) -> DataFrame:
    """The value at the last row before of the same key `within` a log where the condition holds. Keys can be hot: a key's
    rows of a bucket are taken on their own. What went before comes in as one row more for each key and bucket, sorted
    before the others (its order is null) and left out afterwards, so rows are dealt out by bucket once, as live() needs them."""
    prior = W.partitionBy(*keys, BUCKET, *within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("__v", F.when(when, F.struct(value.alias("x"))))
    here = F.last("__v", ignorenulls=True).over(prior)
    if trail.single:
        return rows.withColumn(name, here["x"]).drop("__v")
    per = rows.groupBy(*keys, BUCKET, *within).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("v"))
    before = W.partitionBy(*keys, *within).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = per.select(*keys, BUCKET, *within, F.last("v", ignorenulls=True).over(before).alias("__v"), F.lit(True).alias("__more")).where(F.col("__v").isNotNull())
    both = dealt(rows.withColumn("__more", F.lit(False)).unionByName(carried, allowMissingColumns=True), keys, trail)
    return both.withColumn(name, here["x"]).where(~F.col("__more")).drop("__v", "__more")


class Prior(NamedTuple):
    """A value, never null, that rows need from the last row before of the same key `within` a log, among rows where a
    condition holds."""

    within: Sequence[str]
    value: Column
    when: Column


def ahead(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, prior: Prior, trail: Trail) -> dict[str, DataFrame]:
    """What buckets before have for each key of a bucket: a row of its own, none if every log has one bucket."""
    if trail.single:
        return {}
    rows = df.where(prior.when).select(*keys, BUCKET, *prior.within, F.struct(*order).alias("__o"), prior.value.alias("v"))
    per = rows.groupBy(*keys, BUCKET, *prior.within).agg(F.max_by("v", "__o").alias("v"))
    got = F.lag("v").over(W.partitionBy(*keys, *prior.within).orderBy(BUCKET))
    return {name: per.select(*keys, BUCKET, *prior.within, got.alias(f"__a_{name}"), F.lit(name).alias(AHEAD)).where(F.col(f"__a_{name}").isNotNull())}


def met(df: DataFrame, keys: Sequence[str], rows_ahead: dict[str, DataFrame], trail: Trail) -> DataFrame:
    """Rows and those that go ahead of them (their order is null), dealt out by bucket once for all prior() and live() after."""
    df = df.withColumn(AHEAD, F.lit(None).cast("string"))
    for more in rows_ahead.values():
        df = df.unionByName(more, allowMissingColumns=True)
    return dealt(df, keys, trail)


def prior(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, prior: Prior) -> DataFrame:
    """A column `name` with the value. Keys can be hot: a key's rows of a bucket are taken on their own."""
    carried = f"__a_{name}" in df.columns
    holds = F.coalesce(F.col(AHEAD) == name, prior.when)
    value = F.when(prior.when, prior.value)
    rows = df.withColumn("__w", holds).withColumn("__v", F.coalesce(F.col(f"__a_{name}"), value) if carried else value)
    before = F.lag("__v").over(W.partitionBy(*keys, BUCKET, *prior.within, "__w").orderBy(*order))
    return rows.withColumn(name, F.when(F.col("__w"), before)).drop("__w", "__v", f"__a_{name}")


def alone(df: DataFrame) -> DataFrame:
    """Without the rows that went ahead."""
    return df.where(F.col(AHEAD).isNull()).drop(AHEAD)


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[Column, Column]], trail: Trail) -> DataFrame:
    """For each name (value, condition): the value at the last row before this one where the condition holds.

    Null if there is none. `order` must be a total order of column names."""
    prior = _local(keys, order).rowsBetween(W.unboundedPreceding, -1)
    rows = df
    for name, (value, when) in values.items():
        rows = rows.withColumn(f"__v_{name}", F.when(when, F.struct(value.alias("x"))))
    rows = rows.select("*", *(F.last(f"__v_{n}", ignorenulls=True).over(prior).alias(f"__l_{n}") for n in values))
    if trail.single:
        return rows.withColumns({n: F.col(f"__l_{n}")["x"] for n in values}).drop(*(f"__{p}_{n}" for p in "vl" for n in values))
    rows = trail.settle(rows, "scan-last")
    rank = F.struct(*order)
    per = rows.groupBy(*keys, BUCKET).agg(*(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), rank)).alias(f"t_{n}") for n in values))
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, BUCKET, *(F.last(f"t_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values))
    joined = rows.join(per, [*keys, BUCKET])
    for n in values:
        joined = joined.withColumn(n, F.coalesce(f"__l_{n}", f"__c_{n}")["x"])
    return joined.drop(*(f"__{p}_{n}" for p in "vlc" for n in values))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, trail: Trail) -> DataFrame:
    upto = _local(keys, order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("__d", value).withColumn("__s", F.sum("__d").over(upto))
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    if trail.single:
        return rows.withColumn(name, F.col("__s")).drop("__d", "__s")
    rows = trail.settle(rows, "scan-sum")
    per = rows.groupBy(*keys, BUCKET).agg(F.sum("__d").alias("t")).select(*keys, BUCKET, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("__off"))
    return rows.join(per, [*keys, BUCKET]).withColumn(name, F.col("__off") + F.col("__s")).drop("__d", "__s", "__off")
