import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from iotrail.schemas import BLOCK, CUSTOM, UFS
from iotrail.operators import derive
from iotrail.streaming import derive as live

from .test_derive import block_rows, simulate_block, simulate_ufs, ufs_rows

SCHEMA = {
    UFS: "line_ord long, time double, action string, tag long, opcode string, lba long, size long",
    BLOCK: "line_ord long, time double, action string, devmajor long, devminor long, io_type string, sector decimal(20,0), size long, comm string",
    CUSTOM: "line_ord long, opcode string, lba long, size long, start_time double, end_time double",
}


def custom_rows(seed, n):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 2])
        rows.append((i, rng.choice(["0x28", "0x2a"]), rng.choice([0, 8]), 8, t / 1000, (t + rng.choice([0, 1, 5, 9, 200])) / 1000))
    return rows


ROWS = {UFS: lambda s, n: ufs_rows(s, n), BLOCK: lambda s, n: [(*r[:6], Decimal(r[6]), *r[7:]) for r in block_rows(s, n)], CUSTOM: custom_rows}


def frame(spark, kind, rows):
    return spark.createDataFrame(rows, SCHEMA[kind]).withColumn("source", F.lit("s"))


def run(spark, tmp_path, kind, batches, restart_after=None, **options):
    """Each batch is a file of a stream; the query starts anew after some."""
    live.use_rocksdb(spark)
    schema = frame(spark, kind, []).schema
    out = str(tmp_path / "out")

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live.derive(stream, kind, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    (tmp_path / "in").mkdir()
    for k, batch in enumerate(batches):
        frame(spark, kind, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == restart_after:
            go()
    live.closing(spark, ["s"], schema, kind).select(*schema.names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    return spark.read.parquet(out)


def columns(kind):
    return ("start_qd", "end_qd", "ctoc", "ctod", "continuous") if kind == CUSTOM else ("qd", "dtoc", "ctoc", "ctod", "continuous")


@pytest.mark.parametrize("kind", [UFS, BLOCK, CUSTOM])
def test_stream_equals_batch_across_a_restart(spark, tmp_path, kind):
    """Batches cut anywhere between times, a restart between two of them."""
    rows = ROWS[kind](21, 150)
    time = 4 if kind == CUSTOM else 1
    times = sorted({r[time] for r in rows})
    cuts = [times[len(times) // 3], times[2 * len(times) // 3]]
    batches = [[r for r in rows if r[time] < cuts[0]], [r for r in rows if cuts[0] <= r[time] < cuts[1]], [r for r in rows if r[time] >= cuts[1]]]
    for b in batches:
        random.Random(1).shuffle(b)
    got = run(spark, tmp_path, kind, batches, restart_after=0)
    assert got.where("late").count() == 0
    value = lambda df: {r.line_ord: tuple(r[1:]) for r in df.select("line_ord", *columns(kind)).collect()}
    want = value(derive.derive(frame(spark, kind, rows), kind, buckets=1))
    assert value(got) == want
    if kind != CUSTOM:
        assert want == (simulate_ufs(rows) if kind == UFS else simulate_block([(*r[:6], int(r[6]), *r[7:]) for r in rows]))


@pytest.mark.parametrize("kind", [UFS, CUSTOM])
def test_rows_out_of_order_wait_and_late_ones_are_counted(spark, tmp_path, kind):
    """Within the delay order doesn't matter; what comes later than that is marked, counted once, and changes nothing."""
    rows = ROWS[kind](5, 120)
    time = 4 if kind == CUSTOM else 1
    rows = [r for r in rows if r[time] > 0.005]
    mixed = sorted(rows, key=lambda r: (r[time] + random.Random(r[0]).random() * 0.004))
    stray = [(1000 + k, *r[1:time], 0.001, *((0.002,) if kind == CUSTOM else r[time + 1 :])) for k, r in enumerate(rows[:3])]
    batches = [mixed[:40], [*mixed[40:80], stray[0]], [*mixed[80:], *stray[1:]]]
    got = run(spark, tmp_path, kind, batches, restart_after=1, delay=0.005)
    late = got.where("late")
    assert sorted(r.line_ord for r in late.collect()) == [1000, 1001, 1002] and late.where(F.col("ctoc").isNotNull()).count() == 0
    value = lambda df: {r.line_ord: tuple(r[1:]) for r in df.select("line_ord", *columns(kind)).collect()}
    assert value(got.where("not late")) == value(derive.derive(frame(spark, kind, rows), kind, buckets=1))


@pytest.mark.parametrize("kind", [UFS, BLOCK, CUSTOM])
def test_query_takes_times_that_repeat_far_apart(spark, tmp_path, kind):
    """Two copies of the events with the same times: none is late, and one log has one partition of state."""
    from iotrail import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    d = str(tmp_path / "twice")
    events.unionByName(events.withColumn("event_id", F.col("event_id") + 100_000)).write.parquet(f"{d}/events.parquet")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    with live.state_partitions(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1"
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    value = lambda df: {r.line_ord: tuple(r[1:]) for r in df.select("line_ord", *(c if c == "continuous" or "qd" in c else F.round(c, 6) for c in columns(kind))).collect()}
    got = value(queries.QUERIES[f"r8_live_derive_{kind}"](spark, d))
    assert got == value(derive.derive(queries.view(spark, d, kind), kind, buckets=1))
