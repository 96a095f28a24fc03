import time

import pytest
from pyspark.sql import functions as F

from iotrail.schemas import TYPES
from iotrail.streaming import derive as live_derive
from iotrail.streaming import history
from iotrail.streaming import stats as live


def test_history_on_a_stream(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit(TYPES[0]).alias("kind"), (F.col("id") * 1.0).alias("latency"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.history(stream, "5 minutes", late="1 minute").writeStream.format("memory").queryName("history").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r.total, r.avg_latency, r.ufs_ratio) for r in spark.sql("select * from history order by start").collect()]
    assert got == [(30, 14.5, 1.0), (30, 44.5, 1.0)]


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("0x28,64,8,1.5,2.0\njunk\n\n")
    q = live.tail_logs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("tail").start()
    try:
        q.processAllAvailable()
        (tmp_path / "in/b.log").write_text("0x2a,64,8,1.5,2.5")
        time.sleep(0.1)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.d for r in spark.sql("select ufscustom.dtoc as d from tail where ufscustom is not null").collect()) == [500.0, 1000.0]


def test_late_rows_are_counted_across_restarts(spark, tmp_path):
    """Three batches with a restart between two of them, and one that runs twice: windows without the late rows, each late row
    counted once and kept."""
    batches = [[0, 10, 70, 200], [65, 5, 130, 400], [399, 299, 300, 59, 61, 1000]]  # seconds
    schema = "ts timestamp, kind string, latency double"
    frame = lambda rows: spark.createDataFrame([(float(t), TYPES[t % 3], t * 1.0) for t in rows], "t double, kind string, latency double").select(F.timestamp_seconds("t").alias("ts"), "kind", "latency")
    path = str(tmp_path / "history")

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = history.keep_history(stream, path, str(tmp_path / "check"), "1 minute", "100 seconds", keep_rows=True)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for k, rows in enumerate(batches):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:
            go()
    history.write_batch(frame(batches[2]), 2, path, "1 minute", "100 seconds", keep_rows=True)  # as after a failure
    kept, late, high = {}, {}, None
    for rows in batches:
        for t in rows:
            gone = high is not None and (t // 60 + 1) * 60 <= high - 100
            where = late if gone else kept
            where.setdefault(t // 60 * 60, []).append(t)
        high = max([high or 0, *rows])
    seen = lambda: {int(r.start.timestamp()): (r.total, r.avg_latency, r.min_latency, r.max_latency, r.ufs_ratio) for r in history.read_history(spark, path).collect()}
    want = {s: (len(x), sum(x) / len(x), min(x), max(x), sum(t % 3 == 0 for t in x) / len(x)) for s, x in kept.items()}
    counted = lambda: {int(r.start.timestamp()): r.total for r in history.late_counts(spark, path).collect()}
    assert sum(map(len, late.values())) == 4
    for _ in range(2):
        assert seen() == want and counted() == {s: len(x) for s, x in late.items()}
        history.compact(spark, path, 3)
    assert sorted(r.latency for r in history.late_rows(spark, path).collect()) == sorted(t for x in late.values() for t in x)
    assert history.mark_before(spark, path, 3).first().last_ts.timestamp() == 1000


def test_from_appended_files_to_derived_rows(spark, tmp_path):
    """Lines of three families are appended, the file is rotated, the queries start anew, and one row comes late: derived rows
    are those of the batch functions over all lines."""
    from iotrail.functions import parse
    from iotrail.operators import derive as batch
    from iotrail.schemas import BLOCK, CUSTOM, UFS
    from iotrail.sources import logs

    live_derive.use_rocksdb(spark)
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs/a.log"
    ufs = lambda t, act, tag: f"p-1 [001] ..... {t:.6f}: ufshcd_command: {act}: dev0: tag: {tag}, DB: 0x0, size: 4096, IS: 0, LBA: {tag}, opcode: 0x28 (X), group_id: 0x0, hwq_id: 1\n"
    block = lambda t, act, sector: f"p-1 [001] ..... {t:.6f}: {act}: 8,0 R () {sector} + 8 [c]\n"
    first = ufs(1, "send_req", 3) + ufs(2, "send_req", 4) + block(1, "block_rq_issue", 8) + "0x28,0,8,1.0,5.0\n" + ufs(3, "complete_rsp", 3)[:40]
    second = ufs(3, "complete_rsp", 3)[40:] + block(2, "block_rq_issue", 16) + block(3, "block_rq_complete", 8) + "0x28,8,8,2.0,3.0\n"
    third = ufs(4, "complete_rsp", 4) + ufs(4.5, "send_req", 3) + block(4, "block_rq_complete", 16) + "0x2a,0,8,3.5,3.75\n0x2a,8,8,9.0,9.5\n"
    late = ufs(0.5, "send_req", 9)

    def go(*steps):
        queries = [live.follow(spark, f"{tmp_path}/logs/*", f"{tmp_path}/state/{k}", k).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check/{k}").start(f"{tmp_path}/out/{k}") for k in TYPES]
        try:
            for step in (lambda: None, *steps):
                step()
                for _ in range(2):
                    for q in queries:
                        q.processAllAvailable()
        finally:
            for q in queries:
                q.stop()

    def add(text):
        with open(log, "a") as f:
            f.write(text)

    def rotate():
        add(second)
        log.rename(tmp_path / "logs/a.log.1")

    add(first)
    go(rotate)
    with open(tmp_path / "logs/a.log.1", "a") as f:  # the writer still has it open
        f.write(third)
    go(lambda: (tmp_path / "logs/a.log.1").open("a").write(late))
    (tmp_path / "whole.log").write_text(first + second + third)
    lines = logs.read_log_lines(spark, str(tmp_path / "whole.log"))
    for kind, names in ((UFS, ("qd", "dtoc", "ctoc", "ctod", "continuous")), (BLOCK, ("qd", "dtoc", "ctoc", "ctod", "continuous")), (CUSTOM, ("start_qd", "end_qd", "dtoc", "ctoc", "ctod", "continuous"))):
        time = "start_time" if kind == CUSTOM else "time"
        got = spark.read.parquet(f"{tmp_path}/out/{kind}")
        want = batch.derive(parse.events(parse.parse_log(lines), kind), kind)
        if kind == CUSTOM:
            want = want.where("start_time < 9")  # what ends after the last start still waits
        rows = lambda df: sorted(map(tuple, df.select(time, *names).collect()))
        assert rows(got.where("not late")) == rows(want) and len(rows(want)) >= 3
        assert [r[time] for r in got.where("late").collect()] == ([0.5] if kind == UFS else [])


def test_alerts_and_anomalies(spark):
    start = F.timestamp_seconds(F.col("id") * 60)
    values = spark.range(50).select(F.lit("m").alias("metric"), start.alias("start"), F.when(F.col("id") == 40, 100.0).otherwise(F.col("id") % 3).cast("double").alias("value"))
    assert [r.value for r in live.anomalies(values, 30, 5.0).collect()] == [100.0]
    up = spark.range(10).select(F.lit("m").alias("metric"), start.alias("start"), F.col("id").cast("double").alias("value"))
    t = live.trend(up).first()
    assert t.direction == "rising" and t.slope == pytest.approx(1 / 60) and t.confidence == pytest.approx(1)
