import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from iotrail import queries
from iotrail.functions import parse
from iotrail.functions.events import alignment_kb
from iotrail.operators import bench, filters, series, sinks
from iotrail.schemas import BLOCK, CUSTOM, UFS, event_type
from iotrail.sources import events, logs

UFS_OK = "kworker/0:1-33 [002] ..... 1234.567890: ufshcd_command: send_req: 1d84000.ufshc: tag: 5, DB: 0x0, size: 4097, IS: 0, LBA: 128, opcode: 0x28 (READ_10), group_id: 0xa, hwq_id: 3"
BLOCK_OK = "kworker/0:1-33 [002] ..... 1234.5: block_rq_issue: 8,0 WS 4096 () 18446744073709551615 + 8 be,0,4 [kworker/0:1]"
LINES = [
    (UFS_OK, UFS), (UFS_OK.replace("4097", "-1").replace("hwq_id: 3", "hwq_id: -1").replace("LBA: 128", "LBA: 2305843009213693951"), UFS), (UFS_OK.replace("LBA: 128", "LBA: 281474976710657"), UFS),
    (UFS_OK.replace("send_req", "uic_send"), None), (BLOCK_OK, BLOCK), ("x blk_y", None), ("1.5,0,8,0,77,Q,WS,0,8,fio, x", BLOCK), ("time,cpu,major,minor,pid,action,rwds,sector,size,comm", None),
    ("0x28,64,8,1.5,2.0", CUSTOM), ("0x2A,64,8,1.5,2.0", CUSTOM), ("0x28,64,x,1.5,2.0", None), ("0x28,64,8,1.5", None), ("0xzz,1,1,1,1", None), ("opcode,lba,size,start_time,end_time", None), ("// c", None), ("junk", None),
]


def test_lines(spark):
    df = spark.createDataFrame([("s", i, x) for i, (x, _) in enumerate(LINES)], "source string, line_ord long, line string")
    parsed = parse.parse_log(df)
    kinds = {r.line_ord: next((k for k in (UFS, BLOCK, CUSTOM) if r[k] is not None), None) for r in parsed.collect()}
    assert kinds == {i: k for i, (_, k) in enumerate(LINES)}
    u = {r.line_ord: r for r in parse.events(parsed, UFS).collect()}
    assert (u[0].time, u[0].process, u[0].cpu, u[0].tag, u[0].lba, u[0].size, u[0].groupid, u[0].hwqid, u[0].aligned) == (1234.56789, "kworker/0:1-33", 2, 5, 128, 2, 10, 3, True)
    assert (u[1].size, u[1].hwqid, u[1].lba, u[2].lba) == (1, 0, 0, 0)
    b = {r.line_ord: r for r in parse.events(parsed, BLOCK).collect()}
    assert (int(b[4].sector), b[4].extra, b[4].comm, b[4].io_type) == (18446744073709551615, 4096, "kworker/0:1", "WS")
    assert (b[6].process, b[6].comm, b[6].flags) == ("77", "fio, x", "")
    c = {r.line_ord: r.dtoc for r in parse.events(parsed, CUSTOM).collect()}
    assert c == {8: 500.0, 9: 500.0}
    assert {r.category: (r.lines, r.parsed) for r in parse.report(parsed).collect()}[UFS] == (4, 3)
    assert {r.line_ord for r in parse.parse_custom_strict(df).collect()} == {8}


@pytest.mark.parametrize("byte", ["\x01", "\x00", "\x02", "\x1f", "\x85", "\u2028"])
def test_control_bytes_in_lines(spark, byte):
    """Bytes that could be taken for separators are text like any other in every family, and make no event of junk."""
    rows = [
        (UFS_OK.replace("kworker", f"k{byte}w"), UFS), (BLOCK_OK.replace("[kworker/0:1]", f"[c{byte}d]"), BLOCK), (f"1.5,0,8,0,77,Q,WS,0,8,fi{byte}o", BLOCK), ("ufshcd_command:" + byte * 10, None),
        (byte + byte.join(["ufshcd_command:", *"123456789"]), None), ("block_" + byte * 12, None), (f"1.5,0,8,0,77,Q,WS,0,{byte},x", None), ("0x28,64,8,1.5,2.0" + byte * 5, None), (f"0x28{byte},64,8,1.5,2.0", None),
        ("ufshcd_command:" + "\n1" * 10, None), ("0x28,6\n4,8,1.5,2.0", None), ("0x28\n,64,8,1.5,2.0", None),
    ]
    df = spark.createDataFrame([("s", i, x) for i, (x, _) in enumerate(rows)], "source string, line_ord long, line string")
    for how in (parse.parse_log, parse.parse_permissive):
        parsed = how(df)
        kinds = {r.line_ord: next((k for k in (UFS, BLOCK, CUSTOM) if r[k] is not None), None) for r in parsed.collect()}
        assert kinds == {i: k for i, (_, k) in enumerate(rows)}
        assert parse.events(parsed, UFS).first().process == f"k{byte}w/0:1-33"
        assert {r.line_ord: r.comm for r in parse.events(parsed, BLOCK).collect()} == {1: f"c{byte}d", 2: f"fi{byte}o"}
    strict = spark.createDataFrame([("s", 0, "0x28,64,8,1.5,2.0"), ("s", 1, f"0x28{byte}0x28" + byte * 4), ("s", 2, "0x28\n1\n1\n1\n1")], "source string, line_ord long, line string")
    assert [r.line_ord for r in parse.parse_custom_strict(strict).collect()] == [0] and parse.strict_counts(strict).first().parsed == 1


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("\n".join(f" line {i} " for i in range(2000)).encode() + b"\n\n \t\nbad \xff line\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.read_log_lines(spark, str(tmp_path / "a.log")).orderBy("line_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == [f" line {i} " for i in range(2000)] + ["last"]
    assert len({r.line_ord for r in rows}) == 2001
    plan = logs.read_log_lines(spark, str(tmp_path / "a.log"))._jdf.queryExecution().toString().rsplit("Physical Plan", 1)[-1]
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan
    (tmp_path / "b.log").write_bytes("Größe\r\nzwei\n".encode("latin-1"))
    assert [r.line for r in logs.read_log_lines(spark, str(tmp_path / "b.log"), "ISO-8859-1").orderBy("line_ord").collect()] == ["Größe", "zwei"]


def test_order_over_splits_of_many_files(spark, tmp_path):
    """Several splits of several files a task, in whatever order Spark packs them."""
    want = {}
    for k, n in enumerate((5000, 20, 3000, 1)):
        want[f"{k}.log"] = [f"{k} line {i}" for i in range(n)]
        (tmp_path / f"{k}.log").write_text("\n".join(want[f"{k}.log"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = logs.read_log_lines(spark, str(tmp_path)).orderBy("source", "line_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r.source.rsplit("/", 1)[-1], []).append(r.line)
    assert got == want


def test_archives(spark, tmp_path):
    assert [logs.archive_kind(n) for n in ("a.tar", "A.TAR.GZ", "x.tgz", "x.txz", "x.tar.xz", "x.zip", "x.log")] == ["tar", "gz", "gz", "xz", "xz", "zip", None]
    for name, mode in (("a.tar", "w"), ("b.tgz", "w:gz"), ("c.tar.xz", "w:xz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, text in (("small.log", "no\n"), ("x/big.txt", f"{name}\n\n two \r\n" * 3), ("huge.bin", "z" * 9999)):
                info = tarfile.TarInfo(member)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("disk-events.0", "one\ntwo")
    got = {}
    for r in logs.read_archived_lines(spark, str(tmp_path), marks=("events",)).orderBy("line_ord").collect():
        got.setdefault(r.source.rsplit("/", 1)[-1], []).append(r.line)
    assert got == {n: [n, " two "] * 3 for n in ("a.tar", "b.tgz", "c.tar.xz")} | {"d.zip": ["one", "two"]}


def test_large_archives_are_streamed(tmp_path):
    """A member of 200 MB goes by in batches of a few MB."""
    import tracemalloc

    line = ("x" * 999 + "\n").encode()
    with tarfile.open(tmp_path / "big.tgz", "w:gz", compresslevel=1) as t:
        info = tarfile.TarInfo("big.log")
        info.size = 200_000 * len(line)

        class Endless(io.RawIOBase):
            at = 0

            def read(self, n):
                begin, self.at = self.at % 1000, self.at + n
                return (line * (n // 1000 + 2))[begin : begin + n]

        t.addfile(info, Endless())
    reader = logs.ArchiveReader({"path": str(tmp_path), "batch": "50000", "marks": "[]"})
    tracemalloc.start()
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and most < 64 << 20


def test_archives_that_only_spark_opens(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.log", "one\n\n two")
    monkeypatch.setattr(logs, "_opens", lambda path: False)
    assert [(r.line_ord, r.line) for r in logs.read_archived_lines(spark, str(tmp_path)).collect()] == [(0, "one"), (2, " two")]


def test_filters_and_options():
    f = filters.parse_filter(["time:1:5", "lba:8:0", "cpu:0-2,7", "cpu:1", "qd:0:4"])
    assert (f.start_time, f.end_time, f.start_address, f.cpus, f.max_qd) == (1, 5, 8, (0, 1, 2, 7), 4)
    for bad in ("time:5:1", "cpu:3-1", "x:1:2", "dtoc:1", "dtoc:-1:2"):
        with pytest.raises(ValueError):
            filters.parse_filter([bad])
    assert [alignment_kb(x) for x in ("64KB", "1mb", "2GB", "4096", 65536)] == [64, 1024, 2 << 20, 4, 64]
    assert series.parse_y_range("dtoc:0:5") == ("dtoc", 0.0, 5.0)
    assert [sinks.codec_for(n, UFS) for n in (10, 20_000, 200_000, 2_000_000)] == [("snappy", None), ("zstd", 3), ("zstd", 6), ("zstd", 9)]
    with pytest.raises(ValueError):
        event_type(["a"])


def test_filter_is_pushed_down(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = sinks.write_events(spark.createDataFrame([(1.0, 3)], "time double, cpu long"), str(tmp_path / "x"), UFS)
    plan = filters.filter_events(events.read_events(spark, path, UFS), ["time:1:5", "cpu:3"], UFS).select("time")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(time,1.0)" in plan and "EqualTo(cpu,3)" in plan and "process" not in plan.rsplit("ReadSchema", 1)[-1]


def test_migration(spark, tmp_path):
    old = spark.createDataFrame([("0x28", 1, 8, 1.0, 2.0, 1000.0, 7)], "opcode string, lba long, size long, start_time double, end_time double, dtoc double, qd long")
    old.write.parquet(str(tmp_path / "old"))
    (tmp_path / "bad").mkdir()
    done = events.migrate_dir(spark, [str(tmp_path / "old"), str(tmp_path / "bad")], str(tmp_path / "new"))
    assert [(m.kind, m.changed, m.error is None) for m in done] == [(CUSTOM, True, True), (None, False, False)]
    row = spark.read.parquet(str(tmp_path / "new/old")).first()
    assert (row.start_qd, row.end_qd, row.continuous) == (7, 0, False)
    assert events.is_current(spark.read.parquet(str(tmp_path / "new/old")), CUSTOM)


def test_migration_keeps_datasets_of_one_name_apart(spark, tmp_path):
    for k, place in enumerate(("a/log.parquet", "b/c/log.parquet", "d.parquet")):
        rows = [("0x28", i, 8, 1.0, 2.0, 1000.0) for i in range(k + 1)]
        spark.createDataFrame(rows, "opcode string, lba long, size long, start_time double, end_time double, dtoc double").write.parquet(str(tmp_path / "in" / place))
    for paths in (str(tmp_path / "in"), [str(tmp_path / "in" / p) for p in ("a/log.parquet", "b/c/log.parquet", "d.parquet")]):
        done = events.migrate_dir(spark, paths, str(tmp_path / f"out-{type(paths).__name__}"))
        assert [spark.read.parquet(m.target).count() for m in done] == [1, 2, 3] and all(m.kind == CUSTOM for m in done)


def test_migration_of_many_files_in_two_jobs(spark, tmp_path):
    """Sixty datasets of two schemas, in files and folders, with odd names, an empty one and a broken one."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    old = lambda k, n: pa.table({"opcode": ["0x28"] * n, "lba": pa.array([k] * n, pa.int64()), "size": pa.array([8] * n, pa.int64()), "start_time": [1.0] * n, "end_time": [2.0] * n, "dtoc": [1000.0] * n})
    want = {}
    for k in range(60):
        name = f"d {k % 3}/x%{k}.parquet"
        n = 0 if k == 7 else k % 4 + 1
        table = old(k, n) if k % 2 else old(k, n).append_column("qd", pa.array([9] * n, pa.int64()))
        if k % 5:
            (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
            pq.write_table(table, tmp_path / "in" / name)
        else:
            (tmp_path / "in" / name).mkdir(parents=True)
            for part in range(2):
                pq.write_table(table, tmp_path / "in" / name / f"part-{part}.parquet")
            n *= 2
        want[name] = (n, k, 0 if k % 2 else 9)
    (tmp_path / "in/bad.parquet").write_text("no")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() if hasattr(spark.sparkContext._jsc.sc().dagScheduler(), "nextJobId") else None
    done = events.migrate_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert before is None or spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 20
    got = {m.path.rsplit("/in/", 1)[1]: m for m in done}
    assert got.keys() == {*want, "bad.parquet"} and got["bad.parquet"].error and got["bad.parquet"].target is None
    for name, (n, lba, qd) in want.items():
        assert got[name].kind == CUSTOM and got[name].changed and got[name].error is None
        rows = spark.read.parquet(str(tmp_path / "out" / name)).collect() if lba in (0, 7, 10, 33, 59) else None
        assert rows is None or (len(rows) == n and all((r.lba, r.start_qd) == (lba, qd) for r in rows))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").glob("*/*.parquet")) == sorted(want)


def test_csv_files(spark, tmp_path):
    df = spark.range(100).select((F.col("id") / 10).alias("start_time"), (F.col("id") / 10 + 1).alias("end_time"), F.lit("0x28").alias("opcode"))
    index = sinks.write_csv(df, str(tmp_path / "csv"), CUSTOM, most_rows=30).orderBy("first_time").collect()
    assert sum(r.rows for r in index) == 100 and max(r.rows for r in index) <= 30
    assert all(a.last_time <= b.first_time for a, b in zip(index, index[1:]))
    import csv

    files = {p.name: list(csv.DictReader(p.open())) for p in (tmp_path / "csv").glob("*.csv")}
    assert files.keys() == {r.file for r in index}
    for r in index:
        times = [float(x["start_time"]) for x in files[r.file]]
        assert r.file == f"ufscustom_{r.first_time:g}_{r.last_time:g}.csv" and (len(times), min(times), max(times)) == (r.rows, r.first_time, r.last_time)
    same = sinks.write_csv(df.withColumn("start_time", F.lit(2.5)), str(tmp_path / "same"), CUSTOM, most_rows=40)
    assert sorted(r.file for r in same.collect()) == ["ufscustom_2.5_2.5.csv", "ufscustom_2.5_2.5_2.csv", "ufscustom_2.5_2.5_3.csv"]


def test_iterations(spark):
    lines = ["x", "--- FIO test (Iteration 3) ---", "  WRITE: bw=604MiB/s (633MB/s)", "| Write   1024 MBs |    0.5 s | 1938.124 MB/s | x |", "| Random Write 10 MBs | 1 s | 2 MB/s | x |", "   1048576  1024 2226634 0 9045852 0", "--- FIO test (Iteration 1) ---", "   READ: bw=3190MiB/s", "Parent sees throughput for 8 random readers = 1024.00 kB/sec"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, line_ord long, line string")
    for buckets in (1, 4):
        tagged = bench.assign_iteration(df, buckets)
        assert [r.iteration for r in tagged.orderBy("line_ord").collect()] == [0, 3, 3, 4, 4, 5, 1, 1, 1]
    found = {(r.iteration, r.tool, r.test_type): r.bandwidth for r in bench.results(tagged).collect()}
    assert found == {(3, "FIO", "WRITE"): 604.0, (4, "TIOtest", "Write"): 1938.124, (4, "TIOtest", "Random Write"): 2.0, (5, "IOzone", "Sequential"): 2226634.0, (1, "FIO", "READ"): 3190.0, (1, "IOzone", "Random Read"): 1.0}
    table = {(r.iteration, r.tool): (r.write, r.read) for r in bench.results_table(bench.results(tagged)).collect()}
    assert table == {(3, "FIO"): (604.0, None), (4, "TIOtest"): (2.0, None), (1, "FIO"): (None, 3190.0), (1, "IOzone"): (None, 1.0)}


def test_log_to_parquet_of_all_families(spark):
    d = "/root/testdata/sf0.001"
    block = {r.line_ord: r for r in queries.view(spark, d, BLOCK).where("line_ord % 4 in (1, 2)").collect()}
    before, n, reissued = {}, 0, 0
    for r in sorted(block.values(), key=lambda r: (r.time, r.sector, r.size, r.line_ord)):
        if r.line_ord % 4 == 1 and r.action != "block_rq_insert":  # the lines of odd form are Q and C, which stay
            if r.action == "block_rq_complete" and r.io_type.startswith("W") and r.size == 0:
                continue
            key = (r.sector, r.io_type[0] if r.io_type[0] in "RWD" else "", r.size)
            again, before[key] = r.action == before.get(key) == "block_rq_issue", r.action
            if again:
                reissued += 1
                continue
        n += 1
    got = {r.kind: r.n for r in queries.QUERIES["k7_log_to_parquet"](spark, d).collect()}
    assert reissued and got[BLOCK] == n
    ufs = queries.view(spark, d, UFS)
    assert got[UFS] == ufs.where("line_ord % 4 = 0 and action <> 'other'").count()
    assert got[CUSTOM] == ufs.where("line_ord % 4 = 3 and line_ord % 24 not in (3, 7)").count()


def test_lines_are_made_without_a_join(spark):
    """Four forms of a line come from one row, so no task sorts the table against itself (p6_control_bytes)."""
    plan = queries.lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" in plan


@pytest.mark.parametrize("name", ["k7_log_to_parquet", "k7_log_to_parquet_without_repeats"])
def test_log_job_is_one_log_however_many_files(spark, tmp_path, name):
    """Two copies with the same times, in several files, against the query's SQL."""
    import duckdb

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    d = str(tmp_path / "twice")
    e.unionByName(e.withColumn("event_id", F.col("event_id") + 100_000)).repartition(5).write.parquet(f"{d}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{d}/events.parquet/*.parquet'")
    got = {r.kind: r.n for r in queries.QUERIES[name](spark, d).collect()}
    assert got == dict(con.sql(queries.SQL[name]).fetchall())


def test_written_files_hold_ranges_of_time(spark, tmp_path):
    """A table that is written sorts about rows_a_file rows a task, and its files don't overlap in time."""
    rows = queries.view(spark, "/root/testdata/sf0.001", UFS)
    n = rows.count()
    path = sinks.write_events(rows, str(tmp_path / "out"), UFS, rows_a_file=n // 4)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).orderBy("a").collect()
    assert len(files) >= 4 and sum(f.n for f in files) == n and max(f.n for f in files) < n // 2
    assert all(x.b < y.a for x, y in zip(files, files[1:]))


def test_lines_of_segments_are_not_shuffled(spark, tmp_path):
    """Where each piece begins goes to the lines, also if the files are large (b8_benchmark_log)."""
    spark.range(1000).selectExpr("concat('line ', id) AS line").write.text(str(tmp_path / "log"))
    plan = logs.read_log_segments(spark, str(tmp_path / "log"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
