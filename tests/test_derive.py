"""Sequential simulators, written from the semantics, against the windows; one bucket against many."""

import random

import pytest
from pyspark.sql import functions as F

from iotrail.operators import derive, order, stats
from iotrail.plans.percentiles import two_pass
from iotrail.schemas import BLOCK, CUSTOM, UFS


def ufs_rows(seed, n):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 3])
        rows.append((i, t / 1000, rng.choice(["send_req", "send_req", "complete_rsp", "complete_rsp", "other"]), rng.randint(0, 2), rng.choice(["0x28", "0x2a"]), rng.choice([0, 8, 16]), 8))
    return rows


def simulate_ufs(rows):
    rank = {"c": 0, "s": 1}
    rows = sorted(rows, key=lambda r: (r[1], rank.get(r[2][0], 2), r[3], r[0]))
    qd, sent, since, idle, follow, out = 0, {}, None, None, None, {}
    for i, t, action, tag, opcode, lba, size in rows:
        dtoc = ctoc = ctod = 0.0
        cont = False
        if action == "send_req":
            cont = follow == (lba, opcode)
            follow = (lba + size, opcode)
            sent[tag, opcode] = t
            qd += 1
            if qd == 1:
                ctod = 0.0 if idle is None else (t - idle) * 1000
                since = t
        elif action == "complete_rsp":
            qd = max(0, qd - 1)
            if (tag, opcode) in sent:
                dtoc = (t - sent.pop((tag, opcode))) * 1000
            ctoc = 0.0 if since is None else (t - since) * 1000
            since = t
            if qd == 0:
                idle = t
        out[i] = (qd, dtoc, ctoc, ctod, cont)
    return out


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("n", [0, 1, 400])
def test_ufs(spark, buckets, n):
    rows = ufs_rows(n, n)
    df = spark.createDataFrame(rows, "line_ord long, time double, action string, tag long, opcode string, lba long, size long").withColumn("source", F.lit("s")).repartition(3)
    got = {r.line_ord: (r.qd, r.dtoc, r.ctoc, r.ctod, r.continuous) for r in derive.ufs(df, buckets=buckets).collect()}
    assert got == simulate_ufs(rows)


def klass(io_type):
    return {"R": "read", "W": "write", "D": "discard"}.get(io_type[:1], "other")


def block_rows(seed, n):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 2])
        action = rng.choice(["block_rq_issue", "block_rq_issue", "block_rq_complete", "block_rq_complete", "Q", "C", "block_rq_insert"])
        rows.append((i, t / 1000, action, rng.choice([8, 9]), 0, rng.choice(["R", "WS", "D", "FF", "W", ""]), rng.choice([0, 8, 16]), rng.choice([0, 8]), "c"))
    return rows


def simulate_block(rows):
    rows = sorted(rows, key=lambda r: (r[1], r[6], r[7], r[0]))
    first, queued = {}, {}
    for i, t, action, major, minor, io, sector, size, comm in rows:
        key, first[i] = (major, minor, sector, size, comm), 0.0
        if action == "Q":
            queued[key] = t
        elif action == "C" and key in queued:
            first[i] = (t - queued.pop(key)) * 1000
    left, open_ = [], set()
    for r in rows:
        key = (r[6], klass(r[5]), r[7])
        if r[2] == "block_rq_issue":
            if key in open_:
                continue
            open_.add(key)
        elif r[2] == "block_rq_complete":
            if r[5].startswith("W") and r[7] == 0:
                continue
            open_.discard(key)
        left.append(r)
    qd, sent, since, idle, follow, out = 0, {}, None, None, None, {}
    for i, t, action, _, _, io, sector, size, _ in left:
        dtoc, ctoc, ctod, cont, c = first[i], 0.0, 0.0, False, klass(io)
        if action in ("block_rq_issue", "Q"):
            if c != "other":
                cont = follow == (sector, c)
                follow = (sector + size, c)
            sent[sector, c] = t
            qd += 1
            ctod = 0.0 if idle is None else (t - idle) * 1000
            if qd == 1:
                since = t
        elif action in ("block_rq_complete", "C"):
            if (sector, c) in sent:
                dtoc = (t - sent.pop((sector, c))) * 1000
            ctoc = 0.0 if since is None else (t - since) * 1000
            since = t
            qd = max(0, qd - 1)
            if qd == 0:
                idle = t
        out[i] = (qd, dtoc, ctoc, ctod, cont)
    return out


@pytest.mark.parametrize("buckets", [1, 6])
def test_block(spark, buckets):
    rows = block_rows(2, 400)
    schema = "line_ord long, time double, action string, devmajor long, devminor long, io_type string, sector decimal(20,0), size long, comm string"
    from decimal import Decimal

    df = spark.createDataFrame([(*r[:6], Decimal(r[6]), *r[7:]) for r in rows], schema).withColumn("source", F.lit("s")).repartition(3)
    got = {r.line_ord: (r.qd, r.dtoc, r.ctoc, r.ctod, r.continuous) for r in derive.block(df, buckets=buckets).collect()}
    want = simulate_block(rows)
    assert got.keys() == want.keys()
    assert got == want


@pytest.mark.parametrize("buckets", [1, 5])
def test_custom(spark, buckets):
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 2])
        rows.append((i, rng.choice(["0x28", "0x2a"]), rng.choice([0, 8]), 8, t / 1000, (t + rng.choice([0, 1, 5, 9])) / 1000))
    df = spark.createDataFrame(rows, "line_ord long, opcode string, lba long, size long, start_time double, end_time double").withColumn("source", F.lit("s")).repartition(3)
    got = {r.line_ord: (r.start_qd, r.end_qd, r.ctoc, r.ctod, r.continuous) for r in derive.custom(df, buckets=buckets).collect()}
    rows.sort(key=lambda r: (r[4], r[2], r[3], r[0]))
    ends, qd, depth = sorted([(r[4], k, 0) for k, r in enumerate(rows)] + [(r[5], k, 1) for k, r in enumerate(rows)]), 0, {}
    for _, k, end in ends:
        qd = max(0, qd - 1) if end else qd + 1
        depth[k, end] = qd
    want = {}
    for k, r in enumerate(rows):
        before = rows[k - 1] if k else None
        want[r[0]] = (
            depth[k, 0], depth[k, 1], max(0.0, r[5] - before[5]) * 1000 if k else 0.0, max(0.0, r[4] - before[5]) * 1000 if k else 0.0,
            bool(k) and before[2] + before[3] == r[2] and before[1] == r[1],
        )
    assert got == want


def test_state_restarts_with_each_key(spark):
    rows = ufs_rows(5, 200)
    df = spark.createDataFrame([(*r, r[0] % 3) for r in rows], "line_ord long, time double, action string, tag long, opcode string, lba long, size long, iteration long").withColumn("source", F.lit("s"))
    got = {r.line_ord: (r.qd, r.dtoc, r.ctoc, r.ctod, r.continuous) for r in derive.ufs(df, ("source", "iteration"), 4).collect()}
    want = {}
    for k in range(3):
        want |= simulate_ufs([r for r in rows if r[0] % 3 == k])
    assert got == want


def test_repeats(spark):
    df = spark.createDataFrame([(i, 1.0, 0, 8, "R") for i in range(3)] + [(3, 1.0, 0, 8, "W")], "line_ord long, time double, sector long, size long, io_type string").withColumn("source", F.lit("s"))
    assert {r.line_ord for r in order.drop_repeated(df, BLOCK).collect()} == {0, 3}


def test_percentiles_agree(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice([1.0, 2.0, rng.random() * 1e6])) for _ in range(3000)] + [("c", 5.0)], "g string, v double")
    shares = [0.0, 0.5, 0.99, 0.999999, 1.0]
    got = {(r.g, round(r.share, 6)): r.result for r in two_pass(df, "g", "v", shares, 50).collect()}
    want = {(r.g, round(s, 6)): v for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() for s, v in zip(shares, r.q)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("shape", ["heavy tail", "one value", "few values"])
def test_percentiles_of_uneven_values(spark, shape):
    """Nearly all values in one equal-width range, or nearly all the same: no range that is sorted is over the bound."""
    from iotrail.plans import percentiles
    from iotrail.work import materialise

    v = F.hash("id") / 1e6
    far = {"heavy tail": F.when(F.col("id") < 3, 1e15).otherwise(v), "one value": F.when(F.col("id") < 40, v).otherwise(7.0), "few values": (F.col("id") % 7).cast("double")}[shape]
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), far.alias("v"))
    shares = [0.0, 0.5, 0.99, 0.9999, 0.999999, 1.0]
    ranges = percentiles.narrow(materialise(df, "t"), shares, 16, 200).collect()
    assert ranges and all(r.c <= 200 or r.lo == r.hi for r in ranges)
    got = {(r.g, r.share): r.result for r in two_pass(df, "g", "v", shares, 16, 200).collect()}
    want = {(r.g, s): x for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() for s, x in zip(shares, r.q)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_latency_table_modes(spark):
    df = spark.createDataFrame([("0x28", float(i % 97) + 0.5) for i in range(1000)] + [("0x2a", 3.0)], "opcode string, dtoc double")
    items = df.select(F.col("opcode").alias("item"), F.lit("C").alias("phase"), F.lit(1).alias("size"), F.lit(1).alias("qd"), "dtoc", F.lit(0.0).alias("ctoc"), F.lit(0.0).alias("ctod"))
    tables = [sorted(map(tuple, stats.latency_table(items, CUSTOM, "dtoc", m).collect())) for m in ("exact", "exact_two_pass", "approx")]
    assert tables[0] == tables[1]
    assert tables[2][1][0] == "0x2a" and tables[0][1][6] == 0.0
    with pytest.raises(ValueError):
        stats.check_ranges([1, 1])


assert UFS


def test_a_derivation_reads_its_input_once(spark, tmp_path):
    """Whether logs have one bucket or several, the plan that is left reads written rows, not what made them."""
    rows = [(f"s{i % 2}", i, i / 10, ("send_req", "complete_rsp")[i // 2 % 2], i % 3, "0x28", i, 8) for i in range(200)]
    spark.createDataFrame(rows, "source string, line_ord long, time double, action string, tag long, opcode string, lba long, size long").write.parquet(str(tmp_path / "log"))
    runs = spark.sparkContext.accumulator(0)
    log = spark.read.parquet(str(tmp_path / "log"))

    def counted(parts):
        for part in parts:
            runs.add(len(part))
            yield part

    for buckets in (None, 1, 5):
        before = runs.value
        got = derive.derive(log.mapInPandas(counted, log.schema), "ufs", buckets=buckets)
        assert got.count() == 200
        assert runs.value - before == 200
        if buckets != 1:
            assert str(tmp_path) not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", [UFS, BLOCK, CUSTOM])
def test_one_write_for_many_buckets(spark, monkeypatch, kind):
    """All that is written is the input and its cuts, whatever the number of buckets; more buckets than rows give the same."""
    from iotrail.plans import scan

    from .test_live_derive import ROWS, columns, frame

    written = []

    def counted(df, name, *rest):
        written.append(name)
        return materialise(df, name, *rest)

    materialise = scan.materialise
    monkeypatch.setattr(scan, "materialise", counted)
    df = frame(spark, kind, ROWS[kind](33, 300))
    got = [sorted(map(tuple, derive.derive(df, kind, buckets=b).select("line_ord", *columns(kind)).collect())) for b in (1, 9, 1000)]
    assert got[0] == got[1] == got[2]
    assert written == ["scan-rows", "scan-cuts"] * 2


@pytest.mark.parametrize("seed", range(4))
def test_depth_over_empty_and_saturated_buckets(spark, seed):
    """Long runs of completions and of requests, over cuts at every time."""
    rng = random.Random(seed)
    rows, t, action = [], 0, "send_req"
    for i in range(240):
        if rng.random() < 0.12:
            action = rng.choice(["send_req", "complete_rsp", "complete_rsp", "other"])
        t += rng.choice([0, 1, 1, 2])
        rows.append((i, t / 1000, action, rng.randint(0, 1), "0x28", rng.choice([0, 8]), 8))
    df = spark.createDataFrame(rows, "line_ord long, time double, action string, tag long, opcode string, lba long, size long").withColumn("source", F.lit("s"))
    got = {r.line_ord: (r.qd, r.dtoc, r.ctoc, r.ctod, r.continuous) for r in derive.ufs(df, buckets=60).collect()}
    assert got == simulate_ufs(rows)


@pytest.mark.parametrize("kind", [UFS, BLOCK, CUSTOM])
def test_buckets_are_not_put_together_in_tasks(spark, kind):
    """Rows are dealt out by bucket over a number of tasks that is named, two a bucket, so what a task sorts is bounded."""
    from iotrail import queries

    plan = derive.derive(queries.view(spark, "/root/testdata/sf0.001", kind), kind, buckets=4)._jdf.queryExecution().optimizedPlan().toString()
    assert ", 8" in "".join(x for x in plan.splitlines() if "RepartitionByExpression" in x)


def block_frame(spark, rows):
    from decimal import Decimal

    schema = "line_ord long, time double, action string, devmajor long, devminor long, io_type string, sector decimal(20,0), size long, comm string"
    return spark.createDataFrame([(*r[:6], Decimal(r[6]), *r[7:]) for r in rows], schema).withColumn("source", F.lit("s"))


@pytest.mark.parametrize("queue", [True, False])
def test_pairs_of_few_sectors_over_buckets(spark, queue):
    """Issues, completions and reissues of a sector lie in different buckets, with and without Q and C in the log."""
    rows = [r for r in block_rows(11, 300) if queue or r[2] not in "QC"]
    df, want = block_frame(spark, rows), simulate_block(rows)
    assert {r.line_ord: (r.qd, r.dtoc, r.ctoc, r.ctod, r.continuous) for r in derive.block(df, buckets=50).collect()} == want
    left = order.drop_reissued(order.drop_empty_writes(df), buckets=50).select("line_ord").collect()
    assert sorted(r.line_ord for r in left) == sorted(want)
    one, many = ({r.line_ord: r.dtoc for r in derive.qc_latency(df, buckets=b).collect()} for b in (1, 50))
    assert one == many and any(one.values()) == queue


def test_block_rows_are_written_before_any_window(spark, monkeypatch):
    """A log may hold few sectors, so no window takes all rows of a sector: every one runs within buckets of the rows written."""
    from iotrail.plans import scan

    plans = []
    materialise = scan.materialise

    def seen(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return materialise(df, name, *rest)

    monkeypatch.setattr(scan, "materialise", seen)
    derive.block(block_frame(spark, block_rows(3, 100)), buckets=4)
    assert [n for n, _ in plans] == ["scan-rows", "scan-cuts"]
    assert not any("Window" in p for _, p in plans)


def test_report_counts_rows_before_it_parts_them(spark):
    """No row of items becomes several: what is exploded has been counted."""
    items = stats.as_items(derive.block(block_frame(spark, block_rows(3, 50)), buckets=1), BLOCK)
    plan = stats._profile(items, BLOCK, ("all", "item", "size", "ranges"), ("dtoc", "ctoc", "ctod"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for k, line in enumerate(plan):
        if "Generate" in line:
            assert any("Aggregate" in x for x in plan[k + 1 : k + 4])
