"""Registered queries over views of the test tables, and the same in SQL.

Three views of the table events stand for the three families; raw text is made from them where a query parses.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import events as E
from .functions import parse
from .operators import bench, derive, filters, order, series, sinks, stats
from .plans import scan
from .schemas import BLOCK, CUSTOM, STORED, UFS, conform, event_type, time_column
from .sources import events as stored
from .sources import logs
from .sources.files import filesystem
from .streaming import derive as live_derive
from .streaming import history, tail
from .streaming import stats as live
from .work import materialise, work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TIME = "(US(ts) - 1704067200000000) / 1e6"
VIEWS = {
    UFS: f"""SELECT event_id AS line_ord, {_TIME} AS time, concat('p-', user_id) AS process, user_id % 8 AS cpu,
 CASE WHEN event_type IN ('click','view') THEN 'send_req' WHEN event_type IN ('purchase','error') THEN 'complete_rsp' ELSE 'other' END AS action,
 user_id % 8 AS tag, CASE event_id % 4 WHEN 0 THEN '0x28' WHEN 1 THEN '0x2a' WHEN 2 THEN '0x35' ELSE '0x42' END AS opcode, (user_id % 5) * 8 AS lba, 8 AS size FROM events""",
    BLOCK: f"""SELECT event_id AS line_ord, {_TIME} AS time, concat('p-', user_id) AS process, user_id % 8 AS cpu,
 CASE WHEN event_type IN ('click','view') THEN 'block_rq_issue' WHEN event_type IN ('purchase','error') THEN 'block_rq_complete' ELSE 'block_rq_insert' END AS action,
 8 AS devmajor, 0 AS devminor, CASE event_id % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'WS' WHEN 2 THEN 'D' WHEN 3 THEN 'FF' ELSE 'W' END AS io_type,
 (user_id % 6) * 8 AS sector, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 8 END AS size, 'c' AS comm FROM events""",
    CUSTOM: f"""SELECT event_id AS line_ord, CASE event_id % 3 WHEN 0 THEN '0x28' WHEN 1 THEN '0x2a' ELSE '0x35' END AS opcode,
 (user_id % 5) * 8 AS lba, 8 AS size, {_TIME} AS start_time, {_TIME} + value AS end_time, value * 1000 AS dtoc FROM events""",
}
US_SPARK = "unix_micros(cast(ts as timestamp))"
QC = VIEWS[BLOCK].replace("'block_rq_issue'", "'Q'").replace("'block_rq_complete'", "'C'")


def _table(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, kind: str, sql: str | None = None) -> DataFrame:
    text = (sql or VIEWS[kind]).replace("US(ts)", US_SPARK).replace("FROM events", "FROM {events}")
    return spark.sql(text, events=_table(spark, d)).withColumn("source", F.lit("log"))


def _sql(text: str) -> str:
    for kind, v in VIEWS.items():
        text = text.replace("{" + kind + "}", f"({v})")
    return text.replace("{qc}", f"({QC})").replace("US(ts)", "epoch_us(ts)")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = _sql(sql)
        return f

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


# ---- derived columns, as one window over the whole log -------------------------------------------------------

_UFS = """, r AS (SELECT *, CASE action WHEN 'send_req' THEN 'I' WHEN 'complete_rsp' THEN 'C' ELSE 'X' END AS p,
  row_number() OVER (ORDER BY time, CASE WHEN action LIKE 'c%' THEN 0 WHEN action LIKE 's%' THEN 1 ELSE 2 END, tag, line_ord) AS rn FROM e),
s AS (SELECT *, sum(CASE p WHEN 'I' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (ORDER BY rn) AS s FROM r),
q AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY rn)) AS BIGINT) AS qd FROM s),
w AS (SELECT *, lag(p) OVER k AS bp, lag(time) OVER k AS bt,
  last_value(CASE WHEN p = 'C' OR (p = 'I' AND qd = 1) THEN time END IGNORE NULLS) OVER b AS since,
  last_value(CASE WHEN p = 'C' AND qd = 0 THEN time END IGNORE NULLS) OVER b AS idle,
  last_value(CASE WHEN p = 'I' THEN lba + size END IGNORE NULLS) OVER b AS nl,
  last_value(CASE WHEN p = 'I' THEN opcode END IGNORE NULLS) OVER b AS no
  FROM q WINDOW k AS (PARTITION BY tag, opcode, p <> 'X' ORDER BY rn), b AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, round(coalesce(CASE WHEN p = 'C' AND bp = 'I' THEN (time - bt) * 1000 END, 0), 6) AS dtoc,
  round(coalesce(CASE WHEN p = 'C' THEN (time - since) * 1000 END, 0), 6) AS ctoc,
  round(coalesce(CASE WHEN p = 'I' AND qd = 1 THEN (time - idle) * 1000 END, 0), 6) AS ctod,
  coalesce(p = 'I' AND lba = nl AND opcode = no, false) AS continuous, lba % 16 = 0 AS aligned FROM w)"""
UFS_D = "WITH e AS {ufs}" + _UFS
_BLOCK = """, q0 AS (SELECT *, CASE WHEN io_type LIKE 'R%' THEN 'read' WHEN io_type LIKE 'W%' THEN 'write' WHEN io_type LIKE 'D%' THEN 'discard' ELSE 'other' END AS c,
  CASE WHEN action = 'C' AND lag(action) OVER k = 'Q' THEN (time - lag(time) OVER k) * 1000 ELSE 0 END AS d0
  FROM e WINDOW k AS (PARTITION BY devmajor, devminor, sector, size, comm, action IN ('Q', 'C') ORDER BY time, sector, size, line_ord)),
o4 AS (SELECT * FROM q0 WHERE NOT (action = 'block_rq_complete' AND io_type LIKE 'W%' AND size = 0)),
o3 AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY sector, c, size, action IN ('block_rq_issue', 'block_rq_complete') ORDER BY time, line_ord) AS ba FROM o4)
  WHERE NOT (action = 'block_rq_issue' AND coalesce(ba, '') = 'block_rq_issue')),
r AS (SELECT *, CASE WHEN action IN ('block_rq_issue', 'Q') THEN 'I' WHEN action IN ('block_rq_complete', 'C') THEN 'C' ELSE 'X' END AS p,
  row_number() OVER (ORDER BY time, sector, size, line_ord) AS rn FROM o3),
s AS (SELECT *, sum(CASE p WHEN 'I' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (ORDER BY rn) AS s FROM r),
q AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY rn)) AS BIGINT) AS qd FROM s),
w AS (SELECT *, lag(p) OVER k AS bp, lag(time) OVER k AS bt,
  last_value(CASE WHEN p = 'C' OR (p = 'I' AND qd = 1) THEN time END IGNORE NULLS) OVER b AS since,
  last_value(CASE WHEN p = 'C' AND qd = 0 THEN time END IGNORE NULLS) OVER b AS idle,
  last_value(CASE WHEN p = 'I' AND c <> 'other' THEN sector + size END IGNORE NULLS) OVER b AS nl,
  last_value(CASE WHEN p = 'I' AND c <> 'other' THEN c END IGNORE NULLS) OVER b AS nc
  FROM q WINDOW k AS (PARTITION BY sector, c, p <> 'X' ORDER BY rn), b AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, round(coalesce(CASE WHEN p = 'C' AND bp = 'I' THEN (time - bt) * 1000 END, d0), 6) AS dtoc,
  round(coalesce(CASE WHEN p = 'C' THEN (time - since) * 1000 END, 0), 6) AS ctoc,
  round(coalesce(CASE WHEN p = 'I' THEN (time - idle) * 1000 END, 0), 6) AS ctod,
  coalesce(p = 'I' AND c <> 'other' AND sector = nl AND c = nc, false) AS continuous, sector % 128 = 0 AS aligned FROM w)"""
BLOCK_D = "WITH e AS {block}" + _BLOCK
QC_D = "WITH e AS {qc}" + _BLOCK
CUSTOM_D = """WITH e AS (SELECT *, row_number() OVER (ORDER BY start_time, lba, size, line_ord) AS rn FROM {ufscustom}),
t AS (SELECT rn, start_time AS t, 0 AS k FROM e UNION ALL SELECT rn, end_time, 1 FROM e),
s AS (SELECT *, sum(1 - 2 * k) OVER (ORDER BY t, rn, k) AS s FROM t),
q AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY t, rn, k)) AS BIGINT) AS qd FROM s),
d AS (SELECT e.*, a.qd AS start_qd, b.qd AS end_qd,
  round(coalesce(greatest(0, end_time - lag(end_time) OVER w), 0) * 1000, 6) AS ctoc, round(coalesce(greatest(0, start_time - lag(end_time) OVER w), 0) * 1000, 6) AS ctod,
  coalesce(lba = lag(lba + size) OVER w AND opcode = lag(opcode) OVER w, false) AS continuous, lba % 128 = 0 AS aligned
  FROM e JOIN q a ON a.rn = e.rn AND a.k = 0 JOIN q b ON b.rn = e.rn AND b.k = 1 WINDOW w AS (ORDER BY e.rn))"""
DERIVED = {UFS: UFS_D, BLOCK: BLOCK_D, CUSTOM: CUSTOM_D}
LATENCIES = ("dtoc", "ctoc", "ctod")


def derived(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _round(derive.derive(view(spark, d, kind), kind), *LATENCIES)


def items(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return stats.as_items(derived(spark, d, kind), kind)


for _kind, _names in {UFS: {"w1_dtoc": "dtoc", "w3_queue_depth": "qd", "w4_ctoc": "ctoc", "w5_ctod": "ctod", "w6_continuous": "continuous"}, BLOCK: {"w2_dtoc": "dtoc", "w3_queue_depth": "qd", "w4_ctoc": "ctoc", "w5b_ctod": "ctod", "w6b_continuous": "continuous"}, CUSTOM: {"w7_depths": "start_qd, end_qd", "w8_ctoc": "ctoc", "w9_ctod": "ctod", "w10_continuous": "continuous"}}.items():
    for _name, _columns in _names.items():
        query(f"{_name}_{_kind}", f"{DERIVED[_kind]} SELECT line_ord, {_columns} FROM d")(lambda s, d, k=_kind, c=_columns: derived(s, d, k).select("line_ord", *c.split(", ")))


@query("w11_dtoc_ufscustom", "SELECT line_ord, round((end_time - start_time) * 1000, 6) AS dtoc FROM {ufscustom}")
def _(spark, d):
    line = F.concat_ws(",", "opcode", "lba", "size", F.format_string("%.6f", "start_time"), F.format_string("%.6f", "end_time"))
    got = parse.parse_log(view(spark, d, CUSTOM).select("source", "line_ord", line.alias("line")))
    return _round(parse.events(got, CUSTOM).select("line_ord", "dtoc"), "dtoc")


@query("w2b_dtoc_queue_complete", f"{QC_D} SELECT line_ord, round(d0, 6) AS dtoc FROM q0")
def _(spark, d):
    return _round(derive.qc_latency(view(spark, d, BLOCK, QC)).select("line_ord", "dtoc"), "dtoc")


@query("w12_derive_queue_complete", f"{QC_D} SELECT line_ord, qd, dtoc, ctoc, ctod, continuous FROM d")
def _(spark, d):
    return _round(derive.derive(view(spark, d, BLOCK, QC), BLOCK).select("line_ord", "qd", *LATENCIES, "continuous"), *LATENCIES)


@query("w12_derive_by_iteration", "WITH e AS (SELECT * FROM {ufs}), r AS (SELECT *, cpu AS iteration, CASE action WHEN 'send_req' THEN 1 WHEN 'complete_rsp' THEN -1 ELSE 0 END AS v, row_number() OVER (ORDER BY time, CASE WHEN action LIKE 'c%' THEN 0 WHEN action LIKE 's%' THEN 1 ELSE 2 END, tag, line_ord) AS rn FROM e), s AS (SELECT *, sum(v) OVER (PARTITION BY iteration ORDER BY rn) AS s FROM r) SELECT line_ord, iteration, CAST(s - least(0, min(s) OVER (PARTITION BY iteration ORDER BY rn)) AS BIGINT) AS qd FROM s")
def _(spark, d):
    return derive.derive(view(spark, d, UFS).withColumn("iteration", F.col("cpu")), UFS, ("source", "iteration")).select("line_ord", "iteration", "qd")


# ---- parsing ------------------------------------------------------------------------------------------------


def _clock(us: str = US_SPARK) -> str:
    rest = f"({us} - 1704067200000000)"
    return f"concat(cast({rest} div 1000000 as string), '.', lpad(cast({rest} % 1000000 as string), 6, '0'))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """source, line_ord, line: each event as a line of one of four formats by event_id, with headers and junk between."""
    rows = _table(spark, d).select("event_id", "ts", "user_id", "event_type", "value").repartition(spark.sparkContext.defaultParallelism, "event_id")  # a file may be one task
    for kind in (UFS, BLOCK, CUSTOM):  # the columns of all three views from one row, so nothing is joined
        text = VIEWS[kind].replace("SELECT ", "SELECT *, ", 1).replace("US(ts)", US_SPARK).replace("FROM events", "FROM {rows}")
        seen = spark.sql(text, rows=rows)
        rows = seen.toDF(*rows.columns, *(f"{kind}_{c}" for c in seen.columns[len(rows.columns) :]))
    wide = rows.selectExpr(
        "event_id AS line_ord", *(f"ufs_{c} AS {c}" for c in ("process", "cpu", "tag", "opcode", "lba")), "ufs_action AS ua", "block_action AS ba", "block_io_type AS io_type", "block_sector AS sector", "block_size AS bs",
        "ufscustom_opcode AS co", f"{_clock()} AS clock", "cast(value as decimal(12,6)) AS value",
    )
    text = F.expr("""CASE line_ord % 4
      WHEN 0 THEN concat(process, ' [', lpad(cast(cpu as string), 3, '0'), '] ..... ', clock, ': ufshcd_command: ', CASE WHEN ua = 'other' THEN 'uic_send' ELSE ua END, ': dev0: tag: ', tag,
        ', DB: 0x0, size: ', CASE WHEN line_ord % 8 = 0 THEN '-1' ELSE '32768' END, ', IS: 0, LBA: ', lba, ', opcode: ', opcode, ' (X), group_id: 0x1f, hwq_id: ', CASE WHEN line_ord % 12 = 0 THEN '-1' ELSE '3' END)
      WHEN 1 THEN concat(process, ' [', lpad(cast(cpu as string), 3, '0'), '] ..... ', clock, ': ', ba, ': 8,0 ', io_type, CASE WHEN line_ord % 8 = 1 THEN ' 4096' ELSE '' END, ' () ', sector, ' + ', bs, ' [c]')
      WHEN 2 THEN concat(clock, ',', cpu, ',8,0,77,', CASE WHEN ua = 'send_req' THEN 'Q' ELSE 'C' END, ',', io_type, ',', sector, ',', bs, ',c')
      ELSE CASE WHEN line_ord % 24 = 3 THEN 'opcode,lba,size,start_time,end_time' WHEN line_ord % 24 = 7 THEN concat('0x28,', lba, ',x,', clock, ',1')
        ELSE concat(co, ',', CASE WHEN line_ord % 24 = 11 THEN '2305843009213693951' ELSE cast(lba as string) END, ',8,', clock, ',', cast(value + cast(clock as decimal(18,6)) as string)) END END""")
    return wide.select(F.lit("log").alias("source"), "line_ord", text.alias("line"))


_CATEGORY = "CASE line_ord % 4 WHEN 0 THEN 'ufs' WHEN 1 THEN 'block' WHEN 2 THEN 'block' ELSE CASE WHEN line_ord % 24 = 3 THEN 'unknown' ELSE 'ufscustom' END END"
_PARSED = "CASE WHEN line_ord % 4 = 0 THEN action <> 'other' WHEN line_ord % 4 = 3 THEN line_ord % 24 NOT IN (3, 7) ELSE true END"


@query("p1_categorize", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM {{ufs}} GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy(parse.category(parse.trimmed(F.col("line"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("p2_parse_ufs", "SELECT line_ord, round(time, 6) AS time, process, cpu, action, tag, opcode, lba, CASE WHEN line_ord % 8 = 0 THEN 1 ELSE 8 END AS size, 31 AS groupid, CASE WHEN line_ord % 12 = 0 THEN 0 ELSE 3 END AS hwqid, lba % 16 = 0 AS aligned FROM {ufs} WHERE line_ord % 4 = 0 AND action <> 'other'")
def _(spark, d):
    return _round(parse.events(parse.parse_log(lines(spark, d)), UFS).select("line_ord", "time", "process", "cpu", "action", "tag", "opcode", "lba", "size", "groupid", "hwqid", "aligned"), "time")


@query("p3_parse_block", "SELECT line_ord, round(time, 6) AS time, process, cpu, '.....' AS flags, action, devmajor, devminor, io_type, CASE WHEN line_ord % 8 = 1 THEN 4096 ELSE 0 END AS extra, sector, size, comm FROM {block} WHERE line_ord % 4 = 1")
def _(spark, d):
    got = parse.events(parse.parse_log(lines(spark, d)), BLOCK).where("flags <> ''").withColumn("sector", F.col("sector").cast("long"))
    return _round(got.select("line_ord", "time", "process", "cpu", "flags", "action", "devmajor", "devminor", "io_type", "extra", "sector", "size", "comm"), "time")


@query("p4_parse_blktrace_csv", "SELECT line_ord, round(time, 6) AS time, '77' AS process, cpu, CASE WHEN action = 'block_rq_issue' THEN 'Q' ELSE 'C' END AS action, io_type, sector, size, comm FROM {block} WHERE line_ord % 4 = 2")
def _(spark, d):
    got = parse.events(parse.parse_log(lines(spark, d)), BLOCK).where("flags = ''").withColumn("sector", F.col("sector").cast("long"))
    return _round(got.select("line_ord", "time", "process", "cpu", "action", "io_type", "sector", "size", "comm"), "time")


_P5 = "SELECT line_ord, opcode, CASE WHEN line_ord % 24 = 11 THEN 0 ELSE lba END AS lba, size, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(dtoc, 3) AS dtoc FROM {ufscustom} WHERE line_ord % 4 = 3 AND line_ord % 24 NOT IN (3, 7)"


@query("p5_parse_custom", _P5)
def _(spark, d):
    got = parse.events(parse.parse_log(lines(spark, d)), CUSTOM)
    return got.select("line_ord", "opcode", "lba", "size", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"), F.round("dtoc", 3).alias("dtoc"))


@query("p5b_parse_custom_strict", "SELECT line_ord, row_number() OVER (ORDER BY dtoc, line_ord) AS rank FROM (SELECT line_ord, round(dtoc, 3) AS dtoc FROM {ufscustom} WHERE line_ord % 4 = 3 AND line_ord % 24 NOT IN (3, 7))")
def _(spark, d):
    got = parse.parse_custom_strict(lines(spark, d)).withColumn("dtoc", F.round("dtoc", 3))
    trail = scan.Trail()
    got = scan.bucketed(got, ["source"], "dtoc", 16, trail)
    got = scan.running_sum(got, ["source"], ["dtoc", "line_ord"], F.lit(1).cast("long"), "rank", trail)
    return got.select("line_ord", "rank")


@query("p5b_strict_counts", "SELECT count(*) AS lines, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS skipped, round(min(dtoc) FILTER (ok), 3) AS min_dtoc, round(max(dtoc) FILTER (ok), 3) AS max_dtoc, round(avg(dtoc) FILTER (ok), 3) AS avg_dtoc FROM (SELECT *, line_ord % 4 = 3 AND line_ord % 24 NOT IN (3, 7) AS ok FROM {ufscustom})")
def _(spark, d):
    found = parse.strict_counts(lines(spark, d))
    return found.select("lines", "parsed", "skipped", *(F.round(c, 3).alias(c) for c in ("min_dtoc", "max_dtoc", "avg_dtoc")))


@query("p6_control_bytes", """SELECT line_ord, 'ufs' AS kind, concat('p', chr(1), user) AS name FROM (SELECT line_ord, action, split_part(process, '-', 2) AS user FROM {ufs}) WHERE line_ord % 4 = 0 AND action <> 'other'
UNION ALL SELECT line_ord, 'block', concat('c', chr(1)) FROM {ufs} WHERE line_ord % 4 IN (1, 2)""")
def _(spark, d):
    """Bytes 0x01 in process and command names; lines of the fourth form are made junk of such bytes."""
    mark, line, form = F.lit("\x01"), F.col("line"), F.col("line_ord") % 4
    text = F.when(form == 0, F.regexp_replace(line, "^p-", "p\x01")).when(form == 1, F.regexp_replace(line, r"\[c\]$", "[c\x01]")).when(form == 2, F.regexp_replace(line, ",c$", ",c\x01")).otherwise(F.concat(F.lit("ufshcd_command:"), F.repeat(mark, 10)))
    parsed = parse.parse_log(lines(spark, d).withColumn("line", text))
    one = lambda kind, name: parse.events(parsed, kind).select("line_ord", F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return one(UFS, "process").unionByName(one(BLOCK, "comm")).unionByName(one(CUSTOM, "opcode"))


@query("p6b_parse_permissive", f"SELECT count(*) FILTER (line_ord % 4 = 0 AND action <> 'other') AS ufs, count(*) FILTER (line_ord % 4 IN (1, 2)) AS block, count(*) FILTER (line_ord % 4 = 3 AND line_ord % 24 NOT IN (3, 7)) AS ufscustom FROM {{ufs}}")
def _(spark, d):
    return parse.parse_permissive(lines(spark, d)).agg(*(F.count(k).alias(k) for k in (UFS, BLOCK, CUSTOM)))


@query("p7_classify", "SELECT CASE WHEN line_ord % 4 = 0 AND action <> 'other' THEN 'ufs' WHEN line_ord % 4 = 1 THEN 'block' WHEN line_ord % 4 = 3 AND line_ord % 24 NOT IN (3, 7) THEN 'ufscustom' ELSE 'unknown' END AS class, count(*) AS n FROM {ufs} GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy(parse.classify(F.col("line")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_parse_report", f"SELECT {_CATEGORY} AS category, count(*) AS lines, CAST(sum(CASE WHEN {_PARSED} THEN 1 ELSE 0 END) AS BIGINT) AS parsed, CAST(sum(CASE WHEN {_PARSED} THEN 0 ELSE 1 END) AS BIGINT) AS skipped FROM {{ufs}} GROUP BY 1")
def _(spark, d):
    return parse.report(parse.parse_log(lines(spark, d)))


@query("p9_sanitize_lba", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 8 END AS lba FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit(1 << 48) + 1 + F.col("event_id")).otherwise(F.col("event_id") * 8)
    return _table(spark, d).select("event_id", E.sanitize_lba(raw).alias("lba"))


@query("p10_aligned", "SELECT line_ord, lba % 4 = 0 AS ufs_16k, lba % 32 = 0 AS block_16k, lba = 0 AS ufs_1k FROM {ufs}")
def _(spark, d):
    u, at = view(spark, d, UFS), F.col("lba")
    return u.select("line_ord", E.is_aligned(UFS, "16KB").alias("ufs_16k"), E.is_aligned(BLOCK, "16kb", at).alias("block_16k"), E.is_aligned(UFS, "1KB").alias("ufs_1k"))


@query("p12_op_class", "SELECT CASE WHEN io_type LIKE 'R%' THEN 'read' WHEN io_type LIKE 'W%' THEN 'write' WHEN io_type LIKE 'D%' THEN 'discard' ELSE 'other' END AS class, count(*) AS n FROM {block} GROUP BY 1")
def _(spark, d):
    return view(spark, d, BLOCK).groupBy(E.op_class(F.col("io_type")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_item_type", "SELECT left(io_type, 1) AS item, io_type AS rw, count(*) AS n FROM {block} GROUP BY 1, 2 UNION ALL SELECT opcode, CASE opcode WHEN '0x28' THEN 'R' WHEN '0x2a' THEN 'W' ELSE 'O' END, count(*) FROM {ufs} GROUP BY 1, 2")
def _(spark, d):
    one = lambda k: view(spark, d, k).groupBy(E.item_type(k).alias("item"), E.io_rw(k).alias("rw")).agg(F.count(F.lit(1)).alias("n"))
    return one(BLOCK).unionByName(one(UFS))


@query("p14_phase", "SELECT CASE WHEN action IN ('block_rq_issue', 'Q', 'send_req') THEN 'I' WHEN action IN ('block_rq_complete', 'C', 'complete_rsp') THEN 'C' ELSE 'X' END AS phase, count(*) AS n FROM (SELECT action FROM {ufs} UNION ALL SELECT action FROM {block} UNION ALL SELECT action FROM {qc}) GROUP BY 1")
def _(spark, d):
    all_ = view(spark, d, UFS).select("action").unionByName(view(spark, d, BLOCK).select("action")).unionByName(view(spark, d, BLOCK, QC).select("action"))
    return all_.groupBy(E.phase(F.col("action")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


# ---- order --------------------------------------------------------------------------------------------------


@query("o1_canonical_order", "SELECT line_ord, row_number() OVER (ORDER BY time, CASE WHEN action LIKE 'c%' THEN 0 WHEN action LIKE 's%' THEN 1 ELSE 2 END, tag, line_ord) AS place FROM {ufs}")
def _(spark, d):
    trail = scan.Trail()
    rows = scan.bucketed(order.with_rank(view(spark, d, UFS), UFS), ["source"], "time", 32, trail)
    return scan.running_sum(rows, ["source"], order.order_of(UFS), F.lit(1).cast("long"), "place", trail).select("line_ord", "place")


_TWICE = "(SELECT * FROM {%s} UNION ALL SELECT * REPLACE (line_ord + 100000000 AS line_ord) FROM {%s})"
for _kind, _key in {UFS: "time, tag, action, opcode", BLOCK: "time, sector, size, io_type", CUSTOM: "start_time, lba, size"}.items():

    @query(f"o2_drop_repeated_{_kind}", f"SELECT line_ord FROM (SELECT line_ord, row_number() OVER (PARTITION BY {_key} ORDER BY line_ord) AS n FROM {_TWICE % (_kind, _kind)}) WHERE n = 1")
    def _(spark, d, kind=_kind):
        v = view(spark, d, kind)
        return order.drop_repeated(v.unionByName(v.withColumn("line_ord", F.col("line_ord") + 100000000)), kind).select("line_ord")


@query("o3_drop_reissued", f"{BLOCK_D} SELECT line_ord, action FROM o3")
def _(spark, d):
    return order.drop_reissued(order.drop_empty_writes(view(spark, d, BLOCK))).select("line_ord", "action")


@query("o4_drop_empty_writes", f"{BLOCK_D} SELECT line_ord FROM o4")
def _(spark, d):
    return order.drop_empty_writes(view(spark, d, BLOCK)).select("line_ord")


@query("o5_limit", "SELECT line_ord, row_number() OVER (ORDER BY time, sector, size, line_ord) - 1 AS index, total FROM (SELECT *, count(*) OVER () AS total FROM {block}) ORDER BY 2 LIMIT 100")
def _(spark, d):
    return order.head(view(spark, d, BLOCK), BLOCK, 100).select("line_ord", F.col("index").cast("long").alias("index"), "total")


@query("o6_by_latency", "SELECT line_ord, round(dtoc, 6) AS dtoc, row_number() OVER (ORDER BY dtoc, line_ord) AS rank FROM {ufscustom}")
def _(spark, d):
    trail = scan.Trail()
    rows = order.by_latency(view(spark, d, CUSTOM)).withColumn("at", F.monotonically_increasing_id())  # ascends as the rows stand
    rows = scan.running_sum(scan.bucketed(rows, ["source"], "at", 8, trail), ["source"], ["at"], F.lit(1).cast("long"), "rank", trail)
    return _round(rows.select("line_ord", "dtoc", "rank"), "dtoc")


# ---- filters ------------------------------------------------------------------------------------------------

for _name, _kind, _spec, _where in (
    ("f1_time", UFS, ["time:1000:50000"], "time BETWEEN 1000 AND 50000"),
    ("f2_time_overlap", CUSTOM, ["time:1000:50000"], "end_time >= 1000 AND start_time <= 50000"),
    ("f3_address_overlap", BLOCK, ["sector:10:24"], "sector + size >= 10 AND sector <= 24"),
    ("f3_address_overlap_ufs", UFS, ["lba:10:24"], "lba + size >= 10 AND lba <= 24"),
    ("f4_dtoc", UFS, ["dtoc:100:500000"], "dtoc >= 100 AND dtoc <= 500000"),
    ("f5_ctoc", BLOCK, ["ctoc:0:90000"], "ctoc <= 90000"),
    ("f6_ctod", BLOCK, ["ctod:50:0"], "ctod >= 50"),
    ("f7_qd", CUSTOM, ["qd:2:9"], "start_qd BETWEEN 2 AND 9"),
    ("f8_cpu", UFS, ["cpu:0-2,5"], "cpu IN (0, 1, 2, 5)"),
    ("f9_all", BLOCK, ["time:100:900000", "cpu:1,3", "qd:1:40", "dtoc:0:800000"], "time BETWEEN 100 AND 900000 AND cpu IN (1, 3) AND qd BETWEEN 1 AND 40 AND dtoc <= 800000"),
):
    query(_name, f"{DERIVED[_kind]} SELECT line_ord FROM d WHERE {_where}")(lambda s, d, k=_kind, x=_spec: filters.filter_events(derived(s, d, k), x, k).select("line_ord"))

# ---- statistics ---------------------------------------------------------------------------------------------

_ITEM = {UFS: "opcode", BLOCK: "left(io_type, 1)", CUSTOM: "opcode"}
_REQ = {UFS: "action = 'send_req'", BLOCK: "action = 'block_rq_issue'", CUSTOM: "true"}
_COM = {UFS: "action = 'complete_rsp'", BLOCK: "action = 'block_rq_complete'", CUSTOM: "true"}


def _summary_sql(k: str) -> str:
    qd = "start_qd" if k == CUSTOM else "qd"
    dtoc = "round(dtoc, 6)"
    return f"""{DERIVED[k]} SELECT count(*) AS n, max({qd}) AS max_qd, round(avg({qd}), 6) AS avg_qd, round(avg({dtoc}) FILTER ({_COM[k]}), 4) AS avg_dtoc,
      round(avg(ctoc) FILTER ({_COM[k]} AND ctoc > 0), 4) AS avg_ctoc, round(avg(ctod) FILTER ({_REQ[k]} AND ctod > 0), 4) AS avg_ctod,
      round(avg(CAST(continuous AS INT)) * 100, 6) AS continuous_pct, round(avg(CAST(aligned AS INT)) * 100, 6) AS aligned_pct FROM d"""


def _latency_sql(k: str, m: str) -> str:
    who = _REQ[k] if m == "ctod" else _COM[k]
    p = ", ".join(f"round(quantile_cont(v, {s}), 3) AS {n}" for n, s in {"median": 0.5, **stats.PERCENTILES}.items())
    return f"""{DERIVED[k]}, l AS (SELECT {_ITEM[k]} AS item, round({m}, 6) AS v FROM d WHERE {who} AND {m} > 0)
      SELECT item, count(*) AS n, round(avg(v), 3) AS avg, round(min(v), 3) AS min, {p}, round(max(v), 3) AS max, round(coalesce(stddev_samp(v), 0), 3) AS std FROM l GROUP BY item"""


def _histogram_sql(k: str, m: str) -> str:
    who = _REQ[k] if m == "ctod" else _COM[k]
    bounds = [0, *stats.RANGES, 1e300]
    rows = ", ".join(f"({i}, {bounds[i]}, {bounds[i + 1]}, '{label}')" for i, label in enumerate(stats.range_labels(stats.RANGES)))
    return f"""{DERIVED[k]}, l AS (SELECT {_ITEM[k]} AS item, {m} AS v FROM d WHERE {who} AND {m} > 0), b(bucket, lo, hi, label) AS (VALUES {rows})
      SELECT bucket, label, item, count(v) AS n FROM (SELECT DISTINCT item FROM l) CROSS JOIN b LEFT JOIN l USING (item) WHERE v > lo AND v <= hi OR v IS NULL GROUP BY ALL
      UNION ALL SELECT bucket, label, i.item, 0 FROM (SELECT DISTINCT item FROM l) i CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.item = i.item AND v > lo AND v <= hi)"""


for _kind in (UFS, BLOCK, CUSTOM):
    query(f"a1_summary_{_kind}", _summary_sql(_kind))(lambda s, d, k=_kind: stats.summary(items(s, d, k), k).select("n", "max_qd", F.round("avg_qd", 6).alias("avg_qd"), *(F.round(c, 4).alias(c) for c in ("avg_dtoc", "avg_ctoc", "avg_ctod")), *(F.round(c, 6).alias(c) for c in ("continuous_pct", "aligned_pct"))))
    query(f"a4_type_mix_{_kind}", f"{DERIVED[_kind]} SELECT {_ITEM[_kind]} AS item, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM d), 6) AS pct FROM d GROUP BY 1")(lambda s, d, k=_kind: _round(stats.type_mix(items(s, d, k)), "pct"))
    query(f"a8_sizes_{_kind}", f"{DERIVED[_kind]} SELECT {_ITEM[_kind]} AS item, size, count(*) AS n FROM d WHERE {_COM[_kind]} GROUP BY 1, 2")(lambda s, d, k=_kind: stats.size_distribution(items(s, d, k), k))
    for _m in ("dtoc",) if _kind == CUSTOM else LATENCIES:
        query(f"a5_latency_{_kind}_{_m}", _latency_sql(_kind, _m))(lambda s, d, k=_kind, m=_m: stats.latency_table(items(s, d, k), k, m))
    for _m in LATENCIES:
        query(f"a6_histogram_{_kind}_{_m}", _histogram_sql(_kind, _m))(lambda s, d, k=_kind, m=_m: stats.latency_histogram(items(s, d, k), k, m))


@query("a5_latency_two_pass", "WITH l AS (SELECT l_returnflag AS item, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) SELECT item, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99999), 6) AS p99_999 FROM l GROUP BY 1")
def _(spark, d):
    from .plans.percentiles import two_pass

    p = two_pass(_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("item"), F.col("l_extendedprice").cast("double").alias("v")), "item", "v", [0.5, 0.99999])
    return p.groupBy("item").agg(F.round(F.max(F.when(F.col("share") < 0.6, F.col("result"))), 6).alias("p50"), F.round(F.max(F.when(F.col("share") > 0.6, F.col("result"))), 6).alias("p99_999"))


@query("a10_event_counts", f"{UFS_D} SELECT count(*) AS n, count(*) FILTER (opcode = '0x28') AS reads, count(*) FILTER (opcode = '0x2a') AS writes, count(*) FILTER (opcode = '0x35') AS syncs, round(min(time), 6) AS first_time, round(max(time), 6) AS last_time FROM d")
def _(spark, d):
    return _round(stats.event_counts(view(spark, d, UFS), UFS), "first_time", "last_time")


@query("a11_quick_latency", "SELECT round(min(dtoc), 6) AS min_dtoc, round(max(dtoc), 6) AS max_dtoc, round(avg(dtoc), 4) AS avg_dtoc FROM {ufscustom}")
def _(spark, d):
    q = stats.quick_latency(view(spark, d, CUSTOM))
    return q.select(F.round("min_dtoc", 6).alias("min_dtoc"), F.round("max_dtoc", 6).alias("max_dtoc"), F.round("avg_dtoc", 4).alias("avg_dtoc"))


@query("a12_report_sizes", f"{BLOCK_D} SELECT 'summary' AS part, count(*) AS n FROM d UNION ALL SELECT 'types', count(DISTINCT left(io_type, 1)) FROM d")
def _(spark, d):
    r = stats.report(derived(spark, d, BLOCK), BLOCK)
    return r["summary"].select(F.lit("summary").alias("part"), "n").unionByName(r["types"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("types").alias("part"), "n"))


_A12_KEYS = {"summary": ("''", "0"), "counts": ("''", "0"), "types": ("item", "0"), "sizes": ("item", "size"), "latency": ("item", "0"), "histogram": ("item", "bucket")}


def _a12_tables(k: str) -> dict[str, str]:
    """The SQL of each table of a family's report."""
    rw = ("io_type LIKE 'R%'", "io_type LIKE 'W%'", "io_type LIKE '%S%'") if k == BLOCK else ("opcode = '0x28'", "opcode = '0x2a'", "opcode = '0x35'")
    time = "start_time" if k == CUSTOM else "time"
    out = {
        "summary": _summary_sql(k), "types": f"{DERIVED[k]} SELECT {_ITEM[k]} AS item, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM d) AS pct FROM d GROUP BY 1", "sizes": f"{DERIVED[k]} SELECT {_ITEM[k]} AS item, size, count(*) AS n FROM d WHERE {_COM[k]} GROUP BY 1, 2",
        "counts": f"{DERIVED[k]} SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {n}' for c, n in zip(rw, ('reads', 'writes', 'syncs')))}, min({time}) AS first_time, max({time}) AS last_time FROM d",
    }
    for m in LATENCIES:
        if k != CUSTOM or m == "dtoc":
            out[f"latency_{m}"] = _latency_sql(k, m)
        out[f"histogram_{m}"] = _histogram_sql(k, m)
    return out


_A12_VALUES = {
    "summary": ("n", "max_qd", "avg_qd", "avg_dtoc", "avg_ctoc", "avg_ctod", "continuous_pct", "aligned_pct"), "types": ("n", "pct"), "sizes": ("n",), "counts": ("n", "reads", "writes", "syncs", "first_time", "last_time"),
    "latency": ("n", "avg", "min", "median", "max", "std", *stats.PERCENTILES), "histogram": ("n",),
}


def _a12_sql(k: str) -> str:
    parts = []
    for name, sql in _a12_tables(k).items():
        what = name.split("_")[0]
        values = ", ".join(f"{{'name': '{c}', 'value': round(CAST({c} AS DOUBLE), 3)}}" for c in _A12_VALUES[what])
        parts.append(f"SELECT '{name}' AS part, {_A12_KEYS[what][0]} AS item, CAST({_A12_KEYS[what][1]} AS BIGINT) AS key, unnest([{values}], recursive := true) FROM ({sql})")
    return " UNION ALL ".join(parts)


def _a12(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Every value of every table of the report, a row each."""
    out = None
    for name, table in stats.report(derived(spark, d, kind), kind).items():
        what = name.split("_")[0]
        item, key = (F.col(x) if x in table.columns else F.lit("") for x in _A12_KEYS[what])
        values = F.array(*(F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 3).alias("value")) for c in _A12_VALUES[what]))
        key = key.cast("long") if _A12_KEYS[what][1] != "0" else F.lit(0).cast("long")
        one = table.select(F.lit(name).alias("part"), item.alias("item"), key.alias("key"), F.explode(values).alias("x")).select("part", "item", "key", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


for _kind in (UFS, BLOCK, CUSTOM):
    query(f"a12_report_{_kind}", _a12_sql(_kind))(lambda s, d, k=_kind: _a12(s, d, k))


# ---- charts -------------------------------------------------------------------------------------------------

for _kind in (UFS, BLOCK, CUSTOM):
    for _m in series.METRICS[_kind]:
        _where = f"{_m} > 0" if _m in LATENCIES else ("true" if _kind == CUSTOM else _REQ[_kind])
        _x = "start_time" if _kind == CUSTOM else "time"
        query(f"g_series_{_kind}_{_m}", f"{DERIVED[_kind]} SELECT round({_x}, 6) AS x_time, round(CAST({_m} AS DOUBLE), 6) AS y_value, {'io_type' if _kind == BLOCK else 'opcode'} AS \"group\" FROM d WHERE {_where}")(
            lambda s, d, k=_kind, m=_m: _round(series.metric_series(derived(s, d, k), k, m), "x_time", "y_value")
        )
for _kind in (UFS, BLOCK):
    for _w, _y in ((w, y) for w in ("request", "complete") for y in ("cpu", "address")):
        query(f"g4_cpu_{_kind}_{_w}_{_y}", f"{DERIVED[_kind]} SELECT round(time, 6) AS x_time, CAST({'cpu' if _y == 'cpu' else ('sector' if _kind == BLOCK else 'lba')} AS DOUBLE) AS y_value, CAST(cpu AS VARCHAR) AS \"group\" FROM d WHERE {(_REQ if _w == 'request' else _COM)[_kind]}")(
            lambda s, d, k=_kind, w=_w, y=_y: _round(series.cpu_series(derived(s, d, k), k, w, y), "x_time")
        )


@query("g5_axis_bounds", f"{UFS_D}, b AS (SELECT min(time) AS x0, max(time) AS x1, min(dtoc) AS y0, max(dtoc) AS y1 FROM d WHERE dtoc > 0) SELECT round(x0 - (x1 - x0) * 0.05, 4) AS x_min, round(x1 + (x1 - x0) * 0.05, 4) AS x_max, round(greatest(0, y0 - (y1 - y0) * 0.05), 4) AS y_min, round(y1 + (y1 - y0) * 0.05, 4) AS y_max FROM b")
def _(spark, d):
    b = series.axis_bounds(series.metric_series(derived(spark, d, UFS), UFS, "dtoc"))
    return b.select(*(F.round(c, 4).alias(c) for c in b.columns))


@query("g6_downsample", f"{UFS_D} SELECT opcode AS \"group\", CAST(floor(time / 3600) AS BIGINT) AS bin, min(dtoc) AS y_min, max(dtoc) AS y_max, round(avg(dtoc), 4) AS y_avg, count(*) AS n FROM d WHERE dtoc > 0 GROUP BY 1, 2")
def _(spark, d):
    return series.downsample(series.metric_series(derived(spark, d, UFS), UFS, "dtoc"), 3600.0).withColumn("y_avg", F.round("y_avg", 4))


# ---- benchmark logs -----------------------------------------------------------------------------------------


def bench_lines(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d)
    text = F.expr(f"""CASE event_id % 50
      WHEN 0 THEN concat('--- FIO run (Iteration ', event_id % 7, ') ---') WHEN 1 THEN concat('  WRITE: bw=', user_id, '.5MiB/s (x)') WHEN 2 THEN concat('   READ: bw=', user_id + 1, 'MiB/s')
      WHEN 11 THEN concat('| Write         1024 MBs |    0.5 s | ', user_id, '.25 MB/s | 1 % |') WHEN 12 THEN concat('| Read         1024 MBs |    0.5 s | ', user_id, '.75 MB/s | 1 % |')
      WHEN 13 THEN concat('| Random Write   10 MBs |    0.5 s | ', user_id, ' MB/s | 1 % |') WHEN 21 THEN concat('   1048576    1024 ', user_id, ' 0 ', user_id + 5, ' 0')
      WHEN 22 THEN concat('Parent sees throughput for 8 random readers = ', user_id * 1024, '.00 kB/sec') WHEN 23 THEN concat('Parent sees throughput for 8 random writers = ', user_id * 512, ' kB/sec')
      WHEN 30 THEN 'junk' ELSE concat('p-1 [001] ..... ', {_clock()}, ': ufshcd_command: ', CASE WHEN event_type IN ('click', 'view') THEN 'send_req' ELSE 'complete_rsp' END, ': dev0: tag: ', user_id % 8,
        ', DB: 0x0, size: 4096, IS: 0, LBA: ', user_id, ', opcode: 0x28 (X), group_id: 0x0, hwq_id: 1') END""")
    return e.select(F.lit("log").alias("source"), F.col("event_id").alias("line_ord"), text.alias("line"))


_BENCH = """WITH c AS (SELECT event_id AS line_ord, user_id, ts, event_type, event_id % 50 AS m FROM events),
s AS (SELECT *, sum(CASE WHEN m IN (11, 21) THEN 1 ELSE 0 END) OVER (ORDER BY line_ord) AS steps FROM c),
t AS (SELECT *, CAST(steps + coalesce(last_value(CASE WHEN m = 0 THEN line_ord % 7 - steps END IGNORE NULLS) OVER (ORDER BY line_ord), 0) AS BIGINT) AS iteration FROM s),
r AS (SELECT line_ord, iteration, CASE WHEN m IN (1, 2) THEN 'FIO' WHEN m IN (11, 12, 13) THEN 'TIOtest' ELSE 'IOzone' END AS tool,
  CASE m WHEN 1 THEN 'WRITE' WHEN 2 THEN 'READ' WHEN 11 THEN 'Write' WHEN 12 THEN 'Read' WHEN 13 THEN 'Random Write' WHEN 21 THEN 'Sequential' WHEN 22 THEN 'Random Read' ELSE 'Random Write' END AS test_type,
  CAST(CASE m WHEN 1 THEN user_id + 0.5 WHEN 2 THEN user_id + 1 WHEN 11 THEN user_id + 0.25 WHEN 12 THEN user_id + 0.75 WHEN 23 THEN user_id * 0.5 ELSE user_id END AS DOUBLE) AS bandwidth
  FROM t WHERE m IN (1, 2, 11, 12, 13, 21, 22, 23)),
b AS (SELECT iteration, tool, round(arg_max(bandwidth, line_ord) FILTER (upper(test_type) LIKE '%WRITE%'), 2) AS write, round(arg_max(bandwidth, line_ord) FILTER (upper(test_type) LIKE '%READ%'), 2) AS read FROM r GROUP BY 1, 2)"""


@query("b1_classify", "SELECT CASE m WHEN 0 THEN 'fio_header' WHEN 1 THEN 'fio' WHEN 2 THEN 'fio' WHEN 11 THEN 'tiotest' WHEN 12 THEN 'tiotest' WHEN 13 THEN 'tiotest' WHEN 21 THEN 'iozone_sequential' WHEN 22 THEN 'iozone_random' WHEN 23 THEN 'iozone_random' WHEN 30 THEN 'other' ELSE 'ufs' END AS class, count(*) AS n FROM (SELECT event_id % 50 AS m FROM events) GROUP BY 1")
def _(spark, d):
    return bench_lines(spark, d).groupBy(bench.classify(F.col("line")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("b2_iterations", f"{_BENCH} SELECT line_ord, iteration FROM t")
def _(spark, d):
    return bench.assign_iteration(bench_lines(spark, d)).select("line_ord", "iteration")


@query("b3_results", f"{_BENCH} SELECT * FROM r")
def _(spark, d):
    return bench.results(bench.assign_iteration(bench_lines(spark, d))).drop("source")


@query("b4_results_table", f"{_BENCH} SELECT * FROM b WHERE write IS NOT NULL OR read IS NOT NULL")
def _(spark, d):
    return bench.results_table(bench.results(bench.assign_iteration(bench_lines(spark, d)))).drop("source")


@query("b5_results_arrays", f"{_BENCH} SELECT tool, list(read ORDER BY iteration) FILTER (iteration > 0 AND read IS NOT NULL) AS read, list(write ORDER BY iteration) FILTER (iteration > 0 AND write IS NOT NULL) AS write FROM b GROUP BY tool")
def _(spark, d):
    return bench.results_arrays(bench.results_table(bench.results(bench.assign_iteration(bench_lines(spark, d))))).drop("source", "json")


@query("b6_iteration_depth", f"""{_BENCH}, e AS (SELECT line_ord, iteration, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS v, user_id % 8 AS tag, {_TIME} AS time FROM t WHERE m NOT IN (0, 1, 2, 11, 12, 13, 21, 22, 23, 30) AND iteration > 0),
  x AS (SELECT *, row_number() OVER (ORDER BY time, v, tag, line_ord) AS rn FROM e), y AS (SELECT *, sum(v) OVER (PARTITION BY iteration ORDER BY rn) AS s FROM x)
  SELECT line_ord, iteration, CAST(s - least(0, min(s) OVER (PARTITION BY iteration ORDER BY rn)) AS BIGINT) AS qd FROM y""")
def _(spark, d):
    return bench.iteration_events(bench.assign_iteration(bench_lines(spark, d)), UFS).select("line_ord", "iteration", "qd")


@query("b7_whole_log", f"{_BENCH} SELECT count(*) AS n, count(*) AS reads, 0 AS writes, 0 AS syncs FROM t WHERE m NOT IN (0, 1, 2, 11, 12, 13, 21, 22, 23, 30)")
def _(spark, d):
    return bench.whole_log(bench_lines(spark, d))[UFS][1].select("n", "reads", "writes", "syncs")


@query("b7_whole_log_without_repeats", f"{_BENCH} SELECT count(*) AS n, count(*) AS reads, 0 AS writes, 0 AS syncs FROM (SELECT DISTINCT ts, user_id % 8, event_type IN ('click', 'view') FROM t WHERE m NOT IN (0, 1, 2, 11, 12, 13, 21, 22, 23, 30))")
def _(spark, d):
    return bench.whole_log(bench_lines(spark, d), drop_repeats=True)[UFS][1].select("n", "reads", "writes", "syncs")


# ---- sources, sinks, migration ------------------------------------------------------------------------------


@query("s1_read_log_lines", "SELECT count(*) AS n, count(DISTINCT event_id) AS places FROM events")
def _(spark, d):
    path = work_path(spark, "s1")
    lines(spark, d).select("line").write.text(path)
    got = logs.read_log_lines(spark, path)
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source", "line_ord").alias("places"))


@query("s1_read_log_segments", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events")
def _(spark, d):
    """The place of each line in a log of several files, from the order that reading gives it."""
    path = work_path(spark, "s1")
    _table(spark, d).orderBy("event_id").select(F.concat(F.lit("line "), "event_id").alias("line")).write.text(path)
    trail = scan.Trail()
    rows = scan.bucketed(logs.read_log_segments(spark, path), ["source"], "line_ord", None, trail)
    rows = scan.running_sum(rows, ["source"], ["line_ord"], F.lit(1).cast("long"), "place", trail)
    return rows.select(F.regexp_extract("line", r"line (\d+)", 1).cast("long").alias("event_id"), "place")


def _archives(spark: SparkSession, d: str) -> str:
    """A folder of archives of the lines, one a task, with a smaller log and a larger file that is none beside them."""
    folder = work_path(spark, "s2")
    endings = ("tar", "tar.gz", "tar.xz", "zip")

    def pack(batches):
        k, text = TaskContext.get().partitionId(), io.BytesIO()
        for b in batches:
            text.write("".join(x + "\n" for x in b.column("line").to_pylist()).encode())
        members = {"small.log": b"junk\n", "x/large.txt": text.getvalue(), "huge.bin": text.getvalue() * 2}
        out, ending = io.BytesIO(), endings[k % 4]
        if ending == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in members.items():
                    z.writestr(name, content)
        else:
            with tarfile.open(fileobj=out, mode="w" + ending[3:].replace(".", ":")) as t:
                for name, content in members.items():
                    info = tarfile.TarInfo(name)
                    info.size = len(content)
                    t.addfile(info, io.BytesIO(content))
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{k}.{ending}", compression=None) as f:
            f.write(out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], names=["k"])

    # An archive of at most 50,000 lines a task.
    tasks = max(4, _table(spark, d).count() // 50_000)
    lines(spark, d).select("line").repartition(tasks).mapInArrow(pack, "k int").write.format("noop").mode("overwrite").save()
    return folder


@query("s2_read_archived_lines", _P5.replace("line_ord, opcode", "opcode"))
def _(spark, d):
    got = parse.events(parse.parse_log(logs.read_archived_lines(spark, _archives(spark, d))), CUSTOM)
    return got.select("opcode", "lba", "size", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"), F.round("dtoc", 3).alias("dtoc"))


@query("s5_read_events_dir", f"{CUSTOM_D} SELECT round(start_time, 6) AS start_time, opcode, lba, size, start_qd, end_qd, ctoc FROM d UNION ALL SELECT round(start_time, 6), opcode, lba, size, start_qd, end_qd, ctoc FROM d")
def _(spark, d):
    """Two datasets at different depths below a folder, beside files of another kind."""
    root, rows = work_path(spark, "s5"), materialise(derived(spark, d, CUSTOM), "s5-rows")  # what makes them runs once
    for place in ("a/one", "b/c/two"):
        sinks.write_events(rows, f"{root}/{place}", CUSTOM)
    rows.select("opcode").write.csv(f"{root}/b/notes")
    return _round(stored.read_events(spark, root, recursive=True, pattern="*.parquet").select("start_time", "opcode", "lba", "size", "start_qd", "end_qd", "ctoc"), "start_time", "ctoc")


def _stored(spark: SparkSession, d: str, kind: str) -> str:
    return sinks.write_events(derived(spark, d, kind), work_path(spark, "k1"), kind)


for _kind in (UFS, BLOCK, CUSTOM):
    _cols = "round(time, 6) AS time, qd, dtoc, ctoc, ctod, continuous, aligned" if _kind != CUSTOM else "round(start_time, 6) AS start_time, start_qd, end_qd, ctoc, ctod, continuous, aligned"
    query(f"k1_s3_round_trip_{_kind}", f"{DERIVED[_kind]} SELECT {_cols} FROM d")(lambda s, d, k=_kind, c=_cols: stored.read_events(s, _stored(s, d, k)).selectExpr(*_columns_of(c)))


def _columns_of(text: str) -> list[str]:
    return [x.replace(";", ",").strip() for x in text.replace("time, 6)", "time; 6)").split(",")]


_ROWS = "opcode, lba, size, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(dtoc, 3) AS dtoc"


def _custom_rows(df: DataFrame) -> DataFrame:
    return df.select("opcode", "lba", "size", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"), F.round("dtoc", 3).alias("dtoc"))


@query("k2_append", f"SELECT {_ROWS} FROM {{ufscustom}} UNION ALL SELECT {_ROWS} FROM {{ufscustom}}")
def _(spark, d):
    path, rows = work_path(spark, "k2"), view(spark, d, CUSTOM)
    sinks.write_events(rows, path, CUSTOM)
    return _custom_rows(stored.read_events(spark, sinks.append_events(rows, path, CUSTOM)))


@query("k3_write_csv", f"SELECT {_ROWS} FROM {{ufscustom}}")
def _(spark, d):
    path = work_path(spark, "k3")
    sinks.write_csv(view(spark, d, CUSTOM), path, CUSTOM, most_rows=1000)
    return _custom_rows(spark.read.option("header", "true").option("inferSchema", "true").csv(path)).withColumns({c: F.col(c).cast("long") for c in ("lba", "size")})


@query("k3_csv_files", "SELECT round(start_time, 6) AS start_time, true AS named, true AS short FROM {ufscustom}")
def _(spark, d):
    """Each row is in a file whose name says the times it spans, and which has no more rows than it may."""
    path = work_path(spark, "k3")
    index = sinks.write_csv(view(spark, d, CUSTOM), path, CUSTOM, most_rows=1000)
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(path).select("start_time", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).join(index, "file")
    said = [F.regexp_extract("file", r"^ufscustom_([\d.]+?)_([\d.]+?)(_\d+)?\.csv$", k).cast("double") for k in (1, 2)]
    return rows.select(F.round("start_time", 6).alias("start_time"), ((F.col("start_time") >= said[0] - 1e-9) & (F.col("start_time") <= said[1] + 1e-9)).alias("named"), (F.col("rows") <= 1000).alias("short"))


@query("k4_partitioned", "SELECT DISTINCT user_id % 8 AS iteration FROM events")
def _(spark, d):
    path = sinks.write_events(view(spark, d, UFS).withColumn("iteration", F.col("cpu")), work_path(spark, "k4"), UFS, partition_by=("iteration",))
    return sinks.iterations(spark, path).select(F.col("iteration").cast("long").alias("iteration"))


@query("k5_json_rows", "SELECT round(time, 6) AS time, process, cpu, action, tag, opcode, lba, size, 0 AS qd, false AS continuous FROM {ufs} WHERE cpu IN (1, 2)")
def _(spark, d):
    j = sinks.json_rows(view(spark, d, UFS), UFS, ["cpu:1-2"])
    back = j.select(F.from_json("json", STORED[UFS]).alias("x")).select("x.*")
    return _round(back.select("time", "process", "cpu", "action", "tag", "opcode", "lba", "size", "qd", "continuous"), "time")


@query("k6_parquet_to_csv", f"{UFS_D} SELECT round(time, 6) AS time, action, tag, opcode, lba, qd, dtoc, ctoc, ctod, continuous FROM d WHERE cpu = 3")
def _(spark, d):
    path = work_path(spark, "k6")
    sinks.parquet_to_csv(spark, _stored(spark, d, UFS), path, ["cpu:3"])
    back = spark.read.option("header", "true").schema(STORED[UFS]).csv(path)
    return _round(back.select("time", "action", "tag", "opcode", "lba", "qd", *LATENCIES, "continuous"), "time", *LATENCIES)


_K7 = """WITH b AS (SELECT line_ord, time, sector, size, io_type, CASE WHEN line_ord % 4 = 1 THEN action WHEN action = 'block_rq_issue' THEN 'Q' ELSE 'C' END AS action,
  CASE WHEN io_type LIKE 'R%' THEN 'read' WHEN io_type LIKE 'W%' THEN 'write' WHEN io_type LIKE 'D%' THEN 'discard' ELSE 'other' END AS c FROM {block} WHERE line_ord % 4 IN (1, 2)),
o2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, sector, size, io_type ORDER BY line_ord) AS n FROM b) WHERE n = 1),
o4 AS (SELECT * FROM o2 WHERE NOT (action = 'block_rq_complete' AND io_type LIKE 'W%' AND size = 0)),
o3 AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY sector, c, size, action IN ('block_rq_issue', 'block_rq_complete') ORDER BY time, line_ord) AS ba FROM o4)
  WHERE NOT (action = 'block_rq_issue' AND coalesce(ba, '') = 'block_rq_issue'))
SELECT 'block' AS kind, count(*) AS n FROM o3 UNION ALL SELECT 'ufs', count(*) FROM {ufs} WHERE line_ord % 4 = 0 AND action <> 'other' UNION ALL SELECT 'ufscustom', count(*) FROM {ufs} WHERE line_ord % 4 = 3 AND line_ord % 24 NOT IN (3, 7)"""


def _log_job(spark: SparkSession, d: str, drop_repeats: tuple[str, ...]) -> DataFrame:
    """Files are pieces of one log in event order, however many the table is written as."""
    path = work_path(spark, "k7")
    lines(spark, d).orderBy("line_ord").select("line").write.text(path)
    made = sinks.log_to_parquet(spark, path, work_path(spark, "k7-out"), drop_repeats=drop_repeats, segments=True)
    out = None
    for kind, p in sorted(made.items()):
        one = spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


query("k7_log_to_parquet", _K7.replace("WHERE n = 1", ""))(lambda s, d: _log_job(s, d, ()))
query("k7_log_to_parquet_without_repeats", _K7)(lambda s, d: _log_job(s, d, (BLOCK,)))  # as the SQL: repeats of block events go, others stay


@query("b8_benchmark_log", f"{_BENCH} SELECT * FROM b WHERE write IS NOT NULL OR read IS NOT NULL")
def _(spark, d):
    """From files of raw lines (iozone rows begin with blanks) to the table of results; files are pieces in event order."""
    path = work_path(spark, "b8")
    bench_lines(spark, d).orderBy("line_ord").select("line").write.text(path)
    made = sinks.benchmark_log(spark, path, work_path(spark, "b8-out"), segments=True)
    return spark.read.parquet(made["results"]).drop("source")


@query("b8_benchmark_log_depth", f"""{_BENCH}, e AS (SELECT iteration, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS v, user_id % 8 AS tag, line_ord, {_TIME} AS time FROM t WHERE m NOT IN (0, 1, 2, 11, 12, 13, 21, 22, 23, 30) AND iteration > 0),
  x AS (SELECT *, row_number() OVER (ORDER BY time, v, tag, line_ord) AS rn FROM e), y AS (SELECT *, sum(v) OVER (PARTITION BY iteration ORDER BY rn) AS s FROM x),
  z AS (SELECT iteration, CAST(s - least(0, min(s) OVER (PARTITION BY iteration ORDER BY rn)) AS BIGINT) AS qd FROM y) SELECT iteration, count(*) AS n, CAST(sum(qd) AS BIGINT) AS depths, max(qd) AS deepest FROM z GROUP BY 1""")
def _(spark, d):
    path = work_path(spark, "b8")
    bench_lines(spark, d).orderBy("line_ord").select("line").write.text(path)
    made = sinks.benchmark_log(spark, path, work_path(spark, "b8-out"), segments=True)
    rows = spark.read.parquet(made[UFS]).groupBy(F.col("iteration").cast("long").alias("iteration"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("qd").alias("depths"), F.max("qd").alias("deepest"))


@query("k8_analyse", _latency_sql(UFS, "dtoc"))
def _(spark, d):
    return sinks.analyse(spark, _stored(spark, d, UFS))["latency_dtoc"]


@query("m1_detect_event_type", "SELECT 'ufs' AS kind, count(*) AS n FROM {ufs} UNION ALL SELECT 'block', count(*) FROM {block} UNION ALL SELECT 'ufscustom', count(*) FROM {ufscustom}")
def _(spark, d):
    """The family of datasets under names that don't tell it, from their columns."""
    out = None
    for k, kind in enumerate((UFS, BLOCK, CUSTOM)):
        path = work_path(spark, f"m1-{k}")
        conform(view(spark, d, kind), kind).write.parquet(path)
        rows = spark.read.parquet(path)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(event_type(rows.columns)).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("m2_migrate", "SELECT opcode, lba, size, 0 AS start_qd, 0 AS end_qd, count(*) AS n FROM {ufscustom} GROUP BY 1, 2, 3")
def _(spark, d):
    old = view(spark, d, CUSTOM).select("opcode", "lba", "size", "start_time", "end_time", "dtoc")
    return stored.migrate(old).groupBy("opcode", "lba", "size", "start_qd", "end_qd").agg(F.count(F.lit(1)).alias("n"))


@query("m3_migrate_dir", "SELECT 'ufscustom' AS kind, true AS changed, count(*) AS n FROM events UNION ALL SELECT 'ufs', false, count(*) FROM events")
def _(spark, d):
    old, target = work_path(spark, "m3") + "_old.parquet", work_path(spark, "m3-out")
    view(spark, d, CUSTOM).select("opcode", "lba", "size", "start_time", "end_time", "dtoc").write.parquet(old)
    done = stored.migrate_dir(spark, [old, _stored(spark, d, UFS)], target)
    out = None
    for m in done:
        one = spark.read.parquet(m.target).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m.kind).alias("kind"), F.lit(m.changed).alias("changed"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- streaming statistics, on stored events ------------------------------------------------------------------


def live_events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d)
    kind = F.when(F.col("event_type").isin("click", "view"), UFS).when(F.col("event_type") == "purchase", BLOCK).otherwise(CUSTOM)
    return e.select(F.col("event_id").alias("line_ord"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("value").alias("latency"))


_LIVE = "WITH e AS (SELECT event_id AS line_ord, ts, CASE WHEN event_type IN ('click', 'view') THEN 'ufs' WHEN event_type = 'purchase' THEN 'block' ELSE 'ufscustom' END AS kind, value AS latency FROM events), h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS total, count(*) / 3600.0 AS entries_per_second, avg(latency) AS avg_latency, min(latency) AS min_latency, max(latency) AS max_latency, avg(CAST(kind = 'ufs' AS INT)) AS ufs_ratio FROM e GROUP BY 1)"


@query("r2_running", f"{_LIVE} SELECT count(*) AS total, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS entries_per_second, round(avg(latency), 4) AS avg_latency, min(latency) AS min_latency, max(latency) AS max_latency, count(*) FILTER (kind = 'ufs') AS n_ufs, count(*) FILTER (kind = 'block') AS n_block, count(*) FILTER (kind = 'ufscustom') AS n_ufscustom FROM e")
def _(spark, d):
    return live.running(live_events(spark, d)).withColumns({"entries_per_second": F.round("entries_per_second", 6), "avg_latency": F.round("avg_latency", 4)})


@query("r3_history", f"{_LIVE} SELECT epoch_us(start) // 1000000 AS start, total, round(entries_per_second, 6) AS entries_per_second, round(avg_latency, 4) AS avg_latency, min_latency, max_latency, round(ufs_ratio, 6) AS ufs_ratio FROM h")
def _(spark, d):
    h = live.history(live_events(spark, d), "1 hour")
    return h.select(F.unix_seconds("start").alias("start"), "total", F.round("entries_per_second", 6).alias("entries_per_second"), F.round("avg_latency", 4).alias("avg_latency"), "min_latency", "max_latency", F.round("ufs_ratio", 6).alias("ufs_ratio"))


@query("r4_alerts", f"{_LIVE} SELECT epoch_us(start) // 1000000 AS start, 'high average latency' AS rule FROM h WHERE avg_latency > 100 UNION ALL SELECT epoch_us(start) // 1000000, 'high latency' FROM h WHERE max_latency > 1000 UNION ALL SELECT epoch_us(start) // 1000000, 'low rate' FROM h WHERE entries_per_second < 10 UNION ALL SELECT epoch_us(start) // 1000000, 'high rate' FROM h WHERE entries_per_second > 10000")
def _(spark, d):
    return live.alerts(live.history(live_events(spark, d), "1 hour")).select(F.unix_seconds("start").alias("start"), "rule")


@query("r5_trend", f"{_LIVE}, p AS (SELECT epoch_us(start) / 1e6 AS x, avg_latency AS y FROM h ORDER BY start DESC LIMIT 1000), z AS (SELECT x - min(x) OVER () AS x, y FROM p) SELECT round(regr_slope(y, x) * 1e6, 4) AS slope, round(regr_r2(y, x), 6) AS confidence, count(*) AS n FROM z")
def _(spark, d):
    h = live.history(live_events(spark, d), "1 hour").select(F.lit("avg_latency").alias("metric"), "start", F.col("avg_latency").alias("value"))
    return live.trend(h).select(F.round(F.col("slope") * 1e6, 4).alias("slope"), F.round("confidence", 6).alias("confidence"), "n")


@query("r6_anomalies", f"{_LIVE}, z AS (SELECT start, avg_latency AS v, (avg_latency - avg(avg_latency) OVER w) / nullif(stddev_samp(avg_latency) OVER w, 0) AS z FROM h WINDOW w AS (ORDER BY start ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT epoch_us(start) // 1000000 AS start, round(v, 4) AS value, round(z, 4) AS z FROM z WHERE abs(z) >= 1.5")
def _(spark, d):
    h = live.history(live_events(spark, d), "1 hour").select(F.lit("avg_latency").alias("metric"), "start", F.col("avg_latency").alias("value"))
    return live.anomalies(h, 100, 1.5).select(F.unix_seconds("start").alias("start"), F.round("value", 4).alias("value"), F.round("z", 4).alias("z"))


@query("r7_recent", f"{_LIVE} SELECT line_ord, kind FROM e WHERE kind = 'block' ORDER BY ts DESC, line_ord DESC LIMIT 50")
def _(spark, d):
    return live.recent(live_events(spark, d), 50, (BLOCK,)).select("line_ord", "kind")


@query("r9_subscription", f"{_LIVE} SELECT line_ord FROM e WHERE kind IN ('ufs', 'block') AND latency >= 100 AND latency <= 300")
def _(spark, d):
    return live_events(spark, d).where(live.subscription((UFS, BLOCK), 100, 300)).select("line_ord")


# ---- streams, run over the tables to their end ----------------------------------------------------------------


def _run(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> str:
    """Starts a query, waits until it has read all there is, stops it; the folder that it has filled."""
    spark = stream.sparkSession
    out = out or work_path(spark, f"{name}-out")
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint or work_path(spark, f"{name}-check")).start(out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


@query("r1_tail", "SELECT round(time, 6) AS time, process, cpu, action, tag, opcode, lba FROM {ufs} WHERE line_ord % 4 = 0 AND action <> 'other'")
def _(spark, d):
    """Lines of files that a stream follows, appended after it has begun, to parsed events."""
    path = work_path(spark, "r1")
    text = lines(spark, d)
    state, check, out = work_path(spark, "r1-state"), work_path(spark, "r1-check"), work_path(spark, "r1-out")
    for half in (0, 1):
        text.where(F.col("line_ord") % 8 >= 4 if half else F.col("line_ord") % 8 < 4).select("line").write.mode("append").text(path)
        _run(parse.events(parse.parse_log(tail.tail(spark, f"{path}/*.txt", state)), UFS), "r1", check, out)
    return _round(spark.read.parquet(out).select("time", "process", "cpu", "action", "tag", "opcode", "lba"), "time")


def _live(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """A log that arrives in order of time, in pieces of about 200,000 events (four at least; equal times stay together), the
    query stopped and started between them. Pieces are written by one job and moved, one at a time, to where the query looks."""
    live_derive.use_rocksdb(spark)
    rows, trail = view(spark, d, kind), scan.Trail()
    made, folder, check, out = (work_path(spark, f"r8-{x}") for x in ("pieces", "in", "check", "out"))
    pieces = max(4, -(-rows.count() // 200_000))
    cut = scan.bucketed(rows, ["source"], time_column(kind), pieces, trail).withColumnRenamed(scan.BUCKET, "piece")
    cut.repartition("piece").write.partitionBy("piece").parquet(made)
    live_derive.closing(spark, ["log"], rows.schema, kind).write.parquet(f"{made}/closing")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place(folder))
    for k, name in enumerate([*(f"piece={k}" for k in range(pieces)), "closing"]):
        if not fs.exists(place(f"{made}/{name}")):  # fewer times than pieces
            continue
        if not fs.rename(place(f"{made}/{name}"), place(f"{folder}/{k}")):
            raise RuntimeError(f"{made}/{name} could not be moved")
        with live_derive.state_partitions(spark, 1):
            _run(live_derive.derive(spark.readStream.schema(rows.schema).parquet(f"{folder}/*"), kind), "r8", check, out)
    return spark.read.parquet(out).where("not late")


for _kind, _columns in {UFS: ("qd", *LATENCIES, "continuous"), BLOCK: ("qd", *LATENCIES, "continuous"), CUSTOM: ("start_qd", "end_qd", "ctoc", "ctod", "continuous")}.items():
    query(f"r8_live_derive_{_kind}", f"{DERIVED[_kind]} SELECT line_ord, {', '.join(_columns)} FROM d")(lambda s, d, k=_kind, c=_columns: _round(_live(s, d, k).select("line_ord", *c), *(x for x in c if x in LATENCIES)))


@query("r10_late_rows", """WITH e AS (SELECT event_id % 3 AS batch, ts, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events),
m AS (SELECT b.batch, max(e.ts) - INTERVAL 1 DAY AS low FROM (SELECT DISTINCT batch FROM e) b LEFT JOIN e ON e.batch < b.batch GROUP BY 1)
SELECT epoch_us(start) // 1000000 AS start, coalesce(start + INTERVAL 1 HOUR <= low, false) AS late, count(*) AS n FROM e JOIN m USING (batch) GROUP BY 1, 2""")
def _(spark, d):
    """Three batches, each of which spans all the time, so all but the first come late for windows that ended a day ago."""
    path, check, folder = work_path(spark, "r10"), work_path(spark, "r10-check"), work_path(spark, "r10-in")
    rows = live_events(spark, d)
    for k in range(3):
        rows.where(F.col("line_ord") % 3 == k).write.mode("append").parquet(folder)
        q = history.keep_history(spark.readStream.schema(rows.schema).parquet(folder), path, check, "1 hour", "1 day")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    one = lambda df, late: df.select(F.unix_seconds("start").alias("start"), F.lit(late).alias("late"), F.col("total").alias("n"))
    return one(history.read_history(spark, path), False).unionByName(one(history.late_counts(spark, path), True))
