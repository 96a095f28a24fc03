"""Benchmark logs: fio, tiotest and iozone output mixed with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..plans import scan
from ..schemas import TYPES
from . import order
from .derive import derive
from .stats import event_counts

# The formats of result lines.
FIO_HEADER = r"---\s+FIO.*\(Iteration\s+(\d+)\)\s+---"
FIO_RESULT = r"(WRITE|READ):\s+bw=(\d+\.?\d*)MiB/s"
TIOTEST = r"\|\s+(Write|Read|Random Write|Random Read)\s+\d+\s+MBs\s+\|.*\|\s+(\d+\.?\d*)\s+MB/s\s+\|"
IOZONE_ROW = r"^\s+\d+\s+\d+\s+(\d+)\s+\d+\s+(\d+)"
IOZONE_RANDOM = r"Parent sees throughput for \d+ random (readers|writers)\s+=\s+(\d+\.?\d*)\s+kB/sec"
CUSTOM_START = r"^0x[0-9a-f]+,\d+,\d+,"


def classify(line: Column) -> Column:
    return (
        F.when(line.rlike(FIO_HEADER), "fio_header")
        .when(line.rlike(FIO_RESULT), "fio")
        .when(line.rlike(TIOTEST), "tiotest")
        .when(line.rlike(IOZONE_ROW), "iozone_sequential")
        .when(line.rlike(IOZONE_RANDOM), "iozone_random")
        .when(line.contains("ufshcd_command:"), "ufs")
        .when(line.contains("block_rq_"), "block")
        .when(line.rlike(CUSTOM_START), "ufscustom")
        .otherwise("other")
    )


def assign_iteration(lines: DataFrame, buckets: int | None = None) -> DataFrame:
    """lines(source, line_ord, line) -> with class and iteration.

    An fio header sets the number; a tiotest Write row and an iozone sequential row add one to it, for themselves
    too. With the running sum of steps, what a header sets is a base that holds until the next."""
    rows = lines.withColumn("class", classify(F.col("line")))
    step = ((F.col("class") == "tiotest") & (F.regexp_extract("line", TIOTEST, 1) == "Write")) | (F.col("class") == "iozone_sequential")
    trail = scan.Trail()
    rows = scan.bucketed(rows, ["source"], "line_ord", buckets, trail)
    rows = scan.running_sum(rows, ["source"], ["line_ord"], step.cast("long"), "__steps", trail)
    number = F.regexp_extract("line", FIO_HEADER, 1).try_cast("long")
    head = (F.col("class") == "fio_header") & number.isNotNull()
    own = number - F.col("__steps")
    rows = scan.last_before(rows, ["source"], ["line_ord"], {"__base": (own, head)}, trail)
    base = F.when(head, own).otherwise(F.coalesce("__base", F.lit(0)))
    return rows.withColumn("iteration", (F.col("__steps") + base).cast("long")).drop("__steps", "__base", scan.BUCKET)


def results(tagged: DataFrame) -> DataFrame:
    """source, line_ord, iteration, tool, test_type, bandwidth (MiB/s, MB/s; the iozone row as it stands)."""
    what, line = F.col("class"), F.col("line")
    number = lambda regex, k: F.regexp_extract(line, regex, k).try_cast("double")
    tool = F.when(what == "fio", "FIO").when(what == "tiotest", "TIOtest").when(what.startswith("iozone"), "IOzone")
    test = (
        F.when(what == "fio", F.regexp_extract(line, FIO_RESULT, 1))
        .when(what == "tiotest", F.regexp_extract(line, TIOTEST, 1))
        .when(what == "iozone_sequential", "Sequential")
        .otherwise(F.when(F.regexp_extract(line, IOZONE_RANDOM, 1) == "readers", "Random Read").otherwise("Random Write"))
    )
    band = F.when(what == "fio", number(FIO_RESULT, 2)).when(what == "tiotest", number(TIOTEST, 2)).when(what == "iozone_sequential", number(IOZONE_ROW, 1)).otherwise(number(IOZONE_RANDOM, 2) / 1024)
    return tagged.where(what.isin("fio", "tiotest", "iozone_sequential", "iozone_random")).select("source", "line_ord", "iteration", tool.alias("tool"), test.alias("test_type"), band.alias("bandwidth"))


def results_table(found: DataFrame, compat: bool = False) -> DataFrame:
    """Write and read per iteration and tool, the later row of a test winning. compat: only upper-case names count."""
    name = F.col("test_type") if compat else F.upper("test_type")
    last = lambda word: F.round(F.max_by(F.when(name.contains(word), F.col("bandwidth")), F.when(name.contains(word), F.col("line_ord"))), 2)
    table = found.groupBy("source", "iteration", "tool").agg(last("WRITE").alias("write"), last("READ").alias("read"))
    return table.where("write is not null or read is not null")


def results_arrays(table: DataFrame) -> DataFrame:
    """Per tool: read and write from iteration 1 on, and as JSON."""
    pick = lambda c: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("iteration", c))), lambda x: (x["iteration"] > 0) & x[c].isNotNull()), lambda x: x[c])
    out = table.groupBy("source", "tool").agg(pick("read").alias("read"), pick("write").alias("write"))
    return out.withColumn("json", F.to_json(F.struct("read", "write")))


def iteration_events(tagged: DataFrame, kind: str, buckets: int | None = None) -> DataFrame:
    """Events of iterations above 0, each iteration derived on its own."""
    lines = tagged.where((F.col("iteration") > 0) & F.col("class").isin(*TYPES)).select("source", "line_ord", "iteration", "line")
    events = parse.events(parse.parse_log(lines), kind)
    return derive(events, kind, ("source", "iteration"), buckets)


def whole_log(lines: DataFrame, buckets: int | None = None, drop_repeats: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per family: all events derived together, and their counts."""
    parsed = parse.parse_log(lines)
    out = {}
    for kind in TYPES:
        events = parse.events(parsed, kind)
        events = derive(order.drop_repeated(events, kind) if drop_repeats else events, kind, buckets=buckets)
        out[kind] = (events, event_counts(events, kind))
    return out
