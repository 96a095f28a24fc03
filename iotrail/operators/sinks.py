"""Parquet, CSV and JSON output of events, and the jobs that go from one form to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from ..schemas import CUSTOM, TYPES, conform, event_type, time_column
from ..sources.events import read_events
from ..sources.logs import read_log_lines, read_log_segments
from ..work import forget, materialise
from . import bench, order, stats
from .derive import derive
from .filters import Filter, filter_events

# Estimated bytes a row, codec by estimated size (below MB -> codec and level), limits and CSV order.
ROW_BYTES = {"ufs": 200, "block": 250, "ufscustom": 150}
CODECS = ((1, "snappy", None), (10, "zstd", 3), (100, "zstd", 6), (float("inf"), "zstd", 9))
CSV_ROWS = 1_048_575
CSV_CUSTOM = ("start_time", "end_time", "opcode", "lba", "size", "start_qd", "end_qd", "dtoc", "ctoc", "ctod", "continuous")


def codec_for(rows: int, kind: str) -> tuple[str, int | None]:
    mb = rows * ROW_BYTES[kind] / (1 << 20)
    return next((c, level) for top, c, level in CODECS if mb < top)


def _sorted(df: DataFrame, kind: str) -> DataFrame:
    have = set(df.columns)
    by = [c for c in ("source", *order.ORDER[kind], "line_ord") if c in have]
    return df.sortWithinPartitions(*by)


def write_events(df: DataFrame, path: str, kind: str, rows: int | None = None, partition_by: tuple[str, ...] = (), mode: str = "errorifexists", row_group_mb: int = 128, rows_a_file: int = 500_000) -> str:
    """<path>_<kind>.parquet, sorted within files. rows: an estimate that picks the codec; if it is left out, df is
    written to a working table first and counted there, so that what makes df runs once, and sorted in ranges of time of about
    rows_a_file rows, where a task would else sort as much as a split of the working table holds."""
    whole = None
    if rows is None:
        df = whole = materialise(df, "events")
        rows = df.count()
        if rows > rows_a_file:
            df = df.repartitionByRange(-(-rows // rows_a_file), time_column(kind))
    codec, level = codec_for(rows, kind)
    target = f"{path}_{kind}.parquet"
    writer = _sorted(conform(df, kind, partition_by), kind).write.mode(mode).option("compression", codec).option("parquet.block.size", row_group_mb << 20)
    if level:
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    forget(whole)
    return target


def append_events(df: DataFrame, path: str, kind: str, rows: int | None = None) -> str:
    return write_events(df, path, kind, rows, mode="append")


def iterations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("iteration").distinct()


def _clock(c: str) -> Column:
    """Seconds without needless zeros, to the nanosecond."""
    return F.regexp_replace(F.format_string("%.9f", F.col(c)), r"\.?0+$", "")


def write_csv(df: DataFrame, path: str, kind: str, most_rows: int = CSV_ROWS) -> DataFrame:
    """Header lines, at most most_rows a file, files in order of time. A file is named by its family and its first and last
    time, and a number if others have the same. Returns (file, rows, first_time, last_time)."""
    spark, rows, time = df.sparkSession, conform(df, kind), time_column(kind)
    if kind == CUSTOM:
        rows = rows.select(*CSV_CUSTOM)
    rows.repartitionByRange(time).sortWithinPartitions(time).write.option("header", "true").option("maxRecordsPerFile", most_rows).csv(path)
    written = spark.read.option("header", "true").schema(rows.schema).csv(path)
    old = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    index = written.groupBy(old.alias("old")).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    index = index.withColumn("name", F.concat_ws("_", F.lit(kind), _clock("first_time"), _clock("last_time")))
    nth = F.row_number().over(W.partitionBy("name").orderBy("old"))
    index = index.withColumn("file", F.concat("name", F.when(nth > 1, F.concat(F.lit("_"), nth)).otherwise(""), F.lit(".csv")))
    index = materialise(index, "csv-index", 1)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in index.select("old", "file").toLocalIterator():  # a name a file; data stays where it is
        if not fs.rename(place(f"{path}/{r.old}"), place(f"{path}/{r.file}")):
            raise RuntimeError(f"{r.old} could not be renamed to {r.file}")
    return index.select("file", "rows", "first_time", "last_time")


def json_rows(df: DataFrame, kind: str, options: Filter | list[str] = (), limit: int | None = None) -> DataFrame:
    """One JSON document a row, after the filter."""
    rows = filter_events(df, options, kind)
    if limit is not None:
        rows = order.with_rank(rows, kind).orderBy("source", *order.order_of(kind)).limit(limit)
    return conform(rows, kind).select(F.to_json(F.struct("*")).alias("json"))


def parquet_to_csv(spark: SparkSession, path: str, target: str, options: Filter | list[str] = (), kind: str | None = None) -> DataFrame:
    rows = read_events(spark, path, kind)
    kind = kind or event_type(rows.columns)
    return write_csv(filter_events(rows, options, kind), target, kind)


def log_to_parquet(spark: SparkSession, paths: str | list[str], prefix: str, options: Filter | list[str] = (), buckets: int | None = None, drop_repeats: bool | tuple[str, ...] = False, segments: bool = False) -> dict[str, str]:
    """Scan, parse, derive, then filter; one dataset for each family that has events. Events that repeat are kept unless
    drop_repeats is set, for all families or for those that it names. segments: paths is a folder of the pieces of one log."""
    lines = read_log_segments(spark, paths) if segments else read_log_lines(spark, paths)
    parsed = materialise(parse.parse_log(lines).drop("line"), "parsed")
    counts = parsed.agg(*(F.count(k).alias(k) for k in TYPES)).first()
    out = {}
    repeats = drop_repeats if isinstance(drop_repeats, tuple) else TYPES if drop_repeats else ()
    for kind in TYPES:
        if counts[kind]:
            events = parse.events(parsed, kind)
            events = order.drop_repeated(events, kind) if kind in repeats else events
            out[kind] = write_events(filter_events(derive(events, kind, buckets=buckets), options, kind), prefix, kind, counts[kind])
    forget(parsed)
    return out


def benchmark_log(spark: SparkSession, paths: str | list[str], prefix: str, options: Filter | list[str] = (), buckets: int | None = None, segments: bool = False) -> dict[str, str]:
    """A benchmark log (segments: a folder of its pieces) from file to results: <prefix>_results.parquet (bandwidths by iteration and tool), _arrays, and
    for each family with events in an iteration one dataset, derived iteration by iteration and stored by iteration."""
    lines = read_log_segments(spark, paths) if segments else read_log_lines(spark, paths)
    tagged = materialise(bench.assign_iteration(lines, buckets), "tagged")
    table = bench.results_table(bench.results(tagged))
    out = {"results": f"{prefix}_results.parquet", "arrays": f"{prefix}_arrays.parquet"}
    table.write.parquet(out["results"])
    bench.results_arrays(spark.read.parquet(out["results"])).write.parquet(out["arrays"])
    counts = tagged.where("iteration > 0").agg(*(F.count_if(F.col("class") == k).alias(k) for k in TYPES)).first()
    for kind in (k for k in TYPES if counts[k]):
        events = filter_events(bench.iteration_events(tagged, kind, buckets), options, kind)
        out[kind] = write_events(events, prefix, kind, counts[kind], ("iteration",))
    forget(tagged)
    return out


def analyse(spark: SparkSession, path: str, options: Filter | list[str] = (), kind: str | None = None, align: str | int = "64KB") -> dict[str, DataFrame]:
    """The report over stored events."""
    rows = read_events(spark, path, kind, align)
    kind = kind or event_type(rows.columns)
    return stats.report(filter_events(rows, options, kind), kind, align)
