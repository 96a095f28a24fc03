"""Raw log lines with an order: source, line_ord, line."""

from __future__ import annotations

import fnmatch
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import filesystem

LINES = "source string, line_ord long, line string"
# The endings of archive members that are logs.
LOG_ENDINGS = (".csv", ".log", ".txt")
ARCHIVE_ENDINGS = {".tar": "tar", ".tar.gz": "gz", ".tgz": "gz", ".tar.xz": "xz", ".txz": "xz", ".zip": "zip"}


PLACE_BITS, SPLIT_BITS = 28, 12


def read_log_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines of plain or compressed text files as they stand, without those of white space alone; large files are
    split over tasks. What is read from them, parsers trim.

    line_ord ascends through a file, with gaps, and takes no second pass: its high bits hold where the line's split
    begins, in steps of 4 KB, its low ones the line's place in its task. Splits of one file may be read in any order and by
    any task, and still sort as the file does. Splits are at least 4 KB long, and a task of several has less than 2^28
    lines before a split that isn't a file's first. A last line without a line end counts. Lines that can't be decoded
    are left out. Text in another encoding (with line ends of one byte) is decoded line by line."""
    lines = _lines(spark.read.text(paths), encoding)
    return lines.select("source", _order(F.col("start")).alias("line_ord"), "line").where(F.col("line").rlike(r"\S"))


def _lines(rows: DataFrame, encoding: str) -> DataFrame:
    """source, start of the split, place in the task, line."""
    if encoding.upper().replace("-", "") == "UTF8":
        value = F.when(F.is_valid_utf8("value"), F.col("value"))
    else:
        value = F.decode(F.col("value").cast("binary"), encoding)  # the text source keeps bytes as they are
    in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), in_task.alias("place"), F.regexp_replace(value, "\r$", "").alias("line"))


def _order(start: Column) -> Column:
    return F.shiftleft(F.shiftright(start, SPLIT_BITS), PLACE_BITS) + F.col("place")


def read_log_segments(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> DataFrame:
    """The same, where the files of a folder are pieces of one log, in the order of their names. source is the folder.

    Only names and sizes of files are gone through to find where each begins; this row a file goes to all tasks, so lines are not
    shuffled to meet it."""
    cell = 1 << SPLIT_BITS
    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("source"), "length")
    whole = (F.floor(F.col("length") / cell) + 1) * cell
    files = files.select("source", (F.sum(whole).over(W.orderBy("source")) - whole).alias("before"))
    lines = _lines(spark.read.text(folder), encoding).join(F.broadcast(files), "source")
    return lines.select(F.lit(folder).alias("source"), _order(F.col("before") + F.col("start")).alias("line_ord"), "line").where(F.col("line").rlike(r"\S"))


def archive_kind(name: str) -> str | None:
    low = name.lower()
    return next((k for end, k in sorted(ARCHIVE_ENDINGS.items(), key=lambda x: -len(x[0])) if low.endswith(end)), None)


def _is_log(name: str, marks: tuple[str, ...]) -> bool:
    low = name.lower()
    return low.endswith(LOG_ENDINGS) or any(m.lower() in low for m in marks)


def _member(kind: str, file, marks: tuple[str, ...]) -> Iterator[bytes]:
    """Lines of the largest log in an open archive, streamed: what is compressed is gone through twice, to find and to read it."""
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            logs = [m for m in z.infolist() if not m.is_dir() and _is_log(m.filename, marks)]
            if logs:
                with z.open(max(logs, key=lambda m: m.file_size)) as f:
                    yield from f
        return
    with tarfile.open(fileobj=file, mode="r" if kind == "tar" else f"r:{kind}") as t:
        largest = None
        for m in t:
            if m.isfile() and _is_log(m.name, marks) and (largest is None or m.size > largest.size):
                largest = m
            t.members = []  # else every header stays in memory
        if largest is not None:
            yield from t.extractfile(largest)


def _batches(source: str, lines: Iterator[bytes], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of so many lines, or of about so many bytes."""
    places, texts, held = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([source] * len(texts)), pa.array(places, pa.int64()), pa.array(texts)], names=["source", "line_ord", "line"])
    for k, raw in enumerate(lines):
        try:
            line = raw.decode().rstrip("\r\n")
        except UnicodeDecodeError:
            continue
        if line.strip():
            places.append(k)
            texts.append(line)
            held += len(raw)
        if len(texts) >= rows or held >= size:
            yield batch()
            places, texts, held = [], [], 0
    if texts:
        yield batch()


def _opens(path: str) -> bool:
    """Whether Python can open the path, or only Spark."""
    try:
        filesystem(path)
        return True
    except OSError:
        return False


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.batch, self.marks = options["path"], int(options["batch"]), tuple(json.loads(options["marks"]))

    def partitions(self) -> list[Archive]:
        fs, path = filesystem(self.path)
        folder, _, name = path.rstrip("/").rpartition("/")
        if fs.get_file_info(path.rstrip("/")).type == pafs.FileType.Directory:
            folder, name = path.rstrip("/"), "*"
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, name) and archive_kind(f.path)]
        return [Archive(p) for p in sorted(found)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with filesystem(self.path)[0].open_input_file(partition.path) as f:
                yield from _batches(partition.path, _member(archive_kind(partition.path), f, self.marks), self.batch)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_archive"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archived_lines(spark: SparkSession, path: str, batch: int = 50_000, marks: tuple[str, ...] = ()) -> DataFrame:
    """The largest log of each archive of a folder or pattern, one archive a task; lines that are no UTF-8 are left out.

    Members that end like logs, or whose names hold one of `marks`, are logs. Archives are streamed, so they and their
    members may be of any size; a task holds a batch of lines. Paths of stores that only Spark can open are read as
    binary files, each whole and below 2 GB."""
    if _opens(path):
        spark.dataSource.register(ArchiveSource)
        return spark.read.format("log_archive").options(path=path, batch=batch, marks=json.dumps(marks)).load()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                if archive_kind(name):
                    yield from _batches(name, _member(archive_kind(name), io.BytesIO(content), marks), batch)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, LINES)
