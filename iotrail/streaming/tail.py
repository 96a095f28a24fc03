"""Lines as they are appended to log files: a streaming source with a byte position for each log.

    register(spark)
    lines = spark.readStream.format("log_tail").options(path="/logs/*.log*", state="/shared/tail-state").load()

path: a folder or a pattern. state: a folder, used by one query alone, in which the source keeps what it knows of each log;
Spark's own checkpoint holds the number of such a record. Both are read by pyarrow.fs on driver and executors, so
they are on shared disks or in a store that it knows. bytes_a_batch and bytes_a_task bound the work of a batch and of a task.

Rows are (source, line_ord, line): line_ord is where the line begins, in bytes. Lines count once they have their line end.
Lines that are no UTF-8 or hold white space alone are left out.

A log is known by its inode (on local disks) and by the crc of its first bytes, not by its name: one that is renamed goes
on where it was, under the name it was first seen by, and is read to its end (without a line end too, once it has been left
alone between two looks); a new or cut file of the old name is a log of its own, `name#1`, `name#2` and so on. What a
log held when it was deleted before its turn is lost. Executors look at the first bytes again before they read, and look
for the file among the others if it has been renamed since.
"""

from __future__ import annotations

import fnmatch
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import filesystem

HEAD = 1024  # so many first bytes tell a log, once it has them
STEP = 1 << 16


@dataclass(frozen=True)
class Log:
    source: str
    path: str
    inode: int
    end: int  # read up to here
    head: int
    crc: int
    size: int  # at the last look
    renamed: bool = False


class Files:
    """The files of a pattern, and their bytes."""

    def __init__(self, pattern: str):
        self.fs, self.pattern = filesystem(pattern)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        folder, _, name = self.pattern.rstrip("/").rpartition("/")
        whole = not any(c in name for c in "*?[") and self.fs.get_file_info(self.pattern.rstrip("/")).type == pafs.FileType.Directory
        self.folder, self.name = (self.pattern.rstrip("/"), "*") if whole else (folder, name)

    def seen(self) -> dict[str, tuple[int, int]]:
        """path -> (size, inode or 0), without hidden files."""
        out = {}
        for f in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.name) and f.base_name[0] not in "._":
                try:
                    out[f.path] = (f.size, os.stat(f.path).st_ino if self.local else 0)
                except FileNotFoundError:  # went meanwhile
                    pass
        return out

    def bytes(self, path: str, begin: int, end: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            f.seek(begin)
            return f.read(max(0, end - begin))

    def is_log(self, path: str, log: Log) -> bool:
        try:
            return zlib.crc32(self.bytes(path, 0, log.head)) == log.crc
        except FileNotFoundError:
            return False

    def line_end(self, path: str, begin: int, end: int, size: int) -> int:
        """Behind the last line end in [begin, end), or behind the first one after it, or begin."""
        at = end
        while at > begin:
            low = max(begin, at - STEP)
            found = self.bytes(path, low, at).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
        at = end
        while at < size:
            found = self.bytes(path, at, min(size, at + STEP)).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += STEP
        return begin


class Records:
    """The logs as they were at each offset, one small file each."""

    def __init__(self, folder: str):
        self.fs, self.folder = filesystem(folder.rstrip("/"))
        self.fs.create_dir(self.folder, recursive=True)

    def numbers(self) -> list[int]:
        return sorted(int(f.base_name[:-5]) for f in self.fs.get_file_info(pafs.FileSelector(self.folder)) if f.base_name.endswith(".json"))

    def load(self, n: int) -> tuple[dict[str, Log], dict[str, int]]:
        """Logs by source, and how many logs each name has had."""
        if not n:
            return {}, {}
        with self.fs.open_input_file(f"{self.folder}/{n:012}.json") as f:
            x = json.loads(f.read())
        return {k: Log(**v) for k, v in x["logs"].items()}, x["names"]

    def save(self, n: int, logs: dict[str, Log], names: dict[str, int]) -> None:
        with self.fs.open_output_stream(f"{self.folder}/{n:012}.new") as f:
            f.write(json.dumps({"logs": {k: asdict(v) for k, v in logs.items()}, "names": names}).encode())
        self.fs.move(f"{self.folder}/{n:012}.new", f"{self.folder}/{n:012}.json")

    def forget(self, below: int) -> None:
        for n in self.numbers():
            if n < below:
                self.fs.delete_file(f"{self.folder}/{n:012}.json")


def look(files: Files, logs: dict[str, Log], names: dict[str, int], most: int) -> tuple[dict[str, Log], dict[str, int]]:
    """The logs after a look at the files, read on by `most` bytes in all (more only to end a line)."""
    seen, left, found = files.seen(), dict(logs), {}
    holds = lambda path, log: seen[path][0] >= log.end and files.is_log(path, log)

    def match(how) -> None:
        for path in sorted(p for p in seen if p not in found):
            for log in sorted(left.values(), key=lambda x: (x.path != path, x.source)):
                if how(path, log) and holds(path, log):
                    found[path] = left.pop(log.source)
                    break

    match(lambda path, log: log.inode and log.inode == seen[path][1])
    match(lambda path, log: log.head > 0)
    match(lambda path, log: log.path == path)
    names = dict(names)
    for path in sorted(p for p in seen if p not in found):
        k = names[path] = names.get(path, -1) + 1
        found[path] = Log(f"{path}#{k}" if k else path, path, seen[path][1], 0, 0, 0, 0)
    out = {}
    for path, log in sorted(found.items(), key=lambda x: (not x[1].renamed, x[1].source)):  # old ones first
        size, renamed = seen[path][0], log.renamed or path != log.path
        end = log.end
        try:
            if most > 0 and size > end:
                end = files.line_end(path, end, min(size, end + most), size)
                if end == log.end and renamed and size == log.size and size - end <= most:
                    end = size  # a last line without an end
            most -= end - log.end
            head = min(end, HEAD)
            crc = log.crc if head == log.head else zlib.crc32(files.bytes(path, 0, head))
        except FileNotFoundError:  # renamed just now: the next look finds it
            end, head, crc = log.end, log.head, log.crc
        out[log.source] = replace(log, path=path, inode=seen[path][1], end=end, head=head, crc=crc, size=size, renamed=renamed)
    return out, names


@dataclass(frozen=True)
class Range(InputPartition):
    log: Log
    begin: int
    end: int
    first: bool  # begins where a line does


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state = options["path"], options["state"]
        self.batch, self.task = int(options.get("bytes_a_batch", 1 << 30)), int(options.get("bytes_a_task", 64 << 20))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        records = Records(self.state)
        n = max(records.numbers(), default=0)
        logs, names = records.load(n)
        now, names = look(Files(self.path), logs, names, self.batch)
        if now == logs:
            return {"n": n}
        records.save(n + 1, now, names)
        return {"n": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        records = Records(self.state)
        before, now = records.load(start["n"])[0], records.load(end["n"])[0]
        out = []
        for source, log in sorted(now.items()):
            at = before[source].end if source in before else 0
            for begin in range(at, log.end, self.task):
                out.append(Range(log, begin, min(log.end, begin + self.task), begin == at))
        return out

    def commit(self, end: dict) -> None:
        Records(self.state).forget(end["n"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        log, files = partition.log, Files(self.path)
        path = log.path if files.is_log(log.path, log) else next((p for p, (size, _) in files.seen().items() if size >= log.end and files.is_log(p, log)), None)
        if path is None:
            raise FileNotFoundError(f"{log.source}: no file has its first bytes any more")
        with files.fs.open_input_file(path) as f:
            yield from _lines(f, partition)


def _lines(f, part: Range, step: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Lines that begin in [begin, end) of a range, the last one to its end."""
    at, last, rest = part.begin, part.log.end, b""
    skip = not part.first
    if skip:  # the line that begins here belongs here: look at the byte before
        at -= 1
    f.seek(at)
    pos = at  # of rest
    while at < last:
        chunk = f.read(min(step, last - at))
        if not chunk:
            break
        at += len(chunk)
        rest += chunk
        if skip:
            cut = rest.find(b"\n")
            if cut < 0:
                pos, rest = pos + len(rest), b""
                continue
            pos, rest, skip = pos + cut + 1, rest[cut + 1 :], False
        whole = rest if at >= last else rest[: rest.rfind(b"\n") + 1]
        rest = rest[len(whole) :]
        places, lines = [], []
        for raw in whole.split(b"\n"):
            if pos >= part.end:
                break
            try:
                line = raw.removesuffix(b"\r").decode()
                if line.strip():
                    places.append(pos)
                    lines.append(line)
            except UnicodeDecodeError:
                pass
            pos += len(raw) + 1
        else:
            pos = at - len(rest)
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([part.log.source] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], names=["source", "line_ord", "line"])
        if pos >= part.end:
            return


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source string, line_ord long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def tail(spark: SparkSession, path: str, state: str, **options: int):
    """A streaming frame of (source, line_ord, line)."""
    register(spark)
    return spark.readStream.format("log_tail").options(path=path, state=state, **options).load()
