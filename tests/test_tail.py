import os
import random
import shutil

import pytest

from iotrail.streaming import tail as T


class Session:
    """A query over a tail source that appends what it reads to a Parquet table."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options

    def run(self, *steps):
        lines = T.tail(self.spark, f"{self.folder}/logs/*", f"{self.folder}/state", **self.options)
        q = lines.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/check").start(f"{self.folder}/out")
        try:
            q.processAllAvailable()
            for step in steps:
                step()
                q.processAllAvailable()
                q.processAllAvailable()
        finally:
            q.stop()

    def rows(self):
        got = self.spark.read.schema("source string, line_ord long, line string").parquet(f"{self.folder}/out").collect()
        return sorted((os.path.basename(r.source), r.line_ord, r.line) for r in got)


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode() if isinstance(text, str) else text)


def test_appended_lines_are_read_once_across_restarts(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    a, b = tmp_path / "logs/a.log", tmp_path / "logs/b.log"
    append(a, "one\ntwo\nhal")
    s = Session(spark, tmp_path)
    s.run(lambda: append(a, "f\n\n \nfour\r\n"), lambda: append(b, b"b1\n\xff\xfe\nb3\n"))
    first = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "half"), ("a.log", 16, "four"), ("b.log", 0, "b1"), ("b.log", 6, "b3")]
    assert s.rows() == first
    append(a, "while down\n")
    s.run(lambda: append(b, "b4\n"))
    assert s.rows() == sorted([*first, ("a.log", 22, "while down"), ("b.log", 9, "b4")])
    s.run()
    assert len(s.rows()) == 8


def test_rotation(spark, tmp_path):
    """Renamed, copied and cut, and replaced logs; what was unread goes on under the first name."""
    (tmp_path / "logs").mkdir()
    a, old = tmp_path / "logs/a.log", tmp_path / "logs/a.log.1"

    def rotate():
        append(a, "a2\nlast without end")
        a.rename(old)
        append(a, "header\nnew1\n")

    def copy_and_cut():
        append(a, "new2\n")
        shutil.copy(a, tmp_path / "logs/a.log.2")
        with open(a, "wb"):
            pass
        append(a, "third\n")

    append(a, "header\na1\n")
    s = Session(spark, tmp_path)
    s.run(rotate, lambda: append(a, "more\n"))
    s.run(copy_and_cut)
    got = {}
    for source, _, line in s.rows():
        got.setdefault(source, []).append(line)
    assert got == {"a.log": ["header", "a1", "a2", "last without end"], "a.log#1": ["header", "new1", "more", "new2"], "a.log#2": ["third"]}


def test_random_appends_and_small_ranges(spark, tmp_path):
    """Batches and tasks of a few bytes; every line once, at its own byte."""
    (tmp_path / "logs").mkdir()
    rng, texts = random.Random(5), {}

    def grow():
        for name in ("x.log", "y.log", "z.log"):
            piece = "".join("w" * rng.randint(0, 30) + rng.choice(["\n", "\n", "", " é\n"]) for _ in range(rng.randint(0, 8)))
            texts[name] = texts.get(name, "") + piece
            append(tmp_path / "logs" / name, piece)

    s = Session(spark, tmp_path, bytes_a_batch=90, bytes_a_task=17)
    for _ in range(3):
        s.run(grow, grow, lambda: None, lambda: None, lambda: None)
    want = []
    for name, text in texts.items():
        at = 0
        for line in text.encode().split(b"\n")[:-1]:
            if line.strip():
                want.append((name, at, line.decode()))
            at += len(line) + 1
    assert s.rows() == sorted(want)


def test_a_log_renamed_before_it_is_read(tmp_path):
    """The range was planned under the old name; its bytes are read from the file that has them now."""
    (tmp_path / "logs").mkdir()
    a = tmp_path / "logs/a.log"
    append(a, "one\ntwo\n")
    reader = T.TailReader({"path": str(tmp_path / "logs"), "state": str(tmp_path / "state")})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    a.rename(tmp_path / "logs/a.log.1")
    append(a, "other\nlines\nof the same length\n")
    assert [x for p in parts for b in reader.read(p) for x in b.column("line").to_pylist()] == ["one", "two"]
    (tmp_path / "logs/a.log.1").unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert reader.latestOffset() == {"n": end["n"] + 1} and T.Records(str(tmp_path / "state")).numbers() == [1, 2]
    reader.commit({"n": 2})
    assert T.Records(str(tmp_path / "state")).numbers() == [2]
