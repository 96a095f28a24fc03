"""Stored events: typed scans, migration of old files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import is_aligned
from ..schemas import conform, event_type, schema
from .files import filesystem


def read_events(spark: SparkSession, paths: str | list[str], kind: str | None = None, align: str | int = "64KB", recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Stored columns with missing ones filled, aligned computed anew, and source. Filters and column choices that
    follow reach the scan."""
    options = {"recursiveFileLookup": str(recursive).lower(), "mergeSchema": "true"} | ({"pathGlobFilter": pattern} if pattern else {})
    raw = spark.read.options(**options).parquet(*([paths] if isinstance(paths, str) else paths))
    kind = kind or event_type(raw.columns)
    rows = conform(raw.withColumn("source", F.col("_metadata.file_path")), kind, ("source", "line_ord", "iteration") if "line_ord" in raw.columns else ("source", "iteration"))
    return rows.withColumn("aligned", is_aligned(kind, align))


def is_current(df: DataFrame, kind: str) -> bool:
    want = [(f.name, f.dataType) for f in schema(kind)]
    return [(f.name, f.dataType) for f in df.schema] == want


def migrate(df: DataFrame, kind: str | None = None) -> DataFrame:
    kind = kind or event_type(df.columns)
    return df if is_current(df, kind) else conform(df, kind)


@dataclass(frozen=True)
class Migrated:
    path: str
    kind: str | None
    changed: bool
    error: str | None
    target: str | None = None


def _below(paths: list[str]) -> dict[str, str]:
    """Each path without the folders that all have in common, so no two have one name."""
    parts = {p: p.rstrip("/").split("/") for p in paths}
    same = 0
    while all(len(x) > same + 1 for x in parts.values()) and len({x[same] for x in parts.values()}) == 1:
        same += 1
    return {p: "/".join(x[same:]) for p, x in parts.items()}


def datasets(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files, and folders that hold some themselves, at any depth below a folder (names, not data)."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs, found, open_ = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), [], [root]
    while open_:
        here = open_.pop()
        for s in sorted(fs.listStatus(here), key=lambda s: s.getPath().getName()):
            name, path = s.getPath().getName(), s.getPath()
            if name[0] in "._":
                continue
            if s.isDirectory() and not name.endswith(".parquet"):
                open_.append(path)
            elif name.endswith(".parquet"):
                found.append(path.toString() if s.isDirectory() or not here.getName().endswith(".parquet") else here.toString())
    return sorted(set(found))


def _files(spark: SparkSession, path: str) -> list[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(place).isDirectory():
        return [path]
    return [s.getPath().toString() for s in fs.listStatus(place) if s.isFile() and s.getPath().getName().endswith(".parquet")]


def _footers(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(dataset, file, columns, error): the names and types in each file's footer, read in tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns, errors = [], []
            for path in part.column("file").to_pylist():
                try:
                    fs, at = filesystem(path)
                    with fs.open_input_file(at) as f:
                        found = pq.read_schema(f)
                    columns.append([f"{c.name} {c.type}" for c in found])
                    errors.append(None)
                except Exception as e:  # the report is the feature: a bad file must not stop the others
                    columns.append(None)
                    errors.append((str(e) or type(e).__name__).splitlines()[0])
            yield pa.RecordBatch.from_arrays([part.column("dataset"), part.column("file"), pa.array(columns, pa.list_(pa.string())), pa.array(errors, pa.string())], names=["dataset", "file", "columns", "error"])

    tasks = max(1, min(len(files) // 16, 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(files, "dataset string, file string").repartition(tasks).mapInArrow(run, "dataset string, file string, columns array<string>, error string")


def migrate_dir(spark: SparkSession, paths: str | list[str], target: str) -> list[Migrated]:
    """Each dataset to its place below target, by its path below what all have in common; the old ones stay. A string is
    a folder whose datasets at any depth are meant. One that fails is reported, and the rest go on.

    Footers are read in tasks, by one job; then one job migrates all datasets of the same columns. Their rows go to a
    folder for each dataset, which is then moved to its place (names, not data, pass through the driver). Datasets
    in stores that only Spark opens, or whose files differ in columns, go one by one."""
    names = _below(datasets(spark, paths) if isinstance(paths, str) else list(dict.fromkeys(paths)))
    files, errors = [], {}
    for path in names:
        try:
            files += [(path, f) for f in _files(spark, path)]
        except Exception as e:
            errors[path] = str(e).splitlines()[0]
    held: dict[str, set[str]] = {}
    broken: set[str] = set()
    for r in _footers(spark, files).collect() if files else ():  # a row a file, as the list that it was made from
        if r.error is not None:
            broken.add(r.dataset)
        else:
            held.setdefault(r.dataset, set()).add(json.dumps(r.columns))
    groups: dict[str, list[str]] = {}
    for path, columns in held.items():
        if path not in broken and len(columns) == 1:
            groups.setdefault(next(iter(columns)), []).append(path)
    together = {p for g in groups.values() for p in g}
    done: dict[str, Migrated] = {}
    for group in groups.values():
        done |= _migrate_together(spark, group, names, target)
    for path, name in names.items():
        if path in errors:
            done[path] = Migrated(path, None, False, errors[path])
        elif path not in together:
            done[path] = _migrate_one(spark, path, f"{target}/{name}")
    return [done[p] for p in names]


def _migrate_one(spark: SparkSession, path: str, target: str) -> Migrated:
    try:
        old = spark.read.parquet(path)
        kind = event_type(old.columns)
        migrate(old, kind).write.mode("overwrite").parquet(target)
        return Migrated(path, kind, not is_current(old, kind), None, target)
    except Exception as e:
        return Migrated(path, None, False, str(e).splitlines()[0])


def _migrate_together(spark: SparkSession, group: list[str], names: dict[str, str], target: str) -> dict[str, Migrated]:
    try:
        old = spark.read.parquet(*group)
        kind = event_type(old.columns)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = place(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole = {place(p).toUri().getPath(): k for k, p in enumerate(group)}
        file = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:(//[^/]*)?", "")
        number = spark.createDataFrame(list(whole.items()), "at string, __k int")
        rows = conform(old.withColumn("__file", F.url_decode(file)), kind, ("__file",))
        # A dataset is a file or the folder of one.
        folder = F.regexp_replace("__file", "/[^/]*$", "")
        both = number.select(F.col("at"), "__k")
        rows = rows.withColumn("__at", folder).join(F.broadcast(both.withColumnRenamed("at", "__at").withColumnRenamed("__k", "__a")), "__at", "left")
        rows = rows.join(F.broadcast(both.withColumnRenamed("at", "__file").withColumnRenamed("__k", "__b")), "__file", "left")
        work = f"{target}/_migrating-{uuid.uuid4().hex}"
        rows.withColumn("__k", F.coalesce("__b", "__a")).drop("__at", "__file", "__a", "__b").write.partitionBy("__k").parquet(work)
        out = {}
        for k, p in enumerate(group):
            to, made = place(f"{target}/{names[p]}"), place(f"{work}/__k={k}")
            fs.delete(to, True)
            if fs.exists(made):
                fs.mkdirs(to.getParent())
                fs.rename(made, to)
            else:  # no rows
                migrate(spark.read.parquet(p), kind).write.mode("overwrite").parquet(to.toString())
            out[p] = Migrated(p, kind, not is_current(old, kind), None, f"{target}/{names[p]}")
        fs.delete(place(work), True)
        return out
    except Exception as e:
        if len(group) == 1:
            return {group[0]: Migrated(group[0], None, False, str(e).splitlines()[0])}
        return {p: _migrate_one(spark, p, f"{target}/{names[p]}") for p in group}
