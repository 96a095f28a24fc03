"""Working tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the cluster names in spark.checkpoint.dir.

    Only a session with a local master may lack the setting; it gets a temporary folder of its own. Elsewhere
    executors would write to their own disks, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/iotrail/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, per_core: int | None = None, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    per_core: write with at most so many tasks for each core of the cluster (tables of a few columns)."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = (df.coalesce(per_core * spark.sparkContext.defaultParallelism) if per_core else df).write
    (writer.option("compression", compression) if compression else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that materialise() wrote and that nothing reads any more. Others are left alone."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path:
            spark = t.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
