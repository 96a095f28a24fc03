"""The data behind charts: points, axis bounds, bounded summaries for any number of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import phase
from ..schemas import BLOCK, CUSTOM, UFS

POINT = "x_time double, y_value double, group string"
METRICS = {UFS: ("dtoc", "ctoc", "ctod", "qd", "lba"), BLOCK: ("dtoc", "ctoc", "ctod", "qd", "sector"), CUSTOM: ("dtoc", "ctoc", "ctod", "start_qd", "end_qd", "lba")}
LATENCIES = ("dtoc", "ctoc", "ctod")
PADDING = 0.05


def metric_series(df: DataFrame, kind: str, metric: str) -> DataFrame:
    """Latencies above 0; addresses and depths of requests. Groups are opcodes, or whole io_types."""
    if metric not in METRICS[kind]:
        raise ValueError(f"{kind} has no series {metric}")
    if metric in LATENCIES:
        df = df.where(F.col(metric) > 0)
    elif kind != CUSTOM:
        df = df.where(phase(F.col("action")) == "I")
    x = "start_time" if kind == CUSTOM else "time"
    return df.select(F.col(x).alias("x_time"), F.col(metric).cast("double").alias("y_value"), F.col("io_type" if kind == BLOCK else "opcode").alias("group"))


def cpu_series(df: DataFrame, kind: str, which: str, y: str) -> DataFrame:
    """which: request or complete; y: cpu or address. Groups are CPUs."""
    rows = df.where(phase(F.col("action")) == ("I" if which == "request" else "C"))
    column = "cpu" if y == "cpu" else ("sector" if kind == BLOCK else "lba")
    return rows.select(F.col("time").alias("x_time"), F.col(column).cast("double").alias("y_value"), F.col("cpu").cast("string").alias("group"))


def all_series(df: DataFrame, kind: str) -> dict[str, DataFrame]:
    out = {m: metric_series(df, kind, m) for m in METRICS[kind]}
    if kind != CUSTOM:
        out |= {f"cpu_{w}_{y}": cpu_series(df, kind, w, y) for w in ("request", "complete") for y in ("cpu", "address")}
    return out


def parse_y_range(text: str) -> tuple[str, float, float]:
    metric, low, high = text.split(":")
    if not float(low) < float(high):
        raise ValueError("the least must be below the most")
    return metric, float(low), float(high)


def axis_bounds(points: DataFrame, y_range: tuple[float, float] | None = None) -> DataFrame:
    """One row: x padded on both sides, y from 0 or above, or as given."""
    b = points.agg(F.min("x_time").alias("x0"), F.max("x_time").alias("x1"), F.min("y_value").alias("y0"), F.max("y_value").alias("y1"))
    pad_x, pad_y = (F.col("x1") - F.col("x0")) * PADDING, (F.col("y1") - F.col("y0")) * PADDING
    low = F.greatest(F.lit(0.0), F.col("y0") - pad_y) if y_range is None else F.lit(float(y_range[0]))
    high = F.col("y1") + pad_y if y_range is None else F.lit(float(y_range[1]))
    return b.select((F.col("x0") - pad_x).alias("x_min"), (F.col("x1") + pad_x).alias("x_max"), low.alias("y_min"), high.alias("y_max"))


def downsample(points: DataFrame, width: float) -> DataFrame:
    """Per group and time bin: least, greatest and mean value, and how many points."""
    return points.groupBy("group", F.floor(F.col("x_time") / width).alias("bin")).agg(
        F.min("y_value").alias("y_min"), F.max("y_value").alias("y_max"), F.avg("y_value").alias("y_avg"), F.count(F.lit(1)).alias("n")
    )
