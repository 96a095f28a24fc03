"""Event filters: a set of bounds becomes one predicate that Spark can push into a Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BLOCK, CUSTOM, UFS_UNIT, address_column


@dataclass(frozen=True)
class Filter:
    """0 is no bound. Times are seconds, latencies milliseconds; all bounds are inclusive."""

    start_time: float = 0
    end_time: float = 0
    start_address: int = 0
    end_address: int = 0
    min_dtoc: float = 0
    max_dtoc: float = 0
    min_ctoc: float = 0
    max_ctoc: float = 0
    min_ctod: float = 0
    max_ctod: float = 0
    min_qd: int = 0
    max_qd: int = 0
    cpus: tuple[int, ...] = ()


def parse_filter(specs: Iterable[str]) -> Filter:
    """time:a:b, sector:a:b or lba:a:b, dtoc / ctoc / ctod / qd:a:b, cpu:0-3 or cpu:0,4,7 or cpu:2."""
    got: dict = {}
    for spec in specs:
        name, _, rest = spec.strip().partition(":")
        name = name.lower()
        if name == "cpu":
            cpus: list[int] = []
            for part in rest.split(","):
                low, dash, high = part.partition("-")
                first, last = int(low), int(high if dash else low)
                if last < first:
                    raise ValueError(f"{spec}: {last} is below {first}")
                cpus += range(first, last + 1)
            got["cpus"] = tuple(dict.fromkeys([*got.get("cpus", ()), *cpus]))
            continue
        to = {"time": ("start_time", "end_time"), "sector": ("start_address", "end_address"), "lba": ("start_address", "end_address")}
        to |= {m: (f"min_{m}", f"max_{m}") for m in ("dtoc", "ctoc", "ctod", "qd")}
        bounds = rest.split(":")
        if name not in to or len(bounds) != 2:
            raise ValueError(f"no such filter: {spec}")
        number = int if name in ("sector", "lba", "qd") else float
        low, high = map(number, bounds)
        if low < 0 or high < 0:
            raise ValueError(f"{spec}: below 0")
        if high and high < low or name == "time" and high <= low:
            raise ValueError(f"{spec}: the end must be above the start")
        got |= dict(zip(to[name], (low, high)))
    return Filter(**got)


def _between(c: Column, low: float, high: float) -> Column | None:
    if not low and not high:
        return None
    if not high:
        return c >= low
    return (c >= low) & (c <= high)  # with no lower bound, not below 0


def predicate(f: Filter, kind: str, compat: bool = False) -> Column | None:
    """The conjunction of what is set, or None. compat: addresses end as in the original tool, which divides
    sizes of UFS and custom events by the unit once more."""
    terms: list[Column | None] = []
    if kind == CUSTOM:
        if f.end_time > f.start_time:
            terms.append(~((F.col("end_time") < f.start_time) | (F.col("start_time") > f.end_time)))
        elif f.start_time:
            terms.append(F.col("end_time") >= f.start_time)
    elif f.end_time > f.start_time:
        terms.append(F.col("time").between(f.start_time, f.end_time))
    elif f.start_time:
        terms.append(F.col("time") >= f.start_time)
    if f.start_address or f.end_address:
        at = F.col(address_column(kind))
        size = F.floor(F.col("size") / UFS_UNIT) if compat and kind != BLOCK else F.col("size")
        if f.start_address:
            terms.append(at + size >= f.start_address)
        if f.end_address:
            terms.append(at <= f.end_address)
    terms += [_between(F.col(m), getattr(f, f"min_{m}"), getattr(f, f"max_{m}")) for m in ("dtoc", "ctoc", "ctod")]
    terms.append(_between(F.col("start_qd" if kind == CUSTOM else "qd"), f.min_qd, f.max_qd))
    if f.cpus and kind != CUSTOM:
        terms.append(F.col("cpu").isin(*f.cpus))
    set_ = [t for t in terms if t is not None]
    return reduce(lambda a, b: a & b, set_) if set_ else None


def filter_events(df: DataFrame, f: Filter | Iterable[str], kind: str, compat: bool = False) -> DataFrame:
    p = predicate(f if isinstance(f, Filter) else parse_filter(f), kind, compat)
    return df if p is None else df.where(p)


KNOBS = tuple(x.name for x in fields(Filter))
