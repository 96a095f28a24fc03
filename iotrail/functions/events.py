"""Column expressions on events: classes, phases, alignment, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLOCK, CUSTOM, DEBUG_LBA, DEFAULT_ALIGNMENT_KB, MAX_LBA, READ_OPCODE, SECTOR, UFS, UFS_UNIT, WRITE_OPCODE

# The names of requests and completions.
ISSUES = ("block_rq_issue", "Q", "send_req")
COMPLETIONS = ("block_rq_complete", "C", "complete_rsp")


def phase(action: Column) -> Column:
    """I for a request, C for a completion, X for anything else."""
    return F.when(action.isin(*ISSUES), "I").when(action.isin(*COMPLETIONS), "C").otherwise("X")


def op_class(io_type: Column) -> Column:
    first = F.substring(io_type, 1, 1)
    return F.when(first == "R", "read").when(first == "W", "write").when(first == "D", "discard").otherwise("other")


OTHER = 3


def op_code(io_type: Column) -> Column:
    """The class as a number, which rows are faster sorted by."""
    first = F.substring(io_type, 1, 1)
    return F.when(first == "R", 0).when(first == "W", 1).when(first == "D", 2).otherwise(OTHER)


def item_type(kind: str) -> Column:
    if kind != BLOCK:
        return F.col("opcode")
    return F.when(F.length("io_type") > 0, F.substring("io_type", 1, 1)).otherwise("?")


def io_rw(kind: str) -> Column:
    if kind == BLOCK:
        return F.col("io_type")
    if kind == UFS:
        return F.when(F.col("opcode") == READ_OPCODE, "R").when(F.col("opcode") == WRITE_OPCODE, "W").otherwise("O")
    name = F.lower("opcode")
    return F.when(name.contains("read"), "R").when(name.contains("write"), "W").otherwise("O")


def sanitize_lba(lba: Column) -> Column:
    return F.when((lba == DEBUG_LBA) | (lba > MAX_LBA), 0).otherwise(lba).cast("long")


def ufs_units(size: Column) -> Column:
    return F.ceil(F.abs(size) / UFS_UNIT).cast("long")


def alignment_kb(text: str | int) -> int:
    """64KB, 1mb, 2GB or a bare number of bytes -> KB."""
    if isinstance(text, int):
        return text // 1024
    name = text.strip().upper()
    for suffix, kb in (("KB", 1), ("MB", 1024), ("GB", 1024 * 1024)):
        if name.endswith(suffix):
            return int(name[: -len(suffix)].strip()) * kb
    return int(name) // 1024


def is_aligned(kind: str, align: str | int = f"{DEFAULT_ALIGNMENT_KB}KB", address: Column | None = None) -> Column:
    kb = alignment_kb(align)
    divisor = kb // 4 if kind == UFS else kb * 1024 // SECTOR
    at = F.col("sector" if kind == BLOCK else "lba") if address is None else address
    return (at == 0) if divisor == 0 else (F.pmod(at, F.lit(divisor)) == 0)


def phase_of(kind: str) -> Column:
    """Custom rows are requests and completions in one; they count as completions."""
    return F.lit("C") if kind == CUSTOM else phase(F.col("action"))
