"""Columns of the three event families, and the fixed values that give them meaning.

An engine frame has two columns more than a stored one: source (which log) and line_ord (place in it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UFS, BLOCK, CUSTOM = "ufs", "block", "ufscustom"
TYPES = (UFS, BLOCK, CUSTOM)

# Stored columns in their order.
STORED = {
    UFS: "time double, process string, cpu long, action string, tag long, opcode string, lba long, size long, groupid long, hwqid long, qd long, dtoc double, ctoc double, ctod double, continuous boolean",
    BLOCK: "time double, process string, cpu long, flags string, action string, devmajor long, devminor long, io_type string, extra long, sector decimal(20,0), size long, comm string, qd long, dtoc double, ctoc double, ctod double, continuous boolean",
    CUSTOM: "opcode string, lba long, size long, start_time double, end_time double, dtoc double, start_qd long, end_qd long, ctoc double, ctod double, continuous boolean",
}
# Which columns tell a family.
MARKS = {
    BLOCK: {"time", "process", "action", "sector"},
    UFS: {"time", "process", "action", "opcode", "lba"},
    CUSTOM: {"opcode", "lba", "size", "start_time", "end_time", "dtoc"},
}
# Limits and units.
MILLISECONDS = 1000
DEBUG_LBA = 2305843009213693951
MAX_LBA = 1 << 48
UFS_UNIT = 4096
SECTOR = 512
DEFAULT_ALIGNMENT_KB = 64
READ_OPCODE, WRITE_OPCODE, FLUSH_OPCODE = "0x28", "0x2a", "0x35"


def schema(kind: str) -> T.StructType:
    return T._parse_datatype_string(STORED[kind])


def event_type(columns: list[str]) -> str:
    """The family whose marks the columns hold; of several, the first of block, ufs, ufscustom."""
    names = set(columns)
    for kind, marks in MARKS.items():
        if marks <= names:
            return kind
    raise ValueError(f"columns of no known event type: {sorted(names)}")


def time_column(kind: str) -> str:
    return "start_time" if kind == CUSTOM else "time"


def address_column(kind: str) -> str:
    return "sector" if kind == BLOCK else "lba"


def default(data_type: T.DataType):
    """What stored files hold where there is no value."""
    if isinstance(data_type, T.StringType):
        return F.lit("")
    return F.lit(False) if isinstance(data_type, T.BooleanType) else F.lit(0).cast(data_type)


def conform(df: DataFrame, kind: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the stored columns (and `extra`): cast, missing ones filled, others left out."""
    have = set(df.columns)
    out = []
    for f in schema(kind):
        if f.name in have:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "start_qd" and "qd" in have:
            out.append(F.col("qd").cast(f.dataType).alias(f.name))
        else:
            out.append(default(f.dataType).alias(f.name))
    return df.select(*out, *(c for c in extra if c in have))
