"""Log lines to typed events with Column expressions.

A line's fields are found in a step of its own, an explode() of one array, which Spark neither merges with the steps that
read the fields nor moves filters through: one pattern runs for each line of a family (two for lines that could be
of both block formats), and everything else reads an array. Lines are trimmed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BLOCK, CUSTOM, MILLISECONDS, TYPES, UFS, schema
from .events import is_aligned, sanitize_lba, ufs_units

# The formats of the lines, with numbered groups.
UFS_LINE = r"^\s*(.*?)\s+\[([0-9]+)\].*?([0-9]+\.[0-9]+):\s+ufshcd_command:\s+(send_req|complete_rsp):.*?tag:\s*(\d+).*?size:\s*([-]?\d+).*?LBA:\s*(\d+).*?opcode:\s*(0x[0-9a-f]+).*?group_id:\s*0x([0-9a-f]+).*?hwq_id:\s*([-]?\d+)"
BLOCK_LINE = r"^\s*(.*?)\s+\[(\d+)\]\s+(.+?)\s+([\d\.]+):\s+(\S+):\s+(\d+),(\d+)\s+([A-Z]+)(?:\s+(\d+))?\s+\(\)\s+(\d+)\s+\+\s+(\d+)(?:\s+\S+)?\s+\[(.*?)\]$"
BLKTRACE_LINE = r"^([\d\.]+),(\d+),(\d+),(\d+),(\d+),([A-Z]),([A-Z]*),(\d+),(\d+),(.*)$"
CUSTOM_LINE = r"^(0x[0-9a-f]+),(\d+),(\d+),(\d+(?:\.\d+)?),(\d+(?:\.\d+)?)$"
BLKTRACE_START = r"^\d+\.\d+,\d+,\d+,\d+,\d+,[A-Z],[A-Z]*,\d+,\d+,"
BLKTRACE_HINT = r"^[\d\.]+,\d+,"
MARK = "\n"  # no line has it inside, and no group matches it


def _marked(line: Column, regex: str, n: int) -> Column:
    """The n groups of a match with marks before each (an unmatched group is empty), or the line without a match."""
    line = F.when(~line.contains("\n") | line.startswith(MARK), line)  # what holds line ends is no line; what begins with one is marked already
    whole = f"(?d){regex}" + ("" if regex.endswith("$") else ".*$")
    return F.regexp_replace(line, whole, MARK + MARK.join(f"${k}" for k in range(1, n + 1)))


def _parts(marked: Column) -> Column:
    """Empty text and the groups; anything but n + 1 parts is no match."""
    return F.split(marked, MARK)


def _commas(line: Column) -> Column:
    return F.when(~line.contains("\n"), F.split(line, ",", 5))


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\n\x0b\x0c"))


def _block_parts(line: Column) -> Column:
    block = _marked(line, BLOCK_LINE.replace("^", f"^(?!{MARK})", 1), 12)
    both = _marked(_marked(line, BLKTRACE_LINE, 10), BLOCK_LINE.replace("^", f"^(?!{MARK})", 1), 12)
    return _parts(F.when(line.rlike(BLKTRACE_HINT), both).otherwise(block))


def _once(rows: DataFrame, name: str, fields: Column) -> DataFrame:
    return rows.select("*", F.explode(F.array(fields)).alias(name))


def category(line: Column) -> Column:
    return (
        F.when(line == "", "empty")
        .when(line.contains("ufshcd_command:"), UFS)
        .when(line.rlike(BLKTRACE_START) | line.contains("blk_") | line.contains("block_"), BLOCK)
        .when(line.rlike("^0x[0-9A-Fa-f]") & line.contains(","), CUSTOM)
        .otherwise("unknown")
    )


def classify(raw: Column) -> Column:
    """The other order of tests: custom, UFS, block; no blktrace CSV."""
    line = trimmed(raw)
    return (
        F.when(line.rlike(CUSTOM_LINE), CUSTOM)
        .when(line.rlike(UFS_LINE), UFS)
        .when(line.rlike(BLOCK_LINE), BLOCK)
        .otherwise("unknown")
    )


def _number(text: Column, kind: str = "long") -> Column:
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def _count(text: Column, top: int = 1 << 32) -> Column:
    """An unsigned number below `top`; anything else is 0."""
    n = text.try_cast("long")  # null beyond 64 bits, as it may be: that is not below top either
    return F.when(n.between(0, top - 1), n).otherwise(F.lit(0).cast("long"))


def _event(kind: str, values: dict[str, Column], extra: dict[str, Column]) -> Column:
    fields = [(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(kind)]
    return F.struct(*fields, *(c.alias(n) for n, c in extra.items()))


def _ufs_event(g: Column) -> Column:
    f = [F.get(g, F.lit(k + 1)) for k in range(10)]
    lba = sanitize_lba(_number(f[6]))  # what needs more than 64 bits is 0 either way
    event = _event(
        UFS,
        {
            "time": _number(f[2], "double"), "process": f[0], "cpu": _count(f[1]), "action": f[3], "tag": _count(f[4]), "opcode": f[7], "lba": lba,
            "size": ufs_units(_number(f[5])), "groupid": _count(F.conv(f[8], 16, 10)), "hwqid": _count(f[9]),
        },
        {"aligned": is_aligned(UFS, address=lba)},
    )
    return F.when(F.size(g) == 11, event)


def _block(values: dict[str, Column]) -> Column:
    return _event(BLOCK, values, {"aligned": is_aligned(BLOCK, address=values["sector"])})


def _block_event(g: Column) -> Column:
    """Of either format, by the number of fields."""
    f = [F.get(g, F.lit(k + 1)) for k in range(12)]
    ftrace = {
        "time": _number(f[3], "double"), "process": f[0], "cpu": _count(f[1]), "flags": f[2], "action": f[4], "devmajor": _count(f[5]), "devminor": _count(f[6]), "io_type": f[7],
        "extra": _count(f[8]), "sector": _number(f[9], "decimal(20,0)"), "size": _count(f[10]), "comm": f[11],
    }
    blktrace = {
        "time": _number(f[0], "double"), "process": f[4], "cpu": _count(f[1]), "flags": F.lit(""), "action": f[5], "devmajor": _count(f[2]), "devminor": _count(f[3]), "io_type": f[6],
        "extra": F.lit(0), "sector": _number(f[7], "decimal(20,0)"), "size": _count(f[8]), "comm": f[9],
    }
    return F.when(F.size(g) == 13, _block(ftrace)).when(F.size(g) == 11, _block(blktrace))


def _custom(opcode: Column, lba: Column, size: Column, start: Column, end: Column) -> Column:
    clean = sanitize_lba(lba)
    return _event(CUSTOM, {"opcode": opcode, "lba": clean, "size": size, "start_time": start, "end_time": end, "dtoc": (end - start) * MILLISECONDS}, {"aligned": is_aligned(CUSTOM, address=clean)})


def _custom_event(f: Column) -> Column:
    """Of the parts between commas; any that is no number rejects the line."""
    number = r"^\+?0*[0-9]{1,20}\z"
    address = F.when(F.get(f, F.lit(1)).rlike(number), F.get(f, F.lit(1)).try_cast("decimal(20,0)"))
    bytes_ = F.when(F.get(f, F.lit(2)).rlike(number), F.get(f, F.lit(2)).try_cast("long"))
    real = lambda c: F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), c.try_cast("double"))
    good = (F.size(f) == 5) & F.get(f, F.lit(0)).rlike(r"^0x[0-9A-Fa-f]+\z")
    safe = [F.get(f, F.lit(k)) for k in range(5)]
    lba = F.when(address < F.lit(str(1 << 64)).cast("decimal(20,0)"), address)
    size, start, end = F.when(bytes_ < 1 << 32, bytes_), real(safe[3]), real(safe[4])
    return F.when(good & lba.isNotNull() & size.isNotNull() & start.isNotNull() & end.isNotNull(), _custom(safe[0], lba, size, start, end))


def parse_log(lines: DataFrame) -> DataFrame:
    """lines(line, ...) -> with category and one struct column per family, null where the line is none.

    A line whose category's parser fails is no event of any family."""
    what, line, g = F.col("category"), trimmed(F.col("line")), F.col("__g")
    parts = F.when(what == UFS, _parts(_marked(line, UFS_LINE, 10))).when(what == BLOCK, _block_parts(line)).when(what == CUSTOM, _commas(line))
    rows = _once(lines.withColumn("category", category(line)), "__g", parts)
    return rows.select(
        *(F.col(f"`{c}`") for c in lines.columns if c != "category"),
        "category",
        F.when(what == UFS, _ufs_event(g)).alias(UFS),
        F.when(what == BLOCK, _block_event(g)).alias(BLOCK),
        F.when(what == CUSTOM, _custom_event(g)).alias(CUSTOM),
    )


def parse_permissive(lines: DataFrame) -> DataFrame:
    """No gate: the first parser that takes the line, of UFS, blktrace CSV, block, custom."""
    line, u, b = trimmed(F.col("line")), F.col("__u"), F.col("__b")
    rows = _once(lines, "__u", _parts(_marked(line, UFS_LINE, 10)))
    rows = _once(rows, "__b", F.when(F.size(u) != 11, _block_parts(line)))
    rest = (F.size(u) != 11) & ~F.size(b).isin(11, 13)
    return rows.select(*(F.col(f"`{c}`") for c in lines.columns), _ufs_event(u).alias(UFS), _block_event(b).alias(BLOCK), F.when(rest, _custom_event(_commas(line))).alias(CUSTOM))


def events(parsed: DataFrame, kind: str) -> DataFrame:
    keep = [c for c in parsed.columns if c not in (*TYPES, "line", "category")]
    return parsed.where(F.col(kind).isNotNull()).select(*keep, f"{kind}.*")


def report(parsed: DataFrame) -> DataFrame:
    """category, lines, parsed, skipped."""
    ok = F.coalesce(*(F.col(k).isNotNull().cast("int") for k in (UFS,))) + F.col(BLOCK).isNotNull().cast("int") + F.col(CUSTOM).isNotNull().cast("int")
    return parsed.groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.sum(ok).alias("parsed"), (F.count(F.lit(1)) - F.sum(ok)).alias("skipped"))


def parse_custom_strict(lines: DataFrame) -> DataFrame:
    """Strict custom events; order them with order.by_latency. strict_counts() adds up what it finds."""
    g = F.col("__g")
    f = [F.get(g, F.lit(k + 1)) for k in range(5)]
    event = _custom(f[0], _number(f[1]), _count(f[2]), _number(f[3], "double"), _number(f[4], "double"))
    rows = _once(lines, "__g", _parts(_marked(trimmed(F.col("line")), CUSTOM_LINE, 5))).where(F.size(g) == 6)
    return rows.withColumn("e", event).select(*(F.col(f"`{c}`") for c in lines.columns if c != "line"), "e.*")


def strict_counts(lines: DataFrame) -> DataFrame:
    """One row: lines, parsed, skipped, and the least, greatest and mean latency of strict custom events."""
    line = trimmed(F.col("line"))
    rows = _once(lines, "__g", _parts(_marked(line, CUSTOM_LINE, 5)))
    ok = F.size("__g") == 6
    start, end = (_number(F.get("__g", F.lit(k)), "double") for k in (4, 5))
    dtoc = F.when(ok, (end - start) * MILLISECONDS)
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("skipped"), F.min(dtoc).alias("min_dtoc"), F.max(dtoc).alias("max_dtoc"), F.avg(dtoc).alias("avg_dtoc")
    )
