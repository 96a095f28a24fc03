"""Positions of regular-expression matches as Column expressions (no Python in tasks).

A span is a struct(start, rank, end, kind, text, score): code points, end exclusive; rank orders kinds.

No step costs the square of a text or of its matches: running totals go over blocks of about the square root of
their number, and parts of a text are taken from pieces of CHUNK code points that it is cut into once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,text:string,score:double>"
SPANS = f"array<{SPAN}>"


def none() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers, what add() makes of 0 and all before it."""
    fold = lambda xs, start: F.aggregate(xs, start.cast("int"), lambda acc, x: add(acc, x).cast("int"))

    def of(values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(values))).cast("int")
        starts = F.sequence(F.lit(1), F.size(values), size)
        blocks = F.transform(starts, lambda at: F.slice(values, at, size))

        def all_(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda x: fold(x, F.lit(0)))
            firsts = let(sums, lambda sums: F.transform(sums, lambda _, i: fold(F.slice(sums, F.lit(1), i), F.lit(0))))
            return F.flatten(F.zip_with(blocks, firsts, lambda x, first: F.transform(x, lambda _, j: fold(F.slice(x, F.lit(1), j), first))))

        return let(blocks, all_)

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, regex: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches in order. The text between matches gives the positions, so each
    text is scanned twice where it matches and once where it doesn't."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap"), F.char_length(m).alias("size")))

        def spans(pairs: Column) -> Column:
            totals = before(F.transform(pairs, lambda p: p["gap"] + p["size"]), lambda a, b: a + b)

            def one(p: Column, at: Column) -> Column:
                start = at + p["gap"]
                parts = start.alias("start"), F.lit(rank).alias("rank"), (start + p["size"]).alias("end"), F.lit(kind).alias("kind"), p["m"].alias("text"), F.lit(None).cast("double").alias("score")
                return F.struct(*parts)

            return F.zip_with(pairs, totals, one)

        return let(pairs, spans)

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none()))


def apart(spans: Column, others: Column) -> Column:
    """The spans that none of the others overlaps: what reaches furthest of those that begin before a span's end
    tells, so one sorted array does."""
    mark = lambda s, at, own: F.struct(s[at].alias("at"), F.lit(own).alias("own"), F.when(F.lit(own == 0), s["end"]).otherwise(0).alias("till"), s.alias("span"))

    def kept(marks: Column) -> Column:
        reached = before(F.transform(marks, lambda m: m["till"]), F.greatest)
        both = F.zip_with(marks, reached, lambda m, till: F.when((m["own"] < 0) & (till <= m["span"]["start"]), m["span"]))
        return F.filter(both, lambda s: s.isNotNull())

    events = F.concat(F.transform(others, lambda s: mark(s, "start", 0)), F.transform(spans, lambda s: mark(s, "end", -1)))
    return let(others, lambda o: F.when((F.size(spans) == 0) | (F.size(o) == 0), spans).otherwise(let(F.array_sort(events), kept)))


CHUNK = 1024


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}+" % CHUNK), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text from its chunks."""
    low, high = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    part = F.array_join(F.slice(pieces, low + 1, F.greatest(high - low + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(part, start - low * CHUNK + 1, end - start)).otherwise("")


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, test)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span replaced by mark; overlapping spans are replaced once."""

    def replaced(pieces: Column, spans: Column) -> Column:
        reached = before(F.transform(spans, lambda s: s["end"]), F.greatest)
        parts = F.zip_with(spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(cut(pieces, at, s["start"]), F.lit(mark))).otherwise(""))
        last = F.aggregate(spans, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
        return F.concat(F.array_join(parts, ""), cut(pieces, last, F.char_length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(chunks(text), lambda pieces: let(F.array_sort(spans), lambda s: replaced(pieces, s))))
