"""Operator 10: packing token pieces into as few sequences as can be found, by bin completion.

pieces(docs) tokenises whole texts and cuts only documents longer than the capacity. pack(pieces) gives every
piece a sequence_id and an offset. The search sees nothing but how many pieces have each length, at most
`capacity` numbers whatever the input: it fills a sequence around the largest length left, trying undominated
fillings by least waste, and prunes by the waste that is still allowed under the best solution so far, which
is best-fit decreasing at first. A filling is dominated if a length that is left fits in place of some of its pieces
and what remains free (none of them: it could be added); all that are not are listed, of any number of pieces, one
after another as the search asks for them. A filling is used as often as the counts allow, then once. If the lower
bound is met, or `work` steps of the search are done, the best solution stands. Pieces of one length are interchangeable,
so they are numbered in Spark and take their places by number.

Null texts are empty; an empty document is its end id alone. Repeated rows each get their place. Columns that
pieces carries besides are kept. An empty input gives an empty result. A length over the capacity is an error.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoder, list_array, materialise, slices, table, texts_of
from .token_output import with_crc

PIECES = "doc_id long, piece int, start long, length long, ids array<int>"
Filling = tuple[tuple[int, int], ...]  # (length, how often), lengths descending


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                ids, n = encoder(tokenizer_path).encode(b.column("text").to_pylist(), end_id)
                times = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), list_array(ids, length, pa.int32())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return texts_of(docs).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over counts by length: [(how many sequences, filling)]."""
    open_: dict[int, list[tuple[int, Filling]]] = {}  # by room left
    rooms: list[int] = []  # those that have some, ascending
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                room, have, filling = capacity, left, ()
            else:
                room = rooms[k]
                have, filling = open_[room].pop()
            each = min(room // length, left)
            times = min(have, left // each)
            if filling and have > times:
                open_[room].append((have - times, filling))
            elif filling and not open_[room]:
                del rooms[k]
            left -= times * each
            if not open_.setdefault(room - each * length, []):
                bisect.insort(rooms, room - each * length)
            open_[room - each * length].append((times, (*filling, (length, each))))
    return [x for some in open_.values() for x in some]


def bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: pieces over half stand apart, with what no room beside them can take."""
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    k = np.arange(capacity + 2)
    half = capacity // 2
    over, size_over = np.cumsum(n[::-1])[::-1], np.cumsum((n * (capacity - k))[::-1])[::-1]  # of lengths >= k
    mass = np.cumsum((n * k)[::-1])[::-1]
    small = np.arange(half + 1)
    large = over[capacity - small + 1]
    middle, room = over[half + 1] - large, size_over[half + 1] - size_over[capacity - small + 1]
    beyond = mass[small] - mass[half + 1] - room
    return max(-(-int(mass[0]) // capacity), int((large + middle + np.maximum(0, -(-beyond // capacity))).max()))


def _smear(bits: int, by: int) -> int:
    """Bits moved up by 0 to `by` places, together."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def undominated(filling: Filling, counts: dict[int, int], room: int, spare: int = 0) -> bool:
    """No length that is left can take the place of some of the filling's pieces (or of none) and of free room.

    If any other filling dominates this one, a single such exchange is possible too, so one suffices to tell.
    spare: a length of which one piece less is left than counts says."""
    one, several, free = 0, 0, room - sum(k * n for k, n in filling)
    for k, n in filling:
        for _ in range(n):  # bit s: some pieces add up to s
            several |= (several | one) << k
            one |= 1 << k
    left = dict(filling)
    better = _smear(1, free) & ~1 | (_smear(one, free - 1) << 1 if free else 0) | _smear(several, free)
    return not any(better >> k & 1 and n - (k == spare) > left.get(k, 0) for k, n in counts.items() if k <= room)


def _sums(lengths: list[int], most: int) -> list[int]:
    """Bit s of the i-th number: s can be made of the first i lengths, were there enough of each."""
    out, whole = [1], (1 << most + 1) - 1
    for k in lengths:
        s, step = out[-1], k
        while step <= most:
            s |= s << step & whole
            step *= 2
        out.append(s)
    return out


def fillings(
    counts: dict[int, int], room: int, most_waste: int | None = None, spend: Callable[[], bool] = lambda: True, spare: int = 0, known: tuple[list[int], list[int]] | None = None
) -> Iterator[Filling]:
    """All undominated ways to fill a room from the counts, by least waste, up to a waste. spend() is asked at each
    step and ends the search by False. known: lengths that counts may have, and their _sums."""
    lengths, sums = known or (sorted(k for k, n in counts.items() if n), None)
    sums = sums or _sums(lengths, room)
    first = bisect.bisect_right(lengths, room)

    def ways(upto: int, left: int, items: Filling) -> Iterator[tuple[int, int, Filling]]:
        for i in range(bisect.bisect_right(lengths, left, 0, upto) - 1, -1, -1):  # the largest piece of the rest
            if not sums[i + 1] >> left & 1:
                return  # shorter lengths make even fewer sums
            k = lengths[i]
            for m in range(min(counts.get(k, 0) - (k == spare), left // k), 0, -1):
                if sums[i] >> left - m * k & 1:
                    yield i, left - m * k, (*items, (k, m))

    for waste in range(room + 1 if most_waste is None else min(room, most_waste) + 1):
        if not sums[first] >> room - waste & 1:
            continue
        stack = [iter([(first, room - waste, ())])]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
            elif not spend():
                return
            elif step[1]:
                stack.append(ways(*step))
            elif undominated(step[2], counts, room, spare):
                yield step[2]


def complete(counts: dict[int, int], capacity: int, work: int = 150_000) -> list[tuple[int, Filling]]:
    """[(how many sequences, filling)]. work: steps of the search; one within fillings counts 1, one that ends in a
    partial packing to be judged 10 and an eighth of the lengths left. One set of counts is changed and changed back,
    so what the search holds grows with the lengths plus its depth."""
    left = {k: n for k, n in counts.items() if n}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("a length is outside 1..capacity")
    best = best_fit(left, capacity)
    fewest, least = sum(n for n, _ in best), bound(left, capacity)
    if fewest <= least:
        return best
    total = sum(k * n for k, n in left.items())
    lengths = sorted(left)
    known = lengths, _sums(lengths, capacity)
    done: list[tuple[int, Filling]] = []
    used = waste = spent = 0

    def spend(n: int = 1) -> bool:
        nonlocal spent
        spent += n
        return spent <= work

    def take(times: int, filling: Filling) -> None:
        nonlocal used, waste
        for k, n in filling:
            left[k] = left.get(k, 0) - times * n
            if not left[k]:
                del left[k]
        used, waste = used + times, waste + times * (capacity - sum(k * n for k, n in filling))

    def moves() -> Iterator[tuple[int, Filling]]:
        """Ways on from the packing so far: a filling as often as may be, then once."""
        largest = max(left)
        room = lambda: (fewest - 1) * capacity - total - waste  # noqa: E731  more waste than one sequence fewer allows is in vain
        for filling in fillings(left, capacity - largest, room(), spend, largest, known):
            full = dict(filling)
            full[largest] = full.get(largest, 0) + 1
            empty = capacity - sum(k * n for k, n in full.items())
            most = min(left[k] // n for k, n in full.items())
            for again in (False, True):
                times = 1 if again else min(most, room() // empty) if empty else most
                if times >= 1 and times * empty <= room() and not (again and most == 1) and spend(10 + len(left) // 8):
                    yield times, tuple(sorted(full.items(), reverse=True))

    stack = [moves()]
    while stack and spent <= work:
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if done:
                times, filling = done.pop()
                take(-times, filling)
            continue
        take(*move)
        done.append(move)
        quick = best_fit(left, capacity)
        if (n := used + sum(x for x, _ in quick)) < fewest:
            best, fewest = [*done, *quick], n
            if fewest <= least:
                break
        if left and used + bound(left, capacity) < fewest:
            stack.append(moves())
        else:
            take(-move[0], move[1])
            done.pop()
    return best


def places(solution: list[tuple[int, Filling]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, pieces a sequence, first sequence, offset) for each part of a filling."""
    numbered: dict[int, int] = {}
    sequence, out = 0, []
    for times, filling in solution:
        offset = 0
        for k, each in filling:
            first = numbered.get(k, 0)
            numbered[k] = first + times * each
            out.append((k, first, numbered[k], each, sequence, offset))
            offset += k * each
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048, per_bucket: int = 100_000, work: int = 150_000) -> DataFrame:
    """Adds sequence_id and offset. `pieces` is read three times, so it should be a written table.

    Pieces of one length are numbered bucket by bucket (hash of doc_id and piece) with about per_bucket pieces in
    each, so a length that most pieces share is spread over as many buckets as it needs, and there are at most
    capacity + pieces / per_bucket buckets. Parts of the solution meet the pieces of their numbers in a window over
    each bucket, a row for each part that begins in it or holds its first number; no piece meets more than one.
    """
    spark = pieces.sparkSession
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` numbers at most
    buckets = spark.createDataFrame([(k, -(-n // per_bucket)) for k, n in sorted(total.items())], "length long, __buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), "__buckets")).drop("__buckets")  # `capacity` rows of two numbers
    counts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = materialise(counts.withColumn("__before", F.sum("n").over(W.partitionBy("length").orderBy("__bucket")) - F.col("n")), "pack-counts")
    rows = places(complete(total, capacity, work))
    where = spark.createDataFrame(rows, "length long, __first long, __end long, __each long, __sequence long, __offset long")
    part = F.struct("__first", "__each", "__sequence", "__offset")
    marks = where.join(before, "length").where((F.col("__first") < F.col("__before") + F.col("n")) & (F.col("__end") > F.col("__before")))
    marks = marks.select("length", "__bucket", (F.greatest("__first", "__before") - F.col("__before")).alias("__number"), part.alias("__part"), "__before")
    number = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "piece")) - 1
    numbered = dealt.select("length", "__bucket", number.cast("long").alias("__number"), F.struct(*pieces.columns).alias("__piece"))
    both = numbered.unionByName(marks, allowMissingColumns=True)
    upto = W.partitionBy("length", "__bucket").orderBy("__number", F.col("__piece").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__part").isNotNull(), F.struct("__part", "__before")), ignorenulls=True).over(upto).alias("x")
    placed = both.select("__piece", "__number", last).where("__piece is not null")
    part, at = F.col("x.__part"), F.col("__number") + F.col("x.__before") - F.col("x.__part.__first")
    return placed.select(
        "__piece.*",
        (part["__sequence"] + F.floor(at / part["__each"])).cast("long").alias("sequence_id"),
        (part["__offset"] + (at % part["__each"]) * F.col("__piece.length")).cast("long").alias("offset"),
    )


def manifest(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Where each piece of each document goes, with the checksum of its ids."""
    return pack(materialise(with_crc(pieces(docs, tokenizer_path, capacity)), "pack-pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return manifest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
