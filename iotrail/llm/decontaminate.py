"""Operator 9: benchmark decontamination by n-gram seeds, rare ones first, and Smith-Waterman alignment of words.

find(docs, items) -> doc_id, item_id, score, start, end (words of the document): passages that align with a test
item. Seeds are the n-grams of items, in a table (n-gram, item, place) that is joined with the n-grams of all whole
texts. A filter of hash bits of bounded size goes to the tasks that read texts, so only n-grams that are likely seeds
leave them; what it lets through wrongly finds nothing in the join.

A hit opens a window with room for all the words that a passage can have besides (beyond them it scores too
little); windows of one item that overlap are one. The local alignment of item and window scores the copy: matches
give 1, mismatches and gaps cost `cost`, the sum over the number of words of the item is the score (1: whole
copy). Seeds are counted over all documents, and windows of rare ones come first: a window whose words cannot beat
the best score so far (nor reach `least`) is not aligned, and where only the decision counts (drop_leaks) a group of
items is left at its first leak. Rarity orders the work and drops nothing: a passage with every third word but three
edited still scores 0.5, so any seed, however frequent, can be the only one. Scores of `least` or more are
reported, the best one for each row and item, with the first and last word (exclusive) of the aligned passage. A
passage that keeps no n-gram (every third word edited) has no seed and is not found. Windows of an item do not
overlap, so a text and an item take at most their lengths' product of steps.

Everything is one pass over the texts, whatever the size of the benchmark: the filter has 32 bits an n-gram for up to
`block` n-grams (32 MB); with more it lets more through. No item passes through the driver. A task holds a
text with the items it may hold, about 4096 of them at a time. A-Z are lower-cased; words are apart by ASCII white
space; edge punctuation of words is dropped.

Null and empty texts and items match nothing; items of fewer words than a seed use one seed of all their words and
are looked up in runs of as many words. Rows that repeat an item_id are one item each, and the best counts. Each row
of docs gets its own rows, also one that repeats another; a null doc_id is reported as such, and so is a null
item_id. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as H
from .common import forget, list_array, materialise, slices, small_batches, table

EDGE = np.zeros(256, bool)
EDGE[[ord(c) for c in ".,;:!?\"'()[]{}|*#$%&"]] = True


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, without edge punctuation, and how many each text has."""
    data, offsets = H.buffer_of(column)
    s, e, of = H.segments(data, offsets, H.SPACE)
    for _ in range(3):  # up to three marks on either side
        s = s + ((e - s > 1) & EDGE[data[np.minimum(s, len(data) - 1)]] if len(s) else 0)
        e = e - ((e - s > 1) & EDGE[data[e - 1]] if len(s) else 0)
    return H.hashes(data, s, e), np.bincount(of, minlength=len(column))


def align(item: np.ndarray, text: np.ndarray, cost: float) -> tuple[float, int, int]:
    """Best local alignment: its sum, and the start and end of its part of text."""
    here = np.arange(len(text) + 1)
    above, began, steps, best = np.zeros(len(text) + 1), here, here * cost, (0.0, 0, 0)
    for w in item:
        match, skip = above[:-1] + np.where(text == w, 1.0, -cost), above[1:] - cost
        row, start = np.zeros(len(text) + 1), here.copy()
        np.maximum(np.maximum(match, skip), 0, out=row[1:])
        start[1:] = np.where(row[1:] <= 0, here[1:], np.where(match >= skip, began[:-1], began[1:]))
        lifted = np.maximum.accumulate(row + steps)
        source = np.maximum.accumulate(np.where(row + steps >= lifted, here, 0))  # from where gaps in item come
        row, start = lifted - steps, start[source]
        k = int(row.argmax())
        if row[k] > best[0] + 1e-12:
            best = float(row[k]), int(start[k]), k
        above, began = row, start
    return best


def windows(begins: np.ndarray, rare: np.ndarray, size: int, beyond: float) -> list[tuple[int, int]]:
    """Of one document and item of `size` words: the stretches of words to align, those of the rarest seeds first.
    begins: where the item begins by each hit; rare: how often the seed of each is found; beyond: words that a
    passage can have besides the item's, as a share of these."""
    order = np.argsort(begins, kind="stable")
    begins, rare, room = begins[order], rare[order], int(beyond * size) + 1
    cuts = np.flatnonzero(np.diff(begins) > size + 2 * room) + 1
    groups = zip(np.split(begins, cuts), np.split(rare, cuts))
    found = sorted((int(r.min()), -len(g), max(0, int(g[0]) - room), int(g[-1]) + size + room) for g, r in groups)
    return [(s, e) for _, _, s, e in found]


def _runs(column: pa.Array, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, how many each has; n-grams of the given sizes, the text of each and its place there."""
    words, n = word_ids(column)
    grams, owner, at = [], [], []
    for size in sizes:
        g, o = H.shingles(words, n, size)
        keep = n[o] >= size  # a text shorter than the n-gram has none of that size
        grams.append(g[keep]), owner.append(o[keep]), at.append((np.arange(len(o)) - np.searchsorted(o, o))[keep])
    if not sizes:
        return words, n, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return words, n, np.concatenate(grams), np.concatenate(owner), np.concatenate(at)


def best_of(item: np.ndarray, text: np.ndarray, stretches: list[tuple[int, int]], cost: float, least: float) -> tuple[float, int, int] | None:
    """score, start, end of the best alignment in the stretches, if it reaches least."""
    best = None
    for s, e in stretches:
        most = np.isin(item, text[s:e]).sum() / len(item)  # if all of them match
        if most < max(least, best[0] if best else 0.0) - 1e-9:
            continue
        total, start, end = align(item, text[s:e], cost)
        got = (total / len(item), s + start, s + end)
        best = got if best is None else max(best, got)
    return best if best and best[0] >= least - 1e-12 else None


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words (hashes): one row per row of items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                words, n = word_ids(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("item_id"), list_array(words.view(np.int64), n, pa.int64())], names=["item_id", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") > 0)


def _seeds(items: DataFrame, size: int) -> DataFrame:
    """items(item, words) -> gram, item, at (its place), width (words of the n-gram): the seeds of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column("words").value_lengths()).astype(np.int64)
            words = np.asarray(b.column("words").flatten()).astype(np.int64).view(np.uint64)
            grams, owner = H.shingles(words, n, size)
            at = np.arange(len(owner)) - np.searchsorted(owner, owner)
            width = np.minimum(n, size)[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), b.column("item").take(pa.array(owner)), pa.array(at), pa.array(width)], names=["gram", "item", "at", "width"]
            )

    return items.select("item", "words").mapInArrow(run, "gram long, item long, at long, width long")


PART = 1 << 16  # bits of the filter in a row
PROBES = 6


def _probe(grams: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each n-gram among `bits` bits, a power of two."""
    return (H.mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) & np.uint64(bits - 1)).astype(np.int64)


def _filter(seeds: DataFrame, block: int) -> np.ndarray:
    """Hash bits of all seeds, made in tasks; the driver gets 32 * block bits at most, in parts."""
    bits = 1 << max(16, (32 * min(block, seeds.count()) - 1).bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, np.uint8)
        for b in batches:
            grams = np.asarray(b.column("gram")).view(np.uint64)
            for at in (_probe(grams, k, bits) for k in range(PROBES)):
                np.bitwise_or.at(mine, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = mine.reshape(-1, PART // 8)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["part", "bits"])

    def merge(key, table):
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros((bits // PART, PART // 8), np.uint8)
    for row in seeds.select("gram").mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(merge, "part long, bits binary").toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _maybe(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places in grams of those that the filter lets through."""
    left = np.arange(len(grams))
    for k in range(PROBES):
        at = _probe(grams[left], k, len(bits) * 8)
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def _with_hits(docs: DataFrame, widths: list[int], bits: np.ndarray) -> DataFrame:
    """docs(row, ..., text) with `grams` and `places`: the n-grams of each text that may be seeds, and where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole.append_column("__whole", whole.column(TEXT).fill_null("")), "__whole"):
                _, _, grams, owner, at = _runs(b.column("__whole"), widths)
                hit = _maybe(grams, shared.value)
                hit = hit[np.argsort(owner[hit], kind="stable")]
                n = np.bincount(owner[hit], minlength=b.num_rows)
                out = b.drop_columns(["__whole"])
                yield out.append_column("__grams", list_array(grams[hit].view(np.int64), n, pa.int64())).append_column("__places", list_array(at[hit], n, pa.int64()))

    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("__grams", "__places"))])
    return docs.mapInArrow(run, kind)


FOUND = "doc_id long, item_id long, score double, start long, end long"
TEXT = "__text"


def _candidates(rows: DataFrame, seeds: DataFrame, items: DataFrame) -> DataFrame:
    """row, some (item_id, words, begins, rare): each text's items by the join of n-grams with seeds."""
    hits = rows.where(F.size("__grams") > 0).select("__row", F.explode(F.arrays_zip(F.col("__grams").alias("gram"), F.col("__places").alias("place"))).alias("x"))
    hits = hits.select("__row", F.col("x.gram").alias("gram"), F.col("x.place").alias("place"))
    counted = seeds.join(hits.groupBy("gram").agg(F.count(F.lit(1)).alias("rare")), "gram")
    met = hits.join(counted, "gram").select("__row", "item", (F.col("place") - F.col("at")).alias("begin"), "rare")
    pairs = met.groupBy("__row", "item").agg(F.collect_list(F.struct("begin", "rare")).alias("hits"))
    parts = max(1, items.count() // 4096)
    known = pairs.join(items, "item").select("__row", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"), F.struct(F.array_min(F.transform("hits", lambda h: h["rare"])).alias("rare"), "item_id", "words", F.col("hits.begin").alias("begins"), F.col("hits.rare").alias("rares")).alias("x"))
    return known.groupBy("__row", "part").agg(F.array_sort(F.collect_list("x")).alias("some"))


def _found(rows: DataFrame, items: DataFrame, seeds: DataFrame, cost: float, least: float, first: bool) -> DataFrame:
    """__row and item_id, score, start, end: the best of each row and item_id; first: one for each group of items."""
    beyond = max(0.0, 1 - least) / cost if cost else 1e6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, TEXT):
                words, n = word_ids(b.column(TEXT))
                out, till = [], np.cumsum(n)
                for k, number in enumerate(b.column("__row").to_pylist()):
                    text = words[till[k] - n[k] : till[k]]
                    for x in b.column("some")[k]:
                        item, begins, rares = (np.asarray(x[c].values).astype(np.int64) for c in ("words", "begins", "rares"))
                        item = item.view(np.uint64)
                        got = best_of(item, text, windows(begins, rares, len(item), beyond), cost, least)
                        if got:
                            out.append((number, x["item_id"].as_py(), *got))
                            if first:
                                break
                kinds = {"__row": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "start": pa.int64(), "end": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    some = _candidates(rows, seeds, items)
    texts = rows.where(F.size("__grams") > 0).select("__row", F.coalesce(TEXT, F.lit("")).alias(TEXT))
    found = texts.join(some, "__row").select("__row", TEXT, "some").mapInArrow(run, "__row long, item_id long, score double, start long, end long")
    best = F.max(F.struct("score", "start", "end")).alias("x")
    return found.groupBy("__row", "item_id").agg(best).select("__row", "item_id", "x.score", "x.start", "x.end")


def _prepared(docs: DataFrame, items: DataFrame, size: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Written tables: docs(..., __text) with numbers and hits, items (item, item_id, words), seeds. None without items."""
    small_batches(docs.sparkSession)
    known = materialise(item_words(items).withColumn("item", F.monotonically_increasing_id()), "leak-items")
    seeds = materialise(_seeds(known, size), "leak-seeds")
    widths = [r["width"] for r in seeds.select("width").distinct().orderBy("width").collect()]  # size numbers at most
    if not widths:
        return None
    rows = _with_hits(docs.withColumn("__row", F.monotonically_increasing_id()), widths, _filter(seeds, block))
    return rows, known, seeds


def find(docs: DataFrame, items: DataFrame, size: int = 3, cost: float = 0.5, least: float = 0.5, block: int = 1 << 23) -> DataFrame:
    made = _prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias(TEXT)), items, size, block)
    if made is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    rows, known, seeds = made
    rows = materialise(rows.where(F.size("__grams") > 0), "leak-rows", compression="zstd")
    found = materialise(_found(rows, known, seeds, cost, least, False), "leak-finds")
    return found.join(rows.select("__row", "doc_id"), "__row").select("doc_id", "item_id", "score", "start", "end")


def drop_leaks(docs: DataFrame, items: DataFrame, size: int = 3, cost: float = 0.5, least: float = 0.5, block: int = 1 << 23, most: int = 2_000_000) -> DataFrame:
    """docs without the rows that hold a passage of a test item, with the columns docs has. Rows are looked at one by
    one, so rows without a doc_id and rows that repeat others go if they hold one and stay if not. The numbers of the
    rows that go are broadcast if there are at most `most` (counted; 8 bytes each); beyond that a join shuffles rows."""
    made = _prepared(docs.withColumn(TEXT, F.col("text")).drop("text"), items, size, block)
    if made is None:
        return docs
    rows, known, seeds = made
    rows = materialise(rows, "leak-rows", compression="zstd")
    gone = materialise(_found(rows, known, seeds, cost, least, True).select("__row").distinct(), "leak-gone")
    forget(known, seeds)
    if gone.count() <= most:
        gone = F.broadcast(gone)
    kept = rows.join(gone, "__row", "left_anti")
    return kept.select(*(F.col(TEXT).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
