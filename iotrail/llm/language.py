"""Operator 12: the language of a text, by n-gram filters that hold a mask of languages in each place.

An n-gram is three or four characters of a lower-cased word, whose ends may be the word's borders. It belongs to each
language in which it is at least 1/`ratio` as frequent as in the one where it is most frequent. Bloom filters of
all languages lie side by side: place p has one bit a language, so the bits that all places of an n-gram have in
common are all languages that hold it. What a filter finds by mistake is known from how full it is: of N n-grams,
a language with `count` hits and false rate f truly holds (count - f N) / (1 - f). The language with most decides;
score is its share of what all languages hold.

Learnt from a bounded sample of documents with a text and a lang, spread by hash: `per_language` of each
language at most (expected number, copies count once), of the `most` most frequent languages. lang, source and
doc_id are no inputs of a prediction. A text without a letter, or none, is `und` with score 0, as are all if nothing
was learnt. A text with letters but no n-gram that any filter holds gets the most frequent language and score 0; ties
go to the language of lower name. Documents without a doc_id are neither learnt from nor held out. Repeated rows
each get their answer. Other columns are kept by predict(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, table
from .quality import fold
from .wordhash import mix

SIZES = (3, 4)
PROBES = 3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each, and how many letters each text has."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    owner = np.repeat(np.arange(len(low)), sizes)  # of place p + 1: a border comes first
    code = np.where(letter, code, 0).astype(np.uint64)
    hashes, owners = [], []
    for size in SIZES:
        last = len(code) - size + 1
        if last <= 0:
            continue
        inside = letter[1 : last + 1].copy()
        for k in range(2, size - 1):
            inside &= letter[k : last + k]
        at = np.flatnonzero(inside)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[at + k]
        hashes.append(mix(h))
        owners.append(owner[at])
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, o = (np.concatenate([x, *y]) for x, y in zip(none, (hashes, owners)))
    return h, o, np.bincount(owner, letter[1:], minlength=len(low)) if len(low) else np.zeros(0)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass(frozen=True)
class Filters:
    names: list[str]  # ascending
    prior: int  # the most frequent language
    masks: np.ndarray  # places x words of 64 languages
    false: np.ndarray  # chance that a filter holds what was never put in

    def languages(self, h: np.ndarray) -> np.ndarray:
        """The mask of all languages that hold each n-gram."""
        first, *rest = _places(h, int(np.log2(len(self.masks))))
        found = self.masks[first]
        for p in rest:
            found &= self.masks[p]
        return found

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, owner, letters = grams(texts)
        found, n = self.languages(h), np.bincount(owner, minlength=len(texts))
        held = np.zeros((len(texts), len(self.names)))
        for k, f in enumerate(self.false):
            bit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            held[:, k] = np.maximum(0, (np.bincount(owner, bit, len(texts)) - f * n) / (1 - f))
        best, total = held.argmax(1) if self.names else np.zeros(len(texts), int), held.sum(1)
        best = np.where(total > 0, best, self.prior)
        score = np.where(total > 0, held[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0) if self.names else np.zeros(len(texts))
        known = (letters > 0) & bool(self.names)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, per_language: int = 4000, most: int = 1024, bits: int = 19, ratio: float = 4.0, least: int = 2) -> Filters:
    """Filters from docs(doc_id, text, lang) of the folds that are learnt from. An n-gram seen fewer than `least` times
    in a language is left out. The filters have 2**bits places, whatever the input."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not counts:
        return Filters([], 0, np.zeros((1 << bits, 1), np.uint64), np.zeros(0))
    names = sorted(r.lang for r in counts)
    number = {name: k for k, name in enumerate(names)}
    shares = spark.createDataFrame([(r.lang, number[r.lang], min(1.0, per_language / r.n)) for r in counts], "lang string, k int, share double")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(12), "doc_id"), 11) / float(1 << 53)
    sample = rows.join(F.broadcast(shares), "lang").where(chance < F.col("share"))  # at most `most` rows are broadcast
    sample = sample.groupBy("k", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text") if whole.num_rows else ():
                h, owner, _ = grams(b.column("text").to_pylist())
                k = b.column("k").to_numpy()[owner]
                order = np.lexsort((h, k))
                h, k = h[order], k[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))[: len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))))], names=["k", "gram", "n"])

    found = materialise(sample.mapInArrow(run, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")), "language-grams")
    total = found.groupBy("k").agg(F.sum("n").alias("total"))
    rates = found.join(F.broadcast(total), "k").select("k", "gram", "n", (F.col("n") / F.col("total")).alias("rate"))
    held = rates.where(F.col("n") >= least).join(rates.groupBy("gram").agg(F.max("rate").alias("top")), "gram").where(F.col("rate") * ratio >= F.col("top"))
    place = F.explode(F.array(*(F.shiftrightunsigned("gram", bits * p).bitwiseAND((1 << bits) - 1) for p in range(PROBES)))).alias("place")
    mask = F.expr("shiftleft(1L, k % 64)").alias("mask")
    held = held.select(place, F.floor(F.col("k") / 64).cast("int").alias("word"), mask)
    masks = np.zeros((1 << bits, (len(names) + 63) // 64), np.uint64)
    for part in held.groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).coalesce(4).toArrow().to_batches():  # at most a row a place and word
        masks[part.column("place").to_numpy(), part.column("word").to_numpy()] = part.column("mask").to_numpy().view(np.uint64)
    full = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))])
    return Filters(names, number[counts[0].lang], masks, np.minimum(full**PROBES, 0.999))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score more (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # of a size set by `bits` and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            filled = pa.RecordBatch.from_arrays([*whole.columns, whole.column("text").fill_null("")], names=[*kept, "__filled"])
            for b in slices(filled, "__filled"):
                name, score = shared.value.decide(b.column("__filled").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(name, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
