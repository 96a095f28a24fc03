"""Operator 6: document quality by histogram gradient-boosted trees over document statistics.

score(docs, labels) learns from at most `most` labelled rows (those of lowest hash of doc_id, a documented
bound) whose crc32(doc_id as text) mod 4 is not 2, and scores every whole text. Statistics are of bytes, words
and lines; labels, lang, source and doc_id are no inputs. Trees are complete and flattened into arrays, and
all documents of a batch walk down them together.

Null and empty texts have statistics of zero and a score like any other. Rows of labels with a null doc_id or
quality are not learnt from; repeated ones count as often. With no labelled rows, or one class only, every
score is the smoothed share of class 1 (0.5 without any). Repeated documents each get their row, as do
those without a doc_id, which are not held out. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as H
from .common import materialise, slices, small_batches, table, texts_of

CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "bar": b"|", "symbol": b"#$%&*@^~<>{}[]=+_\\/", "bang": b"!?", "stop": b".,;:", "quote": b"'\"`()-", "line": b"\n", "beyond": range(128, 256)}
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(CLASSES.values(), 1):
    _CLASS[list(_bytes)] = _k
N_CLASSES = len(CLASSES) + 1
N_STATS = N_CLASSES + 18
DECISION = 0.7  # least score of a document that counts as good, in the query and in the pipeline


def statistics(column: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers per text."""
    n = len(column)
    data, offsets = H.buffer_of(column)
    size = np.diff(offsets).astype(float)
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(owner * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    some = np.maximum(size, 1)
    out = [*(count / some[:, None]).T, np.log1p(size), count[:, 1] / np.maximum(count[:, 1] + count[:, 2], 1)]

    s, e, of = H.segments(data, offsets, H.SPACE)
    words = np.bincount(of, minlength=n)
    w = np.maximum(words, 1)
    length = (e - s).astype(float)
    mean = np.bincount(of, length, n) / w
    share = lambda flag: np.bincount(of, flag, n) / w
    upto = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
    upper, lower, symbol, letters = (upto(kind == 1), upto(kind == 2), upto((kind == 4) | (kind == 5) | (kind == 6)), upto((kind == 1) | (kind == 2) | (kind == N_CLASSES - 1)))
    inner = lambda x: x[e] - x[s]
    _, kinds = H.distinct(H.hashes(data, s, e), of, n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    out += [
        np.log1p(words), mean, np.sqrt(np.maximum(np.bincount(of, length**2, n) / w - mean**2, 0)), kinds / w, np.log1p(longest), share(length <= 3), share(length >= 12),
        share((inner(upper) > 0) & (inner(lower) == 0)), share(_CLASS[data[s]] == 1), share(inner(symbol) > 0), share(inner(letters) == 0), share(_CLASS[data[e - 1]] == 7),
    ]

    s, e, of = H.segments(data, offsets, H.LINE_END)
    lines = np.bincount(of, minlength=n)
    few = np.maximum(lines, 1)
    _, kinds = H.distinct(H.hashes(data, s, e), of, n)
    out += [np.log1p(lines), 1 - kinds / few, np.bincount(of, e - s, n) / few, np.bincount(of, data[e - 1] == ord("."), n) / few]
    return np.stack(out, 1).astype(np.float32)


class Trees:
    """Boosted complete trees: node k of a tree has children 2k+1 and 2k+2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    none = Trees(base, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    if len(y) < 2 * least or y.min() == y.max():
        return none
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).astype(np.float32)
    coded = np.stack([np.searchsorted(cuts[:, f], x[:, f], side="left") for f in range(x.shape[1])])  # bin b: x <= cuts[b]
    raw = np.full(len(y), base)
    inner, n_f = 2**depth - 1, x.shape[1]
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for d in range(depth):
            low, wide = 2**d - 1, 2**d
            node = at - low
            best, chosen, where = np.full(wide, 1e-6), np.zeros(wide, np.int64), np.full(wide, bins, np.int64)
            for f in range(n_f):
                key = node * bins + coded[f]
                gs, hs, ns = (np.cumsum(np.bincount(key, v, wide * bins).reshape(wide, bins), 1) for v in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (nt - nl < least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(wide), b]
                better = top > best
                best[better], chosen[better], where[better] = top[better], f, b[better]
            split = where < bins
            feature[t, low : low + wide] = chosen
            cut[t, low : low + wide] = np.where(split, cuts[np.minimum(where, bins - 2), chosen], np.inf)
            at = 2 * at + 1 + (coded[chosen[node], np.arange(len(y))] > where[node])
        end = at - inner
        gs, hs = np.bincount(end, g, inner + 1), np.bincount(end, h, inner + 1)
        leaf[t] = rate * gs / (hs + ridge)
        raw += leaf[t][end]
    return Trees(base, feature, cut, leaf)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> Trees:
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    rank = F.xxhash64("doc_id")
    sample = materialise(usable.where(fold(F.col("doc_id")) != 2).orderBy(rank, "doc_id", "quality").limit(most), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                x = statistics(b.column("text"))
                flat = pa.array(x.ravel())
                yield pa.RecordBatch.from_arrays([b.column("quality"), pa.FixedSizeListArray.from_arrays(flat, N_STATS).cast(pa.list_(pa.float32()))], names=["quality", "x"])

    known = texts_of(docs).join(F.broadcast(sample), "doc_id").select("quality", "text")
    rows = known.mapInArrow(run, "quality int, x array<float>").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), N_STATS)
    order = np.lexsort((*x.T, rows["quality"].to_numpy()))  # any order of rows gives the same trees
    return fit(x[order], rows["quality"].to_numpy(float)[order], **options)


def apply(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with a column `score` more; a null text is scored as an empty one, and stays null."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            filled = pa.RecordBatch.from_arrays([*whole.columns, whole.column("text").fill_null("")], names=[*kept, "__filled"])
            for b in slices(filled, "__filled"):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(trees.score(statistics(b.column("__filled"))))], names=[*kept, "score"])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def accept(docs: DataFrame, labels: DataFrame, least: float = DECISION) -> DataFrame:
    """The documents that score `least` or more, with the columns they have."""
    scored = apply(docs.withColumnRenamed("score", "__own_score") if "score" in docs.columns else docs, train(docs, labels))
    kept = scored.where(F.col("score") >= least).drop("score")
    return kept.withColumnRenamed("__own_score", "score") if "score" in docs.columns else kept


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = apply(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
    )
