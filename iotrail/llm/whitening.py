"""Operator 11: whitening of embeddings by eigenvectors refined to double precision.

Entries become whole numbers x = floor(64 * c) + 1000000. Each distinct x vector counts once in the fit list, whose
sums are exact and whose covariance is added up in tasks from centred vectors, a matrix a task. The driver sees
matrices of the vectors' width alone. Eigenvectors found in float32 are corrected by Ogita-Aishima iterations, which
are matrix products in extended precision; eigenvalues too close together to be told apart by them are handled as
clusters, whose subspace is solved anew after its mean eigenvalue has been taken off.

Rows go whose vector is null or empty, or holds a null or non-finite entry or one of 2^40 and more in size, and so do
vectors of another length than the most frequent (of equally frequent ones the greatest). Rows that repeat a vec_id or
have none each get their answer. Components without variance (a fit list of one vector has no other) are left out:
they can't be scaled to one. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, materialise, table

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 40
WIDE = np.longdouble  # 64 bits of mantissa on x86, 113 on some others; never fewer than float64


def refine(v: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, to double precision."""
    size = len(v)
    power = np.frexp(np.abs(v).max(initial=0))[1]
    a = np.ldexp(v, -power)  # exact, and within float32's range
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    a, one = a.astype(WIDE), np.eye(size, dtype=WIDE)
    small = 8 * size * np.finfo(WIDE).eps
    for _ in range(most):
        r, s = one - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would skew the vectors
        value = np.diag(s) / (1 - np.diag(r))
        unsure = 2 * (np.linalg.norm((s - np.diag(value)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > unsure
        step = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        turned = 0.0
        order = np.argsort(value)
        runs = np.split(order, np.flatnonzero(np.diff(value[order]) > unsure) + 1)
        for cluster in (c for c in runs if len(c) > 1):
            some = x[:, cluster]
            middle = value[cluster].mean()
            inner = some.T @ (a @ some - middle * some)
            inner = (inner + inner.T) / 2
            off = np.abs(inner - np.diag(np.diag(inner))).max()
            if off > small:
                x[:, cluster] = some @ np.linalg.eigh(np.ldexp(inner, -np.frexp(np.abs(inner).max())[1]).astype(float))[1].astype(WIDE)
                turned = max(turned, float(off))
        if max(float(np.abs(step).max(initial=0)), turned) <= small:
            break
    x = x + x @ ((one - x.T @ x) / 2)
    value = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    x = (x / np.sqrt((x * x).sum(0)))[:, order]
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(size)]) if size else np.ones(0)
    return np.ldexp(value[order], power).astype(float), (x * sign).astype(float)


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q array<long>) of usable rows, q = floor(64 * c)."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    width = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return rows.where(F.size("v") == (width[0] if width else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("q"))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _added(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(q)^T of(q) over the fit list: one matrix a task, rows of which are then added by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                z = of(_matrix(b.column("q")))
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), list_array(total.ravel(), np.full(size, size), pa.float64())], names=["i", "g"])

    def add(group: pa.Table) -> pa.Table:
        rows = _matrix(group.column("g").combine_chunks())
        return pa.table({"i": group.column("i").slice(0, 1), "g": list_array(rows.sum(0), np.array([size]), pa.float64())})

    rows = fit.select("q").mapInArrow(run, "i int, g array<double>").groupBy("i").applyInArrow(add, "i int, g array<double>")
    out = np.zeros((size, size))
    for r in rows.toLocalIterator():
        out[r.i] = r.g
    return out


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # of q, exact
    values: np.ndarray  # eigenvalues of components
    vectors: np.ndarray  # a column each
    explained: np.ndarray
    identity_error: float

    def centred(self, q: np.ndarray) -> np.ndarray:
        """x - S/n to double precision: the whole part of the mean is taken off exactly first."""
        parts = [divmod(s, self.n) for s in self.sums]
        return (q - np.array([p[0] for p in parts], np.int64)).astype(float) - np.array([p[1] / self.n for p in parts])

    def whitened(self, q: np.ndarray) -> np.ndarray:
        return self.centred(q) @ self.vectors / np.sqrt(self.values)

    def deviation(self, q: np.ndarray) -> list[int]:
        """Sum of (n*x - S)^2 of each row, exact at any size."""
        bound = self.n * int(np.abs(q).max(initial=0)) + max(map(abs, self.sums), default=0)
        exact = np.int64 if bound * bound * max(1, q.shape[1]) < 1 << 63 else object
        t = q.astype(exact) * self.n - np.array(self.sums, exact)
        return (t * t).sum(1).tolist()


def fit(rows: DataFrame, most: int = 16) -> Whitening | None:
    """rows(q) of one width -> what whitens them; None without rows."""
    points = materialise(rows.select("q").distinct(), "whitening-fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = _matrix(b.column("q")).sum(0)  # batches are small: no overflow
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array([b.num_rows, *total.tolist()], pa.int64())], names=["i", "s"])

    sums = {r.i: int(r.s) for r in points.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s")).collect()}
    if not sums:
        return None
    n, total = sums[-1], [sums[k] for k in range(len(sums) - 1)]
    plain = Whitening(n, total, np.ones(0), np.zeros((len(total), 0)), np.ones(0), 0.0)
    v = _added(points, plain.centred, len(total)) / n
    values, vectors = refine((v + v.T) / 2)
    k = int((values[:most] > len(values) * np.finfo(float).eps * values.max(initial=0)).sum())
    found = Whitening(n, total, values[:k], vectors[:, :k], values[:k] / np.trace(v) if k else values[:k], 0.0)
    error = float(np.abs(_added(points, found.whitened, k) / n - np.eye(k)).max(initial=0))
    return Whitening(n, total, found.values, found.vectors, found.explained, error)


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def apply(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """rows(vec_id, q) -> a row for each of them and component, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values) if model else 0
        for b in batches:
            if b.num_rows and k:
                q = _matrix(b.column("q"))
                each = lambda values, m=b.num_rows: np.tile(values, m)
                where = pa.array(np.repeat(np.arange(b.num_rows), k))
                deviation = pa.array(map(str, model.deviation(q)), pa.string()).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(where), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(where), model.n)), deviation.take(where),
                        pa.array(model.whitened(q).ravel()), pa.array(each(model.explained)), pa.array(np.full(len(where), model.identity_error)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return rows.select("vec_id", "q").mapInArrow(run, OUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings"))
    return apply(rows, fit(rows)).withColumn("deviation", F.col("deviation").cast("long"))
