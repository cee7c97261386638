"""Whitening of embeddings: the distributed centred scatter, diagonalised by cyclic Jacobi rotations.

1. Every entry c becomes the whole number ``x = floor(scale * c) + offset``.  The fit list holds each distinct x vector
   once; copies meet in a map-side combined ``distinct``, so a vector that a third of all rows have costs one row a task.
2. A first pass over the list gives its length n and the sums S, a second one the scatter of ``x - m`` with m = S / n
   rounded: products of centred whole numbers, added up exactly.  The driver gets ``d * (d + 1) / 2`` sums.
3. ``V = (n * scatter - B B') / n**2`` with ``B = S - n * m`` is worked out in whole numbers and rounded once an entry.
   Symmetric rotations zero all pairs of V in rounds of disjoint pairs, sweep after sweep, until no off-diagonal entry
   counts against its two diagonal ones.  That is a relative test, so small eigenvalues are as accurate as large ones.
4. Eigenvectors by falling eigenvalue, each divided by the root of its eigenvalue, go to all tasks (``d * k`` numbers).

Defined cases: rows whose vector is null or has null or non-finite entries are left out; so are, of vectors of different
lengths, all but those of the most frequent length (of the longest of these in a tie).  Entries that overflow a LONG are
taken as its 2**61.  Components of no variance have null whitened values and don't count in ``identity_error``; a trace
of 0 gives an explained share of 0.  A deviation beyond a LONG is null.  A null id stays, as do repeated ids; further
columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that one matrix product works on.
BLOCK = 4096
_MOST = 2**61


def whole_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, vector) of the rows whose vector has entries, none of them null or non-finite."""
    v = F.col(column).cast("array<double>")
    clean = vectors.select(F.col(key).cast("long").alias("key"), v.alias("vector")).where("size(vector) > 0 AND forall(vector, c -> c IS NOT NULL AND abs(c) < double('infinity') AND NOT isnan(c))")
    lengths = clean.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return clean.where(F.size("vector") == (lengths[0] if lengths else 0))


def _whole(column: pa.Array, scale: float, offset: int) -> np.ndarray:
    """The matrix of whole numbers of a list column with rows of equal length."""
    at = column.offsets.to_numpy()
    c = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(column), -1)
    return np.clip(np.floor(scale * c), -float(_MOST), float(_MOST)).astype(np.int64) + offset


def _centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - middle; Python's whole numbers where products of 64 bits could overflow."""
    if max(map(abs, middle), default=0) < 2**52 and (not x.size or np.abs(x).max() < 2**52):
        return x - np.array(middle, np.int64)
    return x.astype(object) - np.array(middle, object)


def _products(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * max(1, len(y)) < 2**53:  # doubles are exact up to here, and matrix products of doubles are fast
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def _sums(parts: DataFrame) -> dict[int, int]:
    """The whole sums by cell; sums travel in two halves, so none can overflow."""
    return {r[0]: (int(r[1]) << 62) + int(r[2]) for r in parts.groupBy("cell").agg(F.sum("high"), F.sum("low")).collect()}


def _cells(totals: np.ndarray) -> pa.RecordBatch:
    halves = [divmod(int(v), 1 << 62) for v in totals]
    kind = pa.decimal128(28, 0)
    return pa.RecordBatch.from_arrays([pa.array(range(len(halves)), pa.int32()), pa.array([Decimal(h) for h, _ in halves], kind), pa.array([Decimal(v) for _, v in halves], kind)], names=["cell", "high", "low"])


_CELLS = "cell int, high decimal(28,0), low decimal(28,0)"


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of a symmetric matrix, by falling eigenvalue.

    A sweep visits every pair of rows once, as a tournament does: rounds of disjoint pairs, which are rotated together.
    """
    a, n = np.array(v, np.float64), len(v)
    a = (a + a.T) / 2
    q = np.eye(n)
    seats = np.arange(n + n % 2)
    half = len(seats) // 2
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps if n > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            i, j = seats[:half], seats[half:][::-1]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
            real = (i < n) & (j < n)
            i, j = np.minimum(i, j)[real], np.maximum(i, j)[real]
            off, p, r = a[i, j], a[i, i], a[j, j]
            act = np.abs(off) > eps * np.sqrt(np.abs(p)) * np.sqrt(np.abs(r))
            act &= off != 0
            if not act.any():
                continue
            turned = True
            i, j, off, p, r = i[act], j[act], off[act], p[act], r[act]
            with np.errstate(over="ignore"):
                tau = (r - p) / (2 * off)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
            c = 1 / np.hypot(1, t)
            s = t * c
            for m in (a, q):  # columns
                x, y = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = c * x - s * y, s * x + c * y
            x, y = a[i].copy(), a[j].copy()
            a[i], a[j] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[i, i], a[j, j] = p - t * off, r + t * off  # as rounding must not feed on itself
            a[i, j] = a[j, i] = 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    q = q[:, order]
    q *= np.where(q[np.abs(q).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return np.diag(a)[order], q


class Whitening:
    """What the fit list gives: n, the sums, eigenvalues and unit eigenvectors in columns."""

    def __init__(self, n: int, sums: list[int], scatter: dict[int, int], middle: list[int], scale: float, offset: int):
        self.n, self.sums, self.scale, self.offset, d = n, sums, scale, offset, len(sums)
        rest = [s - n * m for s, m in zip(sums, middle)]
        upper = [(i, j) for i in range(d) for j in range(i, d)]
        v = np.zeros((d, d))
        whole = {}
        for cell, (i, j) in enumerate(upper):
            whole[i, j] = n * scatter.get(cell, 0) - rest[i] * rest[j]
            v[i, j] = v[j, i] = whole[i, j] / n**2  # one rounding: Python divides whole numbers exactly
        self.covariance, self.trace = v, float(Fraction(sum(whole[i, i] for i in range(d)), n**2))
        self.values, self.vectors = jacobi(v)
        floor = d * np.finfo(np.float64).eps * max(float(self.values[0]) if d else 0.0, 0.0)
        self.rank = int((self.values > floor).sum())

    def project(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(whitened values, exact deviations as whole numbers) of a matrix of whole numbers."""
        big = x.size and self.n * (int(np.abs(x).max()) + max(map(abs, self.sums), default=0) // max(1, self.n) + 1) >= 2**62
        far = (x.astype(object) if big else x) * self.n - np.array(self.sums, object if big else np.int64)
        most = int(np.abs(far).max()) if far.size else 0
        deviation = (far * far if most * most * x.shape[1] < 2**63 else far.astype(object) ** 2).sum(axis=1)
        k = min(k, self.rank)
        return (far.astype(np.float64) / self.n) @ (self.vectors[:, :k] / np.sqrt(self.values[:k])), deviation


def fit_list(space: Workspace, whole: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """The distinct vectors of whole numbers, as a table with the column ``x``."""
    x = F.transform("vector", lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-float(_MOST))), F.lit(float(_MOST)))).cast("long") + F.lit(offset).cast("long"))
    return space.write(whole.select(x.alias("x")).distinct(), "fit")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(batch.num_rows, -1)


def fit(listed: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x``; None if it is empty."""
    first = listed.first()
    if first is None:
        return None
    d = len(first[0])
    i, j = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, object)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                total[0] += batch.num_rows
                total[1:] += x.astype(object).sum(axis=0) if np.abs(x).max() >= 2**40 else x.sum(axis=0)
        if total[0]:
            yield _cells(total)

    sums = _sums(listed.mapInArrow(add, _CELLS))
    n, sums = sums[0], [sums[c + 1] for c in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in sums]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(len(i), object), False
        for batch in batches:
            x, some = _rows(batch) if batch.num_rows else np.zeros((0, d), np.int64), some or batch.num_rows > 0
            for at in range(0, len(x), BLOCK):
                total += _products(_centred(x[at : at + BLOCK], middle))[i, j]
        if some:
            yield _cells(total)

    return Whitening(n, sums, _sums(listed.mapInArrow(scatter, _CELLS)), middle, scale, offset)


def identity_error(listed: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the fit list's whitened covariance minus the identity, by one more pass over it."""
    k = min(components, model.rank)
    if not k:
        return 0.0
    sent = listed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = sent.value.project(_rows(batch), k)[0]
                total[:, :k] += w.T @ w
                total[:, k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["cell", "v"])

    got = np.zeros(k * (k + 1))
    for cell, v in listed.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v")).collect():
        got[cell] = v / model.n
    got = got.reshape(k, k + 1)
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


RESULT_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each usable vector and each of its first components."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, column)
    listed = fit_list(Workspace(spark, "whitening"), whole)
    model = fit(listed)
    if model is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    error, d = identity_error(listed, model, components), len(model.sums)
    k = min(components, d)
    share = np.clip(model.values[:k], 0, None) / model.trace if model.trace else np.zeros(k)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, BLOCK // 4) for at in range(0, batch.num_rows, BLOCK // 4)):
                known, m = sent.value, part.num_rows
                values, deviation = known.project(_whole(part.column(1), known.scale, known.offset), k)
                full = np.full((m, k), np.nan)
                full[:, : values.shape[1]] = values
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, known.n, np.int64)),
                    pa.array([v if v < 2**63 else None for v in map(int, deviation)], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(full.ravel(), pa.float64(), mask=np.isnan(full.ravel())),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    return whole.select(F.col("key"), F.col("vector")).mapInArrow(run, RESULT_SCHEMA)
