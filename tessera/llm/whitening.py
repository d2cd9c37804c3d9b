"""Whitening by spectral divide and conquer with polar decompositions.

The covariance of the distinct vectors is summed on the executors. A shifted
symmetric matrix ``A - s I = U H`` has the polar factor ``U``, whose projector
``(U + I) / 2`` spans the eigenvectors above ``s``. ``U`` comes from Halley
iterations with dynamic weights in QR form (QDWH). The projector splits the space in two, and each
part is split again until single components remain, the upper part first; parts
below the wanted components are never split. The few components are then
broadcast, and every row is projected where it lies.

Sums stay exact: entries are whole numbers, centred on the whole number next to
their mean before they are multiplied, and the remainder of the mean is taken
off the finished matrix. Only d x d values reach the driver.

Defined cases: vectors that are NULL or hold NULL or non-finite entries take no
part, nor do vectors of another length than the most common one (the shorter on
ties); a NULL id stays NULL; repeated rows give repeated results and one fit
vector; a component without variance has ``explained`` 0 (NULL where nothing
varies at all) and ``whitened`` NULL, and ``identity_error`` is over the others;
a deviation beyond 64 bits is NULL; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fields, list_array, slices, stage_derived

#: Components returned at most, and rows a task multiplies at a time.
COMPONENTS = 16
SLICE = 4096
EPS = float(np.finfo(float).eps)


def whole_entries(vector: Column) -> Column:
    """Entries as whole numbers: 64ths, moved by a million."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + F.lit(1_000_000))


def finite(vector: Column) -> Column:
    known = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(known, F.lit(False))


def usable_vectors(rows: DataFrame, vector: str = "embedding", name: str = "vec_id") -> tuple[DataFrame, int]:
    """``vec_id`` and whole entries ``x`` of usable rows, and their length (an eager job)."""
    held = rows.filter(finite(F.col(vector))).select(F.col(name).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    sizes = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    d = int(sizes["d"]) if sizes else 0
    return held.filter(F.size("v") == d).select("vec_id", whole_entries(F.col("v")).alias("x")), d


def _matrix(column, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def entry_sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of fit vectors and the exact sum of every entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, dtype=np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1:] += _matrix(batch.column(0), d).sum(axis=0)
        yield fields(["i", "s"], [pa.array(range(d + 1), pa.int32()), pa.array(total, pa.int64())])

    found = fit.select("x").mapInArrow(work, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r["i"]: int(r["s"]) for r in found.collect()}
    return sums.get(0, 0), np.array([sums.get(i, 0) for i in range(1, d + 1)], dtype=object)


def cross_products(fit: DataFrame, d: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``part(x)`` and of its products over all fit vectors, added up on the executors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in slices(batches, SLICE):
            y = part(_matrix(batch.column(0), d))
            total[0] += y.sum(axis=0)
            total[1:] += y.T @ y
        yield fields(["i", "s"], [pa.array(range(width + 1), pa.int32()), list_array(list(total), pa.float64())])

    partial = fit.select("x").mapInArrow(work, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s"))
    total = np.zeros((width + 1, width))
    for r in partial.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    return total[0], total[1:]


# spectral divide and conquer


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based weighted Halley steps."""
    k = len(a)
    eye = np.eye(k)
    x = a / np.linalg.norm(a)
    try:
        low = min(1.0, max(1 / np.linalg.norm(np.linalg.inv(x)), EPS))
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        moved = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:k] @ q[k:].T)
        moved = (moved + moved.T) / 2
        change = np.linalg.norm(moved - x)
        x, low = moved, min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if 1 - low < 10 * EPS and change < np.cbrt(10 * EPS):
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """Orthonormal basis whose first columns span the eigenvectors above ``shift``; None if the split fails."""
    k = len(a)
    projector = (polar_factor(a - shift * np.eye(k)) + np.eye(k)) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < k or np.linalg.norm(projector @ projector - projector) > 1e-8:
        return None
    start = np.random.default_rng(k * 1009 + rank).standard_normal((k, rank))
    for _ in range(2):
        basis, _ = np.linalg.qr(projector @ start, mode="complete")
        start = basis[:, :rank]
    return basis, rank


def leading_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix and their unit vectors, falling."""
    v = (v + v.T) / 2
    noise = EPS * np.linalg.norm(v) * len(v)
    found: list[np.ndarray] = []
    left = [np.eye(len(v))]
    while left and sum(b.shape[1] for b in found) < count:
        basis = left.pop()
        k = basis.shape[1]
        inner = basis.T @ v @ basis
        inner = (inner + inner.T) / 2
        middle = np.trace(inner) / k
        spread = np.linalg.norm(inner - middle * np.eye(k))
        cut = None
        if k > 1 and spread > noise:
            # the mean lies between the extremes; a shift that hits an eigenvalue moves a little
            for offset in (0.0, 0.11, -0.13, 0.29, -0.31):
                cut = _split(inner, middle + offset * spread / np.sqrt(k))
                if cut:
                    break
        if cut is None:  # one component, or several that rounding cannot tell apart
            found.append(basis)
            continue
        turned, rank = cut
        left += [basis @ turned[:, rank:], basis @ turned[:, :rank]]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    vectors, _ = np.linalg.qr(np.hstack(found))
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What the tasks need: whole centre, remainder of the mean, projection, shares."""

    n: int
    sums: np.ndarray
    centre: np.ndarray
    rest: np.ndarray
    projection: np.ndarray
    explained: list[float | None]
    usable: np.ndarray
    identity_error: float | None

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre - self.rest) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of ``n x - S``; None beyond 64 bits."""
        scaled = self.n * x.astype(object) - self.sums
        largest = max(map(abs, scaled.flat), default=0)
        if largest * largest * x.shape[1] < 1 << 63:
            exact = scaled.astype(np.int64)
            return (exact * exact).sum(axis=1).tolist()
        totals = [sum(e * e for e in row) for row in scaled]
        return [t if t < 1 << 63 else None for t in totals]


def fit_whitening(fit: DataFrame, d: int, count: int = COMPONENTS) -> Whitening | None:
    """Components of distinct vectors ``x``; None without rows (three jobs)."""
    n, sums = entry_sums(fit, d)
    if n == 0 or d == 0:
        return None
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(int(s) - n * int(c)) / n for s, c in zip(sums, centre)])
    _, products = cross_products(fit, d, d, lambda x: (x - centre).astype(float))
    covariance = products / n - np.outer(rest, rest)
    values, vectors = leading_components(covariance, min(count, d))
    trace = float(np.trace(covariance))
    usable = values > max(trace, 0.0) * d * EPS
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
    explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in values]
    found = Whitening(n, sums, centre, rest, vectors * scale, explained, usable, None)
    if usable.any():
        mean, spread = cross_products(fit, d, len(values), found.project)
        whitened = spread / n - np.outer(mean / n, mean / n)
        kept = np.flatnonzero(usable)
        found.identity_error = float(np.abs(whitened[np.ix_(kept, kept)] - np.eye(len(kept))).max())
    return found


def whitened_rows(rows: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling variance."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    held, d = usable_vectors(rows, vector)
    held = stage_derived(held)
    fit = stage_derived(held.select("x").distinct())
    found = fit_whitening(fit, d, count)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(found.explained)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in slices(batches, SLICE):
            x = _matrix(batch.column(1), d)
            whitened = found.project(x).ravel()
            hidden = np.tile(~found.usable, len(x))
            index = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            yield fields(names, [
                batch.column(0).take(index),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(size, found.n), pa.int64()),
                pa.array(found.deviations(x), pa.int64()).take(index),
                pa.array(whitened, pa.float64(), mask=hidden),
                pa.array(found.explained * len(x), pa.float64()),
                pa.array([found.identity_error] * size, pa.float64()),
            ])

    return held.mapInArrow(work, schema)
