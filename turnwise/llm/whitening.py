"""Whitening of vectors along the principal components of all distinct ones.

The components come from spectral divide and conquer. For a shift ``s`` the polar factor ``U`` of
``V - s I`` has eigenvalue 1 on the components above the shift and -1 on those below, so that
``(U + I) / 2`` is the projector on the former. An orthonormal basis of its range and one of the rest split
the covariance ``V`` into two smaller problems, down to single components. The polar factor is
found by QDWH: iterates ``X (a I + b X'X)(I + c X'X)^-1`` with weights that follow the least singular value,
computed through a QR factorisation of ``[sqrt(c) X; I]`` without an inverse.

Vectors are rounded to whole numbers first (``floor(64 * c) + 1_000_000`` per entry), so sums are exact, and each
distinct rounded vector counts once. Covariances are sums of products of centred entries: each task adds up
its own, tasks' sums meet per row of the matrix, and only the matrix, which does not grow with the
rows, reaches the driver. The whitening matrix goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Components whose variance is at most this share of the whole are numerically nil: they are not whitened.
NIL = 1e-14
_EPS = np.finfo(float).eps


# --- QDWH and divide and conquer, on one small matrix -----------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH.

    Singular values below the rounding of ``a`` are left where the iteration takes them.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = _EPS  # of the singular values that rounding leaves any digits of
    for _ in range(60):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(n)]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(low * (alpha + beta * square) / (1 + gamma * square), 1 - 1e-16)
        if step < _EPS ** (1 / 3) and 1 - low < 10 * _EPS:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if ``a`` is a multiple of I."""
    n, norm = len(a), np.linalg.norm(a)
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * _EPS * norm:
        return None
    best, least = None, np.inf
    around = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    for shift in (float(np.median(np.diag(a))), mean, *(mean + f * around for f in (0.1, -0.1, 0.37, -0.37, 0.73, -0.73))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = np.random.default_rng(n).standard_normal((n, k))
        for _ in range(2):  # the second pass removes what rounding left of the other subspace
            basis, _ = np.linalg.qr(projector @ basis)
        rest = np.random.default_rng(n + 1).standard_normal((n, n - k))
        for _ in range(2):
            rest, _ = np.linalg.qr(rest - basis @ (basis.T @ rest))
        off = np.linalg.norm(rest.T @ a @ basis)
        if off < least:
            best, least = (basis, rest), off
        if off <= 20 * np.sqrt(n) * _EPS * norm:
            break
    return best


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns.

    Each vector's entry of the largest size (the first of equals) is positive, so the result is fixed.
    """

    def split(a: np.ndarray, basis: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        halves = _halves(a) if len(a) > 1 else None
        if halves is None:
            for i in range(len(a)):
                yield float(basis[:, i] @ v @ basis[:, i]), basis[:, i]
            return
        for half in halves:
            inner = half.T @ a @ half
            yield from split((inner + inner.T) / 2, basis @ half)

    found = sorted(split((v + v.T) / 2, np.eye(len(v))), key=lambda pair: -pair[0])
    vectors = np.stack([u / np.linalg.norm(u) for _, u in found], 1) if found else np.empty((0, 0))
    for c in range(vectors.shape[1]):
        vectors[:, c] *= np.sign(vectors[np.argmax(np.abs(vectors[:, c]).round(12)), c])
    return np.array([e for e, _ in found]), vectors


# --- sums over all rows --------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, dtype=np.int64).reshape(-1, d)


def _products(of: Callable[[np.ndarray], np.ndarray], d: int):
    """Per task one row per matrix row: the sums of products of what ``of`` makes of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = of(_matrix(batch.column(0).slice(at, 4096), d))
                part = y.T @ y
                if total is None:
                    total, rest = np.zeros_like(part), np.zeros_like(part)
                part = part - rest  # compensated, so the number of rows does not matter
                new = total + part
                rest, total = (new - total) - part, new
        if total is not None:
            k = len(total)
            cells = pa.array(total.ravel())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, k * k + 1, k), pa.int32()), cells)
            yield pa.record_batch([pa.array(np.arange(k), pa.int32()), rows], names=["i", "cells"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    cells = np.sort(np.stack(group["cells"].to_list()), axis=0).sum(0)  # the same in any order of arrival
    return pd.DataFrame({"i": [group["i"].iloc[0]], "cells": [cells]})


def covariance(vectors: DataFrame, n: int, of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The mean product matrix of ``of(vectors)`` over all rows of the column ``x``."""
    parts = vectors.select("x").mapInArrow(_products(of, d), "i int, cells array<double>")
    summed = parts.groupBy("i").applyInPandas(_added, "i int, cells array<double>")
    rows = sorted(summed.collect())  # as many rows as the matrix has
    return np.stack([np.asarray(r.cells) for r in rows]) / n


def rounded(vector: Column) -> Column:
    """floor(64 * c) + 1_000_000 of each entry, or null if the vector or an entry is null or not finite."""
    c = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(c, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    most = F.lit(float(1 << 62))  # entries beyond it count as it
    held = lambda v: F.least(F.greatest(v * F.lit(float(SCALE)), -most), most)
    whole = F.transform(c, lambda v: F.floor(held(v)).cast("long") + F.lit(OFFSET).cast("long"))
    return F.when(finite & (F.size(vector) > 0), whole)


def whiten(docs: DataFrame, id: str = "vec_id", vector: str = "embedding", top: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Rows whose vector is null, empty, or holds a null or an entry that is not finite are dropped, as are those whose
    length is not the most frequent one (of several, the largest). The fit takes each distinct rounded
    vector once: ``n`` of them. ``component`` counts from 1 to at most ``top``; there are no more than the
    vector has entries. ``whitened`` is null for components of no variance, which ``identity_error`` leaves out;
    ``explained`` is null if nothing varies. ``deviation`` is null if it exceeds a long. Repeated rows and
    identifiers each get their rows. No usable row: an empty table. Other columns are not looked at.
    """
    kind = docs.schema[id].dataType.simpleString()
    usable = docs.select(F.col(f"`{id}`").alias("id"), rounded(F.col(f"`{vector}`")).alias("x")).filter("x IS NOT NULL")
    sizes = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    widest = sizes.agg(F.max(F.struct("rows", "d")).alias("m")).first().m
    schema = (
        f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if widest is None:
        return usable.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    d = widest.d
    usable = usable.filter(F.size("x") == d)
    fit = stored(usable.select("x").distinct(), "fit")
    entries = [F.col("x")[i] for i in range(d)]
    wide = [F.sum(e.cast("decimal(38,0)")).alias(f"s{i}") for i, e in enumerate(entries)]
    ends = [F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")]
    row = fit.agg(F.count("*").alias("n"), *ends, *wide).first()
    n, exact = row.n, [int(row[f"s{i}"]) for i in range(d)]
    spread = max(abs(n * row.hi - min(exact)), abs(max(exact) - n * row.lo))
    fits = max(map(abs, (*exact, n * row.hi, n * row.lo))) < 1 << 62 and d * spread * spread < 1 << 62
    # sums beyond a long only centre: the whole part of the mean still is one
    whole, part = np.array([s // n for s in exact], np.int64), np.array([(s % n) / n for s in exact])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - part

    values, vectors = components(covariance(fit, n, centred, d))
    trace = float(values.sum())
    k = min(top, d)
    live = values[:k] > NIL * max(trace, 0.0)
    matrix = np.zeros((d, k))
    matrix[:, live] = vectors[:, :k][:, live] / np.sqrt(values[:k][live])

    def project(x: np.ndarray) -> np.ndarray:
        return centred(x) @ matrix

    error = covariance(fit, n, project, d) - np.diag(live.astype(float))
    identity_error = float(np.abs(error).max()) if live.any() else 0.0
    explained = [float(e / trace) if trace > 0 else None for e in values[:k]]
    sums = np.array(exact, np.int64) if fits else np.array(exact, object)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), d)
                m = len(x)
                gap = n * (x if fits else x.astype(object)) - sums
                deviation = (gap * gap).sum(1)
                if not fits:
                    deviation = [v if v < 1 << 63 else None for v in deviation.tolist()]
                deviation = pa.array(deviation, pa.int64())
                owner = pa.array(np.repeat(np.arange(m), k))
                white = pa.array(project(x).ravel(), pa.float64(), mask=np.tile(~live, m))
                yield pa.record_batch(
                    [
                        part.column(0).take(owner),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, n), pa.int64()),
                        deviation.take(owner),
                        white,
                        pa.array(explained * m, pa.float64()),
                        pa.array(np.full(m * k, identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return usable.mapInArrow(each, schema).withColumnRenamed("id", id)
