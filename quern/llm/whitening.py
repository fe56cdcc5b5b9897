"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become vectors of whole numbers, and each distinct one is once in the fit list.
Let X be its centred rows. Two orthonormal families are built by turns: u from Xv less
its parts along the earlier u, and the next v from Xᵀu less its parts along the earlier
v (full reorthogonalisation of both). They turn X into a small upper bidiagonal matrix,
whose singular value decomposition gives the components and their deviations.

Each step is one Spark job over the fit list: every batch of rows makes its part of Xv
and at once of Xᵀ(Xv), and what is added up is as wide as a vector, however many rows
there are. The left vectors are as long as the table, so they are not stored: each is X
times a short vector of coefficients, and its inner products with Xv follow from them.
If these are not small enough a step is corrected and run again. Broadcast are a few
short vectors; the fit list is a table in the shared folder, so a lost executor costs
its tasks only.

Exact: the sums S, the fit list's size n and n·x - S are whole numbers, and centring is
(n·x - S) / n, so the size of the entries costs no digits.

Defined cases: rows whose vector is null or holds null or non-finite entries are left
out; vectors shorter than the longest are filled with zero entries; entries count within
±2**52 (after the factor); repeated rows have their own output rows and are once in the
fit list; a component whose deviation is below 1e-7 of the largest one is not given, as
nothing can be whitened along it, so an empty table, a single vector or empty vectors give
no rows; of equal eigenvalues any orthonormal components are taken; a deviation that no
long holds is null; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

COMPONENTS, FACTOR, OFFSET = 16, 64.0, 1_000_000
#: Rows of a batch that are worked on at once.
ROWS = 4096
#: The least deviation of a component, as a part of the largest.
LEAST = 1e-7


@dataclass(frozen=True)
class Whitening:
    """The fit list's size n, its sums, unit vectors and eigenvalues of the components, the trace of the
    covariance, and the largest absolute entry of the whitened fit list's covariance less the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    error: float


def whole_vectors(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep`` and x, the vector in whole numbers, of the rows that have only finite entries."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(1 << 52)
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c.cast("double") * FACTOR))) + OFFSET)
    return vectors.where(F.coalesce(finite, F.lit(False))).select(*keep, whole.cast("array<bigint>").alias("x"))


def widened(rows: DataFrame, size: int) -> DataFrame:
    """x of each row with zero entries up to ``size``."""
    short = F.size("x") < size
    return rows.withColumn("x", F.when(short, F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), size - F.size("x")))).otherwise(F.col("x")))


def _matrices(batches, d: int):
    """(the batch's slice, its x as a matrix) in pieces of bounded size."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n·x - S as whole numbers; of Python's where they may not fit."""
    exact = n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61
    return n * x - sums if exact else n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(float)


def _added(fit: DataFrame, d: int, made, width: int) -> np.ndarray:
    """The sum over all batches of ``made(x)``, an array of ``width`` doubles; only that is collected."""

    def run(batches):
        total = np.zeros(width)
        for _, x in _matrices(batches, d):
            total += made(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(width)
    for r in fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def column_sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """n and S, exact: upper and lower bits are added up apart."""

    def run(batches):
        n, total = 0, np.zeros((2, d), np.int64)
        for _, x in _matrices(batches, d):
            n += len(x)
            total += (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
        values = np.append(n, total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    values = [0] * (1 + 2 * d)
    for r in fit.mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect():
        values[r["i"]] = r["v"]
    sums = [(upper << 26) + lower for upper, lower in zip(values[1 : d + 1], values[d + 1 :], strict=True)]
    return values[0], np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)


def _against(v: np.ndarray, family: list[np.ndarray]) -> np.ndarray:
    """v less its parts along an orthonormal family, twice."""
    for _ in range(2 if family else 0):
        q = np.stack(family, axis=1)
        v = v - q @ (q.T @ v)
    return v


def bidiagonalise(product, d: int, steps: int, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """(B, V): X V = U B with the columns of U and V orthonormal and B upper bidiagonal.

    ``product(w)`` gives (Xᵀ(Xw), |Xw|²) of the distributed X. A left vector u = X w is
    known by w, and z = Xᵀu. Where Xv has no part outside the earlier u, no u is added;
    where Xᵀu has none outside the earlier v, a new direction is drawn, so all
    directions are found after d steps."""
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []
    images: list[np.ndarray] = []
    columns: list[np.ndarray] = []
    largest, v = 0.0, None
    for _ in range(min(steps, d)):
        if v is None:
            v = _against(rng.standard_normal(d), right)
            v /= np.linalg.norm(v)
        right.append(v)
        w, column = v, np.zeros(len(left))
        u, z = (np.stack(f, axis=1) if f else np.zeros((d, 0)) for f in (left, images))
        c = z.T @ v
        for _ in range(4):
            w, column = w - u @ c, column + c
            image, square = product(w)
            c = u.T @ image
            if np.linalg.norm(c) <= 1e-8 * np.sqrt(square):
                break
        w, image, column, square = w - u @ c, image - z @ c, column + c, square - c @ c
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha, float(np.linalg.norm(column)))
        if alpha <= 1e-10 * largest or alpha == 0:
            columns.append(column)
            v = None
            continue
        left.append(w / alpha)
        images.append(image / alpha)
        columns.append(np.append(column, alpha))
        v = _against(images[-1] - alpha * right[-1], right)
        beta = float(np.linalg.norm(v))
        v = None if beta <= 1e-10 * largest else v / beta
    small = np.zeros((len(left), len(right)))
    for k, column in enumerate(columns):
        small[: len(column), k] = column
    return small, np.stack(right, axis=1) if right else np.zeros((d, 0))


def fit(rows: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """The whitening learnt from the distinct x of ``rows``; None without rows.

    ``steps`` bounds the Lanczos steps; all dimensions unless given. With fewer, components that have not converged are less exact."""
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    distinct = written(widened(rows, d).select("x").distinct())
    n, sums = column_sums(distinct, d)

    def product(w):
        def made(x):
            centred = _centred(x, n, sums)
            part = centred @ w
            return np.append(centred.T @ part, part @ part)

        out = _added(distinct, d, made, d + 1)
        return out[:d], out[d]

    trace = float(_added(distinct, d, lambda x: np.array([np.square(_centred(x, n, sums)).sum()]), 1)[0]) / n
    if not trace:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    small, right = bidiagonalise(product, d, steps or d)
    _, deviations, turns = np.linalg.svd(small, full_matrices=False)
    found = np.flatnonzero(deviations > LEAST * deviations[0])[:components]
    vectors, values, k = right @ turns[found].T, np.square(deviations[found]) / n, len(found)

    def covariance(x):
        y = _centred(x, n, sums) @ (vectors / np.sqrt(values))
        return np.append(y.sum(axis=0), (y.T @ y).ravel())

    out = _added(distinct, d, covariance, k + k * k) / n
    left_over = out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k)
    return Whitening(n, sums, vectors, values, trace, float(np.abs(left_over).max()))


def apply(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """One row of ``key`` and component, with n, deviation, whitened, explained and identity_error."""
    d, k = model.components.shape
    turn = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace if k else np.zeros(0)
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])

    def run(batches):
        for part, x in _matrices(batches, d):
            scaled = _scaled(x, model.n, model.sums)
            most = int(np.abs(scaled).max(initial=0))
            if scaled.dtype == object or most * most * d >= 1 << 62:
                total = [sum(int(v) ** 2 for v in row) for row in scaled]
                deviation = pa.array([t if t < 1 << 63 else None for t in total], pa.int64())
            else:
                deviation = pa.array(np.square(scaled).sum(axis=1))
            whitened = (scaled / model.n).astype(float) @ turn
            for j in range(k):
                same = lambda value, kind: pa.array(np.full(len(x), value), kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), same(j + 1, pa.int32()), same(model.n, pa.int64()), deviation, pa.array(np.ascontiguousarray(whitened[:, j])), same(explained[j], pa.float64()), same(model.error, pa.float64())],
                    names=schema.names,
                )

    return widened(rows, d).select(key, "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row of
    ``vectors`` (vec_id, embedding), for up to ``components`` components by falling eigenvalue."""
    rows = whole_vectors(vectors)
    model = fit(rows, components, steps)
    if model is None or not len(model.eigenvalues):
        none = F.lit(None)
        return rows.where("false").select("vec_id", none.cast("int").alias("component"), *[none.cast(t).alias(c) for c, t in (("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    return apply(rows, model)
