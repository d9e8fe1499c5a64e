"""Embedding whitening on leading principal components.

Entries become whole numbers first, so equal vectors are equal exactly. The fit list holds
each distinct vector once. Its sums are exact; products are summed after the nearest whole
mean is taken off, so they are small whole numbers and doubles add them without rounding in
any order as long as a total stays under 2**53. What the whole mean leaves is taken off the
covariance at the end. Tasks reduce their vectors to one matrix of dimension by dimension;
Spark adds the matrices, and the driver gets one of them, whatever the number of rows.

The eigenvalues come from Householder tridiagonalisation and bisection on Sturm counts, the
eigenvectors from inverse iteration; vectors of close eigenvalues are orthogonalised again
after every step. All three run in extended precision. The projection is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronopanel.llm.common import columns, stage

#: Whole numbers per unit of an entry, and what is added to them.
UNIT, SHIFT = 64, 1_000_000
#: An entry of this size or more has no whole number in 64 bits.
LIMIT = float(1 << 55)
REAL = np.longdouble
#: Eigenvalues below this share of the largest one are rounding, not variance.
FLOOR = max(1e-13, 1e5 * float(np.finfo(REAL).eps))


# -- eigenvalues and eigenvectors of a symmetric matrix ------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and unit reflectors of Householder's reduction."""
    a = np.array(matrix, REAL)
    size, off, mirrors = len(a), np.zeros(max(0, len(a) - 1), REAL), []
    for k in range(size - 1):
        x = a[k + 1 :, k].copy()
        rest = np.sqrt((x[1:] * x[1:]).sum())
        off[k] = x[0]
        if rest == 0:
            mirrors.append(None)
            continue
        length = np.sqrt(x[0] * x[0] + rest * rest)
        off[k] = -length if x[0] >= 0 else length
        x[0] -= off[k]
        x /= np.sqrt((x * x).sum())
        part = a[k + 1 :, k + 1 :]
        p = (part * x[None, :]).sum(axis=1)
        w = p - (x * p).sum() * x
        part -= 2 * (x[:, None] * w[None, :] + w[:, None] * x[None, :])
        mirrors.append(x)
    return np.diagonal(a).copy(), off, mirrors


def sturm(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of `at`: negative pivots of the shifted matrix."""
    tiny = np.finfo(REAL).tiny * REAL(2) ** 64
    count, q = np.zeros(len(at), int), np.ones(len(at), REAL)
    for k, d in enumerate(diagonal):
        q = d - at - (off[k - 1] ** 2 / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The `k` largest eigenvalues, falling, by bisection until no number lies between the bounds."""
    around = np.zeros(len(diagonal), REAL)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    below = len(diagonal) - np.arange(k)  # a bound above the j-th largest has that many below it
    low, high = np.full(k, (diagonal - around).min(), REAL), np.full(k, (diagonal + around).max(), REAL)
    high = high + np.abs(high) * np.finfo(REAL).eps * 4 + np.finfo(REAL).tiny
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any() or (high - low).max() <= np.finfo(REAL).eps * np.abs(high).max() / 4:
            return middle
        above = sturm(diagonal, off, middle) >= below
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(T - at[j]) x[:, j] = right[:, j] for all j together, by elimination with row exchanges."""
    size, least = len(diagonal), np.finfo(REAL).eps * max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0)
    up = np.zeros((3, size, len(at)), REAL)  # pivot, first and second entry beside it
    b = right.copy()
    zero = np.zeros(len(at), REAL)
    pivot, beside = diagonal[0] - at, zero + (off[0] if size > 1 else 0)
    for i in range(size - 1):
        under, own, after = zero + off[i], diagonal[i + 1] - at, zero + (off[i + 1] if i + 2 < size else 0)
        swap = np.abs(under) > np.abs(pivot)
        up[0, i], up[1, i], up[2, i] = np.where(swap, under, pivot), np.where(swap, own, beside), np.where(swap, after, 0)
        up[0, i] = np.where(np.abs(up[0, i]) < least, least, up[0, i])
        factor = np.where(swap, pivot, under) / up[0, i]
        first, second = np.where(swap, b[i + 1], b[i]), np.where(swap, b[i], b[i + 1])
        b[i], b[i + 1] = first, second - factor * first
        pivot = np.where(swap, beside, own) - factor * up[1, i]
        beside = np.where(swap, 0, after) - factor * up[2, i]
    up[0, -1] = np.where(np.abs(pivot) < least, least, pivot)
    for i in range(size - 1, -1, -1):
        rest = b[i]
        if i + 1 < size:
            rest = rest - up[1, i] * b[i + 1]
        if i + 2 < size:
            rest = rest - up[2, i] * b[i + 2]
        b[i] = rest / up[0, i]
    return b


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 6, close: float = 1e-3) -> np.ndarray:
    """Unit eigenvectors, one column each, of falling eigenvalues of a tridiagonal matrix.

    Neighbours nearer than `close` of the matrix's size form a cluster, whose vectors are
    made orthogonal after every step. A vector that vanishes there starts anew.
    """
    rng = np.random.default_rng(11)
    size = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0, np.finfo(REAL).tiny)
    shifts = values.copy()
    for j in range(1, len(shifts)):
        # equal shifts would lead to equal vectors
        shifts[j] = min(shifts[j], shifts[j - 1] - 8 * np.finfo(REAL).eps * size)
    starts = [0, *(np.flatnonzero(-np.diff(values) > close * size) + 1), len(values)]
    x = rng.uniform(0.5, 1.0, (len(diagonal), len(values))).astype(REAL) * rng.choice([-1, 1], (len(diagonal), len(values)))
    for _ in range(steps):
        x = _solve(diagonal, off, shifts, x / np.sqrt((x * x).sum(axis=0)))
        x /= np.abs(x).max(axis=0)
        x /= np.sqrt((x * x).sum(axis=0))
        for lo, hi in zip(starts, starts[1:]):
            for j in range(lo, hi):
                for _again in range(2):
                    for i in range(lo, j):
                        x[:, j] -= (x[:, i] * x[:, j]).sum() * x[:, i]
                length = np.sqrt((x[:, j] * x[:, j]).sum())
                x[:, j] = x[:, j] / length if length > 1e-12 else rng.normal(size=len(diagonal))
    return x


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, at most `k` and only those above rounding, and unit eigenvectors.

    Vectors are columns; the entry of largest size of each is positive.
    """
    scale = np.abs(matrix).max() if matrix.size else 0
    if not scale > 0:
        return np.zeros(0, REAL), np.zeros((len(matrix), 0), REAL)
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading(diagonal, off, min(k, len(matrix)))
    values = values[values > FLOOR * values[0]]
    x = eigenvectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        if v is not None:
            x[at + 1 :] -= 2 * v[:, None] * (v[:, None] * x[at + 1 :]).sum(axis=0)[None, :]
    x *= np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values * scale, x


# -- the distributed parts ------------------------------------------------------------------


def points(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows whose vector can be used, of the table's commonest length."""
    rows = columns(vectors, vec_id=id, v=vector)
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    x = F.transform("v", lambda c: F.floor(c.cast("double") * UNIT) + SHIFT)
    rows = stage(rows.where(F.col("v").isNotNull() & usable).select("vec_id", x.alias("x")), "points")
    top = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("x") == (top["size"] if top else 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""

    def run(batches):
        n, total = 0, [0] * size
        for b in batches:
            x = _matrix(b.column(0), size)
            if not len(x):
                continue
            # 64 bits where they are sure to hold the sum of a batch
            safe = len(x) * max(int(x.max()), -int(x.min())) < 1 << 62
            part = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            n, total = n + len(x), [a + int(p) for a, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size + 1), pa.int32()), pa.array([Decimal(t) for t in [*total, n]], pa.decimal128(38, 0))], ["dim", "total"]
        )

    rows = fit.mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    of = {r["dim"]: int(r["total"]) for r in rows}
    return of.get(size, 0), [of.get(k, 0) for k in range(size)]


def products(fit: DataFrame, size: int, width: int, features) -> np.ndarray:
    """Sums of products of `width` features of every vector and a one beside them."""

    def run(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            f = features(_matrix(b.column(0), size))
            f = np.hstack([f, np.ones((len(f), 1))])
            total += f.T @ f
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"])

    lines = fit.mapInArrow(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "v"))
    out = np.zeros((width + 1, width + 1))
    for r in lines.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@dataclass
class Whitening:
    """What a fit leaves: whole means and rests, components, eigenvalues, the error of the identity."""

    n: int
    total: list[int]
    whole: list[int]
    rest: np.ndarray
    projection: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is taken off in whole numbers."""
        return (x - np.array(self.whole, np.int64)).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection

    def deviations(self, x: np.ndarray) -> list:
        """Sums of (n x - S) ** 2, exact; null where 64 bits do not hold one."""
        off = [s - self.n * w for s, w in zip(self.total, self.whole)]
        d = x - np.array(self.whole, np.int64)
        most = self.n * int(max(d.max(initial=0), -d.min(initial=0))) + max(map(abs, off), default=0)
        if x.shape[1] * most * most < 1 << 63:
            return list(((self.n * d - np.array(off, np.int64)) ** 2).sum(axis=1))
        exact = ((self.n * d.astype(object) - np.array(off, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of `points`; None where no vector is left."""
    # copies collapse before they move
    distinct = stage(rows.select("x").distinct(), "fit")
    first = distinct.select(F.size("x").alias("size")).first()
    if first is None or not first["size"]:
        return None
    size = first["size"]
    n, total = sums(distinct, size)
    whole = [(2 * s + n) // (2 * n) for s in total]
    shared = np.array(whole, np.int64)
    gram = products(distinct, size, size, lambda x: (x - shared).astype(np.float64)).astype(REAL)
    rest = np.array([REAL(s - n * w) / REAL(n) for s, w in zip(total, whole)], REAL)
    covariance = gram[:size, :size] / REAL(n) - rest[:, None] * rest[None, :]
    values, vectors = principal((covariance + covariance.T) / 2, components)
    projection = (vectors / np.sqrt(values)).astype(np.float64)
    out = Whitening(n, total, whole, rest.astype(np.float64), projection, values.astype(np.float64), float(np.trace(covariance)))
    if len(values):
        again = products(distinct, size, len(values), out.whitened) / n
        mean = again[-1, :-1]
        out.identity_error = float(np.abs(again[:-1, :-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    return out


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Each usable vector on up to `components` whitened principal components.

    A row is left out if its vector is null, holds null, NaN or infinite entries, or entries
    of 2**55 and more, whose whole number 64 bits do not hold. The dimension is the commonest
    length of the vectors left, of equally common ones the largest; rows of another length
    have no place in the space and are left out. Whole numbers are floor(64 * c) + 1000000;
    vectors equal in them count once in the fit, however many rows share them, and every row
    gets its result. Components without variance above rounding (1e-13 of the largest
    eigenvalue) have no whitened form: they are left out, so a table whose vectors are all
    equal, an empty one and vectors without entries give no rows. Null ids stay null,
    repeated rows are returned each, other columns play no part. A deviation too large for 64
    bits is null.

    Returns vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained, identity_error.
    """
    rows = points(vectors, id, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(rows, components)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(found)
    size = len(found.total)

    def run(batches):
        m = shared.value
        k = len(m.values)
        for b in batches:
            x = _matrix(b.column(1), size)
            each = np.repeat(np.arange(len(x)), k)
            cols = [
                b.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), m.n, np.int64)),
                pa.array(m.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(m.whitened(x).ravel()),
                pa.array(np.tile(m.values / m.trace, len(x))),
                pa.array(np.full(len(each), m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
