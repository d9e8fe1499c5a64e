"""Ridge regression per series from mergeable sums.

The cross products of a series are sums over its rows, so they are built where the rows
are (numpy, one small matrix per series and task), added up by Spark, and solved from
one row per series. A series of any length, or one holding a third of all rows, never
gathers in a single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

FLUSH = 2_000


def cross_products(df: DataFrame, keys, features: str, y: str) -> DataFrame:
    """Upper triangle of the cross products of [features, y] per series, as an array."""
    keys = list(keys)
    rows = df.select(*keys, F.col(features).alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.filter(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        held: dict = {}

        def drain():
            out = pd.DataFrame(list(held), columns=keys)
            out["_g"] = [g[np.triu_indices(len(g))] for g in held.values()]
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            m = np.column_stack([np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy()])
            for k, idx in pdf.groupby(keys, sort=False).indices.items():
                part = m[idx]
                key = k if isinstance(k, tuple) else (k,)
                g = part.T @ part
                held[key] = held[key] + g if key in held else g
            if len(held) >= FLUSH:
                yield drain()
        if held:
            yield drain()

    parts = rows.mapInPandas(partial, schema)
    cells = parts.select(*keys, F.posexplode("_g").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"])
    return cells.groupBy(*keys).agg(ordered.alias("_g"))


def _unpacked(g: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross products of the features, with y, and of y with itself, of all series of a batch."""
    flat = np.stack(g.to_numpy())
    q = int((np.sqrt(8 * flat.shape[1] + 1) - 1) / 2)
    full = np.zeros((len(flat), q, q))
    a, b = np.triu_indices(q)
    full[:, a, b] = flat
    full[:, b, a] = flat
    return full[:, :-1, :-1], full[:, :-1, -1], full[:, -1, -1]


def _penalised(xx: np.ndarray, penalty: pd.Series) -> np.ndarray:
    """The normal equations' matrix with each feature's penalty, relative to its sum of squares."""
    diag = np.einsum("nii->ni", xx)
    pen = np.stack(penalty.to_numpy()) * np.maximum(diag, 1e-12) + 1e-9
    return xx + pen[:, :, None] * np.eye(xx.shape[1])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve(g: pd.Series, penalty: pd.Series) -> pd.Series:
    """Coefficients from the packed cross products, all series of a batch at once."""
    if len(g) == 0:
        return pd.Series([], dtype=object)
    xx, xy, _ = _unpacked(g)
    beta = np.linalg.solve(_penalised(xx, penalty), xy[:, :, None])[:, :, 0]
    return pd.Series(list(beta))


def sparse_changes(xx: np.ndarray, xy: np.ndarray, limit: np.ndarray, start: np.ndarray, sweeps: int = 400) -> np.ndarray:
    """Least squares with a penalty `limit` on the sum of sizes, by coordinate descent.

    One row a series; a coefficient whose pull stays under the limit is exactly 0.
    """
    beta, diag = start.copy(), np.maximum(np.einsum("nii->ni", xx), 1e-12)
    for _ in range(sweeps):
        before = beta.copy()
        for j in range(beta.shape[1]):
            pull = xy[:, j] - np.einsum("nk,nk->n", xx[:, j], beta) + diag[:, j] * beta[:, j]
            beta[:, j] = np.sign(pull) * np.maximum(np.abs(pull) - limit, 0) / diag[:, j]
        if np.abs(beta - before).max() <= 1e-10 * max(np.abs(beta).max(), 1e-12):
            break
    return beta


def solve_changes(first: int, count: int, prior: float):
    """A solver whose features `first` to `first + count` are slope changes, most of them none.

    Changes have a double-exponential prior of scale `prior` times the series' deviation, so
    their penalty is the noise variance over that scale; the noise comes from the solution
    before, twice. Other features are eliminated exactly, hence solve their normal equations.
    The first feature is a constant one. Returns the coefficients and the mean size of a change.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve_(g: pd.Series, penalty: pd.Series) -> pd.Series:
        if len(g) == 0:
            return pd.Series([], dtype=object)
        xx, xy, yy = _unpacked(g)
        full = _penalised(xx, penalty)
        n = np.maximum(xx[:, 0, 0], 1)
        scale = prior * np.sqrt(np.maximum(yy / n - (xy[:, 0] / n) ** 2, 1e-12))
        at = np.arange(xx.shape[1])
        own, rest = (at >= first) & (at < first + count), (at < first) | (at >= first + count)
        inverse = np.linalg.inv(full[:, rest][:, :, rest])
        cross = full[:, own][:, :, rest]
        reduced = xx[:, own][:, :, own] - cross @ inverse @ cross.transpose(0, 2, 1)
        pull = xy[:, own] - (cross @ inverse @ xy[:, rest, None])[:, :, 0]
        beta = np.linalg.solve(full, xy[:, :, None])[:, :, 0]
        for _ in range(2):
            left = yy - 2 * np.einsum("nk,nk->n", beta, xy) + np.einsum("nj,njk,nk->n", beta, xx, beta)
            noise = np.maximum(left / n, 1e-12)
            changes = sparse_changes(reduced, pull, noise / scale, beta[:, own])
            beta[:, own] = changes
            beta[:, rest] = (inverse @ (xy[:, rest] - (cross.transpose(0, 2, 1) @ changes[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
        size = np.abs(beta[:, own]).mean(axis=1)
        return pd.Series(list(np.column_stack([beta, size])))

    return solve_


def fit(df: DataFrame, keys, features: str, y: str, penalties, solver=solve) -> DataFrame:
    """Keys and beta. `penalties` are per feature, relative to its sum of squares."""
    g = cross_products(df, keys, features, y)
    pen = F.array(*[F.lit(float(p)) for p in penalties])
    return g.select(*keys, solver("_g", pen).alias("beta"))


def dot(features: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(features, beta, lambda x, b: x * b), F.lit(0.0), lambda acc, v: acc + v)
