"""Correlation, tests and column pruning from mergeable sums.

Each task turns its rows into a few small matrices (numpy), Spark adds them up, and
the final arithmetic is on one row per pair of columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from chronopanel.operators.aggregate import melt

_PAIR = "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double"


def pair_sums(df: DataFrame, names) -> DataFrame:
    """Sums over rows where both columns of a pair are known, one row per ordered pair.

    Columns are shifted by their mean first, so large offsets do not eat the digits.
    """
    names = list(names)
    centre = df.agg(*[F.avg(c).alias(c) for c in names])
    shifted = df.select(*[F.col(c).cast("double").alias(c) for c in names]).crossJoin(
        F.broadcast(centre.select(*[F.coalesce(c, F.lit(0.0)).alias(f"_{c}") for c in names]))
    )
    shifted = shifted.select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in names])
    p = len(names)

    def partial(batches):
        total = np.zeros((6, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            known = ~np.isnan(x)
            m = known.astype(float)
            x = np.where(known, x, 0.0)
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        a, b = np.indices((p, p)).reshape(2, -1)
        flat = total.reshape(6, -1)
        keep = flat[0] > 0
        cols = ["n", "sx", "sy", "sxx", "syy", "sxy"]
        out = pd.DataFrame({"a": a[keep], "b": b[keep], **{c: flat[i][keep] for i, c in enumerate(cols)}})
        yield out

    parts = shifted.mapInPandas(partial, _PAIR)
    summed = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    labels = F.array(*[F.lit(c) for c in names])
    return summed.withColumns({"i": F.col("a"), "j": F.col("b"), "a": labels[F.col("a")], "b": labels[F.col("b")]})


def correlation(df: DataFrame, names) -> DataFrame:
    """Pearson r for every ordered pair of columns over pairwise complete rows."""
    s = pair_sums(df, names)
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    va = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vb = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    return s.select("a", "b", "i", "j", r.alias("r"))


def correlated_pairs(df: DataFrame, names, limit=0.9) -> DataFrame:
    return correlation(df, names).filter((F.col("i") < F.col("j")) & (F.abs("r") > limit)).select("a", "b", "r")


def label_correlation(df: DataFrame, names, label: str, top: int | None = None) -> DataFrame:
    """Correlation of each column with the label, greatest absolute value first."""
    row = df.agg(*[F.corr(c, label).alias(c) for c in names])
    out = row.unpivot([], list(names), "variable", "r").orderBy(F.desc_nulls_last(F.abs("r")), "variable")
    return out.limit(top) if top else out


def _beta_tail(x, a, b):
    """Regularised incomplete beta I_x(a, b), vectorised continued fraction (modified Lentz)."""
    from math import lgamma

    ln = np.vectorize(lgamma, otypes=[float])
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    xx, aa, bb = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(ln(aa + bb) - ln(aa) - ln(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        tiny = 1e-300
        c = np.ones_like(xx)
        d = 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (
                m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = front * h
    out = np.where(xx <= 0, 0.0, out)
    return np.where(flip, 1 - out, out)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    x = df / (df + t * t)
    return pd.Series(_beta_tail(x.to_numpy(), df.to_numpy() / 2, np.full(len(df), 0.5))).where(t.notna() & df.notna())


def welch(df: DataFrame, names, label: str, by=(), alpha=0.05, min_events=5, min_side=3) -> DataFrame:
    """Unequal-variance t test of each column between event and other rows, per group."""
    by = list(by)
    long = melt(df, [*by, label], names)
    v, ev = F.col("value"), F.col(label) == 1
    side = lambda f, cond: f(F.when(cond, v))
    s = long.groupBy(*by, "variable").agg(
        F.count_if(ev).alias("_events"),
        side(F.count, ev).alias("_n1"),
        side(F.count, ~ev).alias("_n0"),
        side(F.avg, ev).alias("event_mean"),
        side(F.avg, ~ev).alias("other_mean"),
        side(F.var_samp, ev).alias("_v1"),
        side(F.var_samp, ~ev).alias("_v0"),
    )
    s = s.filter((F.col("_events") >= min_events) & (F.least("_n1", "_n0") >= min_side))
    e1, e0 = F.col("_v1") / F.col("_n1"), F.col("_v0") / F.col("_n0")
    diff = F.col("event_mean") - F.col("other_mean")
    out = s.select(
        *by,
        "variable",
        "event_mean",
        "other_mean",
        diff.alias("diff"),
        F.try_divide(diff, F.sqrt(e1 + e0)).alias("t"),
        F.try_divide((e1 + e0) * (e1 + e0), e1 * e1 / (F.col("_n1") - 1) + e0 * e0 / (F.col("_n0") - 1)).alias("df"),
    )
    out = out.withColumn("p_value", student_p("t", "df"))
    return out.withColumn("significant", (F.col("p_value") < alpha).cast("int"))


def significance_rate(tests: DataFrame) -> DataFrame:
    return tests.groupBy("variable").agg(F.avg("significant").alias("rate"), F.count(F.lit(1)).alias("n"))


def low_variance(df: DataFrame, names, limit=0.001) -> DataFrame:
    """Deviation per column and whether it falls under the limit."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in names])
    return row.unpivot([], list(names), "variable", "std").withColumn("dropped", F.coalesce((F.col("std") < limit).cast("int"), F.lit(0)))


def prune_correlated(df: DataFrame, names, label: str, limit=0.95) -> list[str]:
    """Names to drop: of each pair beyond the limit, the one less correlated with the label.

    Pairs are taken in column order and a dropped column takes no further part. The
    matrix is as large as the column list squared, whatever the rows.
    """
    pairs = correlated_pairs(df, names, limit).collect()
    strength = {r["variable"]: abs(r["r"]) if r["r"] is not None else 0.0 for r in label_correlation(df, names, label).collect()}
    place = {c: i for i, c in enumerate(names)}
    gone: list[str] = []
    for r in sorted(pairs, key=lambda r: (place[r["a"]], place[r["b"]])):
        if r["a"] in gone or r["b"] in gone:
            continue
        gone.append(r["b"] if strength[r["a"]] >= strength[r["b"]] else r["a"])
    return gone
