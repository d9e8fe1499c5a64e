"""Linear autoregression per series, rolled forward step by step.

Lags and strict rolling statistics come from the panel windows; the fit is the grouped
ridge; the recursion needs only the last few rows of a series and runs over arrays of
many series at once. The second forecaster is one boosted ensemble for all series, fitted on
values in units of each series' own mean and deviation; its node table walks inside the same
recursion.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from chronopanel.forecast import ridge
from chronopanel.forecast.seasonal import from_index
from chronopanel.models.nodes import Nodes, export
from chronopanel.operators import windows as w
from chronopanel.operators.windows import DAILY, Series, time_index
from chronopanel.schema import SEED
from chronopanel.session import stage

KEYS = ("City", "variable")
# Lags and windows of the forecaster, rows a series needs.
AR_DAILY = ((1, 2, 3, 5, 7, 14, 30), (7, 14, 30))
AR_HOURLY = ((1, 3, 6, 12, 24, 48, 168), (24, 168))
MIN_DAYS, MIN_HOURS = 100, 720


def shape(s: Series):
    return AR_DAILY if s.step == "day" else AR_HOURLY


def ar_features(df: DataFrame, s: Series = DAILY, keys=KEYS, value="value") -> DataFrame:
    """Lags, full-window mean and deviation, and calendar parts per series."""
    lags, windows = shape(s)
    series = s.with_(entity=tuple(keys))

    def build(o):
        return {**w.lag_columns(o, [value], lags), **w.strict_columns(o, [value], windows)}

    out = w.bounded(df, series, build, max(*lags, *windows))
    t = F.col(s.time)
    parts = {"dayofyear": F.dayofyear(t), "month": F.month(t)}
    if s.step == "hour":
        parts = {"hour": F.hour(t), "dayofweek": F.weekday(t), "month": F.month(t)}
    return out.withColumns(parts)


def feature_names(s: Series = DAILY, value="value") -> list[str]:
    lags, windows = shape(s)
    names = [f"{value}_lag{k}" for k in lags]
    names += [f"{value}_full{n}_{m}" for n in windows for m in ("mean", "std")]
    return names + (["dayofyear", "month"] if s.step == "day" else ["hour", "dayofweek", "month"])


def _periods(s: Series):
    return (366.0, 12.0) if s.step == "day" else (24.0, 7.0, 12.0)


def design(s: Series, value="value"):
    """Intercept, autoregressive terms, and a sine/cosine pair per calendar part."""
    names = feature_names(s, value)
    periods = _periods(s)
    ar, parts = names[: -len(periods)], names[-len(periods) :]
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in ar]
    for c, p in zip(parts, periods):
        cols += [F.sin(F.col(c) * (2 * np.pi / p)), F.cos(F.col(c) * (2 * np.pi / p))]
    return F.array(*cols), [0.0] + [1e-4] * len(ar) + [1e-6] * (2 * len(parts))


def tails(known: DataFrame, s: Series, keys, value="value", min_rows=None) -> DataFrame:
    """Per series with enough rows: the last step and the last rows' values in order.

    The tail is bounded by the reach of the features.
    """
    keys = list(keys)
    lags, windows = shape(s)
    reach = max(*lags, *windows)
    min_rows = min_rows or (MIN_DAYS if s.step == "day" else MIN_HOURS)
    numbered = w.indexed(known, s.with_(entity=tuple(keys)))
    last = numbered.groupBy(*keys).agg(F.max("_pos").alias("_end"), F.max(time_index(s)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    last = last.filter(F.col("_n") >= max(min_rows, reach)).drop("_n")
    tail = numbered.join(last, keys).filter(F.col("_pos") > F.col("_end") - reach)
    values = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(value).cast("double").alias("v")))), lambda c: c["v"])
    return tail.groupBy(*keys, "_last").agg(values.alias("_tail"))


def fit(df: DataFrame, s: Series = DAILY, keys=KEYS, value="value", min_rows=None) -> DataFrame:
    """Per series: coefficients, last step, and the last rows' values in order."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    rows = ar_features(known, s, keys, value)
    x, penalties = design(s, value)
    beta = ridge.fit(rows.select(*keys, x.alias("_x"), F.col(value).alias("_y")), keys, "_x", "_y", penalties)
    return tails(known, s, keys, value, min_rows).join(beta, keys)


def _calendar(step: str):
    epoch = dt.datetime(1970, 1, 1)

    def of(i):
        if step == "day":
            d = epoch + dt.timedelta(days=int(i))
            return d.timetuple().tm_yday, d.month
        d = epoch + dt.timedelta(hours=int(i))
        return d.hour, d.weekday(), d.month

    return of


def _roller(steps: int, lags, windows, step: str, periods):
    calendar = _calendar(step)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roll(tail: pd.Series, beta: pd.Series, last: pd.Series) -> pd.Series:
        if len(tail) == 0:
            return pd.Series([], dtype=object)
        y, b = np.stack(tail.to_numpy()), np.stack(beta.to_numpy())
        known = {i: calendar(i) for i in {int(v) + k for v in last.unique() for k in range(1, steps + 1)}}
        for k in range(1, steps + 1):
            parts = np.array([known[int(v) + k] for v in last], dtype=float)
            cols = [np.ones(len(y))] + [y[:, -lag] for lag in lags]
            for n in windows:
                cols += [y[:, -n:].mean(axis=1), y[:, -n:].std(axis=1, ddof=1)]
            for j, p in enumerate(periods):
                angle = parts[:, j] * (2 * np.pi / p)
                cols += [np.sin(angle), np.cos(angle)]
            nxt = np.einsum("np,np->n", np.column_stack(cols), b)[:, None]
            y = np.hstack([y, nxt])
        return pd.Series(list(y[:, -steps:]))

    return roll


def forecast(fitted: DataFrame, steps: int, s: Series = DAILY, keys=KEYS) -> DataFrame:
    """Predictions fed back for `steps` steps after each series' last one."""
    lags, windows = shape(s)
    roll = _roller(steps, lags, windows, s.step, _periods(s))
    out = fitted.select(*keys, "_last", F.posexplode(roll("_tail", "beta", "_last")).alias("_k", "yhat"))
    return out.select(*keys, from_index(F.col("_last") + F.col("_k") + 1, s.step).alias(s.time), "yhat")


@dataclass(frozen=True)
class Pooled:
    """One ensemble for all series, their scales and tails (in units of the scale)."""

    nodes: Nodes
    series: DataFrame
    model: object


def fit_pooled(df: DataFrame, s: Series = DAILY, keys=KEYS, value="value", min_rows=None, **settings) -> Pooled:
    """A boosted ensemble on the lags, rolling statistics and calendar parts of all series.

    `settings` go to Spark's GBTRegressor. Series with fewer rows than `min_rows` (100 days
    or 720 hours) take no part.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    keys, names = list(keys), feature_names(s)
    known = df.filter(F.col(value).isNotNull())
    scale = known.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"), F.count(F.lit(1)).alias("_n"))
    scale = scale.filter(F.col("_n") >= (min_rows or (MIN_DAYS if s.step == "day" else MIN_HOURS))).drop("_n")
    scale = scale.withColumn("_std", F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0))
    rows = stage(known.join(scale, keys).select(*keys, s.time, ((F.col(value) - F.col("_mean")) / F.col("_std")).alias("value")), "scaled")
    ready = ar_features(rows, s, keys).dropna(subset=names)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(ready).select("features", "value")
    given = {"labelCol": "value", "maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": SEED, **settings}
    model = GBTRegressor(**given).fit(ready)
    return Pooled(export(model, df.sparkSession), tails(rows, s, keys, min_rows=min_rows).join(scale, keys), model)


def forecast_pooled(fitted: Pooled, steps: int, s: Series = DAILY, keys=KEYS) -> DataFrame:
    """Predictions of the ensemble fed back for `steps` steps after each series' last one."""
    lags, windows = shape(s)
    calendar = _calendar(s.step)
    shared = fitted.series.sparkSession.sparkContext.broadcast(fitted.nodes)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roll(tail: pd.Series, last: pd.Series) -> pd.Series:
        if len(tail) == 0:
            return pd.Series([], dtype=object)
        y = np.stack(tail.to_numpy())
        known = {i: calendar(i) for i in {int(v) + k for v in last.unique() for k in range(1, steps + 1)}}
        for k in range(1, steps + 1):
            cols = [y[:, -lag] for lag in lags]
            for n in windows:
                cols += [y[:, -n:].mean(axis=1), y[:, -n:].std(axis=1, ddof=1)]
            parts = np.array([known[int(v) + k] for v in last], dtype=float)
            y = np.hstack([y, shared.value.scores(np.column_stack([*cols, parts]))[:, None]])
        return pd.Series(list(y[:, -steps:]))

    out = fitted.series.select(*keys, "_last", "_mean", "_std", F.posexplode(roll("_tail", "_last")).alias("_k", "_z"))
    return out.select(*keys, from_index(F.col("_last") + F.col("_k") + 1, s.step).alias(s.time), (F.col("_z") * F.col("_std") + F.col("_mean")).alias("yhat"))
