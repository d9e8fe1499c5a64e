"""Trend and seasonality per series: piecewise-linear trend plus Fourier terms.

Long tables: (keys..., variable, time, value). Rain is fitted on a log scale, which makes
its seasonality multiplicative.

The trend's slope may change at each knot, but changes are sparse: most are exactly none.
Bounds of a forecast hold the spread of the residuals and what further changes of the same
number and size would do, so they widen with the horizon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from chronopanel.forecast import ridge
from chronopanel.operators.quantiles import quantiles
from chronopanel.operators.windows import DAILY, Series, time_index

KEYS = ("City", "variable")
# Knots of the trend, their share of the history, order of the seasons.
KNOTS, KNOT_RANGE = 10, 0.8
#: Scale of a slope change against the series' deviation, normal quantile of the bounds.
CHANGE, BOUND = 0.05, 1.2815515655446004
DAILY_SEASONS = ((365.25, 10), (7.0, 3))
HOURLY_SEASONS = ((365.25 * 24, 6), (24 * 7.0, 3), (24.0, 4))
MIN_DAYS, MIN_HOURS = 90, 720


def _terms(seasons):
    n_season = 2 * sum(k for _, k in seasons)
    return [0.0, 1e-6] + [1e-3] * KNOTS + [1e-6] * n_season


def design(pos: Column, first: Column, span: Column, seasons) -> Column:
    """Intercept, slope, knots, and sine/cosine pairs at step `pos`."""
    u = (pos - first) / F.greatest(span, F.lit(1))
    cols = [F.lit(1.0), u.cast("double")]
    cols += [F.greatest(u - KNOT_RANGE * (i + 1) / (KNOTS + 1), F.lit(0.0)).cast("double") for i in range(KNOTS)]
    for period, order in seasons:
        for k in range(1, order + 1):
            angle = pos * (2 * math.pi * k / period)
            cols += [F.sin(angle), F.cos(angle)]
    return F.array(*cols)


def _log(variable: Column) -> Column:
    return variable.contains("Rain")


def _seasons(s: Series):
    return DAILY_SEASONS if s.step == "day" else HOURLY_SEASONS


def fit(df: DataFrame, s: Series = DAILY, keys=KEYS, value="value", min_rows=None) -> DataFrame:
    """Per series: coefficients, mean size of a slope change, first and last step, and residual
    quantiles on the fitted scale."""
    keys = list(keys)
    min_rows = min_rows or (MIN_DAYS if s.step == "day" else MIN_HOURS)
    known = df.filter(F.col(value).isNotNull()).withColumn("_i", time_index(s))
    info = known.groupBy(*keys).agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"), F.count(F.lit(1)).alias("_n"))
    info = info.filter(F.col("_n") >= min_rows).drop("_n")
    y = F.when(_log(F.col("variable")), F.log1p(F.greatest(F.col(value), F.lit(0.0)))).otherwise(F.col(value))
    span = (F.col("_last") - F.col("_first")).cast("double")
    rows = known.join(info, keys).select(
        *keys, y.alias("_y"), design(F.col("_i"), F.col("_first"), span, _seasons(s)).alias("_x")
    )
    beta = ridge.fit(rows, keys, "_x", "_y", _terms(_seasons(s)), ridge.solve_changes(2, KNOTS, CHANGE))
    # the mean size of a change stands behind the coefficients
    beta = beta.withColumns({"_size": F.element_at("beta", -1), "beta": F.slice("beta", 1, F.size("beta") - 1)})
    resid = rows.join(beta, keys).select(*keys, (F.col("_y") - ridge.dot(F.col("_x"), F.col("beta"))).alias("_r"))
    spread = quantiles(resid, keys, {"_lo": ("_r", 0.1), "_hi": ("_r", 0.9)})
    return beta.join(info, keys).join(spread, keys)


def _predict(rows: DataFrame, s: Series) -> DataFrame:
    """rows carry _i and the fitted columns; adds yhat, lower and upper."""
    span = (F.col("_last") - F.col("_first")).cast("double")
    x = design(F.col("_i"), F.col("_first"), span, _seasons(s))
    raw = rows.withColumn("_f", ridge.dot(x, F.col("beta")))
    back = lambda c: F.when(_log(F.col("variable")), F.greatest(F.expm1(c), F.lit(0.0))).otherwise(c)
    # changes come at the knots' rate, each with twice the squared mean size as variance, and
    # bend the trend from where they come to the step: the integral of squared distances
    ahead = F.greatest(F.col("_i") - F.col("_last"), F.lit(0)) / F.greatest(span, F.lit(1.0))
    bend = F.lit(KNOTS / KNOT_RANGE * 2 / 3) * F.col("_size") ** 2 * ahead**3 * BOUND**2
    down, up = F.least(F.col("_lo"), F.lit(0.0)), F.greatest(F.col("_hi"), F.lit(0.0))
    out = raw.withColumns(
        {"yhat": back(F.col("_f")), "lower": back(F.col("_f") - F.sqrt(down**2 + bend)), "upper": back(F.col("_f") + F.sqrt(up**2 + bend))}
    )
    return out.drop("_f", "_i", "_first", "_last", "_lo", "_hi", "_size", "beta")


def from_index(i: Column, step: str) -> Column:
    if step == "day":
        return F.date_add(F.lit("1970-01-01").cast("date"), i.cast("int"))
    base = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(i / 24).cast("int")).cast("timestamp_ntz")
    return base + F.make_dt_interval(hours=F.pmod(i, F.lit(24)).cast("int"))


def forecast(fitted: DataFrame, steps: int, s: Series = DAILY, keys=KEYS) -> DataFrame:
    """The `steps` steps after each series' last one."""
    ahead = fitted.withColumn("_i", F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + steps)))
    out = _predict(ahead.withColumn(s.time, from_index(F.col("_i"), s.step)), s)
    return out.select(*keys, s.time, "yhat", "lower", "upper")


def residuals(df: DataFrame, fitted: DataFrame, s: Series = DAILY, keys=KEYS, value="value") -> DataFrame:
    """In-sample fit and what it leaves, for every row of a fitted series."""
    rows = df.withColumn("_i", time_index(s)).join(fitted, list(keys))
    out = _predict(rows, s)
    return out.withColumn("resid", F.col(value) - F.col("yhat")).drop("lower", "upper")
