"""Blending two forecasts: weight search, leaderboard, publication."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chronopanel.functions.columns import clip_columns
from chronopanel.operators.aggregate import first_non_null
from chronopanel.operators.metrics import regression
from chronopanel.schema import FORECAST_BOUNDS

KEYS = ("City", "variable")
# Weight steps of the daily and the hourly search.
DAILY_GRID = tuple(float(x) for x in np.arange(0, 1.05, 0.05))
HOURLY_GRID = tuple(float(x) for x in np.arange(0, 1.05, 0.1))


def weights(pairs: DataFrame, keys=KEYS, grid=DAILY_GRID, min_rows=5) -> DataFrame:
    """Weight of forecast `a` with the least mean absolute error per series.

    pairs: keys, y, a, b. All grid points are aggregates of one pass over the rows, so the
    rows are not multiplied by the grid. The lowest weight wins a tie.
    """
    keys = list(keys)
    err = lambda g: F.avg(F.abs(F.col("y") - (F.col("a") * g + F.col("b") * (1 - g))))
    wide = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[err(g).alias(f"_m{i}") for i, g in enumerate(grid)])
    tried = F.array(*[F.struct(F.round(f"_m{i}", 12).alias("r"), F.lit(g).alias("weight"), F.col(f"_m{i}").alias("mae")) for i, g in enumerate(grid)])
    best = F.array_min(tried)
    return wide.filter(F.col("_n") >= min_rows).select(*keys, best["weight"].alias("weight"), best["mae"].alias("mae_blend"))


def leaderboard(pairs: DataFrame, chosen: DataFrame, granularity: str, keys=KEYS) -> DataFrame:
    """Errors of both forecasts and of the blend per series."""
    keys = list(keys)
    joined = pairs.join(chosen, keys)
    blend = F.col("a") * F.col("weight") + F.col("b") * (1 - F.col("weight"))
    rows = joined.withColumn("yhat", blend)
    both = rows.groupBy(*keys, "weight").agg(
        F.avg(F.abs(F.col("y") - F.col("a"))).alias("mae_a"), F.avg(F.abs(F.col("y") - F.col("b"))).alias("mae_b")
    )
    fit = regression(rows, by=keys).select(*keys, F.col("mae").alias("mae_blend"), F.col("rmse").alias("rmse_blend"))
    return both.join(fit, keys).withColumn("granularity", F.lit(granularity))


def blended(a: DataFrame, b: DataFrame, chosen: DataFrame, time="Date", keys=KEYS, default=0.0) -> DataFrame:
    """Weighted forecast per series; series without a weight take the default."""
    left = a.select(*keys, time, F.col("yhat").alias("_a"))
    right = b.select(*keys, time, F.col("yhat").alias("_b"))
    joined = left.join(right, [*keys, time]).join(chosen.select(*keys, "weight"), list(keys), "left")
    g = F.coalesce("weight", F.lit(default))
    return joined.select(*keys, time, (F.col("_a") * g + F.col("_b") * (1 - g)).alias("value"))


def publish(forecast: DataFrame, actual: DataFrame, variables, time="Date", entity="City", bounds=None) -> DataFrame:
    """Steps after the last actual one, wide by variable, inside physical bounds."""
    last = actual.agg(F.max(time).alias("_last"))
    future = forecast.crossJoin(F.broadcast(last)).filter(F.col(time) > F.col("_last")).drop("_last")
    return clip_columns(first_non_null(future, variables, [entity, time]), bounds or FORECAST_BOUNDS)
