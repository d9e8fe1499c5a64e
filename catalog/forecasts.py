from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog.base import DAILY, LONG, WX, cols, finish, hourly, long_panel, measurements, query
from chronopanel.forecast import blend, compare, recursive, seasonal
from chronopanel.operators import windows as w
from chronopanel.operators.aggregate import melt
from chronopanel.operators.repair import holdout_split

T, R = "Temperature_C_mean", "Rain_mm_sum"
HOUR = w.HOURLY


def series(spark, sf):
    """Two variables of the long panel in long form."""
    return melt(long_panel(spark, sf), ["City", "Date"], [T, R])


def hourly_series(spark, sf):
    s = HOUR.with_(regular=True)
    df = w.fill(w.spine(hourly(spark, sf).select("City", "Timestamp", "Temperature_C"), s), ["Temperature_C"], s)
    return melt(df, ["City", "Timestamp"], ["Temperature_C"])


def train_test(df, time="Date", back="30 day"):
    cut = holdout_split(df, time, back)
    return cut.filter("holdout = 0").drop("holdout"), cut.filter("holdout = 1").drop("holdout")


@query("t1_seasonal_forecast")
def t1_seasonal_forecast(spark, sf):
    train, _ = train_test(series(spark, sf))
    return finish(seasonal.forecast(seasonal.fit(train), 60))


@query(
    "t1_intervals",
    f"""WITH {LONG}, u AS (SELECT City, '{T}' AS variable, Date FROM longp UNION ALL SELECT City, '{R}', Date FROM longp),
    k AS (SELECT City, variable, max(Date) AS last, count(*) AS n FROM u WHERE Date <= (SELECT max(Date) - 30 FROM longp) GROUP BY 1, 2)
    SELECT City, variable, strftime(CAST(last AS DATE) + 1, '%Y-%m-%d') AS first, strftime(CAST(last AS DATE) + 60, '%Y-%m-%d') AS last, 60::BIGINT AS steps, 1::BIGINT AS ordered, 1::BIGINT AS widens FROM k WHERE n >= 90""",
)
def t1_intervals(spark, sf):
    """Of each series' forecast: its steps, whether its bounds hold it, whether they widen at every step.

    Rain is compared on its log scale, up to where the lower bound meets zero.
    """
    train, _ = train_test(series(spark, sf))
    out = seasonal.forecast(seasonal.fit(train), 60)
    up = F.when(F.col("variable") == R, F.log1p("upper") - F.log1p("yhat")).otherwise(F.col("upper") - F.col("yhat"))
    step = F.datediff("Date", F.min("Date").over(Window.partitionBy("City", "variable")))
    told = out.withColumns({"up": F.round(up, 9), "step": step}).withColumn("wide", F.max(F.when((F.col("yhat") > 0) | (F.col("variable") == T), F.struct("step", "up"))).over(Window.partitionBy("City", "variable")))
    flags = F.min((F.col("lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("upper"))).cast("int"), F.min((F.col("up") <= F.col("wide.up")) | (F.col("yhat") <= 0)).cast("int")
    return finish(told.groupBy("City", "variable").agg(F.min("Date").alias("first"), F.max("Date").alias("last"), F.count(F.lit(1)).alias("steps"), flags[0].alias("ordered"), flags[1].alias("widens")))


@query("t1_seasonal_hourly")
def t1_seasonal_hourly(spark, sf):
    train, _ = train_test(hourly_series(spark, sf), "Timestamp", "168 hour")
    fitted = seasonal.fit(train, HOUR, min_rows=400)
    return finish(seasonal.forecast(fitted, 336, HOUR))


@query("t2_residual_features")
def t2_residual_features(spark, sf):
    df = series(spark, sf)
    return finish(seasonal.residuals(df, seasonal.fit(df)))


AR = recursive.feature_names()


@query(
    "t3_ar_features",
    f"""WITH {LONG}, u AS (SELECT City, '{T}' AS variable, Date, {T} AS value FROM longp UNION ALL SELECT City, '{R}', Date, {R} FROM longp),
    f AS (SELECT City, variable, Date, """
    + ", ".join(f"lag(value, {k}) OVER o AS value_lag{k}" for k in (1, 2, 3, 5, 7, 14, 30))
    + ", "
    + ", ".join(
        f"CASE WHEN count(value) OVER (o ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {fn}(value) OVER (o ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS value_full{n}_{m}"
        for n in (7, 14, 30)
        for m, fn in (("mean", "avg"), ("std", "stddev_samp"))
    )
    + f", dayofyear(Date) AS dayofyear, month(Date) AS month FROM u WINDOW o AS (PARTITION BY City, variable ORDER BY Date)) SELECT {cols(key='City variable', date='Date', int_='dayofyear month', num=' '.join(AR[:-2]))} FROM f",
)
def t3_ar_features(spark, sf):
    return finish(recursive.ar_features(series(spark, sf)), "City", "variable", "Date", *AR)


@query("t4_recursive_forecast")
def t4_recursive_forecast(spark, sf):
    train, _ = train_test(series(spark, sf))
    return finish(recursive.forecast(recursive.fit(train), 60))


@query("t4_recursive_hourly")
def t4_recursive_hourly(spark, sf):
    train, _ = train_test(hourly_series(spark, sf), "Timestamp", "168 hour")
    return finish(recursive.forecast(recursive.fit(train, HOUR, min_rows=400), 336, HOUR))


# rounds of the pooled ensemble in the queries; the library's default is 300
ROUNDS = 40


@query(
    "t4_pooled_forecast",
    f"""WITH {LONG}, l AS (SELECT City, max(Date) AS last FROM longp WHERE Date <= (SELECT max(Date) - 30 FROM longp) GROUP BY 1)
    SELECT City, v.variable, strftime(CAST(last AS DATE) + CAST(k AS INT), '%Y-%m-%d') AS Date, CAST(1 AS BIGINT) AS finite FROM l, (VALUES ('{T}'), ('{R}')) v(variable), range(1, 61) r(k)""",
)
def t4_pooled_forecast(spark, sf):
    """Recursive forecast of both variables by one ensemble over all series: 60 steps each."""
    train, _ = train_test(series(spark, sf))
    out = recursive.forecast_pooled(recursive.fit_pooled(train, maxIter=ROUNDS), 60)
    return finish(out.select("City", "variable", "Date", F.col("yhat").between(-1e6, 1e6).cast("int").alias("finite")))


@query("t4_direct_forecast")
def t4_direct_forecast(spark, sf):
    """Pooled direct forecast: horizon as a feature, one fit over all series."""
    from pyspark.ml.regression import GBTRegressor

    names = AR[:-2]
    rows = compare.direct_rows(recursive.ar_features(series(spark, sf).filter(F.col("variable") == T)), (1, 7, 30)).dropna(subset=names)
    train, test = train_test(rows)
    return finish(compare.compare(train, test, [*names, "h"], y="target", models={"DirectGBT": GBTRegressor(maxIter=5, maxDepth=4, seed=42)}))


PAIRS = f"""pr AS (SELECT City, 'temperature' AS variable, Date, Temperature_C AS y, Temperature_C * 0.8 + p * 3.1 AS a, Temperature_C * 1.1 - p * 2.3 AS b FROM wx)"""


def pairs(spark, sf):
    t, p = F.col("Temperature_C"), F.col("p")
    return measurements(spark, sf).select(
        "City", F.lit("temperature").alias("variable"), "Date", t.alias("y"), (t * 0.8 + p * 3.1).alias("a"), (t * 1.1 - p * 2.3).alias("b")
    )


GRID = ", ".join(f"(CAST({g!r} AS DOUBLE))" for g in blend.DAILY_GRID)
WEIGHTS = f"""{PAIRS}, g AS (SELECT City, variable, w, avg(abs(y - (a * w + b * (1 - w)))) AS mae FROM pr, (VALUES {GRID}) v(w) GROUP BY ALL),
  wt AS (SELECT City, variable, w AS weight, mae AS mae_blend FROM (SELECT *, row_number() OVER (PARTITION BY City, variable ORDER BY round(mae, 12), w) AS rn FROM g) WHERE rn = 1)"""


@query("t5_blend_weights", f"WITH {WX}, {WEIGHTS} SELECT {cols(key='City variable', num='weight mae_blend')} FROM wt")
def t5_blend_weights(spark, sf):
    return finish(blend.weights(pairs(spark, sf)))


@query(
    "t6_publish",
    f"""WITH {DAILY}, d AS (SELECT City, Date, 0.3 * ({T} * 1.7 + 3) + 0.7 * ({T} * 0.9) AS {T}, 0.3 * ({R} * 900 - 1) + 0.7 * ({R} * 900) AS {R} FROM daily WHERE Date > DATE '2024-01-20'),
    f AS (SELECT City, Date, least(greatest({T}, -60), 60) AS {T}, least(greatest({R}, 0), 500) AS {R} FROM d) SELECT {cols(key='City', date='Date', num=f'{T} {R}')} FROM f""",
)
def t6_publish(spark, sf):
    from catalog.base import daily

    df = daily(spark, sf)
    long = melt(df, ["City", "Date"], [T, R])
    rain = F.col("variable") == R
    a = long.withColumn("yhat", F.when(rain, F.col("value") * 900 - 1).otherwise(F.col("value") * 1.7 + 3))
    b = long.withColumn("yhat", F.when(rain, F.col("value") * 900).otherwise(F.col("value") * 0.9))
    chosen = long.select("City", "variable").distinct().withColumn("weight", F.lit(0.3))
    actual = df.filter(F.col("Date") <= F.lit("2024-01-20").cast("date"))
    return finish(blend.publish(blend.blended(a, b, chosen), actual, [T, R]))


@query(
    "t7_leaderboard",
    f"""WITH {WX}, {WEIGHTS}, j AS (SELECT pr.*, weight, a * weight + b * (1 - weight) AS h FROM pr JOIN wt ON pr.City = wt.City AND pr.variable = wt.variable),
    f AS (SELECT City, variable, 'daily' AS granularity, weight, avg(abs(y - a)) AS mae_a, avg(abs(y - b)) AS mae_b, avg(abs(y - h)) AS mae_blend, sqrt(avg((y - h) * (y - h))) AS rmse_blend FROM j GROUP BY ALL)
    SELECT {cols(key='City variable granularity', num='weight mae_a mae_b mae_blend rmse_blend')} FROM f""",
)
def t7_leaderboard(spark, sf):
    p = pairs(spark, sf)
    return finish(blend.leaderboard(p, blend.weights(p), "daily"))


@query("t7_forecast_run")
def t7_forecast_run(spark, sf):
    """Both forecasters on the train rows, weights on the holdout, errors per series."""
    train, test = train_test(series(spark, sf))
    a = seasonal.forecast(seasonal.fit(train), 60).select("City", "variable", "Date", F.col("yhat").alias("a"))
    b = recursive.forecast(recursive.fit(train), 60).select("City", "variable", "Date", F.col("yhat").alias("b"))
    key = ["City", "variable", "Date"]
    pair = test.withColumnRenamed("value", "y").join(a, key).join(b, key)
    return finish(blend.leaderboard(pair, blend.weights(pair), "daily"))


@query("t8_model_comparison")
def t8_model_comparison(spark, sf):
    from pyspark.ml.regression import RandomForestRegressor

    names = AR[:-2]
    rows = recursive.ar_features(series(spark, sf).filter(F.col("variable") == T)).dropna(subset=names)
    train, test = train_test(rows)
    models = {k: v for k, v in compare.regressors().items() if k in ("Linear", "Ridge", "ElasticNet")}
    models["RandomForest"] = RandomForestRegressor(numTrees=5, maxDepth=5, seed=42)
    return finish(compare.compare(train, test, names, models=models))
