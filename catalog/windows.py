from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, cols, daily, finish, hourly, long_panel, query
from chronopanel.operators import windows as w
from chronopanel.operators.repair import dedupe
from chronopanel.session import stage

DAY = w.DAILY
HOUR = w.HOURLY
OVER = "OVER (PARTITION BY City ORDER BY Date)"


def frame(a, b="1 PRECEDING", order="Date"):
    return f"OVER (PARTITION BY City ORDER BY {order} ROWS BETWEEN {a} AND {b})"


LAGS = (1, 2, 3, 5, 7, 14, 30)


@query(
    "w1_lag",
    f"WITH {DAILY}, f AS (SELECT City, Date, "
    + ", ".join(f"lag(Temperature_C_mean, {k}) {OVER} AS Temperature_C_mean_lag{k}" for k in LAGS)
    + f" FROM daily) SELECT {cols(key='City', date='Date', num=' '.join(f'Temperature_C_mean_lag{k}' for k in LAGS))} FROM f",
)
def w1_lag(spark, sf):
    out = w.lags(daily(spark, sf), ["Temperature_C_mean"], LAGS, DAY)
    return finish(out, "City", "Date", *[f"Temperature_C_mean_lag{k}" for k in LAGS])


HL = (1, 3, 6, 12, 24, 48, 168)


@query(
    "w1_lag_hourly",
    f"WITH {HOURLY}, f AS (SELECT City, Timestamp, "
    + ", ".join(f"lag(Humidity_percent, {k}) OVER (PARTITION BY City ORDER BY Timestamp) AS Humidity_percent_lag{k}h" for k in HL)
    + f" FROM hourly) SELECT {cols(key='City', stamp='Timestamp', num=' '.join(f'Humidity_percent_lag{k}h' for k in HL))} FROM f",
)
def w1_lag_hourly(spark, sf):
    out = w.lags(hourly(spark, sf), ["Humidity_percent"], HL, HOUR, "h")
    return finish(out, "City", "Timestamp", *[f"Humidity_percent_lag{k}h" for k in HL])


WIN = (3, 7, 14, 30)
W2 = [f"Temperature_C_mean_roll{n}_{s}" for n in WIN for s in ("mean", "std")]


@query(
    "w2_rolling_mean",
    f"WITH {DAILY}, f AS (SELECT City, Date, "
    + ", ".join(
        f"avg(Temperature_C_mean) {frame(f'{n} PRECEDING')} AS Temperature_C_mean_roll{n}_mean, "
        f"stddev_samp(Temperature_C_mean) {frame(f'{n} PRECEDING')} AS Temperature_C_mean_roll{n}_std"
        for n in WIN
    )
    + f" FROM daily) SELECT {cols(key='City', date='Date', num=' '.join(W2))} FROM f",
)
def w2_rolling_mean(spark, sf):
    return finish(w.rolling(daily(spark, sf), ["Temperature_C_mean"], WIN, DAY), "City", "Date", *W2)


@query(
    "w2_rolling_hourly",
    f"WITH {HOURLY}, f AS (SELECT City, Timestamp, "
    + ", ".join(
        f"avg(Rain_mm) {frame(f'{n} PRECEDING', order='Timestamp')} AS Rain_mm_roll{n}h_mean" for n in (6, 12, 24)
    )
    + f" FROM hourly) SELECT {cols(key='City', stamp='Timestamp', num='Rain_mm_roll6h_mean Rain_mm_roll12h_mean Rain_mm_roll24h_mean')} FROM f",
)
def w2_rolling_hourly(spark, sf):
    out = w.rolling(hourly(spark, sf), ["Rain_mm"], (6, 12, 24), HOUR, "h")
    return finish(out, "City", "Timestamp", *[f"Rain_mm_roll{n}h_mean" for n in (6, 12, 24)])


@query(
    "w3_strict_rolling",
    f"WITH {DAILY}, f AS (SELECT City, Date, "
    + ", ".join(
        f"CASE WHEN count(Wind_Speed_kmh_mean) {frame(f'{n} PRECEDING')} = {n} THEN avg(Wind_Speed_kmh_mean) {frame(f'{n} PRECEDING')} END AS Wind_Speed_kmh_mean_full{n}_mean, "
        f"CASE WHEN count(Wind_Speed_kmh_mean) {frame(f'{n} PRECEDING')} = {n} THEN stddev_samp(Wind_Speed_kmh_mean) {frame(f'{n} PRECEDING')} END AS Wind_Speed_kmh_mean_full{n}_std"
        for n in (7, 14)
    )
    + " FROM daily) SELECT "
    + cols(key="City", date="Date", num=" ".join(f"Wind_Speed_kmh_mean_full{n}_{s}" for n in (7, 14) for s in ("mean", "std")))
    + " FROM f",
)
def w3_strict_rolling(spark, sf):
    out = w.strict_rolling(daily(spark, sf), ["Wind_Speed_kmh_mean"], (7, 14), DAY)
    return finish(out, "City", "Date", *[f"Wind_Speed_kmh_mean_full{n}_{s}" for n in (7, 14) for s in ("mean", "std")])


@query(
    "w4_rolling_current",
    f"WITH {DAILY}, f AS (SELECT City, Date, avg(Temperature_C_mean) {frame('13 PRECEDING', 'CURRENT ROW')} AS Temperature_C_mean_mean14, "
    f"sum(Rain_mm_sum) {frame('29 PRECEDING', 'CURRENT ROW')} AS Rain_mm_sum_sum30 FROM daily) "
    f"SELECT {cols(key='City', date='Date', num='Temperature_C_mean_mean14 Rain_mm_sum_sum30')} FROM f",
)
def w4_rolling_current(spark, sf):
    out = w.current_rolling(daily(spark, sf), DAY, [("Temperature_C_mean", 14)], [("Rain_mm_sum", 30)])
    return finish(out, "City", "Date", "Temperature_C_mean_mean14", "Rain_mm_sum_sum30")


@query(
    "w5_event_counts",
    f"WITH {DAILY}, f AS (SELECT City, Date, sum(Rain_mm_sum) {frame('30 PRECEDING')} AS Rain_mm_sum_sum30, "
    + ", ".join(f"sum(Fire_Occurred) {frame(f'{n} PRECEDING')} AS Fire_Occurred_sum{n}" for n in (7, 14, 30, 90))
    + f" FROM daily) SELECT {cols(key='City', date='Date', num='Rain_mm_sum_sum30', int_='Fire_Occurred_sum7 Fire_Occurred_sum14 Fire_Occurred_sum30 Fire_Occurred_sum90')} FROM f",
)
def w5_event_counts(spark, sf):
    def build(o):
        return {**w.sum_columns(o, ["Rain_mm_sum"], [30]), **w.sum_columns(o, ["Fire_Occurred"], (7, 14, 30, 90))}

    out = w.bounded(daily(spark, sf), DAY, build, 90)
    return finish(out, "City", "Date", "Rain_mm_sum_sum30", *[f"Fire_Occurred_sum{n}" for n in (7, 14, 30, 90)])


@query(
    "w6_dry_streak",
    f"WITH {DAILY}, a AS (SELECT City, Date, CASE WHEN Rain_mm_sum < 0.1 THEN 1 ELSE 0 END AS dry FROM daily), "
    f"b AS (SELECT *, sum(1 - dry) {OVER} AS island FROM a), "
    "c AS (SELECT City, Date, sum(dry) OVER (PARTITION BY City, island ORDER BY Date) AS dry_days_streak FROM b) "
    f"SELECT {cols(key='City', date='Date', int_='dry_days_streak')} FROM c",
)
def w6_dry_streak(spark, sf):
    out = w.streak(stage(daily(spark, sf)), F.col("Rain_mm_sum") < 0.1, "dry_days_streak", DAY)
    return finish(out, "City", "Date", "dry_days_streak")


@query(
    "w7_days_since",
    f"WITH {DAILY}, a AS (SELECT City, Date, Fire_Occurred, row_number() {OVER} AS rn FROM daily), "
    f"b AS (SELECT City, Date, least(coalesce(rn - max(CASE WHEN Fire_Occurred = 1 THEN rn END) {frame('UNBOUNDED PRECEDING')}, 9999), 365) AS days_since_last_fire FROM a) "
    f"SELECT {cols(key='City', date='Date', int_='days_since_last_fire')} FROM b",
)
def w7_days_since(spark, sf):
    out = w.rows_since(stage(daily(spark, sf)), F.col("Fire_Occurred") == 1, "days_since_last_fire", DAY)
    return finish(out, "City", "Date", "days_since_last_fire")


@query(
    "w8_prior_rate",
    f"WITH {LONG}, a AS (SELECT *, month(Date) AS Month FROM longp), "
    f"b AS (SELECT City, Date, coalesce(avg(Fire_Occurred) {frame('UNBOUNDED PRECEDING')}, 0) AS city_fire_rate, "
    "coalesce(avg(Fire_Occurred) OVER (PARTITION BY City, Month ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS city_month_fire_rate FROM a) "
    f"SELECT {cols(key='City', date='Date', num='city_fire_rate city_month_fire_rate')} FROM b",
)
def w8_prior_rate(spark, sf):
    df = stage(long_panel(spark, sf).withColumn("Month", F.month("Date")))
    out = w.unlimited(w.indexed(df, DAY), DAY, [w.mean_trail("Fire_Occurred", "city_fire_rate")])
    out = w.unlimited(out, DAY, [w.mean_trail("Fire_Occurred", "city_month_fire_rate")], within=["Month"])
    return finish(out, "City", "Date", "city_fire_rate", "city_month_fire_rate")


@query(
    "w9_group_mean",
    f"WITH {LONG}, f AS (SELECT City, Date, avg(Rain_mm_sum) OVER (PARTITION BY City, month(Date)) AS Rain_mm_sum_group_mean FROM longp) "
    f"SELECT {cols(key='City', date='Date', num='Rain_mm_sum_group_mean')} FROM f",
)
def w9_group_mean(spark, sf):
    df = long_panel(spark, sf).withColumn("Month", F.month("Date"))
    return finish(w.group_mean(df, ["Rain_mm_sum"], ["City", "Month"]), "City", "Date", "Rain_mm_sum_group_mean")


@query(
    "w10_rainfall_deficit",
    f"WITH {LONG}, f AS (SELECT City, Date, sum(Rain_mm_sum) {frame('30 PRECEDING')} AS Rain_roll30_sum, "
    "avg(Rain_mm_sum) OVER (PARTITION BY City, month(Date)) AS m FROM longp), "
    "g AS (SELECT *, m * 30 - coalesce(Rain_roll30_sum, 0) AS Rainfall_Deficit FROM f) "
    f"SELECT {cols(key='City', date='Date', num='Rain_roll30_sum Rainfall_Deficit')} FROM g",
)
def w10_rainfall_deficit(spark, sf):
    df = long_panel(spark, sf).withColumn("Month", F.month("Date"))
    return finish(w.rainfall_deficit(df, DAY), "City", "Date", "Rain_roll30_sum", "Rainfall_Deficit")


@query(
    "w11_anomaly",
    f"WITH {LONG}, c AS (SELECT City, month(Date) AS m, avg(Temperature_C_mean) AS t, avg(Rain_mm_sum) AS r FROM longp WHERE Date < DATE '2000-01-01' GROUP BY 1, 2), "
    "f AS (SELECT l.City, l.Date, Temperature_C_mean - t AS Temperature_C_mean_anomaly, Rain_mm_sum - r AS Rain_mm_sum_anomaly "
    "FROM longp l LEFT JOIN c ON l.City = c.City AND month(l.Date) = c.m) "
    f"SELECT {cols(key='City', date='Date', num='Temperature_C_mean_anomaly Rain_mm_sum_anomaly')} FROM f",
)
def w11_anomaly(spark, sf):
    from chronopanel.operators.aggregate import climatology

    df = long_panel(spark, sf).withColumn("Month", F.month("Date"))
    names = ["Temperature_C_mean", "Rain_mm_sum"]
    fitted = climatology(df.filter(F.col("Date") < F.lit("2000-01-01").cast("date")), names)
    return finish(w.anomaly(df, names, climatology=fitted), "City", "Date", *[f"{c}_anomaly" for c in names])


@query(
    "w12_decompose",
    f"WITH {LONG}, r AS (SELECT City, Date, Temperature_C_mean AS v, row_number() {OVER} - 1 AS i FROM longp), "
    "t AS (SELECT *, CASE WHEN count(*) OVER k = 365 THEN sum(v) OVER k / 365 END AS trend, i % 365 AS ph FROM r "
    "WINDOW k AS (PARTITION BY City ORDER BY i ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)), "
    "m AS (SELECT City, ph, avg(v - trend) AS m FROM t GROUP BY 1, 2), "
    "s AS (SELECT City, ph, m - avg(m) OVER (PARTITION BY City) AS seasonal FROM m), "
    "f AS (SELECT t.City, Date, trend, seasonal, v - trend - seasonal AS resid FROM t JOIN s ON t.City = s.City AND t.ph = s.ph) "
    f"SELECT {cols(key='City', date='Date', num='trend seasonal resid')} FROM f",
)
def w12_decompose(spark, sf):
    out = w.decompose(long_panel(spark, sf), "Temperature_C_mean", 365, DAY)
    return finish(out, "City", "Date", "trend", "seasonal", "resid")


CUT = "2024-01-25"


@query(
    "w13_splice",
    f"WITH {DAILY}, h AS (SELECT City, Date, Temperature_C_mean AS t FROM daily WHERE Date <= DATE '{CUT}'), "
    f"f AS (SELECT City, Date, Temperature_C_mean + 1 AS t FROM daily WHERE Date >= DATE '{CUT}'), "
    "u AS (SELECT *, 0 AS is_forecast FROM h WHERE Date >= (SELECT min(Date) FROM f) - INTERVAL 10 DAY UNION ALL SELECT *, 1 FROM f), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY City, Date ORDER BY is_forecast DESC) AS rn FROM u) "
    f"SELECT {cols(key='City', date='Date', num='t', int_='is_forecast')} FROM d WHERE rn = 1",
)
def w13_splice(spark, sf):
    df = daily(spark, sf).select("City", "Date", F.col("Temperature_C_mean").alias("t"))
    cut = F.lit(CUT).cast("date")
    history = df.filter(F.col("Date") <= cut)
    forecast = df.filter(F.col("Date") >= cut).withColumn("t", F.col("t") + 1)
    return finish(w.splice(history, forecast, DAY, 10), "City", "Date", "t", "is_forecast")


@query(
    "w14_last_known",
    f"WITH {DAILY}, a AS (SELECT City, Date, CASE WHEN Rain_mm_sum > 0 THEN Rain_mm_sum END AS rain, Temperature_C_mean AS temp FROM daily), "
    "f AS (SELECT City, arg_max(rain, CASE WHEN rain IS NOT NULL THEN Date END) AS rain, arg_max(temp, Date) AS temp FROM a GROUP BY City) "
    f"SELECT {cols(key='City', num='rain temp')} FROM f",
)
def w14_last_known(spark, sf):
    rain = F.when(F.col("Rain_mm_sum") > 0, F.col("Rain_mm_sum"))
    df = daily(spark, sf).select("City", "Date", rain.alias("rain"), F.col("Temperature_C_mean").alias("temp"))
    return finish(w.last_known(df, ["rain", "temp"], DAY), "City", "rain", "temp")


@query(
    "w15_spine",
    f"WITH {HOURLY}, e AS (SELECT City, min(Timestamp) AS lo, max(Timestamp) AS hi FROM hourly GROUP BY 1), "
    "s AS (SELECT City, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS Timestamp FROM e), "
    "f AS (SELECT s.City, s.Timestamp, h.Temperature_C FROM s LEFT JOIN hourly h ON s.City = h.City AND s.Timestamp = h.Timestamp) "
    f"SELECT {cols(key='City', stamp='Timestamp', num='Temperature_C')} FROM f",
)
def w15_spine(spark, sf):
    return finish(w.spine(hourly(spark, sf), HOUR), "City", "Timestamp", "Temperature_C")


@query(
    "w15_spine_lag",
    f"WITH {HOURLY}, e AS (SELECT City, min(Timestamp) AS lo, max(Timestamp) AS hi FROM hourly GROUP BY 1), "
    "s AS (SELECT City, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS Timestamp FROM e), "
    "j AS (SELECT s.City, s.Timestamp, h.Temperature_C FROM s LEFT JOIN hourly h ON s.City = h.City AND s.Timestamp = h.Timestamp), "
    "f AS (SELECT City, Timestamp, lag(Temperature_C, 24) OVER (PARTITION BY City ORDER BY Timestamp) AS Temperature_C_lag24h, "
    "avg(Temperature_C) OVER (PARTITION BY City ORDER BY Timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS Temperature_C_roll24h_mean FROM j) "
    f"SELECT {cols(key='City', stamp='Timestamp', num='Temperature_C_lag24h Temperature_C_roll24h_mean')} FROM f",
)
def w15_spine_lag(spark, sf):
    s = HOUR.with_(regular=True)
    df = w.spine(hourly(spark, sf).select("City", "Timestamp", "Temperature_C"), s)

    def build(o):
        return {**w.lag_columns(o, ["Temperature_C"], [24], "h"), **w.rolling_columns(o, ["Temperature_C"], [24], "h")}

    return finish(w.bounded(df, s, build, 24), "City", "Timestamp", "Temperature_C_lag24h", "Temperature_C_roll24h_mean")


@query(
    "w15_coverage",
    f"WITH {HOURLY}, c AS (SELECT City, count(*) AS rows, min(Timestamp) AS first, max(Timestamp) AS last, "
    "datediff('hour', min(Timestamp), TIMESTAMP '2024-01-31 23:00:00') + 1 AS expected FROM hourly GROUP BY 1), "
    "f AS (SELECT *, least(rows * 100.0 / expected, 100.0) AS percent FROM c) "
    f"SELECT {cols(key='City', stamp='first last', int_='rows expected', num='percent')} FROM f",
)
def w15_coverage(spark, sf):
    until = F.lit("2024-01-31 23:00:00").cast("timestamp_ntz")
    return finish(w.expected_steps(hourly(spark, sf), HOUR, until), "City", "first", "last", "rows", "expected", "percent")


@query(
    "a11_coverage",
    f"WITH {DAILY}, c AS (SELECT City, count(*) AS rows, min(Date) AS first, max(Date) AS last, datediff('day', min(Date), DATE '2024-01-31') + 1 AS expected FROM daily GROUP BY 1), "
    "f AS (SELECT *, least(rows * 100.0 / expected, 100.0) AS percent FROM c) "
    f"SELECT {cols(key='City', date='first last', int_='rows expected', num='percent')} FROM f",
)
def a11_coverage(spark, sf):
    out = w.expected_steps(daily(spark, sf), DAY, F.lit("2024-01-31").cast("date"))
    return finish(out, "City", "first", "last", "rows", "expected", "percent")


@query(
    "w16_latest_row",
    f"WITH {DAILY}, f AS (SELECT *, row_number() OVER (PARTITION BY City ORDER BY Date DESC) AS rn FROM daily) "
    f"SELECT {cols(key='City', date='Date', num='Temperature_C_mean Rain_mm_sum', int_='Fire_Occurred')} FROM f WHERE rn = 1",
)
def w16_latest_row(spark, sf):
    df = daily(spark, sf).select("City", "Date", "Temperature_C_mean", "Rain_mm_sum", "Fire_Occurred")
    return finish(w.latest(df, ["City"], "Date"))


@query(
    "w17_every_nth_date",
    f"WITH {DAILY}, d AS (SELECT *, dense_rank() OVER (ORDER BY Date) AS i FROM daily), "
    "k AS (SELECT * FROM d WHERE (i > 4 AND (i - 5) % 5 = 0) OR i = 1 OR i = (SELECT max(i) FROM d)) "
    f"SELECT {cols(key='City', date='Date', num='Temperature_C_mean')} FROM k",
)
def w17_every_nth_date(spark, sf):
    return finish(w.every_nth(daily(spark, sf), "Date", 5, 4), "City", "Date", "Temperature_C_mean")


@query(
    "p13_fill",
    f"WITH {HOURLY}, a AS (SELECT City, Timestamp, CASE WHEN Rain_mm > 0 THEN Rain_mm END AS rain FROM hourly), "
    "f AS (SELECT City, Timestamp, last_value(rain IGNORE NULLS) OVER (PARTITION BY City ORDER BY Timestamp ROWS UNBOUNDED PRECEDING) AS forward, "
    "first_value(rain IGNORE NULLS) OVER (PARTITION BY City ORDER BY Timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM a), "
    "g AS (SELECT City, Timestamp, forward, coalesce(forward, nxt) AS filled FROM f) "
    f"SELECT {cols(key='City', stamp='Timestamp', num='forward filled')} FROM g",
)
def p13_fill(spark, sf):
    rain = F.when(F.col("Rain_mm") > 0, F.col("Rain_mm"))
    df = stage(hourly(spark, sf).select("City", "Timestamp", rain.alias("forward"), rain.alias("filled")))
    out = w.fill(w.indexed(df, HOUR), ["filled"], HOUR, leak_free=False)
    return finish(w.fill(out, ["forward"], HOUR), "City", "Timestamp", "forward", "filled")


@query(
    "p15_dedupe",
    f"WITH {HOURLY}, r AS (SELECT City, CAST(Timestamp AS DATE) AS Date, Timestamp, Temperature_C, "
    "row_number() OVER (PARTITION BY City, CAST(Timestamp AS DATE) ORDER BY Timestamp DESC) AS rn FROM hourly) "
    f"SELECT {cols(key='City', date='Date', stamp='Timestamp', num='Temperature_C')} FROM r WHERE rn = 1",
)
def p15_dedupe(spark, sf):
    df = hourly(spark, sf).select("City", F.to_date("Timestamp").alias("Date"), "Timestamp", "Temperature_C")
    return finish(dedupe(df, ["City", "Date"], "Timestamp"))
