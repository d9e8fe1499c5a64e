from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, WX, cols, daily, finish, hourly, long_panel, measurements, query
from chronopanel.operators import aggregate as a
from chronopanel.operators import stats
from chronopanel.operators.quantiles import quantiles

A1 = "Temperature_C_mean Temperature_C_min Temperature_C_max Humidity_percent_mean Wind_Speed_kmh_mean Wind_Dir_deg_mean Solar_Radiation_Wm2_mean Rain_mm_sum Soil_Moisture_max"


@query(
    "a1_daily_panel",
    f"WITH {HOURLY}, f AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(Temperature_C) AS Temperature_C_mean, min(Temperature_C) AS Temperature_C_min, "
    "max(Temperature_C) AS Temperature_C_max, avg(Humidity_percent) AS Humidity_percent_mean, avg(Wind_Speed_kmh) AS Wind_Speed_kmh_mean, "
    "avg(Wind_Dir_deg) AS Wind_Dir_deg_mean, avg(Solar_Radiation_Wm2) AS Solar_Radiation_Wm2_mean, coalesce(sum(Rain_mm), 0) AS Rain_mm_sum, "
    f"max(Soil_Moisture) AS Soil_Moisture_max FROM hourly GROUP BY 1, 2) SELECT {cols(key='City', date='Date', num=A1)} FROM f",
)
def a1_daily_panel(spark, sf):
    return finish(a.daily_panel(hourly(spark, sf), intraday=False), "City", "Date", *A1.split())


@query(
    "a2_event_days",
    f"WITH {WX}, f AS (SELECT CAST(user_id AS VARCHAR) AS City, Date, count(*) AS fire_count, avg(Temperature_C) AS mean_brightness, "
    "max(Wind_Speed_kmh) AS max_frp, 1 AS Fire_Occurred FROM wx WHERE y = 1 GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', num='mean_brightness max_frp', int_='fire_count Fire_Occurred')} FROM f",
)
def a2_event_days(spark, sf):
    points = measurements(spark, sf).filter("y = 1").select(
        F.col("user_id").cast("string").alias("City"), "Date", F.col("Temperature_C").alias("brightness"), F.col("Wind_Speed_kmh").alias("frp")
    )
    return finish(a.event_days(points))


@query(
    "a3_regroup_day",
    f"WITH {HOURLY}, f AS (SELECT City, CAST(Timestamp AS DATE) AS Date, max(Rain_mm) AS Rain_mm, avg(Soil_Moisture) AS Soil_Moisture FROM hourly GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', num='Rain_mm Soil_Moisture')} FROM f",
)
def a3_regroup_day(spark, sf):
    df = hourly(spark, sf).withColumn("Date", F.to_date("Timestamp"))
    return finish(a.regroup(df, ["City", "Date"], ["Rain_mm"], ["Soil_Moisture"]))


@query(
    "a4_entity_max",
    f"WITH {DAILY}, f AS (SELECT City, max(Temperature_C_max) AS Temperature_C_max, max(Rain_mm_sum) AS Rain_mm_sum FROM daily GROUP BY 1) "
    f"SELECT {cols(key='City', num='Temperature_C_max Rain_mm_sum')} FROM f",
)
def a4_entity_max(spark, sf):
    return finish(a.regroup(daily(spark, sf), ["City"], ["Temperature_C_max", "Rain_mm_sum"]))


A5 = "hours_temp_above_30 hours_humidity_below_30 hours_wind_above_20"


@query(
    "a5_hour_counts",
    f"WITH {WX}, f AS (SELECT City, Date, sum(CASE WHEN Temperature_C > 30 THEN 1 ELSE 0 END) AS hours_temp_above_30, "
    "sum(CASE WHEN Humidity_percent < 30 THEN 1 ELSE 0 END) AS hours_humidity_below_30, "
    "sum(CASE WHEN Wind_Speed_kmh > 20 THEN 1 ELSE 0 END) AS hours_wind_above_20 FROM wx GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', int_=A5)} FROM f",
)
def a5_hour_counts(spark, sf):
    return finish(a.daily_panel(measurements(spark, sf)), "City", "Date", *A5.split())


@query(
    "a6_ranges",
    f"WITH {HOURLY}, f AS (SELECT City, CAST(Timestamp AS DATE) AS Date, max(Temperature_C) - min(Temperature_C) AS temp_range, "
    "max(Humidity_percent) - min(Humidity_percent) AS Humidity_percent_diurnal_range FROM hourly GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', num='temp_range Humidity_percent_diurnal_range')} FROM f",
)
def a6_ranges(spark, sf):
    return finish(a.daily_panel(hourly(spark, sf)), "City", "Date", "temp_range", "Humidity_percent_diurnal_range")


@query(
    "a7_day_parts",
    f"WITH {HOURLY}, f AS (SELECT City, CAST(Timestamp AS DATE) AS Date, "
    "coalesce(min(CASE WHEN hour(Timestamp) <= 5 THEN Temperature_C END), min(Temperature_C)) AS temp_night_min, "
    "coalesce(max(CASE WHEN hour(Timestamp) BETWEEN 12 AND 17 THEN Temperature_C END), max(Temperature_C)) AS temp_afternoon_max FROM hourly GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', num='temp_night_min temp_afternoon_max')} FROM f",
)
def a7_day_parts(spark, sf):
    return finish(a.daily_panel(hourly(spark, sf)), "City", "Date", "temp_night_min", "temp_afternoon_max")


@query(
    "a8_peak_hour",
    f"WITH {HOURLY}, r AS (SELECT City, CAST(Timestamp AS DATE) AS Date, hour(Timestamp) AS h, Solar_Radiation_Wm2 AS s, "
    "row_number() OVER (PARTITION BY City, CAST(Timestamp AS DATE) ORDER BY Solar_Radiation_Wm2 DESC, hour(Timestamp)) AS rn FROM hourly), "
    "f AS (SELECT City, Date, CASE WHEN s > 0 THEN h ELSE 12 END AS solar_peak_hour FROM r WHERE rn = 1) "
    f"SELECT {cols(key='City', date='Date', int_='solar_peak_hour')} FROM f",
)
def a8_peak_hour(spark, sf):
    return finish(a.daily_panel(hourly(spark, sf)), "City", "Date", "solar_peak_hour")


PROF = ("Temperature_C_mean", "Rain_mm_sum")


@query(
    "a9_profile",
    f"WITH {LONG}, u AS (SELECT City, 'Temperature_C_mean' AS variable, Temperature_C_mean AS v FROM longp UNION ALL SELECT City, 'Rain_mm_sum', Rain_mm_sum FROM longp), "
    "f AS (SELECT City, variable, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, "
    "quantile_cont(v, 0.75) AS q75, max(v) AS max, skewness(v) AS skew, kurtosis(v) AS kurtosis FROM u GROUP BY 1, 2) "
    f"SELECT {cols(key='City variable', int_='n', num='mean std min q25 median q75 max skew kurtosis')} FROM f",
)
def a9_profile(spark, sf):
    return finish(a.profile(long_panel(spark, sf), ["City"], PROF))


A10 = ("City", "Date", "rain", "Temperature_C_mean")


@query(
    "a10_null_profile",
    f"WITH {DAILY}, d AS (SELECT CASE WHEN Rain_mm_sum > 0 THEN Rain_mm_sum END AS rain, * FROM daily), f AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{t}' AS dtype, count(*) - count({c}) AS nulls, (count(*) - count({c})) * 100.0 / count(*) AS percent FROM d"
        for c, t in zip(A10, ("string", "date", "double", "double"))
    )
    + f") SELECT {cols(key='variable dtype', int_='nulls', num='percent')} FROM f",
)
def a10_null_profile(spark, sf):
    rain = F.when(F.col("Rain_mm_sum") > 0, F.col("Rain_mm_sum")).alias("rain")
    return finish(a.null_profile(daily(spark, sf).withColumn("rain", rain).select(*A10)))


@query(
    "a10_duplicates",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE))",
)
def a10_duplicates(spark, sf):
    return finish(a.duplicate_rows(measurements(spark, sf), ["user_id", "Date"]))


@query(
    "a10_nulls_by_entity",
    f"WITH {DAILY}, f AS (SELECT City, sum(CASE WHEN Rain_mm_sum > 0 THEN 0 ELSE 1 END) AS rain, 0 AS Temperature_C_mean FROM daily GROUP BY 1) "
    f"SELECT {cols(key='City', int_='rain Temperature_C_mean')} FROM f",
)
def a10_nulls_by_entity(spark, sf):
    df = daily(spark, sf).withColumn("rain", F.when(F.col("Rain_mm_sum") > 0, F.col("Rain_mm_sum")))
    return finish(a.null_counts_by(df, ["City"], ["rain", "Temperature_C_mean"]))


@query(
    "a12_diurnal_curve",
    f"WITH {WX}, f AS (SELECT hour(Timestamp) AS Hour, y, avg(Temperature_C) AS Temperature_C_mean, count(*) AS n FROM wx GROUP BY 1, 2) "
    f"SELECT {cols(int_='Hour y n', num='Temperature_C_mean')} FROM f",
)
def a12_diurnal_curve(spark, sf):
    df = measurements(spark, sf).withColumn("Hour", F.hour("Timestamp"))
    return finish(a.curve(df, "Temperature_C", ["Hour", "y"]))


@query(
    "a13_seasonal_rates",
    f"WITH {LONG}, f AS (SELECT year(Date) AS Year, month(Date) AS Month, sum(Fire_Occurred) AS events, avg(Fire_Occurred) AS rate FROM longp GROUP BY 1, 2) "
    f"SELECT {cols(int_='Year Month events', num='rate')} FROM f",
)
def a13_seasonal_rates(spark, sf):
    df = long_panel(spark, sf).withColumns({"Year": F.year("Date"), "Month": F.month("Date")})
    return finish(a.rates(df, "Fire_Occurred", ["Year", "Month"]))


MONTHS = " ".join(f"m{m}" for m in range(1, 13))


@query(
    "a14_month_matrix",
    f"WITH {LONG}, f AS (SELECT City, "
    + ", ".join(f"avg(CASE WHEN month(Date) = {m} THEN Fire_Occurred END) * 100 AS m{m}" for m in range(1, 13))
    + f" FROM longp GROUP BY 1) SELECT {cols(key='City', num=MONTHS)} FROM f",
)
def a14_month_matrix(spark, sf):
    return finish(a.month_matrix(long_panel(spark, sf).withColumn("Month", F.month("Date"))))


NUM = ("Temperature_C_mean", "Humidity_percent_mean", "Rain_mm_sum", "Wind_Speed_kmh_max", "Solar_Radiation_Wm2_mean")
PAIRS = [(x, y) for i, x in enumerate(NUM) for y in NUM[i + 1 :]]


@query(
    "a15_correlation",
    f"WITH {DAILY}, f AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM daily" for x in NUM for y in NUM)
    + f") SELECT {cols(key='a b', num='r')} FROM f",
)
def a15_correlation(spark, sf):
    return finish(stats.correlation(daily(spark, sf), NUM), "a", "b", "r")


@query(
    "a16_label_correlation",
    f"WITH {DAILY}, f AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS variable, corr({x}, Fire_Occurred) AS r FROM daily" for x in NUM)
    + f") SELECT {cols(key='variable', num='r')} FROM f ORDER BY abs(r) DESC LIMIT 3",
)
def a16_label_correlation(spark, sf):
    return finish(stats.label_correlation(daily(spark, sf), NUM, "Fire_Occurred", top=3))


@query(
    "a17_correlated_pairs",
    f"WITH {DAILY}, f AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM daily" for x, y in PAIRS)
    + f") SELECT {cols(key='a b', num='r')} FROM f WHERE abs(r) > 0.9",
)
def a17_correlated_pairs(spark, sf):
    return finish(stats.correlated_pairs(daily(spark, sf), NUM, 0.9))


WELCH = ("Temperature_C", "Humidity_percent", "Rain_mm")


def welch_sql():
    u = " UNION ALL ".join(f"SELECT CAST(user_id % 7 AS VARCHAR) AS City, p >= 0.8 AS ev, '{c}' AS variable, {c} AS v FROM wx" for c in WELCH)
    return f"""WITH {WX}, u AS ({u}),
    s AS (SELECT City, variable, count(v) FILTER (ev) AS n1, count(v) FILTER (NOT ev) AS n0, avg(v) FILTER (ev) AS m1, avg(v) FILTER (NOT ev) AS m0,
      var_samp(v) FILTER (ev) AS v1, var_samp(v) FILTER (NOT ev) AS v0 FROM u GROUP BY 1, 2),
    f AS (SELECT City, variable, m1 AS event_mean, m0 AS other_mean, m1 - m0 AS diff, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t,
      pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM s WHERE n1 >= 5 AND n0 >= 3)"""


def welch_rows(spark, sf):
    df = measurements(spark, sf).select(
        (F.col("user_id") % 7).cast("string").alias("City"), (F.col("p") >= 0.8).cast("int").alias("y"), *WELCH
    )
    return stats.welch(df, WELCH, "y", ["City"])


@query("a18_welch", welch_sql() + f" SELECT {cols(key='City variable', num='event_mean other_mean diff t df')} FROM f")
def a18_welch(spark, sf):
    return finish(welch_rows(spark, sf), "City", "variable", "event_mean", "other_mean", "diff", "t", "df")


@query("a18_welch_p")
def a18_welch_p(spark, sf):
    return finish(welch_rows(spark, sf), "City", "variable", "p_value", "significant")


@query("a19_significance_rate")
def a19_significance_rate(spark, sf):
    return finish(stats.significance_rate(welch_rows(spark, sf)))


@query(
    "a20_outliers",
    f"""WITH {WX}, u AS (SELECT City, 'Temperature_C' AS variable, Temperature_C AS v FROM wx UNION ALL SELECT City, 'Rain_mm', Rain_mm FROM wx),
    q AS (SELECT City, variable, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM u GROUP BY 1, 2),
    f AS (SELECT u.City, u.variable, sum(CASE WHEN v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) THEN 1 ELSE 0 END) AS outliers, count(*) AS n
      FROM u JOIN q ON u.City = q.City AND u.variable = q.variable GROUP BY 1, 2),
    g AS (SELECT City, variable, outliers, outliers * 100.0 / n AS percent FROM f)
    SELECT {cols(key='City variable', int_='outliers', num='percent')} FROM g""",
)
def a20_outliers(spark, sf):
    return finish(a.outliers(measurements(spark, sf), ["City"], ["Temperature_C", "Rain_mm"]))


@query(
    "a21_quantiles",
    f"WITH {WX}, f AS (SELECT quantile_cont(Temperature_C, 0.95) AS t95, quantile_cont(Humidity_percent, 0.1) AS h10, quantile_cont(Wind_Speed_kmh, 0.9) AS w90 FROM wx) "
    f"SELECT {cols(num='t95 h10 w90')} FROM f",
)
def a21_quantiles(spark, sf):
    wanted = {"t95": ("Temperature_C", 0.95), "h10": ("Humidity_percent", 0.1), "w90": ("Wind_Speed_kmh", 0.9)}
    return finish(quantiles(measurements(spark, sf), [], wanted))


@query(
    "a21_quantiles_large",
    f"WITH {WX}, f AS (SELECT City, quantile_cont(Temperature_C, 0.95) AS t95, quantile_cont(Humidity_percent, 0.1) AS h10, quantile_cont(Temperature_C, 0.5) AS t50 FROM wx GROUP BY 1) "
    f"SELECT {cols(key='City', num='t95 h10 t50')} FROM f",
)
def a21_quantiles_large(spark, sf):
    """By group; two quantiles of one column share its counters."""
    wanted = {"t95": ("Temperature_C", 0.95), "h10": ("Humidity_percent", 0.1), "t50": ("Temperature_C", 0.5)}
    return finish(quantiles(measurements(spark, sf), ["City"], wanted))


@query(
    "a22_climatology",
    f"WITH {LONG}, f AS (SELECT City, month(Date) AS Month, avg(Temperature_C_mean) AS Temperature_C_mean, avg(Rain_mm_sum) AS Rain_mm_sum FROM longp WHERE Date < DATE '2000-01-01' GROUP BY 1, 2) "
    f"SELECT {cols(key='City', int_='Month', num='Temperature_C_mean Rain_mm_sum')} FROM f",
)
def a22_climatology(spark, sf):
    train = long_panel(spark, sf).filter(F.col("Date") < F.lit("2000-01-01").cast("date")).withColumn("Month", F.month("Date"))
    return finish(a.climatology(train, ["Temperature_C_mean", "Rain_mm_sum"]))


@query(
    "a23_risk_by_entity",
    f"WITH {DAILY}, f AS (SELECT City, avg(probability) AS mean_probability, max(probability) AS max_probability FROM daily GROUP BY 1) "
    f"SELECT {cols(key='City', num='mean_probability max_probability')} FROM f",
)
def a23_risk_by_entity(spark, sf):
    return finish(a.risk_by_entity(daily(spark, sf)))


@query(
    "a23_tier_counts",
    f"WITH {DAILY} SELECT CASE WHEN probability >= 0.6 THEN 'Extreme' WHEN probability >= 0.35 THEN 'High' WHEN probability >= 0.15 THEN 'Moderate' ELSE 'Low' END AS risk_level, count(*) AS n FROM daily GROUP BY 1",
)
def a23_tier_counts(spark, sf):
    from chronopanel.functions.risk import tier

    return finish(a.tier_counts(daily(spark, sf).withColumn("risk_level", tier(F.col("probability")))))


@query(
    "a24_day_rollup",
    f"WITH {HOURLY}, f AS (SELECT City, CAST(Timestamp AS DATE) AS Date, max(p) AS hourly_max, avg(p) AS hourly_mean FROM hourly GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', num='hourly_max hourly_mean')} FROM f",
)
def a24_day_rollup(spark, sf):
    df = hourly(spark, sf).groupBy("City", F.to_date("Timestamp").alias("Date"))
    return finish(df.agg(F.max("p").alias("hourly_max"), F.avg("p").alias("hourly_mean")))


FC = "Date >= DATE '2001-01-15' AND Date <= DATE '2001-02-20'"
HIST = "Date < DATE '2001-01-15'"


def forecast_history(spark, sf):
    df = long_panel(spark, sf)
    return df.filter(FC), df.filter(HIST)


@query(
    "a25_versus_last_year",
    f"WITH {LONG}, n AS (SELECT City, avg(Temperature_C_mean) AS forecast FROM longp WHERE {FC} GROUP BY 1), "
    f"s AS (SELECT min(Date) - INTERVAL 12 MONTH AS a, max(Date) - INTERVAL 12 MONTH AS b FROM longp WHERE {FC}), "
    f"p AS (SELECT City, avg(Temperature_C_mean) AS last_year FROM longp, s WHERE {HIST} AND Date BETWEEN a AND b GROUP BY 1), "
    "f AS (SELECT n.City, forecast, last_year, forecast - last_year AS diff FROM n JOIN p ON n.City = p.City) "
    f"SELECT {cols(key='City', num='forecast last_year diff')} FROM f",
)
def a25_versus_last_year(spark, sf):
    return finish(a.versus_last_year(*forecast_history(spark, sf), "Temperature_C_mean"))


@query(
    "a26_versus_decade",
    f"WITH {LONG}, n AS (SELECT City, avg(Temperature_C_mean) AS forecast FROM longp WHERE {FC} GROUP BY 1), "
    f"p AS (SELECT City, avg(Temperature_C_mean) AS decade FROM longp WHERE {HIST} AND year(Date) BETWEEN 1996 AND 2000 AND month(Date) IN (1, 2) GROUP BY 1), "
    "f AS (SELECT n.City, forecast, decade, forecast - decade AS diff FROM n JOIN p ON n.City = p.City) "
    f"SELECT {cols(key='City', num='forecast decade diff')} FROM f",
)
def a26_versus_decade(spark, sf):
    return finish(a.versus_years(*forecast_history(spark, sf), "Temperature_C_mean", 1996, 2000))


@query(
    "a27_annual_trends",
    f"""WITH {LONG}, y AS (SELECT year(Date) AS year, avg(Temperature_C_mean) AS temperature, CAST(sum(CASE WHEN Temperature_C_max > 35 THEN 1 ELSE 0 END) AS DOUBLE) AS hot_days,
      sum(Rain_mm_sum) / count(DISTINCT City) AS rain, CAST(sum(Fire_Occurred) AS DOUBLE) AS events FROM longp GROUP BY 1),
    u AS (UNPIVOT y ON temperature, hot_days, rain, events INTO NAME signal VALUE value),
    f AS (SELECT signal, regr_slope(value, year) AS slope, regr_intercept(value, year) AS intercept FROM u GROUP BY 1)
    SELECT signal, round(slope, 6) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept FROM f""",
)
def a27_annual_trends(spark, sf):
    out = a.annual_trends(long_panel(spark, sf))
    return finish(out).withColumn("intercept", F.round("intercept", 4) + 0.0)


@query(
    "a28_risk_change",
    f"""WITH {LONG}, n AS (SELECT City, avg(Fire_Occurred * 0.37 + 0.011) AS r FROM longp WHERE {FC} GROUP BY 1),
    s AS (SELECT min(Date) - INTERVAL 12 MONTH AS a, max(Date) - INTERVAL 12 MONTH AS b FROM longp WHERE {FC}),
    p AS (SELECT City, avg(Fire_Occurred) AS ly FROM longp, s WHERE {HIST} AND Date BETWEEN a AND b GROUP BY 1),
    d AS (SELECT City, avg(Fire_Occurred) AS dc FROM longp WHERE {HIST} AND year(Date) BETWEEN 1996 AND 2000 AND month(Date) IN (1, 2) GROUP BY 1),
    f AS (SELECT n.City, r * 100 AS risk_percent, (r - ly) * 100 AS vs_last_year, (r - dc) * 100 AS vs_decade FROM n JOIN p ON n.City = p.City JOIN d ON n.City = d.City)
    SELECT City, round(risk_percent, 1) + 0.0 AS risk_percent, round(vs_last_year, 1) + 0.0 AS vs_last_year, round(vs_decade, 1) + 0.0 AS vs_decade FROM f""",
)
def a28_risk_change(spark, sf):
    fc, hist = forecast_history(spark, sf)
    fc = fc.withColumn("fire_probability", F.col("Fire_Occurred") * 0.37 + 0.011)
    return finish(a.risk_change(fc, hist, first=1996, last=2000))


@query(
    "a29_leaderboard_means",
    f"WITH {WX}, f AS (SELECT City, avg(abs(Temperature_C - 3)) AS mae, avg(p) AS weight FROM wx GROUP BY 1) SELECT {cols(key='City', num='mae weight')} FROM f",
)
def a29_leaderboard_means(spark, sf):
    df = measurements(spark, sf).select("City", F.abs(F.col("Temperature_C") - 3).alias("mae"), F.col("p").alias("weight"))
    return finish(a.leaderboard_means(df, ["City"], ["mae", "weight"]))


@query(
    "a30_long_to_wide",
    f"WITH {DAILY} SELECT {cols(key='City', date='Date', num='Temperature_C_mean Rain_mm_sum')} FROM daily",
)
def a30_long_to_wide(spark, sf):
    names = ["Temperature_C_mean", "Rain_mm_sum"]
    long = a.melt(daily(spark, sf), ["City", "Date"], names)
    return finish(a.first_non_null(long, names))


@query(
    "a30_first_in_order",
    f"WITH {WX}, f AS (SELECT City, Date, arg_min(Temperature_C, event_id) AS Temperature_C, arg_min(Rain_mm, event_id) FILTER (Rain_mm > 0) AS Rain_mm FROM wx GROUP BY 1, 2) "
    f"SELECT {cols(key='City', date='Date', num='Temperature_C Rain_mm')} FROM f",
)
def a30_first_in_order(spark, sf):
    """The first temperature of a day and its first rain; dry measurements are null."""
    rows = measurements(spark, sf).withColumn("Rain_mm", F.when(F.col("Rain_mm") > 0, F.col("Rain_mm")))
    long = a.melt(rows, ["City", "Date", "event_id"], ["Temperature_C", "Rain_mm"])
    return finish(a.first_non_null(long, ["Temperature_C", "Rain_mm"], order="event_id"))


@query(
    "a31_entity_medians",
    f"WITH {DAILY}, f AS (SELECT City, quantile_cont(Temperature_C_mean, 0.5) AS Temperature_C_mean, quantile_cont(Rain_mm_sum, 0.5) AS Rain_mm_sum FROM daily GROUP BY 1) "
    f"SELECT {cols(key='City', num='Temperature_C_mean Rain_mm_sum')} FROM f",
)
def a31_entity_medians(spark, sf):
    return finish(a.entity_medians(daily(spark, sf).select("City", "Temperature_C_mean", "Rain_mm_sum")))


@query(
    "a32_histogram",
    f"""WITH {WX}, e AS (SELECT min(Temperature_C) AS lo, max(Temperature_C) AS hi FROM wx),
    b AS (SELECT y, least(CAST(floor((Temperature_C - lo) / ((hi - lo) / 40)) AS INTEGER), 39) AS bin, (hi - lo) / 40 AS w, lo FROM wx, e),
    g AS (SELECT y, bin, w, lo, count(*) AS n FROM b GROUP BY ALL),
    f AS (SELECT y, bin, lo + bin * w AS left_edge, n, n / (sum(n) OVER (PARTITION BY y) * w) AS density FROM g)
    SELECT {cols(int_='y bin n', num='left_edge density')} FROM f""",
)
def a32_histogram(spark, sf):
    return finish(a.histogram(measurements(spark, sf), "Temperature_C", 40, ["y"]).withColumnRenamed("left", "left_edge"))


@query(
    "a33_box_stats",
    f"""WITH {WX}, q AS (SELECT City, quantile_cont(Temperature_C, 0.25) AS q1, quantile_cont(Temperature_C, 0.5) AS q2, quantile_cont(Temperature_C, 0.75) AS q3 FROM wx GROUP BY 1),
    f AS (SELECT wx.City, 'Temperature_C' AS variable, q1, q2, q3,
      min(CASE WHEN Temperature_C BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN Temperature_C END) AS whisker_lo,
      max(CASE WHEN Temperature_C BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN Temperature_C END) AS whisker_hi,
      sum(CASE WHEN Temperature_C BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS outliers
      FROM wx JOIN q ON wx.City = q.City GROUP BY ALL)
    SELECT {cols(key='City variable', int_='outliers', num='q1 q2 q3 whisker_lo whisker_hi')} FROM f""",
)
def a33_box_stats(spark, sf):
    return finish(a.box_stats(measurements(spark, sf), ["City"], ["Temperature_C"]))


@query("a34_distinct", f"WITH {LONG} SELECT CAST(year(Date) AS BIGINT) AS Year, count(DISTINCT City) AS n_distinct FROM longp GROUP BY 1")
def a34_distinct(spark, sf):
    df = long_panel(spark, sf).withColumn("Year", F.year("Date"))
    return finish(a.distinct_count(df, "City", ["Year"]))
