from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, WX, clip_sql, cols, daily, finish, hourly, long_panel, measurements, query
from chronopanel.functions import calendar as c
from chronopanel.functions import columns as fc
from chronopanel.functions import risk, weather
from chronopanel.plans import features
from chronopanel.schema import BOUNDS
from chronopanel.session import stage

T, H, W, R = "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean", "Rain_mm_sum"


@query(
    "f1_calendar_parts",
    f"WITH {LONG} SELECT City, strftime(Date, '%Y-%m-%d') AS Date, year(Date) AS Year, month(Date) AS Month, dayofyear(Date) AS DayOfYear, "
    "isodow(Date) - 1 AS DayOfWeek, weekofyear(Date) AS WeekOfYear FROM longp",
)
def f1_calendar_parts(spark, sf):
    return finish(c.add_calendar(long_panel(spark, sf)), "City", "Date", "Year", "Month", "DayOfYear", "DayOfWeek", "WeekOfYear")


CYC = "Month_sin Month_cos DoY_sin DoY_cos DoW_sin DoW_cos"


@query(
    "f2_cyclic",
    f"WITH {LONG}, f AS (SELECT City, Date, "
    + ", ".join(
        f"{fn}(2 * pi() * {expr} / {period}) AS {stem}_{fn}"
        for stem, expr, period in (("Month", "month(Date)", 12), ("DoY", "dayofyear(Date)", 365), ("DoW", "(isodow(Date) - 1)", 7))
        for fn in ("sin", "cos")
    )
    + f" FROM longp) SELECT {cols(key='City', date='Date', num=CYC)} FROM f",
)
def f2_cyclic(spark, sf):
    return finish(c.add_calendar(long_panel(spark, sf)), "City", "Date", *CYC.split())


@query(
    "f2_cyclic_hour",
    f"WITH {HOURLY}, f AS (SELECT City, Timestamp, hour(Timestamp) AS Hour, sin(2 * pi() * hour(Timestamp) / 24) AS Hour_sin, cos(2 * pi() * hour(Timestamp) / 24) AS Hour_cos, "
    "CASE WHEN hour(Timestamp) BETWEEN 6 AND 20 THEN 1 ELSE 0 END AS is_daytime FROM hourly) "
    f"SELECT {cols(key='City', stamp='Timestamp', int_='Hour is_daytime', num='Hour_sin Hour_cos')} FROM f",
)
def f2_cyclic_hour(spark, sf):
    return finish(c.add_hourly_calendar(hourly(spark, sf)), "City", "Timestamp", "Hour", "Hour_sin", "Hour_cos", "is_daytime")


@query(
    "f3_season_flags",
    f"WITH {LONG}, f AS (SELECT City, Date, CASE WHEN month(Date) IN (12, 1, 2) THEN 0 WHEN month(Date) <= 5 THEN 1 WHEN month(Date) <= 8 THEN 2 ELSE 3 END AS Season, "
    "CAST(month(Date) IN (6, 7, 8) AS INT) AS is_summer, CAST(month(Date) IN (12, 1, 2) AS INT) AS is_winter, CAST(month(Date) BETWEEN 5 AND 9 AS INT) AS is_fire_season FROM longp) "
    f"SELECT {cols(key='City', date='Date', int_='Season is_summer is_winter is_fire_season')} FROM f",
)
def f3_season_flags(spark, sf):
    return finish(c.add_calendar(long_panel(spark, sf)), "City", "Date", "Season", "is_summer", "is_winter", "is_fire_season")


FWI = "FFMC_proxy DMC_proxy DC_proxy ISI_proxy BUI_proxy FWI_proxy"


def fwi_sql(src, extra=""):
    """CTEs ending in `fwi` with the six indices of the panel `src`."""
    o = "OVER (PARTITION BY City ORDER BY Date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return f"""m AS (SELECT *, {clip_sql(f"100 - ({H} * 0.5 + least(greatest({R}, 0), 10) * 3 - least(greatest({T}, 0), 40) * 0.5)", 0, 100)} AS FFMC_proxy,
      greatest(avg(greatest({T}, 0) * 0.3 - {R} * 0.8 + (100 - {H}) * 0.1) {o.format(13)}, 0) AS DMC_proxy,
      greatest(sum(greatest({T}, 0) * 0.2 - {R} * 0.5) {o.format(29)}, 0) AS DC_proxy FROM {src}),
    fwi0 AS (SELECT *, FFMC_proxy / 100 * ({W} * 0.3) AS ISI_proxy, (DMC_proxy + DC_proxy) / 2 AS BUI_proxy FROM m),
    fwi AS (SELECT *, greatest(ISI_proxy * BUI_proxy / 50, 0) AS FWI_proxy FROM fwi0)"""


@query("f4_fire_weather", f"WITH {DAILY}, {fwi_sql('daily')} SELECT {cols(key='City', date='Date', num=FWI)} FROM fwi")
def f4_fire_weather(spark, sf):
    return finish(features.fire_weather_indices(daily(spark, sf)), "City", "Date", *FWI.split())


@query(
    "f5_vapour_deficit",
    f"WITH {WX}, f AS (SELECT event_id, greatest(0.6108 * exp(17.27 * Temperature_C / (Temperature_C + 237.3)) * (1 - Humidity_percent / 100), 0) AS VPD_kPa FROM wx) "
    f"SELECT {cols(key='event_id', num='VPD_kPa')} FROM f",
)
def f5_vapour_deficit(spark, sf):
    v = weather.vapour_deficit(F.col("Temperature_C"), F.col("Humidity_percent"))
    return finish(measurements(spark, sf).select("event_id", v.alias("VPD_kPa")))


@query(
    "f6_dew_point",
    f"WITH {WX}, g AS (SELECT event_id, 17.27 * Temperature_C / (237.3 + Temperature_C) + ln(greatest(Humidity_percent, 1) / 100) AS a FROM wx), "
    f"f AS (SELECT event_id, 237.3 * a / (17.27 - a) AS Dew_Point_C FROM g) SELECT {cols(key='event_id', num='Dew_Point_C')} FROM f",
)
def f6_dew_point(spark, sf):
    v = weather.dew_point(F.col("Temperature_C"), F.col("Humidity_percent"))
    return finish(measurements(spark, sf).select("event_id", v.alias("Dew_Point_C")))


@query(
    "f7_heat_index",
    f"""WITH {WX}, g AS (SELECT event_id, Temperature_C AS c, Temperature_C * 9 / 5 + 32 AS t, Humidity_percent AS h FROM wx),
    f AS (SELECT event_id, CASE WHEN c > 27 THEN (-42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 6.83783e-3 * t * t - 5.481717e-2 * h * h
      + 1.22874e-3 * t * t * h + 8.5282e-4 * t * h * h - 1.99e-6 * t * t * h * h - 32) * 5 / 9 ELSE c END AS Heat_Index FROM g)
    SELECT {cols(key='event_id', num='Heat_Index')} FROM f""",
)
def f7_heat_index(spark, sf):
    v = weather.heat_index(F.col("Temperature_C"), F.col("Humidity_percent"))
    return finish(measurements(spark, sf).select("event_id", v.alias("Heat_Index")))


FLAGS = "heatwave_flag low_humidity_flag high_wind_flag dry_spell_flag hot_dry_windy"


@query(
    "f8_extreme_flags",
    f"""WITH {DAILY}, a AS (SELECT *, CASE WHEN Rain_mm_sum < 0.1 THEN 1 ELSE 0 END AS dry FROM daily),
    b AS (SELECT *, sum(1 - dry) OVER (PARTITION BY City ORDER BY Date) AS island FROM a),
    s AS (SELECT *, sum(dry) OVER (PARTITION BY City, island ORDER BY Date) AS streak FROM b),
    q AS (SELECT quantile_cont({T}, 0.95) AS t95, quantile_cont({H}, 0.1) AS h10, quantile_cont({W}, 0.9) AS w90 FROM daily),
    f AS (SELECT City, Date, CAST({T} > t95 AS INT) AS heatwave_flag, CAST({H} < h10 AS INT) AS low_humidity_flag, CAST({W} > w90 AS INT) AS high_wind_flag, CAST(streak >= 7 AS INT) AS dry_spell_flag FROM s, q),
    g AS (SELECT *, heatwave_flag * low_humidity_flag * high_wind_flag AS hot_dry_windy FROM f)
    SELECT {cols(key='City', date='Date', int_=FLAGS)} FROM g""",
)
def f8_extreme_flags(spark, sf):
    df = stage(daily(spark, sf))
    return finish(features.extreme_weather(df, features.fit_thresholds(df)), "City", "Date", *FLAGS.split())


INTER = "temp_x_low_hum temp_x_wind dry_days_x_wind NDVI_x_drought forest_x_dry_days NDVI_x_VPD"


@query(
    "f9_interactions",
    f"""WITH {WX}, f AS (SELECT event_id, Temperature_C * (100 - Humidity_percent) / 100 AS temp_x_low_hum, Temperature_C * Wind_Speed_kmh / 100 AS temp_x_wind,
      (event_id % 9) * Wind_Speed_kmh / 100 AS dry_days_x_wind, Soil_Moisture * Rain_mm / 100 AS NDVI_x_drought, Soil_Temp_C * (event_id % 9) / 100 AS forest_x_dry_days, Soil_Moisture * Pressure_hPa AS NDVI_x_VPD FROM wx)
    SELECT {cols(key='event_id', num=INTER)} FROM f""",
)
def f9_interactions(spark, sf):
    made = weather.interactions(
        *[F.col(x) for x in ("Temperature_C", "Humidity_percent", "Wind_Speed_kmh")],
        F.col("event_id") % 9,
        *[F.col(x) for x in ("Soil_Moisture", "Rain_mm", "Soil_Temp_C", "Pressure_hPa")],
    )
    return finish(measurements(spark, sf).withColumns(made), "event_id", *INTER.split())


@query("f10_temp_range", f"WITH {DAILY}, f AS (SELECT City, Date, Temperature_C_max - Temperature_C_min AS temp_range FROM daily) SELECT {cols(key='City', date='Date', num='temp_range')} FROM f")
def f10_temp_range(spark, sf):
    df = daily(spark, sf).withColumn("temp_range", F.col("Temperature_C_max") - F.col("Temperature_C_min"))
    return finish(df, "City", "Date", "temp_range")


def tier_sql(p, op=">="):
    return f"CASE WHEN {p} {op} 0.6 THEN 'Extreme' WHEN {p} {op} 0.35 THEN 'High' WHEN {p} {op} 0.15 THEN 'Moderate' ELSE 'Low' END"


@query("f11_risk_tier", f"WITH {WX} SELECT event_id, {tier_sql('p')} AS lower_closed, {tier_sql('p', '>')} AS upper_closed FROM wx")
def f11_risk_tier(spark, sf):
    p = F.col("p")
    return finish(measurements(spark, sf).select("event_id", risk.tier(p).alias("lower_closed"), risk.tier(p, "right").alias("upper_closed")))


@query("f12_confidence", f"WITH {WX}, f AS (SELECT event_id, least(greatest(0.55 + 0.8 * abs(p - 0.5), 0.55), 0.95) AS confidence FROM wx) SELECT {cols(key='event_id', num='confidence')} FROM f")
def f12_confidence(spark, sf):
    return finish(measurements(spark, sf).select("event_id", risk.confidence(F.col("p")).alias("confidence")))


@query(
    "f13_rounding",
    f"WITH {WX} SELECT event_id, round_even(Temperature_C, 1) + 0.0 AS one, round_even(Temperature_C, 2) + 0.0 AS two, round(p * 100, 1) AS risk_score FROM wx",
)
def f13_rounding(spark, sf):
    t = F.col("Temperature_C")
    return measurements(spark, sf).select(
        "event_id", (fc.round_even(t, 1) + 0.0).alias("one"), (fc.round_even(t, 2) + 0.0).alias("two"), risk.risk_score(F.col("p")).alias("risk_score")
    )


@query("f14_predicted", f"WITH {WX}, f AS (SELECT event_id, CAST(p >= 0.44 AS INT) AS predicted_fire FROM wx) SELECT {cols(key='event_id', int_='predicted_fire')} FROM f")
def f14_predicted(spark, sf):
    return finish(measurements(spark, sf).select("event_id", risk.predicted(F.col("p"), 0.44).alias("predicted_fire")))


def colour_sql(p):
    return f"CASE {tier_sql(p)} WHEN 'Low' THEN '#3FA773' WHEN 'Moderate' THEN '#D8A31D' WHEN 'High' THEN '#D96C3B' ELSE '#B73333' END"


@query("f15_colour", f"WITH {WX} SELECT event_id, {colour_sql('p')} AS risk_color FROM wx")
def f15_colour(spark, sf):
    return finish(measurements(spark, sf).select("event_id", risk.colour(risk.tier(F.col("p"))).alias("risk_color")))


def summary_sql(t, w, h, r):
    first = lambda k: risk.PHRASES[k][0].upper() + risk.PHRASES[k][1:]
    return f"""(CASE WHEN {t} >= 28 THEN '{first("hot")}' WHEN {t} <= 12 THEN '{first("cool")}' ELSE '{first("mild")}' END)
      || (CASE WHEN {w} >= 18 THEN ', {risk.PHRASES["wind"]}' ELSE '' END) || (CASE WHEN {h} <= 40 THEN ', {risk.PHRASES["dry"]}' ELSE '' END)
      || (CASE WHEN {r} >= 2 THEN ', {risk.PHRASES["rain"]}' ELSE '' END) || '.'"""


def warning_sql(p, w, h):
    return f"""CASE WHEN {p} >= 0.35 THEN '{risk.WARNINGS["risk"]}'
      WHEN {w} >= 18 THEN '{risk.WARNINGS["wind"]}'
      WHEN {h} <= 40 THEN '{risk.WARNINGS["dry"]}'
      ELSE '{risk.WARNINGS["none"]}' END"""


@query("f16_summary", f"WITH {WX} SELECT event_id, {summary_sql('Temperature_C', 'Wind_Speed_kmh', 'Humidity_percent', 'Rain_mm')} AS climate_summary FROM wx")
def f16_summary(spark, sf):
    text = risk.climate_summary(*[F.col(x) for x in ("Temperature_C", "Wind_Speed_kmh", "Humidity_percent", "Rain_mm")])
    return finish(measurements(spark, sf).select("event_id", text.alias("climate_summary")))


@query("f17_warning", f"WITH {WX} SELECT event_id, {warning_sql('p', 'Wind_Speed_kmh', 'Humidity_percent')} AS warning FROM wx")
def f17_warning(spark, sf):
    text = risk.warning_text(risk.tier(F.col("p")), F.col("Wind_Speed_kmh"), F.col("Humidity_percent"))
    return finish(measurements(spark, sf).select("event_id", text.alias("warning")))


@query(
    "f18_date_text",
    f"WITH {WX} SELECT event_id, strftime(Date, '%Y-%m-%d') AS date_text, strftime(Timestamp, '%Y-%m-%dT%H:%M') AS minute_text FROM wx",
)
def f18_date_text(spark, sf):
    return finish(measurements(spark, sf).select("event_id", c.iso_date(F.col("Date")).alias("date_text"), c.iso_minute(F.col("Timestamp")).alias("minute_text")))


@query(
    "f19_hourly_ceiling",
    f"""WITH {HOURLY}, d AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(p) / 1.97 AS daily_prob FROM hourly WHERE day(Timestamp) % 3 <> 0 GROUP BY 1, 2),
    f AS (SELECT h.City, h.Timestamp, CASE WHEN daily_prob IS NULL THEN p ELSE least(p, greatest(2.5 * daily_prob, 0.15)) END AS probability
      FROM hourly h LEFT JOIN d ON h.City = d.City AND CAST(h.Timestamp AS DATE) = d.Date)
    SELECT {cols(key='City', stamp='Timestamp', num='probability')} FROM f""",
)
def f19_hourly_ceiling(spark, sf):
    from chronopanel.plans.serve import cap_hourly

    h = hourly(spark, sf).select("City", "Timestamp", F.col("p").alias("probability"))
    days = h.filter(F.dayofmonth("Timestamp") % 3 != 0).groupBy("City", F.to_date("Timestamp").alias("Date")).agg((F.avg("probability") / 1.97).alias("probability"))
    return finish(cap_hourly(h, days), "City", "Timestamp", "probability")


@query(
    "f20_bounds_table",
    f"WITH {DAILY}, f AS ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {lo} AS lo, {hi} AS hi, min({v}) AS seen_lo, max({v}) AS seen_hi FROM daily"
        for v, (lo, hi) in BOUNDS.items()
        if v in (T, H, R, W, "Pressure_hPa_mean")
    )
    + f") SELECT {cols(key='variable', num='lo hi seen_lo seen_hi')} FROM f",
)
def f20_bounds_table(spark, sf):
    from chronopanel.operators.quality import observed_bounds

    df = daily(spark, sf)
    bounds = {k: v for k, v in BOUNDS.items() if k in (T, H, R, W, "Pressure_hPa_mean")}
    return finish(observed_bounds(df, bounds))


@query("f21_first_present", f"WITH {WX}, f AS (SELECT event_id, p AS probability, 50.0 AS humidity FROM wx) SELECT {cols(key='event_id', num='probability humidity')} FROM f")
def f21_first_present(spark, sf):
    df = measurements(spark, sf)
    return finish(
        df.select(
            "event_id",
            fc.first_present(df, ["fire_probability", "p"]).alias("probability"),
            fc.first_present(df, ["relative_humidity"], 50.0).alias("humidity"),
        )
    )
