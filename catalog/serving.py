from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, cols, daily, finish, hourly, long_panel, measurements, query, table
from catalog.functions import colour_sql, fwi_sql, summary_sql, tier_sql, warning_sql
from chronopanel.functions import columns, risk
from chronopanel.operators import aggregate, windows as w
from chronopanel.plans import features, master, serve, state
from chronopanel.session import scratch, stage

T, H, W, R = "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean", "Rain_mm_sum"

D1 = f"""pub AS (SELECT strftime(Date, '%Y-%m-%d') AS date, City AS region, probability, {tier_sql('probability')} AS risk_level, round(probability * 100, 1) AS risk_score,
    CAST(probability >= 0.44 AS BIGINT) AS predicted_fire, least(greatest(0.55 + 0.8 * abs(probability - 0.5), 0.55), 0.95) AS confidence, {colour_sql('probability')} AS risk_color,
    round_even({T}, 1) AS temperature, round_even({H}, 1) AS humidity, round_even({W}, 1) AS wind, round_even({R}, 2) AS rain,
    {summary_sql(T, W, H, R)} AS climate_summary, {warning_sql('probability', W, H)} AS warning, 38.5 + CAST(City AS INT) * 0.01 AS Latitude, 45 + CAST(City AS INT) * 0.02 AS Longitude FROM daily)"""
D1_KEYS, D1_INT = "date region risk_level risk_color climate_summary warning", "predicted_fire"
D1_NUM = "probability risk_score confidence temperature humidity wind rain Latitude Longitude"


def coords(df):
    n = F.col("City").cast("int")
    return df.select("City").distinct().withColumns({"Latitude": 38.5 + n * 0.01, "Longitude": 45 + n * 0.02})


def public_daily(spark, sf):
    df = daily(spark, sf)
    return serve.daily_table(df, 0.44, coords(df))


@query("d1_daily_table", f"WITH {DAILY}, {D1} SELECT {cols(key=D1_KEYS, int_=D1_INT, num=D1_NUM)} FROM pub")
def d1_daily_table(spark, sf):
    return finish(public_daily(spark, sf), *D1_KEYS.split(), D1_INT, *D1_NUM.split())


D2 = f"""day AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(p) / 2.03 AS dp FROM hourly WHERE day(Timestamp) % 3 <> 0 GROUP BY 1, 2),
  cap AS (SELECT h.*, CASE WHEN dp IS NULL THEN p ELSE least(p, greatest(2.5 * dp, 0.15)) END AS probability FROM hourly h LEFT JOIN day d ON h.City = d.City AND CAST(h.Timestamp AS DATE) = d.Date),
  pubh AS (SELECT strftime(Timestamp, '%Y-%m-%dT%H:%M') AS timestamp, City AS region, probability, {tier_sql('probability')} AS risk_level,
    CAST(probability >= 0.58 AS BIGINT) AS predicted_fire, least(greatest(0.55 + 0.8 * abs(probability - 0.5), 0.55), 0.95) AS confidence, {colour_sql('probability')} AS risk_color,
    round_even(probability * 100, 1) AS risk_score, round_even(Temperature_C, 1) AS temperature, round_even(Humidity_percent, 1) AS humidity, round_even(Wind_Speed_kmh, 1) AS wind, round_even(Solar_Radiation_Wm2, 1) AS solar FROM cap)"""
D2_KEYS, D2_NUM = "timestamp region risk_level risk_color", "probability confidence risk_score temperature humidity wind solar"


def public_hourly(spark, sf):
    h = hourly(spark, sf).withColumnRenamed("p", "probability")
    day = h.filter(F.dayofmonth("Timestamp") % 3 != 0).groupBy("City", F.to_date("Timestamp").alias("Date")).agg((F.avg("probability") / 2.03).alias("probability"))
    return serve.hourly_table(h, day, 0.58)


@query("d2_hourly_table", f"WITH {HOURLY}, {D2} SELECT {cols(key=D2_KEYS, int_='predicted_fire', num=D2_NUM)} FROM pubh")
def d2_hourly_table(spark, sf):
    return finish(public_hourly(spark, sf), *D2_KEYS.split(), "predicted_fire", *D2_NUM.split())


@query(
    "d3_map_points",
    f"WITH {DAILY}, {D1}, l AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS rn FROM pub) SELECT {cols(key=D1_KEYS, int_=D1_INT, num=D1_NUM)} FROM l WHERE rn = 1",
)
def d3_map_points(spark, sf):
    return finish(serve.map_points(public_daily(spark, sf)), *D1_KEYS.split(), D1_INT, *D1_NUM.split())


@query(
    "d4_filter_view",
    f"WITH {DAILY}, {D1} SELECT {cols(key='date region risk_level', num='probability')} FROM pub WHERE date = '2024-01-15' AND risk_level = 'Extreme'",
)
def d4_filter_view(spark, sf):
    out = serve.select_view(public_daily(spark, sf), day="2024-01-15", level="Extreme")
    return finish(out, "date", "region", "risk_level", "probability")


@query("d4_region_series", f"WITH {HOURLY}, {D2} SELECT {cols(key='timestamp region', num='probability')} FROM pubh WHERE region = 'click' AND timestamp LIKE '2024-01-1%'")
def d4_region_series(spark, sf):
    out = serve.select_view(public_hourly(spark, sf), region="click", day="2024-01-1", stamp="timestamp")
    return finish(out, "timestamp", "region", "probability")


@query(
    "d4_first_hours",
    f"WITH {HOURLY}, {D2}, l AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp) AS rn FROM pubh) SELECT {cols(key='timestamp region risk_level', num='probability')} FROM l WHERE rn = 1",
)
def d4_first_hours(spark, sf):
    return finish(serve.first_hours(public_hourly(spark, sf)), "timestamp", "region", "risk_level", "probability")


def panel_of_days(spark, sf):
    """Measurements to the hourly spine's daily panel."""
    return aggregate.daily_panel(hourly(spark, sf))


def risk_by_day(spark, sf):
    """Daily panel, indices and dry streak, an index-driven probability, the public table."""
    df = w.indexed(stage(panel_of_days(spark, sf)), w.DAILY)
    _, _, _, r = features.inputs(df)
    df = w.streak(df, r < 0.1, "dry_days_streak")
    df = features.fire_weather_indices(df)
    trailing = lambda o: {**w.lag_columns(o, [T], [1]), **w.rolling_columns(o, [T], [7])}
    df = w.unindexed(w.bounded(df, w.DAILY, trailing, 7))
    p = columns.clip(F.col("FFMC_proxy") / 137.0 + F.col("FWI_proxy") / 61.0 + F.col("dry_days_streak") / 29.0, 0.0, 1.0)
    return df.withColumn("probability", p)


RISK_PANEL = f"""days AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(Temperature_C) AS {T}, avg(Humidity_percent) AS {H}, avg(Wind_Speed_kmh) AS {W}, sum(Rain_mm) AS {R},
    sum(CASE WHEN Temperature_C > 30 THEN 1 ELSE 0 END) AS hours_temp_above_30 FROM hourly GROUP BY 1, 2)"""
RISK = f"""dryd AS (SELECT *, CASE WHEN {R} < 0.1 THEN 1 ELSE 0 END AS dry FROM fwi), isl AS (SELECT *, sum(1 - dry) OVER (PARTITION BY City ORDER BY Date) AS island FROM dryd),
  stk AS (SELECT *, sum(dry) OVER (PARTITION BY City, island ORDER BY Date) AS dry_days_streak, lag({T}) OVER (PARTITION BY City ORDER BY Date) AS {T}_lag1,
    avg({T}) OVER (PARTITION BY City ORDER BY Date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS {T}_roll7_mean FROM isl),
  rsk AS (SELECT *, least(greatest(FFMC_proxy / 137.0 + FWI_proxy / 61.0 + dry_days_streak / 29.0, 0), 1) AS probability FROM stk),
  fin AS (SELECT City, Date, {tier_sql('probability')} AS risk_level, probability, least(greatest(0.55 + 0.8 * abs(probability - 0.5), 0.55), 0.95) AS confidence,
    FFMC_proxy, FWI_proxy, dry_days_streak, hours_temp_above_30, {T}_lag1, {T}_roll7_mean FROM rsk)"""
RISK_NUM = f"probability confidence FFMC_proxy FWI_proxy {T}_lag1 {T}_roll7_mean"


@query(
    "daily_risk",
    f"WITH {HOURLY}, {RISK_PANEL}, {fwi_sql('days')}, {RISK} SELECT {cols(key='City risk_level', date='Date', int_='dry_days_streak hours_temp_above_30', num=RISK_NUM)} FROM fin",
)
def daily_risk(spark, sf):
    """Risk tier by entity and day, from raw measurements to the tier."""
    df = risk_by_day(spark, sf)
    p = F.col("probability")
    out = df.withColumns({"risk_level": risk.tier(p), "confidence": risk.confidence(p)})
    return finish(out, "City", "risk_level", "Date", "dry_days_streak", "hours_temp_above_30", *RISK_NUM.split())


FEATURES = f"{T}_lag1 {T}_lag30 {T}_roll30_mean {R}_roll7_std FWI_proxy_lag7 VPD_kPa_roll3_mean temp_x_wind Rainfall_Deficit {T}_anomaly city_fire_rate"


@query(
    "feature_surface",
    f"""WITH {DAILY}, {fwi_sql('daily')}, v AS (SELECT *, greatest(0.6108 * exp(17.27 * {T} / ({T} + 237.3)) * (1 - {H} / 100), 0) AS VPD_kPa FROM fwi),
    c AS (SELECT City, month(Date) AS m, avg({T}) AS ct, avg({R}) AS cr FROM daily WHERE Date < DATE '2024-01-20' GROUP BY 1, 2),
    x AS (SELECT *, lag({T}, 1) OVER o AS {T}_lag1, lag({T}, 30) OVER o AS {T}_lag30, avg({T}) OVER (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS {T}_roll30_mean,
      stddev_samp({R}) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS {R}_roll7_std, lag(FWI_proxy, 7) OVER o AS FWI_proxy_lag7,
      avg(VPD_kPa) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS VPD_kPa_roll3_mean, {T} * {W} / 100 AS temp_x_wind,
      coalesce(sum({R}) OVER (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS r30, coalesce(avg(Fire_Occurred) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS city_fire_rate
      FROM v WINDOW o AS (PARTITION BY City ORDER BY Date)),
    f AS (SELECT x.*, cr * 30 - r30 AS Rainfall_Deficit, {T} - ct AS {T}_anomaly FROM x LEFT JOIN c ON x.City = c.City AND month(x.Date) = c.m)
    SELECT {cols(key='City', date='Date', num=FEATURES)} FROM f""",
)
def feature_surface(spark, sf):
    """The whole daily feature plan; a few of its columns are compared."""
    df = stage(daily(spark, sf))
    fitted = features.fit(df.filter(F.col("Date") < F.lit("2024-01-20").cast("date")))
    return finish(features.daily_features(df, fitted), "City", "Date", *FEATURES.split())


HF = "Temperature_C_lag6h Rain_mm_roll12h_mean Hour_sin"


@query(
    "feature_surface_hourly",
    f"""WITH {HOURLY}, f AS (SELECT City, Timestamp, lag(Temperature_C, 6) OVER o AS Temperature_C_lag6h, avg(Rain_mm) OVER (o ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS Rain_mm_roll12h_mean,
      sin(2 * pi() * hour(Timestamp) / 24) AS Hour_sin, CAST(hour(Timestamp) BETWEEN 6 AND 20 AS INT) AS is_daytime FROM hourly WINDOW o AS (PARTITION BY City ORDER BY Timestamp))
    SELECT {cols(key='City', stamp='Timestamp', num=HF, int_='is_daytime')} FROM f""",
)
def feature_surface_hourly(spark, sf):
    return finish(features.hourly_features(hourly(spark, sf)), "City", "Timestamp", "is_daytime", *HF.split())


# rows that the serving state stands for, rows that move it forward in two steps, forecast rows
STEPS, LAST = ("2000-07-01", "2001-01-01", "2001-01-15"), "2001-02-14"
SERVED = f"{T}_lag1 {T}_lag30 {T}_roll30_mean {R}_roll7_std FWI_proxy FWI_proxy_lag7 {R}_roll30_mean {T}_anomaly Rainfall_Deficit city_fire_rate city_month_fire_rate"
COUNTED = "dry_days_streak dry_days_streak_lag3 days_since_last_fire fire_count_7d fire_count_90d"


@query(
    "serving_daily",
    f"""WITH {LONG}, src AS (SELECT City, Date, {T}, {H}, {W}, {R}, CASE WHEN Date < DATE '{STEPS[-1]}' THEN Fire_Occurred END AS Fire_Occurred FROM longp WHERE Date < DATE '{LAST}'), {fwi_sql('src')},
    c AS (SELECT City, month(Date) AS m, avg({T}) AS ct, avg({R}) AS cr FROM src WHERE Date < DATE '{STEPS[-1]}' GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY City ORDER BY Date) AS pos, CASE WHEN {R} < 0.1 THEN 1 ELSE 0 END AS dry FROM fwi),
    i AS (SELECT *, pos - coalesce(max(CASE WHEN dry = 0 THEN pos END) OVER (PARTITION BY City ORDER BY Date), 0) AS dry_days_streak FROM n),
    x AS (SELECT *, lag({T}, 1) OVER o AS {T}_lag1, lag({T}, 30) OVER o AS {T}_lag30, avg({T}) OVER (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS {T}_roll30_mean,
      stddev_samp({R}) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS {R}_roll7_std, lag(FWI_proxy, 7) OVER o AS FWI_proxy_lag7, lag(dry_days_streak, 3) OVER o AS dry_days_streak_lag3,
      avg({R}) OVER (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS {R}_roll30_mean, coalesce(sum({R}) OVER (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS r30,
      least(coalesce(pos - max(CASE WHEN Fire_Occurred = 1 THEN pos END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9999), 365) AS days_since_last_fire,
      sum(Fire_Occurred) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS fire_count_7d, sum(Fire_Occurred) OVER (o ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS fire_count_90d,
      coalesce(avg(Fire_Occurred) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS city_fire_rate,
      coalesce(avg(Fire_Occurred) OVER (PARTITION BY City, month(Date) ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS city_month_fire_rate
      FROM i WINDOW o AS (PARTITION BY City ORDER BY Date)),
    f AS (SELECT x.*, {T} - ct AS {T}_anomaly, cr * 30 - r30 AS Rainfall_Deficit FROM x LEFT JOIN c ON x.City = c.City AND month(x.Date) = c.m WHERE Date >= DATE '{STEPS[-1]}')
    SELECT {cols(key='City', date='Date', num=SERVED, int_=COUNTED)} FROM f""",
)
def serving_daily(spark, sf):
    """Features of 30 days from the saved state alone: fitted on years, moved forward twice."""
    panel = stage(long_panel(spark, sf).select("City", "Date", T, H, W, R, "Fire_Occurred"))
    day = [F.lit(d).cast("date") for d in (*STEPS, LAST)]
    path = scratch(spark, "serving-state")
    state.fit(panel.filter(F.col("Date") < day[0])).save(path)
    for lo, hi in ((day[0], day[1]), (day[1], day[2])):
        state.advance(state.load(spark, path), panel.filter((F.col("Date") >= lo) & (F.col("Date") < hi))).save(path)
    fitted = features.fit(panel.filter(F.col("Date") < day[2]))
    forecast = panel.filter((F.col("Date") >= day[2]) & (F.col("Date") < day[3])).drop("Fire_Occurred")
    out = state.daily(forecast, state.load(spark, path), fitted)
    return finish(out, "City", "Date", *SERVED.split(), *COUNTED.split())


HS = "Temperature_C_lag24h Temperature_C_lag1h Rain_mm_roll24h_mean Wind_Speed_kmh_roll6h_std Hour_sin"
HOURS = ("2024-01-20", "2024-01-24")


@query(
    "serving_hourly",
    f"""WITH {HOURLY}, f AS (SELECT City, Timestamp, lag(Temperature_C, 24) OVER o AS Temperature_C_lag24h, lag(Temperature_C) OVER o AS Temperature_C_lag1h,
      avg(Rain_mm) OVER (o ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS Rain_mm_roll24h_mean, stddev_samp(Wind_Speed_kmh) OVER (o ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS Wind_Speed_kmh_roll6h_std,
      sin(2 * pi() * hour(Timestamp) / 24) AS Hour_sin FROM hourly WINDOW o AS (PARTITION BY City ORDER BY Timestamp))
    SELECT {cols(key='City', stamp='Timestamp', num=HS)} FROM f WHERE Timestamp >= TIMESTAMP '{HOURS[1]}'""",
)
def serving_hourly(spark, sf):
    """Hourly features of the following week from the saved tail alone."""
    panel = stage(hourly(spark, sf).drop("p"))
    at = [F.lit(d).cast("timestamp_ntz") for d in HOURS]
    path = scratch(spark, "serving-state-hourly")
    state.fit(panel.filter(F.col("Timestamp") < at[0]), w.HOURLY).save(path)
    new = panel.filter((F.col("Timestamp") >= at[0]) & (F.col("Timestamp") < at[1]))
    state.advance(state.load(spark, path), new, w.HOURLY).save(path)
    out = state.hourly(panel.filter(F.col("Timestamp") >= at[1]), state.load(spark, path))
    return finish(out, "City", "Timestamp", *HS.split())


# detections, regions and sparse tables around the hourly panel; the twin builds the same
PLACES = """reg AS (SELECT DISTINCT City, 38.5 + length(City) * 0.07 AS lat, 45 + length(City) * 0.11 AS lon FROM hourly),
  pts AS (SELECT Date, 38.8 + (event_id % 50) * 0.01 AS latitude, 45.3 + (user_id % 40) * 0.02 AS longitude, Temperature_C AS brightness, Wind_Speed_kmh AS frp FROM wx),
  ev AS (SELECT City, Date, count(*) AS fire_count, avg(brightness) AS mean_brightness, max(frp) AS max_frp, 1 AS Fire_Occurred FROM pts, reg
    WHERE day(Date) % 2 = 0 AND latitude BETWEEN lat - 20.0 / 111.32 AND lat + 20.0 / 111.32
      AND longitude BETWEEN lon - 20.0 / (111.32 * cos(radians(lat))) AND lon + 20.0 / (111.32 * cos(radians(lat))) GROUP BY 1, 2),
  ba AS (SELECT City, Date, max(Pressure_hPa) AS Burned_Area_hectares FROM wx WHERE day(Date) % 5 = 0 GROUP BY 1, 2),
  ve AS (SELECT City, Date, avg(Soil_Moisture) AS NDVI, avg(Soil_Temp_C) AS NDBI FROM wx WHERE day(Date) % 8 = 3 GROUP BY 1, 2),
  st AS (SELECT City, lat * 10 AS Elevation, lat AS Latitude FROM reg)"""


def places(spark, sf):
    """Labels, burned area, vegetation and geography of the panel's entities."""
    wx = measurements(spark, sf)
    n = F.length("City")
    regions = hourly(spark, sf).select("City").distinct().select("City", (38.5 + n * 0.07).alias("lat"), (45 + n * 0.11).alias("lon"))
    points = wx.filter(F.dayofmonth("Date") % 2 == 0).select(
        F.col("Date").alias("acq_date"), (38.8 + (F.col("event_id") % 50) * 0.01).alias("latitude"), (45.3 + (F.col("user_id") % 40) * 0.02).alias("longitude"),
        F.col("Temperature_C").alias("brightness"), F.col("Wind_Speed_kmh").alias("frp"),
    )
    burned = wx.filter(F.dayofmonth("Date") % 5 == 0).select("City", "Date", F.col("Pressure_hPa").alias("Burned_Area_hectares"))
    green = wx.filter(F.dayofmonth("Date") % 8 == 3).select("City", "Date", F.col("Soil_Moisture").alias("NDVI"), F.col("Soil_Temp_C").alias("NDBI"))
    static = regions.select("City", (F.col("lat") * 10).alias("Elevation"), F.col("lat").alias("Latitude"))
    return dict(events=master.event_labels(points, regions), burned=burned, vegetation=[green], static=static)


MASTER = "mean_brightness max_frp Burned_Area_hectares NDVI NDBI Elevation Latitude"


def master_sql(src, order):
    """The panel `src` (City, Date and more) with the tables of PLACES."""
    carried = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY p.City ORDER BY {order} ROWS UNBOUNDED PRECEDING), 0) AS {c}" for c in ("NDVI", "NDBI"))
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("fire_count", "mean_brightness", "max_frp", "Fire_Occurred", "Burned_Area_hectares", "Elevation", "Latitude"))
    return f"""mas AS (SELECT p.*, {zero}, {carried} FROM {src} p LEFT JOIN ev ON p.City = ev.City AND p.Date = ev.Date LEFT JOIN ba ON p.City = ba.City AND p.Date = ba.Date
      LEFT JOIN ve ON p.City = ve.City AND p.Date = ve.Date LEFT JOIN st ON p.City = st.City)"""


@query(
    "master_daily",
    f"WITH {HOURLY}, {PLACES}, {RISK_PANEL}, {master_sql('days', 'p.Date')} SELECT {cols(key='City', date='Date', num=f'{T} {R} {MASTER}', int_='fire_count Fire_Occurred hours_temp_above_30')}, CAST(month(Date) AS BIGINT) AS Month, CAST(dayofyear(Date) AS BIGINT) AS DayOfYear FROM mas",
)
def master_daily(spark, sf):
    """Measurements, detections in squares, burned area, vegetation and geography as one daily panel."""
    out = master.master_daily(hourly(spark, sf).drop("p"), **places(spark, sf))
    return finish(out, "City", "Date", T, R, *MASTER.split(), "fire_count", "Fire_Occurred", "hours_temp_above_30", "Month", "DayOfYear")


@query(
    "master_hourly",
    f"WITH {HOURLY}, {PLACES}, hr AS (SELECT *, CAST(Timestamp AS DATE) AS Date FROM hourly), {master_sql('hr', 'p.Timestamp')} SELECT {cols(key='City', stamp='Timestamp', num=f'Temperature_C Rain_mm {MASTER}', int_='fire_count Fire_Occurred')}, CAST(hour(Timestamp) AS BIGINT) AS Hour, CAST(month(Timestamp) AS BIGINT) AS Month FROM mas",
)
def master_hourly(spark, sf):
    """The same tables around every hour."""
    out = master.master_hourly(hourly(spark, sf).drop("p"), **places(spark, sf))
    return finish(out, "City", "Timestamp", "Temperature_C", "Rain_mm", *MASTER.split(), "fire_count", "Fire_Occurred", "Hour", "Month")
