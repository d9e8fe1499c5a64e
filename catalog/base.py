"""Registry and the panels that queries derive from the driver tables.

The panels rename table columns to the library's data model, so operators run with
their defaults. Divisors are no round numbers, which keeps results off rounding ties. Each has a DuckDB twin as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def finish(df: DataFrame, *names) -> DataFrame:
    """Output form shared with the SQL side: doubles to 6 places, times as text, counts as long."""
    out = []
    for f in df.select(*names).schema if names else df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def cols(num="", date="", stamp="", key="", int_="") -> str:
    """The SQL side of `finish`: space separated names by type."""
    out = [k for k in key.split()]
    out += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in date.split()]
    out += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamp.split()]
    out += [f"CAST({c} AS BIGINT) AS {c}" for c in int_.split()]
    out += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in num.split()]
    return ", ".join(out)


def clip_sql(x: str, lo=None, hi=None) -> str:
    """Bound an expression; null stays null."""
    e = x
    if hi is not None:
        e = f"least({e}, {hi})"
    if lo is not None:
        e = f"greatest({e}, {lo})"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {e} END"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


# -- measurements: one row per event with the nine weather variables ------------------

WX = """
wx AS (
  SELECT event_type AS City, user_id, event_id, ts AS Timestamp, CAST(ts AS DATE) AS Date,
    value / 9.6913 - 5 AS Temperature_C, 100 - value / 5.1097 AS Humidity_percent,
    CASE WHEN event_id % 4 = 0 THEN value / 49.6931 ELSE 0.0 END AS Rain_mm,
    value / 16.2917 AS Wind_Speed_kmh, CAST(event_id % 360 AS DOUBLE) AS Wind_Dir_deg,
    1000 + value / 99.0713 AS Pressure_hPa,
    CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN value / 1.0297 ELSE 0.0 END AS Solar_Radiation_Wm2,
    value / 20.2931 AS Soil_Temp_C, value / 997.2913 AS Soil_Moisture,
    ((event_id * 37) % 1000) / 1000.0 AS p, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y
  FROM events
)"""


def measurements(spark, sf) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("City"),
        "user_id",
        "event_id",
        F.col("ts").alias("Timestamp"),
        F.to_date("ts").alias("Date"),
        (v / 9.6913 - 5).alias("Temperature_C"),
        (100 - v / 5.1097).alias("Humidity_percent"),
        F.when(i % 4 == 0, v / 49.6931).otherwise(0.0).alias("Rain_mm"),
        (v / 16.2917).alias("Wind_Speed_kmh"),
        (i % 360).cast("double").alias("Wind_Dir_deg"),
        (1000 + v / 99.0713).alias("Pressure_hPa"),
        F.when(F.hour("ts").between(6, 18), v / 1.0297).otherwise(0.0).alias("Solar_Radiation_Wm2"),
        (v / 20.2931).alias("Soil_Temp_C"),
        (v / 997.2913).alias("Soil_Moisture"),
        (((i * 37) % 1000) / 1000.0).alias("p"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )


# -- hourly panel: event types by hour ---------------------------------------------------

MEANS = (
    "Temperature_C",
    "Humidity_percent",
    "Wind_Speed_kmh",
    "Wind_Dir_deg",
    "Pressure_hPa",
    "Solar_Radiation_Wm2",
    "Soil_Temp_C",
    "Soil_Moisture",
)
HOURLY = (
    WX
    + """, hourly AS (
  SELECT City, date_trunc('hour', Timestamp) AS Timestamp, """
    + ", ".join(f"avg({c}) AS {c}" for c in MEANS)
    + """, sum(Rain_mm) AS Rain_mm, max(p) AS p FROM wx GROUP BY 1, 2
)"""
)


def hourly(spark, sf) -> DataFrame:
    return (
        measurements(spark, sf)
        .groupBy("City", F.date_trunc("hour", "Timestamp").cast("timestamp_ntz").alias("Timestamp"))
        .agg(*[F.avg(c).alias(c) for c in MEANS], F.sum("Rain_mm").alias("Rain_mm"), F.max("p").alias("p"))
    )


# -- daily panel: users by day, with gaps and a rare-event label ---------------------------

RANGED = ("Temperature_C", "Humidity_percent", "Wind_Speed_kmh", "Soil_Temp_C", "Soil_Moisture")
DAILY = (
    WX
    + """, daily AS (
  SELECT CAST(user_id AS VARCHAR) AS City, Date, """
    + ", ".join(f"avg({c}) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in RANGED)
    + """, avg(Pressure_hPa) AS Pressure_hPa_mean, avg(Solar_Radiation_Wm2) AS Solar_Radiation_Wm2_mean,
    avg(Wind_Dir_deg) AS Wind_Dir_deg_mean, sum(Rain_mm) AS Rain_mm_sum, max(y) AS Fire_Occurred, max(p) AS probability
  FROM wx GROUP BY 1, 2
)"""
)


def daily(spark, sf) -> DataFrame:
    aggs = []
    for c in RANGED:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return (
        measurements(spark, sf)
        .groupBy(F.col("user_id").cast("string").alias("City"), "Date")
        .agg(
            *aggs,
            F.avg("Pressure_hPa").alias("Pressure_hPa_mean"),
            F.avg("Solar_Radiation_Wm2").alias("Solar_Radiation_Wm2_mean"),
            F.avg("Wind_Dir_deg").alias("Wind_Dir_deg_mean"),
            F.sum("Rain_mm").alias("Rain_mm_sum"),
            F.max("y").alias("Fire_Occurred"),
            F.max("p").alias("probability"),
        )
    )


# -- long panel: order priorities by day over years ----------------------------------------

LONG = """
longp AS (
  SELECT o_orderpriority AS City, CAST(o_orderdate AS DATE) AS Date,
    avg(o_totalprice) / 9973.13 AS Temperature_C_mean, max(o_totalprice) / 9973.13 AS Temperature_C_max,
    100 - avg(o_totalprice) / 6007.17 AS Humidity_percent_mean,
    sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 ELSE 0 END) / 9.6913 AS Rain_mm_sum,
    avg(o_totalprice) / 19997.19 AS Wind_Speed_kmh_mean,
    max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS Fire_Occurred,
    count(*) AS n
  FROM orders GROUP BY 1, 2
)"""


def long_panel(spark, sf) -> DataFrame:
    price = F.col("o_totalprice")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("City"), F.to_date("o_orderdate").alias("Date"))
        .agg(
            (F.avg(price) / 9973.13).alias("Temperature_C_mean"),
            (F.max(price) / 9973.13).alias("Temperature_C_max"),
            (100 - F.avg(price) / 6007.17).alias("Humidity_percent_mean"),
            (F.sum(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 7).otherwise(0)) / 9.6913).alias("Rain_mm_sum"),
            (F.avg(price) / 19997.19).alias("Wind_Speed_kmh_mean"),
            F.max((F.col("o_orderstatus") == "F").cast("int")).alias("Fire_Occurred"),
            F.count(F.lit(1)).alias("n"),
        )
    )
