from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, cols, daily, finish, hourly, long_panel, query, table
from chronopanel.operators import joins as j
from chronopanel.operators.windows import latest

GEO = """
pts AS (SELECT c_custkey, c_nationkey, 38.5 + (c_custkey % 300) * 0.01 AS latitude, 45 + (c_custkey % 470) * 0.01 AS longitude FROM customer),
reg AS (SELECT n_nationkey AS region, 38.5 + n_nationkey * 0.12 AS lat, 45 + n_nationkey * 0.18 AS lon FROM nation)"""
J1 = f"""WITH {GEO} SELECT c_custkey, CAST(region AS BIGINT) AS region FROM pts, reg
WHERE latitude BETWEEN lat - 20.0 / 111.32 AND lat + 20.0 / 111.32
  AND longitude BETWEEN lon - 20.0 / (111.32 * cos(radians(lat))) AND lon + 20.0 / (111.32 * cos(radians(lat)))"""


def geo(spark, sf):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    points = table(spark, sf, "customer").select(
        k, (38.5 + (k % 300) * 0.01).alias("latitude"), (45 + (k % 470) * 0.01).alias("longitude")
    )
    regions = table(spark, sf, "nation").select(n.alias("region"), (38.5 + n * 0.12).alias("lat"), (45 + n * 0.18).alias("lon"))
    return points, regions


@query("j1_geofence", J1)
def j1_geofence(spark, sf):
    return finish(j.geofence(*geo(spark, sf)), "c_custkey", "region")


@query("j1_geofence_salted", J1)
def j1_geofence_salted(spark, sf):
    """The shuffled form for region tables beyond the size check."""
    return finish(j.geofence(*geo(spark, sf), method="salted"), "c_custkey", "region")


@query(
    "j2_left_panel",
    f"WITH {HOURLY}, d AS (SELECT City, CAST(Timestamp AS DATE) AS Date, max(Rain_mm) AS day_rain FROM hourly WHERE day(Timestamp) % 4 <> 0 GROUP BY 1, 2), "
    "f AS (SELECT h.City, h.Timestamp, Temperature_C, day_rain FROM hourly h LEFT JOIN d ON h.City = d.City AND CAST(h.Timestamp AS DATE) = d.Date) "
    f"SELECT {cols(key='City', stamp='Timestamp', num='Temperature_C day_rain')} FROM f",
)
def j2_left_panel(spark, sf):
    h = hourly(spark, sf).withColumn("Date", F.to_date("Timestamp"))
    d = h.filter(F.dayofmonth("Timestamp") % 4 != 0).groupBy("City", "Date").agg(F.max("Rain_mm").alias("day_rain"))
    return finish(j.left(h, d), "City", "Timestamp", "Temperature_C", "day_rain")


@query(
    "j3_dimension",
    "WITH d AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) "
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN d ON c_nationkey = n_nationkey",
)
def j3_dimension(spark, sf):
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nation = j.dimension(table(spark, sf, "nation"), region, ["n_regionkey"], "inner").withColumnRenamed("n_nationkey", "c_nationkey")
    return finish(j.dimension(table(spark, sf, "customer"), nation, ["c_nationkey"]), "c_custkey", "n_name", "r_name")


@query(
    "j3_dimension_fallback",
    "SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 7.3 END, c_acctbal), 6) + 0.0 AS amount FROM orders JOIN customer ON o_custkey = c_custkey",
)
def j3_dimension_fallback(spark, sf):
    amount = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 7.3)
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), amount.alias("amount"))
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"))
    return finish(j.dimension(orders, dim, ["k"], "inner"), "o_orderkey", "amount")


@query(
    "j4_latest_dimension",
    f"WITH {DAILY}, l AS (SELECT City, arg_max(Temperature_C_mean, Date) AS last_temp, arg_max(Rain_mm_sum, Date) AS last_rain FROM daily GROUP BY 1), "
    "f AS (SELECT d.City, d.Date, last_temp, last_rain FROM daily d LEFT JOIN l ON d.City = l.City WHERE d.Date >= DATE '2024-01-20') "
    f"SELECT {cols(key='City', date='Date', num='last_temp last_rain')} FROM f",
)
def j4_latest_dimension(spark, sf):
    df = daily(spark, sf)
    last = latest(df.select("City", "Date", F.col("Temperature_C_mean").alias("last_temp"), F.col("Rain_mm_sum").alias("last_rain")), ["City"], "Date")
    recent = df.filter(F.col("Date") >= F.lit("2024-01-20").cast("date"))
    return finish(j.dimension(recent.select("City", "Date"), last.drop("Date"), ["City"]), "City", "Date", "last_temp", "last_rain")


@query(
    "j5_align_forecasts",
    f"""WITH {DAILY}, a AS (SELECT City, Date, Temperature_C_mean AS y FROM daily), b AS (SELECT City, Date, Temperature_C_min AS fa FROM daily WHERE day(Date) % 2 = 0),
    c AS (SELECT City, Date, Temperature_C_max AS fb FROM daily WHERE day(Date) % 3 = 0),
    f AS (SELECT a.City, a.Date, y, fa, fb FROM a JOIN b ON a.City = b.City AND a.Date = b.Date JOIN c ON a.City = c.City AND a.Date = c.Date)
    SELECT {cols(key='City', date='Date', num='y fa fb')} FROM f""",
)
def j5_align_forecasts(spark, sf):
    df = daily(spark, sf)
    key = ["City", "Date"]
    y = df.select(*key, F.col("Temperature_C_mean").alias("y"))
    a = df.filter(F.dayofmonth("Date") % 2 == 0).select(*key, F.col("Temperature_C_min").alias("fa"))
    b = df.filter(F.dayofmonth("Date") % 3 == 0).select(*key, F.col("Temperature_C_max").alias("fb"))
    return finish(j.align_forecasts(y, a, b, on=key))


@query(
    "j6_agreement",
    f"""WITH {HOURLY}, d AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(p) AS daily_prob FROM hourly WHERE day(Timestamp) % 2 = 0 GROUP BY 1, 2),
    h AS (SELECT City, CAST(Timestamp AS DATE) AS Date, max(p) AS hourly_max, avg(p) AS hourly_mean FROM hourly GROUP BY 1, 2),
    f AS (SELECT d.City, d.Date, daily_prob, hourly_max, hourly_mean FROM d JOIN h ON d.City = h.City AND d.Date = h.Date)
    SELECT {cols(key='City', date='Date', num='daily_prob hourly_max hourly_mean')} FROM f""",
)
def j6_agreement(spark, sf):
    h = hourly(spark, sf)
    d = h.filter(F.dayofmonth("Timestamp") % 2 == 0).groupBy("City", F.to_date("Timestamp").alias("Date")).agg(F.avg("p").alias("p"))
    return finish(j.agreement(d, h, p="p"))


@query(
    "j7_lookup",
    f"""WITH {LONG}, t AS (SELECT City, month(Date) AS Month, avg(Rain_mm_sum) AS clim FROM longp WHERE month(Date) <> 7 GROUP BY 1, 2),
    f AS (SELECT l.City, l.Date, coalesce(clim, 0.0) AS clim FROM longp l LEFT JOIN t ON l.City = t.City AND month(l.Date) = t.Month)
    SELECT {cols(key='City', date='Date', num='clim')} FROM f""",
)
def j7_lookup(spark, sf):
    df = long_panel(spark, sf).withColumn("Month", F.month("Date"))
    clim = df.filter("Month <> 7").groupBy("City", "Month").agg(F.avg("Rain_mm_sum").alias("clim"))
    return finish(j.lookup(df, clim, ["City", "Month"], "clim", 0.0), "City", "Date", "clim")


@query(
    "j8_month_median",
    f"""WITH {LONG}, m AS (SELECT City, month(Date) AS Month, quantile_cont(Wind_Speed_kmh_mean, 0.5) AS med FROM longp WHERE Date < DATE '2000-01-01' GROUP BY 1, 2),
    f AS (SELECT l.City, l.Date, coalesce(CASE WHEN day(Date) % 2 = 0 THEN Wind_Speed_kmh_mean END, med) AS wind FROM longp l LEFT JOIN m ON l.City = m.City AND month(l.Date) = m.Month WHERE Date >= DATE '2000-01-01')
    SELECT {cols(key='City', date='Date', num='wind')} FROM f""",
)
def j8_month_median(spark, sf):
    df = long_panel(spark, sf).withColumn("wind", F.col("Wind_Speed_kmh_mean"))
    cut = F.lit("2000-01-01").cast("date")
    now = df.filter(F.col("Date") >= cut).withColumn("wind", F.when(F.dayofmonth("Date") % 2 == 0, F.col("wind")))
    return finish(j.month_fill(now, df.filter(F.col("Date") < cut), "wind"), "City", "Date", "wind")


@query(
    "j9_keep_keys",
    f"WITH {DAILY} SELECT {cols(key='City', date='Date', num='Rain_mm_sum')} FROM daily d WHERE EXISTS (SELECT 1 FROM daily k WHERE k.City = d.City AND k.Date = d.Date AND k.Fire_Occurred = 1)",
)
def j9_keep_keys(spark, sf):
    df = daily(spark, sf)
    return finish(j.keep_keys(df, df.filter("Fire_Occurred = 1")), "City", "Date", "Rain_mm_sum")


@query(
    "j10_absent_entities",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def j10_absent_entities(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return finish(j.absent_keys(table(spark, sf, "customer"), urgent, ["c_custkey"]))


@query(
    "o5_common_keys",
    f"WITH {DAILY} SELECT City, strftime(Date, '%Y-%m-%d') AS Date FROM (SELECT City, Date FROM daily WHERE Fire_Occurred = 1 INTERSECT SELECT City, Date FROM daily WHERE Rain_mm_sum > 0)",
)
def o5_common_keys(spark, sf):
    df = daily(spark, sf)
    return finish(j.common_keys(df.filter("Fire_Occurred = 1"), df.filter("Rain_mm_sum > 0")))
