from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, WX, clip_sql, cols, daily, finish, hourly, long_panel, measurements, query, table
from chronopanel.functions import calendar, columns
from chronopanel.operators import aggregate, repair as r
from chronopanel.schema import BOUNDS

T, H, W, R = "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean", "Rain_mm_sum"


@query("p1_rename", f"WITH {WX} SELECT {cols(key='event_id', num='Temperature_C Humidity_percent')} FROM wx")
def p1_rename(spark, sf):
    raw = measurements(spark, sf).withColumnsRenamed({"Temperature_C": "temperature_2m", "Humidity_percent": "relative_humidity_2m"})
    return finish(r.rename_sources(raw), "event_id", "Temperature_C", "Humidity_percent")


@query("p2_suffix", f"WITH {HOURLY} SELECT City, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS Date, round(Temperature_C, 6) + 0.0 AS Temperature_C_mean, round(Rain_mm, 6) + 0.0 AS Rain_mm_sum FROM hourly")
def p2_suffix(spark, sf):
    raw = hourly(spark, sf).select("City", F.col("Timestamp").alias("Date"), "Temperature_C", F.col("Rain_mm").alias("Rain_mm_sum"))
    return finish(r.suffix_means(raw))


@query(
    "p3_coerce",
    "SELECT event_id, round(value, 6) + 0.0 AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0",
)
def p3_coerce(spark, sf):
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    at = F.when(F.col("event_id") % 5 == 0, "2024-13-45").otherwise(F.col("ts").cast("string"))
    return finish(r.coerce(e.select("event_id", value.alias("value"), at.alias("at")), ["value"], ["at"]))


@query(
    "p4_time_parts",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour FROM events",
)
def p4_time_parts(spark, sf):
    ts = calendar.drop_zone(F.col("ts"))
    return finish(table(spark, sf, "events").select("event_id", calendar.floor_day(ts).alias("day"), F.hour(ts).alias("hour")))


@query(
    "p5_temporal_split",
    f"WITH {LONG} SELECT City, strftime(Date, '%Y-%m-%d') AS Date, CASE WHEN Date < DATE '1999-01-01' THEN 'train' WHEN Date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split FROM longp",
)
def p5_temporal_split(spark, sf):
    return finish(r.temporal_split(long_panel(spark, sf), train_end="1999-01-01", test_start="2000-01-01"), "City", "Date", "split")


@query(
    "p6_holdout_split",
    f"WITH {HOURLY} SELECT City, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS Timestamp, CAST(Timestamp > (SELECT max(Timestamp) FROM hourly) - INTERVAL 168 HOUR AS BIGINT) AS holdout FROM hourly",
)
def p6_holdout_split(spark, sf):
    return finish(r.holdout_split(hourly(spark, sf), "Timestamp", "168 hour"), "City", "Timestamp", "holdout")


SAVED = (T, H, "absent_a", R, "absent_b")


@query(
    "p7_select_features",
    f"WITH {DAILY}, f AS (SELECT City, Date, {T}, {H}, CAST(NULL AS DOUBLE) AS absent_a, {R}, CAST(NULL AS DOUBLE) AS absent_b FROM daily) SELECT {cols(key='City', date='Date', num=' '.join(SAVED))} FROM f",
)
def p7_select_features(spark, sf):
    return finish(r.select_features(daily(spark, sf), SAVED))


@query(
    "p7_feature_names",
    f"WITH {DAILY}, n AS (SELECT count(COLUMNS(* EXCLUDE (City, Date, Fire_Occurred))) FROM daily), f AS (UNPIVOT n ON COLUMNS(*) INTO NAME feature VALUE known) "
    "SELECT feature, known, row_number() OVER (ORDER BY feature) - 1 AS place FROM f",
)
def p7_feature_names(spark, sf):
    """Every feature of the daily panel, in order, with its known values."""
    df = daily(spark, sf)
    names = r.feature_names(df)
    known = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "known")
    places = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(i).cast("long") for i in range(len(names))]))
    return known.withColumn("place", places[F.col("feature")])


@query(
    "p8_align_features",
    f"WITH {DAILY}, f AS (SELECT City, Date, {T}, {H}, 0.0 AS absent_a, {R}, 0.0 AS absent_b FROM daily) SELECT {cols(key='City', date='Date', num=' '.join(SAVED))} FROM f",
)
def p8_align_features(spark, sf):
    return finish(r.align_features(daily(spark, sf), SAVED))


@query(
    "p9_clip",
    f"WITH {DAILY}, f AS (SELECT City, Date, {clip_sql(T, 0, 5)} AS t, {clip_sql(H, 90, None)} AS h FROM daily) SELECT {cols(key='City', date='Date', num='t h')} FROM f",
)
def p9_clip(spark, sf):
    df = daily(spark, sf).select("City", "Date", columns.clip(F.col(T), 0.0, 5.0).alias("t"), columns.clip(F.col(H), 90.0).alias("h"))
    return finish(df)


@query(
    "p9_clip_bounds",
    f"WITH {DAILY}, f AS (SELECT City, Date, least(greatest({T} * 10, -60), 60) AS {T}, least(greatest({R} * 100, 0), 500) AS {R} FROM daily) SELECT {cols(key='City', date='Date', num=f'{T} {R}')} FROM f",
)
def p9_clip_bounds(spark, sf):
    df = daily(spark, sf).select("City", "Date", (F.col(T) * 10).alias(T), (F.col(R) * 100).alias(R))
    return finish(columns.clip_columns(df, BOUNDS))


@query(
    "p10_winsorise",
    f"WITH {WX}, q AS (SELECT quantile_cont(Temperature_C, 0.01) AS a, quantile_cont(Temperature_C, 0.99) AS b, quantile_cont(Rain_mm, 0.01) AS c, quantile_cont(Rain_mm, 0.99) AS d FROM wx), "
    "f AS (SELECT event_id, least(greatest(Temperature_C, a), b) AS Temperature_C, least(greatest(Rain_mm, c), d) AS Rain_mm FROM wx, q) "
    f"SELECT {cols(key='event_id', num='Temperature_C Rain_mm')} FROM f",
)
def p10_winsorise(spark, sf):
    return finish(r.winsorise(measurements(spark, sf), ["Temperature_C", "Rain_mm"]), "event_id", "Temperature_C", "Rain_mm")


GAPS = f"g AS (SELECT City, Date, CASE WHEN day(Date) % 3 <> 0 THEN {T} END AS t, CASE WHEN day(Date) % 2 = 0 THEN {R} ELSE 0.0 END AS r FROM daily)"


def gaps(spark, sf):
    return daily(spark, sf).select(
        "City",
        "Date",
        F.when(F.dayofmonth("Date") % 3 != 0, F.col(T)).alias("t"),
        F.when(F.dayofmonth("Date") % 2 == 0, F.col(R)).otherwise(0.0).alias("r"),
    )


@query(
    "p11_median_fill",
    f"WITH {DAILY}, {GAPS}, m AS (SELECT City, quantile_cont(t, 0.5) AS med FROM g GROUP BY 1), f AS (SELECT g.City, Date, coalesce(t, med, 0) AS t FROM g JOIN m ON g.City = m.City) "
    f"SELECT {cols(key='City', date='Date', num='t')} FROM f",
)
def p11_median_fill(spark, sf):
    return finish(r.median_fill(gaps(spark, sf), ["t"]), "City", "Date", "t")


@query(
    "p12_zero_repair",
    f"WITH {DAILY}, {GAPS}, m AS (SELECT City, quantile_cont(t, 0.5) AS mt, quantile_cont(r, 0.5) AS mr FROM g GROUP BY 1), "
    "f AS (SELECT g.City, Date, coalesce(t, mt, 0) AS t, coalesce(nullif(r, 0), mr, 0) AS r FROM g JOIN m ON g.City = m.City) "
    f"SELECT {cols(key='City', date='Date', num='t r')} FROM f",
)
def p12_zero_repair(spark, sf):
    df = gaps(spark, sf)
    return finish(r.zero_repair(df, df, base=["r"], lagged=["t"]), "City", "Date", "t", "r")


@query("p14_constant_fill", f"WITH {DAILY}, {GAPS}, f AS (SELECT City, Date, coalesce(t, 0) AS t, r FROM g) SELECT {cols(key='City', date='Date', num='t r')} FROM f")
def p14_constant_fill(spark, sf):
    return finish(r.constant_fill(gaps(spark, sf)))


@query(
    "p16_spread_estimate",
    f"""WITH {DAILY}, s AS (SELECT avg(greatest(Temperature_C_max - {T}, 0)) AS up, avg(greatest({T} - Temperature_C_min, 0)) AS dn FROM daily),
    f AS (SELECT City, Date, {T} + up AS Temperature_C_max, {T} - dn AS Temperature_C_min FROM daily, s)
    SELECT {cols(key='City', date='Date', num='Temperature_C_max Temperature_C_min')} FROM f""",
)
def p16_spread_estimate(spark, sf):
    df = daily(spark, sf)
    return finish(r.spread_estimate(df.select("City", "Date", T), df, ["Temperature_C"]), "City", "Date", "Temperature_C_max", "Temperature_C_min")


P17 = "temp_range Humidity_percent_diurnal_range hours_temp_above_30 hours_humidity_below_30 hours_wind_above_20 solar_peak_hour temp_night_min"


@query(
    "p17_intraday_proxies",
    f"""WITH {WX}, f AS (SELECT event_id, 6.0 AS temp_range, 20.0 AS Humidity_percent_diurnal_range,
      CASE WHEN Temperature_C >= 28 THEN least(greatest((Temperature_C - 28) * 2, 1), 12) ELSE 0 END AS hours_temp_above_30,
      CASE WHEN Humidity_percent <= 40 THEN least(greatest((40 - Humidity_percent) * 0.5, 1), 10) ELSE 0 END AS hours_humidity_below_30,
      CASE WHEN Wind_Speed_kmh >= 18 THEN least(greatest((Wind_Speed_kmh - 18) * 0.8, 1), 8) ELSE 0 END AS hours_wind_above_20,
      13.0 AS solar_peak_hour, Temperature_C - 4 AS temp_night_min FROM wx)
    SELECT {cols(key='event_id', num=P17)} FROM f""",
)
def p17_intraday_proxies(spark, sf):
    df = measurements(spark, sf).select(
        "event_id", F.col("Temperature_C").alias(T), F.col("Humidity_percent").alias(H), F.col("Wind_Speed_kmh").alias(W)
    )
    return finish(r.intraday_proxies(df), "event_id", *P17.split())


@query(
    "p18_daytime_label",
    "SELECT event_id, CAST(CASE WHEN hour(ts) BETWEEN 6 AND 20 AND event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS Fire_Occurred FROM events",
)
def p18_daytime_label(spark, sf):
    df = measurements(spark, sf).select("event_id", F.col("y").alias("Fire_Occurred"), "Timestamp")
    return finish(r.daytime_label(calendar.add_hourly_calendar(df)), "event_id", "Fire_Occurred")


@query(
    "p19_template_rows",
    f"""WITH {LONG}, have AS (SELECT City, Date, {T} FROM longp WHERE City <> '5-LOW' AND City <> '2-HIGH'), t AS (SELECT Date, {T} FROM have WHERE City = (SELECT min(City) FROM have)),
    f AS (SELECT City, Date, {T}, 0 AS imputed FROM have UNION ALL SELECT City, Date, {T}, 1 FROM t, (SELECT DISTINCT City FROM longp EXCEPT SELECT City FROM have))
    SELECT {cols(key='City', date='Date', num=T, int_='imputed')} FROM f""",
)
def p19_template_rows(spark, sf):
    df = long_panel(spark, sf).select("City", "Date", T)
    have = df.filter(~F.col("City").isin("5-LOW", "2-HIGH"))
    return finish(r.template_rows(have, df.select("City")))


@query(
    "p20_placeholder_rows",
    "WITH s AS (SELECT o_custkey, sum(o_totalprice) / 7.3 AS Slope FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) "
    "SELECT c_custkey AS City, round(coalesce(Slope, 0), 6) + 0.0 AS Slope FROM customer LEFT JOIN s ON c_custkey = o_custkey",
)
def p20_placeholder_rows(spark, sf):
    have = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("City")).agg((F.sum("o_totalprice") / 7.3).alias("Slope"))
    return finish(r.placeholder_rows(have, table(spark, sf, "customer").select(F.col("c_custkey").alias("City")), ["Slope"]))


@query("p21_drop_null_rows", f"WITH {DAILY}, {GAPS} SELECT {cols(key='City', date='Date', num='t r')} FROM g WHERE t IS NOT NULL")
def p21_drop_null_rows(spark, sf):
    return finish(r.drop_null_rows(gaps(spark, sf), ["t", "City"]))


@query("p22_narrow", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) + 0.0 AS c_acctbal FROM customer")
def p22_narrow(spark, sf):
    return finish(r.narrow(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")))


LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "p23_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderpriority = '{v}' AS BIGINT) AS \"city_{v}\"" for v in LEVELS)
    + ", o_orderpriority AS back FROM orders",
)
def p23_one_hot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    hot = r.one_hot(df, "o_orderpriority", LEVELS, "city").drop("o_orderpriority")
    return finish(r.one_hot_inverse(hot, LEVELS, "city", "back"))


@query("o1_sorted", f"WITH {DAILY} SELECT {cols(key='City', date='Date', num=T)} FROM daily ORDER BY Date, City")
def o1_sorted(spark, sf):
    return finish(daily(spark, sf).orderBy("Date", "City"), "City", "Date", T)


@query("o2_top_k", f"WITH {WX} SELECT event_id, p FROM wx ORDER BY p DESC, event_id LIMIT 10")
def o2_top_k(spark, sf):
    return aggregate.top(measurements(spark, sf).select("event_id", "p"), ["p", "event_id"], 10)


@query(
    "o3_union",
    f"WITH {DAILY}, f AS (SELECT City, Date, {T} AS t, NULL AS r FROM daily UNION ALL SELECT City, Date, NULL, {R} FROM daily) SELECT {cols(key='City', date='Date', num='t r')} FROM f",
)
def o3_union(spark, sf):
    df = daily(spark, sf)
    a, b = df.select("City", "Date", F.col(T).alias("t")), df.select("City", "Date", F.col(R).alias("r"))
    return finish(a.unionByName(b, allowMissingColumns=True))


@query("o4_distinct", f"WITH {DAILY} SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS Date FROM daily")
def o4_distinct(spark, sf):
    return finish(daily(spark, sf).select("Date").distinct())


@query("o6_sample", "SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 200")
def o6_sample(spark, sf):
    return aggregate.sample_rows(table(spark, sf, "events"), 200, "event_id").select("event_id")
