from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, LONG, cols, daily, finish, hourly, long_panel, query, table
from catalog.metrics import BOARD, PRED, RANK, predictions
from chronopanel.operators import metrics
from chronopanel.session import scratch
from chronopanel.sources import readers, tables, writers

T, R = "Temperature_C_mean", "Rain_mm_sum"
DAYS = f"WITH {DAILY} SELECT {cols(key='City', date='Date', num=f'{T} {R}')} FROM daily"


def small_daily(spark, sf):
    return daily(spark, sf).select("City", "Date", T, R)


@query("s1_parquet_round_trip", DAYS)
def s1_parquet_round_trip(spark, sf):
    path = scratch(spark, "daily")
    writers.parquet(small_daily(spark, sf).withColumn("Date", F.col("Date").cast("string")), path)
    return finish(readers.parquet(spark, path, dates=["Date"]))


@query("s2_pruned_scan", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events")
def s2_pruned_scan(spark, sf):
    ts = readers.parquet(spark, f"{sf}/events.parquet", columns=["ts"])
    return finish(ts.agg(F.max("ts").alias("last")))


@query("s3_fallback_scan", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def s3_fallback_scan(spark, sf):
    df = readers.with_fallback(spark, f"{sf}/no_such_table.parquet", f"{sf}/nation.parquet")
    return finish(df, "n_nationkey", "n_name")


POINTS = "SELECT strftime(ts, '%Y-%m-%d') AS acq_date, round(38 + user_id % 5 / 7.0, 6) + 0.0 AS latitude, round(45 + event_id % 7 / 3.0, 6) + 0.0 AS longitude, round(value / 3.7, 6) + 0.0 AS brightness, CASE WHEN event_id % 3 < 2 THEN round(value / 9.1, 6) + 0.0 END AS frp FROM events WHERE event_id % 11 <> 0"


def archive(spark, sf):
    """Files of three headers under one root, some bad dates: two sensors, one of them also in
    another column order with a column more and one less."""
    e = table(spark, sf, "events")
    day = F.when(F.col("event_id") % 11 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    base = e.select(
        day.alias("ACQ_DATE"),
        (38 + (F.col("user_id") % 5) / 7.0).alias("Latitude"),
        (45 + (F.col("event_id") % 7) / 3.0).alias("Longitude"),
        (F.col("value") / 3.7).alias("bright"),
        (F.col("value") / 9.1).alias("FRP"),
        F.lit("n").alias("confidence"),
        "event_id",
    )
    path = scratch(spark, "archive")
    of = lambda k: base.filter(F.col("event_id") % 3 == k)
    writers.csv(of(0).withColumnRenamed("bright", "brightness").drop("event_id"), f"{path}/modis")
    writers.csv(of(1).select("ACQ_DATE", "Latitude", "Longitude", F.col("bright").alias("bright_ti4"), F.lit("x").alias("version"), "FRP", "confidence"), f"{path}/viirs")
    writers.csv(of(2).select("confidence", F.col("bright").alias(" Brightness"), "Longitude", "Latitude", F.lit("a,b").alias("note"), "ACQ_DATE"), f"{path}/modis/older")
    return readers.csv_archive(spark, path)


@query(
    "s4_csv_archive",
    "SELECT count(*) AS n, count(CASE WHEN event_id % 3 <> 1 THEN 1 END) AS n_brightness, count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS n_bright_ti4, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS n_note, count(CASE WHEN event_id % 3 < 2 THEN 1 END) AS n_frp FROM events",
)
def s4_csv_archive(spark, sf):
    seen = F.count_if(F.col("note") == "a,b").alias("n_note")
    return archive(spark, sf).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("brightness", "bright_ti4", "frp")], seen)


@query("s5_points", POINTS)
def s5_points(spark, sf):
    return finish(readers.points(archive(spark, sf)), "acq_date", "latitude", "longitude", "brightness", "frp")


@query("s6_csv_dimension", "SELECT n_name AS City, round(n_nationkey / 7.0, 6) + 0.0 AS Elevation FROM nation")
def s6_csv_dimension(spark, sf):
    path = scratch(spark, "static")
    writers.csv(table(spark, sf, "nation").select(F.col("n_name").alias("City"), (F.col("n_nationkey") / 7.0).alias("Elevation")), path)
    return finish(readers.csv(spark, path, "City string, Elevation double"))


@query("s7_json_records", f"WITH {HOURLY} SELECT strftime(Timestamp, '%Y-%m-%dT%H:%M') AS timestamp, City AS region, p AS probability, 'Low' AS risk_level FROM hourly")
def s7_json_records(spark, sf):
    path = scratch(spark, "hourly-json")
    out = hourly(spark, sf).select(
        F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), F.col("City").alias("region"), F.col("p").alias("probability"), F.lit("Low").alias("risk_level")
    )
    writers.json(out, path)
    return readers.json_records(spark, path)


@query(
    "s7_json_array",
    f"WITH {HOURLY} SELECT strftime(Timestamp, '%Y-%m-%dT%H:%M') AS timestamp, City AS region, round(p, 6) + 0.0 AS probability, 'Low' AS risk_level FROM hourly",
)
def s7_json_array(spark, sf):
    """Files that hold one array of records each: an entity's day, 24 records at most."""
    path = scratch(spark, "json-arrays")
    record = F.struct(
        F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), F.col("City").alias("region"), F.col("p").alias("probability"), F.lit("Low").alias("risk_level")
    )
    arrays = hourly(spark, sf).groupBy("City", F.to_date("Timestamp").alias("Date")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return finish(readers.json_records(spark, path, lines=False))


FRESH = (
    "SELECT City, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, rows, "
    "CASE WHEN first > TIMESTAMP '2024-01-02' THEN 'starts late' WHEN last < TIMESTAMP '2024-01-30' THEN 'ends early' ELSE 'ok' END AS reason, "
    "CAST(first <= TIMESTAMP '2024-01-02' AND last >= TIMESTAMP '2024-01-30' AS BIGINT) AS valid FROM c"
)


@query(
    "s8_expired",
    f"WITH c AS (SELECT event_type AS City, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM events GROUP BY 1), f AS ({FRESH}) SELECT City, first, last, rows, 'expired' AS reason, CAST(0 AS BIGINT) AS valid FROM f",
)
def s8_expired(spark, sf):
    """A table written today no longer serves a caller who asks decades later."""
    df = table(spark, sf, "events").withColumnsRenamed({"event_type": "City"})
    return finish(readers.freshness(df, now="2124-01-31 00:00:00", start="2024-01-01", ts="ts", max_age_hours=24))


@query(
    "s8_freshness",
    "WITH c AS (SELECT event_type AS City, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM events GROUP BY 1) "
    "SELECT City, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, rows, CASE WHEN first > TIMESTAMP '2024-01-02' THEN 'starts late' WHEN last < TIMESTAMP '2024-01-30' THEN 'ends early' ELSE 'ok' END AS reason, "
    "CAST(first <= TIMESTAMP '2024-01-02' AND last >= TIMESTAMP '2024-01-30' AS BIGINT) AS valid FROM c",
)
def s8_freshness(spark, sf):
    df = table(spark, sf, "events").withColumnsRenamed({"event_type": "City"})
    return finish(readers.freshness(df, now="2024-01-31 00:00:00", start="2024-01-01", ts="ts", max_age_hours=24 * 365 * 100))


@query("s9_union_entities", f"WITH {LONG} SELECT City, strftime(Date, '%Y-%m-%d') AS Date, round({T}, 6) + 0.0 AS {T} FROM longp")
def s9_union_entities(spark, sf):
    path = scratch(spark, "entities")
    df = long_panel(spark, sf).select("City", "Date", T)
    # one write job makes a folder for each entity; the union reads the folders
    writers.parquet(df.withColumn("entity", F.col("City")), path, ["entity"])
    return finish(readers.union_entities(spark, [f"{path}/*"]))


@query("s10_overwrite", DAYS)
def s10_overwrite(spark, sf):
    path = scratch(spark, "overwrite")
    df = small_daily(spark, sf)
    writers.parquet(df.filter(F.dayofmonth("Date") <= 5), path)
    writers.parquet(df, path)
    return finish(readers.parquet(spark, path))


CUT = "2024-01-20"
APPENDED = f"WITH {DAILY} SELECT {cols(key='City', date='Date', num=f'{T} {R}')} FROM (SELECT City, Date, CASE WHEN Date <= DATE '{CUT}' THEN {T} ELSE {T} + 1 END AS {T}, {R} FROM daily)"


@query("s11_append_new", APPENDED)
def s11_append_new(spark, sf):
    """Corrections to stored days are not taken; s11_upsert takes them."""
    path = scratch(spark, "append")
    df = small_daily(spark, sf)
    writers.append(df.filter(F.col("Date") <= F.lit(CUT).cast("date")), path)
    later = df.withColumn(T, F.col(T) + 1)
    writers.append(later, path)
    writers.append(later, path)
    return finish(readers.parquet(spark, path))


@query(
    "s11_upsert",
    f"WITH {DAILY} SELECT {cols(key='City', date='Date', num=f'{T} {R}')} FROM (SELECT City, Date, CASE WHEN Date >= DATE '2024-01-15' AND CAST(City AS INT) % 2 = 0 THEN {T} + 1 ELSE {T} END AS {T}, {R} FROM daily)",
)
def s11_upsert(spark, sf):
    path = scratch(spark, "upsert")
    df = small_daily(spark, sf)
    writers.upsert(df, path)
    fix = df.filter((F.col("Date") >= F.lit("2024-01-15").cast("date")) & (F.col("City").cast("int") % 2 == 0))
    fix = fix.withColumn(T, F.col(T) + 1)
    writers.upsert(fix, path)
    writers.upsert(fix, path)
    return finish(readers.parquet(spark, path))


SNAPSHOT = f"""
WITH {DAILY}, v AS (
  SELECT 1 AS version, City, Date, {T}, {R} FROM daily WHERE Date <= DATE '{CUT}'
  UNION ALL SELECT 2, City, Date, CASE WHEN Date >= DATE '2024-01-15' AND CAST(City AS INT) % 2 = 0 THEN {T} + 1 ELSE {T} END, {R} FROM daily WHERE Date <= DATE '{CUT}'
  UNION ALL SELECT 3, City, Date, CASE WHEN Date >= DATE '2024-01-15' AND Date <= DATE '{CUT}' AND CAST(City AS INT) % 2 = 0 THEN {T} + 1 ELSE {T} END, {R} FROM daily)
SELECT {cols(int_='version', key='City', date='Date', num=f'{T} {R}')} FROM v"""


@query("s10_snapshots", SNAPSHOT)
def s10_snapshots(spark, sf):
    """Three versions of one table, each read as it was: a load, corrections of many days, new days."""
    path = scratch(spark, "snapshots")
    df = small_daily(spark, sf)
    early = df.filter(F.col("Date") <= F.lit(CUT).cast("date"))
    fix = early.filter((F.col("Date") >= F.lit("2024-01-15").cast("date")) & (F.col("City").cast("int") % 2 == 0))
    tables.overwrite(early, path, "Date", keep=3)
    tables.upsert(fix.withColumn(T, F.col(T) + 1), path, keep=3)
    tables.append(df, path, keep=3)
    read = [tables.read(spark, path, v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return finish(read[0].unionByName(read[1]).unionByName(read[2]), "version", "City", "Date", T, R)


@query("s12_csv_json_sinks", f"WITH {DAILY}, a AS (SELECT City, Date, {T} AS t FROM daily) SELECT 'csv' AS kind, count(*) AS n, count(DISTINCT City) AS cities FROM a UNION ALL SELECT 'json', count(*), count(DISTINCT City) FROM a")
def s12_csv_json_sinks(spark, sf):
    path = scratch(spark, "sinks")
    df = small_daily(spark, sf).select("City", "Date", F.col(T).alias("t"))
    writers.csv(df, f"{path}/csv")
    writers.json(df, f"{path}/json")
    a = readers.csv(spark, f"{path}/csv", "City string, Date date, t double")
    b = readers.json_records(spark, f"{path}/json", "City string, Date date, t double")
    count = lambda x, k: x.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct("City").alias("cities"))
    return count(a, "csv").unionByName(count(b, "json"))


@query(
    "s13_manifest",
    f"WITH {PRED}, {RANK}, {BOARD}, o AS (SELECT *, row_number() OVER (ORDER BY board.selection_score DESC) AS place FROM board) "
    f"SELECT place - 1 AS place, model, (SELECT model FROM o WHERE place = 1) AS selected_model, round(selection_score, 6) + 0.0 AS selection_score FROM o",
)
def s13_manifest(spark, sf):
    path = scratch(spark, "manifest")
    record = writers.metrics_record(metrics.leaderboard(predictions(spark, sf)), threshold=0.44)
    writers.json(record, path)
    back = writers.read_manifest(spark, path)
    rows = back.select("selected_model", F.posexplode("leaderboard").alias("place", "entry"))
    return finish(rows.select("place", "entry.model", "selected_model", "entry.selection_score"))


@query("s15_coordinates", "SELECT n_name AS City, round(CAST(38.5 + n_nationkey * 0.12 AS DOUBLE), 6) AS Latitude, round(CAST(45 + n_nationkey * 0.18 AS DOUBLE), 6) AS Longitude FROM nation")
def s15_coordinates(spark, sf):
    """The table of coordinates from a mapping of places; nations are a fixed, small set."""
    n = F.col("n_nationkey")
    known = table(spark, sf, "nation").select("n_name", (38.5 + n * 0.12).alias("lat"), (45 + n * 0.18).alias("lon"))
    return finish(readers.coordinates(spark, {r.n_name: (r.lat, r.lon) for r in known.collect()}))
