from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAILY, HOURLY, cols, daily, finish, hourly, query, table
from catalog.functions import tier_sql
from chronopanel.functions.risk import tier
from chronopanel.operators import quality as q
from chronopanel.operators.windows import lags

T, R = "Temperature_C_mean", "Rain_mm_sum"


@query("v1_required_columns", f"WITH {DAILY} SELECT 'daily:columns' AS name, false AS passed, 'Slope' AS detail")
def v1_required_columns(spark, sf):
    return q.required_columns(daily(spark, sf), ["City", "Date", T, "Slope"], "daily")


@query("v1_paths_present")
def v1_paths_present(spark, sf):
    found = q.paths_present(spark, [f"{sf}/events.parquet", f"{sf}/no_such_table.parquet"])
    return found.select(F.regexp_extract("name", "[^/]+$", 0).alias("name"), "passed")


@query("v1_manifest_keys")
def v1_manifest_keys(spark, sf):
    rows = daily(spark, sf).select(F.lit("m").alias("model_name"), F.lit(0.44).alias("optimal_threshold"), "probability")
    return q.manifest_keys(rows)


@query("v2_no_nulls", f"WITH {DAILY}, f AS (SELECT sum(CASE WHEN {R} > 0 THEN 0 ELSE 1 END) AS n FROM daily) SELECT 'daily:no_null' AS name, n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM f")
def v2_no_nulls(spark, sf):
    df = daily(spark, sf).select("City", "Date", T, F.when(F.col(R) > 0, F.col(R)).alias(R))
    return q.no_nulls(df, "daily")


@query(
    "v3_bounds",
    f"""WITH {DAILY}, f AS (SELECT '{T}' AS c, count(CASE WHEN {T} * 10 NOT BETWEEN -60 AND 60 THEN 1 END) AS n FROM daily
    UNION ALL SELECT 'Humidity_percent_mean', count(CASE WHEN Humidity_percent_mean NOT BETWEEN 0 AND 100 THEN 1 END) FROM daily
    UNION ALL SELECT '{R}', count(CASE WHEN {R} NOT BETWEEN 0 AND 500 THEN 1 END) FROM daily)
    SELECT 'daily:bounds:' || c AS name, n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM f""",
)
def v3_bounds(spark, sf):
    df = daily(spark, sf).select("City", "Date", (F.col(T) * 10).alias(T), "Humidity_percent_mean", R)
    return q.within_bounds(df, label="daily")


@query("v4_unique_keys", "WITH f AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE))) SELECT 'events:unique' AS name, n = 0 AS passed, CAST(CAST(n AS BIGINT) AS VARCHAR) AS detail FROM f")
def v4_unique_keys(spark, sf):
    df = table(spark, sf, "events").select(F.col("user_id").alias("City"), F.to_date("ts").alias("Date"))
    return q.unique_keys(df, label="events")


@query(
    "v5_entities_covered",
    """WITH m AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))
    SELECT 'orders:entities' AS name, count(*) = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM m
    UNION ALL SELECT 'orders:entity', false, CAST(c_custkey AS VARCHAR) FROM m""",
)
def v5_entities_covered(spark, sf):
    have = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("City"))
    return q.entities_covered(have, table(spark, sf, "customer").select(F.col("c_custkey").alias("City")), label="orders")


@query("v6_probability_range", f"WITH {DAILY}, f AS (SELECT min(probability) AS lo, max(probability) AS hi FROM daily) SELECT 'risk:prob_range' AS name, lo >= 0 AND hi <= 1 AS passed, printf('[%.3f, %.3f]', lo, hi) AS detail FROM f")
def v6_probability_range(spark, sf):
    return q.probability_range(daily(spark, sf), label="risk")




@query("v7_known_levels", f"WITH {DAILY}, f AS (SELECT count(CASE WHEN City = '7' THEN 1 END) AS n FROM daily) SELECT 'risk:risk_levels' AS name, n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM f")
def v7_known_levels(spark, sf):
    level = F.when(F.col("City") == "7", "Unknown").otherwise(tier(F.col("probability")))
    return q.known_levels(daily(spark, sf).withColumn("risk_level", level), label="risk")


GAP = f"""d AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(p) AS daily_prob FROM hourly GROUP BY 1, 2),
  h AS (SELECT City, CAST(Timestamp AS DATE) AS Date, max(p) AS hourly_max, avg(p) AS hourly_mean FROM hourly GROUP BY 1, 2),
  g AS (SELECT d.City, d.Date, daily_prob, hourly_max, hourly_mean, abs(hourly_max - daily_prob) AS disagreement FROM d JOIN h ON d.City = h.City AND d.Date = h.Date),
  rep AS (SELECT *, CAST(disagreement > 0.35 AS INT) AS mismatch_flag, {tier_sql('daily_prob', '>')} AS daily_risk_level, {tier_sql('hourly_max', '>')} AS hourly_max_risk_level FROM g)"""


def gap_report(spark, sf):
    h = hourly(spark, sf).withColumnRenamed("p", "probability")
    d = h.groupBy("City", F.to_date("Timestamp").alias("Date")).agg(F.avg("probability").alias("probability"))
    return q.disagreement(d, h)


@query(
    "v8_disagreement",
    f"WITH {HOURLY}, {GAP} SELECT {cols(key='City daily_risk_level hourly_max_risk_level', date='Date', int_='mismatch_flag', num='daily_prob hourly_max hourly_mean disagreement')} FROM rep ORDER BY rep.disagreement DESC",
)
def v8_disagreement(spark, sf):
    return finish(gap_report(spark, sf).orderBy(F.desc("disagreement")))


@query("v8_agreement_check", f"WITH {HOURLY}, {GAP}, c AS (SELECT sum(mismatch_flag) AS k, count(*) AS n FROM rep) SELECT 'consistency:daily_hourly_agreement' AS name, k <= n * 0.2 AS passed, k || '/' || n AS detail FROM c")
def v8_agreement_check(spark, sf):
    return q.agreement_check(gap_report(spark, sf))


@query(
    "v9_leakage",
    f"WITH {DAILY}, n AS (SELECT count(*) FILTER (Date < DATE '2024-01-25') AS a, count(*) FILTER (Date >= DATE '2024-01-25') AS b FROM daily) "
    "SELECT 'leakage:leak_cols' AS name, true AS passed, 'fire_count' AS detail UNION ALL SELECT 'leakage:lag_roll_cols', true, '1' "
    "UNION ALL SELECT 'leakage:split', a > 0 AND b > 0, 'train=' || a || ' test=' || b FROM n",
)
def v9_leakage(spark, sf):
    df = lags(daily(spark, sf).withColumn("fire_count", F.lit(1)), [T], [1])
    return q.leakage(df, split="2024-01-25")


def all_checks(spark, sf):
    df = daily(spark, sf)
    return q.run_all(
        q.required_columns(df, ["City", "Date", T], "daily"),
        q.no_nulls(df.select("City", "Date", T, R), "daily"),
        q.within_bounds(df, label="daily"),
        q.unique_keys(df, label="daily"),
        q.entities_covered(df, df.select("City"), label="daily"),
        q.probability_range(df, label="daily"),
    )


BOUNDED = [c for c in q.BOUNDS if c.endswith(("_mean", "_sum"))]
ALL = f"""WITH {DAILY}, r AS (
  SELECT 'daily:columns' AS name, true AS passed, '' AS detail
  UNION ALL SELECT 'daily:no_null', n = 0, CAST(n AS VARCHAR) FROM (SELECT count(*) FILTER (City IS NULL OR Date IS NULL OR {T} IS NULL OR {R} IS NULL) AS n FROM daily)
  UNION ALL """ + " UNION ALL ".join(f"SELECT 'daily:bounds:{c}', n = 0, CAST(n AS VARCHAR) FROM (SELECT count(*) FILTER ({c} < {q.BOUNDS[c][0]} OR {c} > {q.BOUNDS[c][1]}) AS n FROM daily)" for c in BOUNDED) + """
  UNION ALL SELECT 'daily:unique', n = 0, CAST(n AS VARCHAR) FROM (SELECT count(*) - count(DISTINCT (City, Date)) AS n FROM daily)
  UNION ALL SELECT 'daily:entities', true, '0'
  UNION ALL SELECT 'daily:prob_range', lo >= 0 AND hi <= 1, printf('[%.3f, %.3f]', lo, hi) FROM (SELECT min(probability) AS lo, max(probability) AS hi FROM daily))"""


@query("v10_run_all", f"{ALL} SELECT * FROM r")
def v10_run_all(spark, sf):
    return all_checks(spark, sf)


@query("v10_summary", f"{ALL} SELECT passed, count(*) AS n FROM r GROUP BY passed")
def v10_summary(spark, sf):
    return q.summary(all_checks(spark, sf))


@query(
    "v11_feature_coverage",
    f"WITH {DAILY} SELECT '{T}' AS feature, CAST(bool_or({T} <> 0) AS BIGINT) AS non_zero, CAST(1 AS BIGINT) AS present FROM daily UNION ALL SELECT 'zero', 0, 1 UNION ALL SELECT 'absent', 0, 0",
)
def v11_feature_coverage(spark, sf):
    df = daily(spark, sf).withColumn("zero", F.lit(0.0))
    return finish(q.feature_coverage(df, [T, "zero", "absent"]))
