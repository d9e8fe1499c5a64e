from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import HOURLY, cols, finish, hourly, query
from catalog.functions import tier_sql
from chronopanel.session import scratch
from chronopanel.sources import tables, writers
from chronopanel.streaming import incremental

T, R = "Temperature_C_mean", "Rain_mm_sum"


@query(
    "s11_stream_daily",
    f"""WITH {HOURLY}, d AS (SELECT City, CAST(Timestamp AS DATE) AS Date, avg(Temperature_C + CASE WHEN hour(Timestamp) = 7 THEN 1 ELSE 0 END) AS {T}, sum(Rain_mm) AS {R} FROM hourly GROUP BY 1, 2),
    f AS (SELECT *, least(greatest({T} / 17.3, 0), 1) AS probability FROM d)
    SELECT {cols(key='City', date='Date', num=f'{T} {R} probability')}, {tier_sql('probability')} AS risk_level FROM f""",
)
def s11_stream_daily(spark, sf):
    """Two runs: hours before and after noon land apart, then one hour is corrected."""
    base = scratch(spark, "stream")
    src, h, d, pub, ck = (f"{base}/{n}" for n in ("landing", "hourly", "daily", "public", "checkpoint"))
    rows = hourly(spark, sf).drop("p")

    def score(daily):
        return daily.withColumn("probability", F.greatest(F.least(F.col(T) / 17.3, F.lit(1.0)), F.lit(0.0)))

    run = lambda: incremental.run_available(spark, src, rows.schema, h, d, ck, score, pub)
    writers.parquet(rows.filter(F.hour("Timestamp") < 12), src, mode="append")
    run()
    fixed = rows.filter(F.hour("Timestamp") == 7).withColumn("Temperature_C", F.col("Temperature_C") + 1)
    writers.parquet(rows.filter(F.hour("Timestamp") >= 12).unionByName(fixed), src, mode="append")
    run()
    daily = tables.read(spark, d).select("City", "Date", T, R)
    public = tables.read(spark, pub).select(F.col("region").alias("City"), F.to_date("date").alias("Date"), "probability", "risk_level")
    return finish(daily.join(public, ["City", "Date"]))
