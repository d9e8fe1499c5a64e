"""Incremental runs over files that land in a folder.

A run takes what arrived since the last one (trigger availableNow) and stops. Each batch
replaces rows by key in snapshot tables kept by day, so a batch that is run again after a
failure leaves the same rows, and readers see each table before or after a batch. The days
of a batch are collected once; the tables are read by these days' folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronopanel.operators.aggregate import daily_panel
from chronopanel.plans.serve import daily_table
from chronopanel.sources import tables


def land(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Streaming scan of parquet files with a declared schema."""
    return spark.readStream.schema(schema).parquet(folder)


def store_hourly(batch: DataFrame, path: str, ts="Timestamp", entity="City") -> list:
    """Upsert measurements by (entity, time) into days; returns the batch's days."""
    rows = batch.withColumn("Date", F.to_date(ts))
    tables.upsert(rows, path, (entity, ts), "Date")
    return [r[0] for r in rows.select("Date").distinct().collect()]


def of_days(spark: SparkSession, path: str, days: list) -> DataFrame:
    """The stored rows of some days; the literals prune the table's folders."""
    return tables.read(spark, path).where(F.col("Date").isin(days))


def refresh_daily(spark: SparkSession, hourly_path: str, daily_path: str, days: list, entity="City", ts="Timestamp") -> None:
    """Recompute the daily rows of the given days from every hour stored for them."""
    touched = of_days(spark, hourly_path, days)
    tables.upsert(daily_panel(touched.drop("Date"), entity, ts), daily_path, (entity, "Date"), "Date")


def run_available(
    spark: SparkSession,
    source: str,
    schema,
    hourly_path: str,
    daily_path: str,
    checkpoint: str,
    scorer=None,
    public_path: str | None = None,
    threshold=0.15,
) -> None:
    """One run: new files to the hourly table, their days to the daily table.

    `scorer(daily)` returns the daily rows with a probability; the public table then gets
    the same days.
    """
    def handle(batch: DataFrame, _id: int) -> None:
        rows = batch.persist()
        try:
            days = store_hourly(rows, hourly_path)
            refresh_daily(spark, hourly_path, daily_path, days)
            if scorer is not None and public_path:
                public = daily_table(scorer(of_days(spark, daily_path, days)))
                tables.upsert(public, public_path, ("region", "date"), "date")
        finally:
            rows.unpersist()

    query = (
        land(spark, source, schema)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
