"""Table sinks. Every write goes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronopanel.sources.readers import exists


def parquet(df: DataFrame, path: str, partition_by=(), mode="overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept, so every record has every key."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def new_rows(existing: DataFrame, incoming: DataFrame, keys=("City", "Date"), time="Date") -> DataFrame:
    """Incoming rows after the last stored time whose key is not stored yet."""
    last = existing.agg(F.max(time)).first()[0]
    late = incoming if last is None else incoming.filter(F.col(time) > F.lit(last))
    if time in keys:
        # a key of a later time can't be stored yet
        return late
    return late.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append(incoming: DataFrame, path: str, keys=("City", "Date"), time="Date", partition_by=()) -> None:
    """Append only what is new; a second run with the same input adds nothing."""
    from chronopanel.operators.repair import dedupe

    spark = incoming.sparkSession
    rows = dedupe(incoming, list(keys), time)
    if exists(spark, path):
        rows = new_rows(spark.read.parquet(path), rows, keys, time)
    parquet(rows, path, partition_by, "append")


def upsert(incoming: DataFrame, path: str, keys=("City", "Date"), day="Date", files=8) -> None:
    """Replace rows by key, late corrections included. The table is partitioned by `day`.

    Only the days in the input are read and rewritten, in at most `files` files each; the
    input wins on a shared key. Running it again with the same input gives the same table.
    """
    from chronopanel.operators.repair import dedupe

    spark = incoming.sparkSession
    rows = dedupe(incoming, list(keys), [day])
    if exists(spark, path):
        old = spark.read.schema(_stored(incoming, day)).parquet(path)
        touched = _touched(old, incoming.select(day).distinct(), day)
        kept = touched.join(rows.select(*keys), list(keys), "left_anti")
        rows = rows.unionByName(kept.select(*rows.columns))
    rows = rows.repartition(F.col(day), F.pmod(F.xxhash64(*keys), F.lit(files)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def _stored(df: DataFrame, day: str):
    """The stored table's schema, without inferring partition types from folder names."""
    return df.schema


def _touched(old: DataFrame, days: DataFrame, day: str, limit=10_000) -> DataFrame:
    """The stored rows of the given days, by literals that prune the stored table's partitions.

    Up to `limit` days are named one by one; more bound a range first and are then joined.
    """
    named = [r[0] for r in days.dropna().limit(limit + 1).collect()]
    if len(named) <= limit:
        return old.filter(F.col(day).isin(named))
    lo, hi = days.agg(F.min(day), F.max(day)).first()
    return old.filter(F.col(day).between(lo, hi)).join(days, day, "left_semi")


def manifest(spark: SparkSession, record: dict, path: str) -> None:
    """One nested record as JSON."""
    import json as text

    df = spark.createDataFrame([(text.dumps(record, sort_keys=True),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The record as a one-row frame with nested structs."""
    return spark.read.option("multiLine", True).json(path)


def metrics_record(board: DataFrame, model="model", threshold=0.5, features=0, horizon_days=30) -> DataFrame:
    """The leaderboard as one nested row: best model, split, ordered board."""
    rest = [c for c in board.columns if c not in (model,)]
    entry = F.struct(F.col("selection_score").alias("selection_score"), F.col(model).alias(model), *[c for c in rest if c != "selection_score"])
    return board.agg(
        F.max_by(F.col(model), F.struct(F.col("selection_score"), F.col(model))).alias("selected_model"),
        F.sort_array(F.collect_list(entry), asc=False).alias("leaderboard"),
    ).select(
        "selected_model",
        F.lit(threshold).alias("selected_threshold"),
        F.lit(features).alias("feature_count"),
        F.lit(horizon_days).alias("prediction_horizon_days"),
        "leaderboard",
    )
