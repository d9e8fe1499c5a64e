"""Data-quality checks as rows of (name, passed, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronopanel.functions.risk import tier
from chronopanel.operators.joins import absent_keys, agreement
from chronopanel.schema import BOUNDS, CHECK, LEAK_COLUMNS, TIERS


def _rows(spark: SparkSession, data) -> DataFrame:
    return spark.createDataFrame(data, CHECK)


def _check(name, passed: Column, detail: Column):
    name = name if isinstance(name, Column) else F.lit(name)
    return name.alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail")


def required_columns(df: DataFrame, names, label="table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    return _rows(df.sparkSession, [(f"{label}:columns", not missing, ",".join(missing))])


def paths_present(spark: SparkSession, paths, label="files") -> DataFrame:
    from chronopanel.sources.readers import exists

    return _rows(spark, [(f"{label}:{p}", exists(spark, p), p) for p in paths])


def manifest_keys(df: DataFrame, keys=("model_name", "optimal_threshold", "metrics")) -> DataFrame:
    return required_columns(df, keys, "manifest")


def no_nulls(df: DataFrame, label="table") -> DataFrame:
    """Total of null cells, one pass."""
    total = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("long"))
    return df.agg(total.alias("n")).select(*_check(f"{label}:no_null", F.col("n") == 0, F.col("n").cast("string")))


def observed_bounds(df: DataFrame, bounds=None) -> DataFrame:
    """Allowed and seen range per column, long form."""
    bounds = {c: b for c, b in (bounds or BOUNDS).items() if c in df.columns}
    aggs = [f(c).alias(f"{k}_{c}") for c in bounds for k, f in (("lo", F.min), ("hi", F.max))]
    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            F.lit(float(lo)).alias("lo"),
            F.lit(float(hi)).alias("hi"),
            F.col(f"lo_{c}").cast("double").alias("seen_lo"),
            F.col(f"hi_{c}").cast("double").alias("seen_hi"),
        )
        for c, (lo, hi) in bounds.items()
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def within_bounds(df: DataFrame, bounds=None, label="table") -> DataFrame:
    """Rows outside the physical range, per column, from one aggregation."""
    bounds = {c: b for c, b in (bounds or BOUNDS).items() if c in df.columns}
    aggs = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]
    long = df.agg(*aggs).unpivot([], list(bounds), "c", "n")
    return long.select(*_check(F.concat(F.lit(f"{label}:bounds:"), "c"), F.col("n") == 0, F.col("n").cast("string")))


def unique_keys(df: DataFrame, keys=("City", "Date"), label="table") -> DataFrame:
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    extra = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return extra.select(*_check(f"{label}:unique", F.col("n") == 0, F.col("n").cast("string")))


def entities_covered(df: DataFrame, required: DataFrame, key="City", label="table") -> DataFrame:
    """Required entities without rows: a row with their number, then one row for each of them."""
    missing = absent_keys(required, df, [key])
    count = missing.agg(F.count(F.lit(1)).alias("n")).select(*_check(f"{label}:entities", F.col("n") == 0, F.col("n").cast("string")))
    return count.unionByName(missing.select(*_check(f"{label}:entity", F.lit(False), F.col(key).cast("string"))))


def probability_range(df: DataFrame, p="probability", label="table") -> DataFrame:
    seen = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    detail = F.format_string("[%.3f, %.3f]", "lo", "hi")
    return seen.select(*_check(f"{label}:prob_range", (F.col("lo") >= 0) & (F.col("hi") <= 1), detail))


def known_levels(df: DataFrame, column="risk_level", levels=tuple(n for n, _ in TIERS), label="table") -> DataFrame:
    bad = df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*levels)).alias("n"))
    return bad.select(*_check(f"{label}:risk_levels", F.col("n") == 0, F.col("n").cast("string")))


def disagreement(daily: DataFrame, hourly: DataFrame, limit=0.35, entity="City", ts="Timestamp") -> DataFrame:
    """City-days with the distance between daily and greatest hourly probability."""
    pairs = agreement(daily, hourly, entity, ts)
    gap = F.abs(F.col("hourly_max") - F.col("daily_prob"))
    return pairs.withColumns(
        {
            "disagreement": gap,
            "mismatch_flag": (gap > limit).cast("int"),
            "daily_risk_level": tier(F.col("daily_prob"), "right"),
            "hourly_max_risk_level": tier(F.col("hourly_max"), "right"),
        }
    )


def agreement_check(report: DataFrame, share=0.20) -> DataFrame:
    row = report.agg(F.coalesce(F.sum("mismatch_flag"), F.lit(0)).alias("k"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") > 0) & (F.col("k") <= F.col("n") * share)
    return row.select(*_check("consistency:daily_hourly_agreement", ok, F.format_string("%d/%d", "k", "n")))


def leakage(df: DataFrame, split="2025-01-01", date="Date") -> DataFrame:
    """Leak columns present, trailing features present, both sides of the split filled."""
    found = [c for c in LEAK_COLUMNS if c in df.columns]
    trailing = [c for c in df.columns if "lag" in c.lower() or "roll" in c.lower()]
    static = _rows(
        df.sparkSession,
        [
            ("leakage:leak_cols", True, ",".join(found)),
            ("leakage:lag_roll_cols", bool(trailing), str(len(trailing))),
        ],
    )
    cut = F.lit(split).cast("date")
    n = df.agg(F.count_if(F.col(date) < cut).alias("a"), F.count_if(F.col(date) >= cut).alias("b"))
    sides = n.select(*_check("leakage:split", (F.col("a") > 0) & (F.col("b") > 0), F.format_string("train=%d test=%d", "a", "b")))
    return static.unionByName(sides)


def feature_coverage(df: DataFrame, expected) -> DataFrame:
    """Per expected feature: present, and whether any value differs from 0."""
    have = [c for c in expected if c in df.columns]
    missing = [c for c in expected if c not in df.columns]
    row = df.agg(*[F.coalesce(F.bool_or(F.col(c) != 0), F.lit(False)).cast("int").alias(c) for c in have])
    out = row.unpivot([], have, "feature", "non_zero").withColumn("present", F.lit(1))
    if missing:
        gone = df.sparkSession.createDataFrame([(c, 0, 0) for c in missing], "feature string, non_zero int, present int")
        out = out.unionByName(gone)
    return out


def run_all(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("passed").agg(F.count(F.lit(1)).alias("n"))


def exit_status(checks: DataFrame) -> int:
    return 1 if checks.filter(~F.col("passed")).limit(1).count() else 0
