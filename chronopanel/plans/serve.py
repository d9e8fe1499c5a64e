"""Public tables: scored rows with tiers, colours, text and rounded weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronopanel.functions import risk
from chronopanel.functions.calendar import iso_date, iso_minute
from chronopanel.functions.columns import clip, first_present, round_even
from chronopanel.operators.joins import dimension
from chronopanel.operators.windows import latest
from chronopanel.schema import DAILY_TARGETS

PROBABILITY = ("probability", "fire_probability")


def attach_scores(rows: DataFrame, scores: DataFrame, keys=("City", "Date"), p="probability") -> DataFrame:
    """Scores join on the key, never by position."""
    return rows.join(scores.select(*keys, p), list(keys))


def _scored(p: Column, threshold) -> dict[str, Column]:
    level = risk.tier(p)
    return {
        "probability": p,
        "risk_level": level,
        "risk_score": risk.risk_score(p),
        "predicted_fire": risk.predicted(p, threshold),
        "confidence": risk.confidence(p),
        "risk_color": risk.colour(level),
    }


def _probability(df: DataFrame) -> Column:
    if not any(c in df.columns for c in PROBABILITY):
        raise ValueError("no probability column")
    return clip(first_present(df, PROBABILITY), 0.0, 1.0)


def _weather(df: DataFrame, names: dict) -> dict[str, Column]:
    return {dst: round_even(F.col(src), n) for src, (dst, n) in names.items() if src in df.columns}


def daily_table(df: DataFrame, threshold=0.15, coords: DataFrame | None = None, text=True) -> DataFrame:
    """The public daily table in one projection; coordinates by key."""
    p = _probability(df)
    made = {"date": iso_date(F.col("Date")), "region": F.col("City"), **_scored(p, threshold)}
    made.update(
        _weather(
            df,
            {
                "Temperature_C_mean": ("temperature", 1),
                "Humidity_percent_mean": ("humidity", 1),
                "Wind_Speed_kmh_mean": ("wind", 1),
                "Rain_mm_sum": ("rain", 2),
            },
        )
    )
    made.update({c: F.col(c) for c in DAILY_TARGETS if c in df.columns})
    if text:
        t, w, h, r = (
            first_present(df, [c])
            for c in ("Temperature_C_mean", "Wind_Speed_kmh_mean", "Humidity_percent_mean", "Rain_mm_sum")
        )
        made["climate_summary"] = risk.climate_summary(t, w, h, r)
        made["warning"] = risk.warning_text(risk.tier(p), w, h)
    return _located(df.select(*[c.alias(n) for n, c in made.items()]), coords)


def _located(out: DataFrame, coords: DataFrame | None) -> DataFrame:
    if coords is None:
        return out
    return dimension(out, coords.select(F.col("City").alias("region"), "Latitude", "Longitude"), ["region"])


def cap_hourly(hourly: DataFrame, days: DataFrame, factor=2.5, floor=0.15, p="probability") -> DataFrame:
    """Hourly probabilities under the ceiling of their day."""
    table = days.select("City", "Date", F.col(p).alias("_day"))
    out = hourly.withColumn("Date", F.to_date("Timestamp")).join(table, ["City", "Date"], "left")
    return out.withColumn(p, risk.hourly_ceiling(F.col(p), F.col("_day"), factor, floor)).drop("_day")


def hourly_table(df: DataFrame, days: DataFrame | None = None, threshold=0.15, coords: DataFrame | None = None) -> DataFrame:
    """The public hourly table, capped by the daily one when given."""
    rows = df.withColumn("probability", _probability(df))
    if days is not None:
        rows = cap_hourly(rows, days)
    p = clip(F.col("probability"), 0.0, 1.0)
    made = {"timestamp": iso_minute(F.col("Timestamp")), "region": F.col("City"), **_scored(p, threshold)}
    made.update(
        _weather(
            rows,
            {
                "Temperature_C": ("temperature", 1),
                "Humidity_percent": ("humidity", 1),
                "Wind_Speed_kmh": ("wind", 1),
                "Solar_Radiation_Wm2": ("solar", 1),
            },
        )
    )
    return _located(rows.select(*[c.alias(n) for n, c in made.items()]), coords)


def map_points(public: DataFrame) -> DataFrame:
    """Latest row per region."""
    return latest(public, ["region"], "date")


def select_view(public: DataFrame, region=None, day=None, level=None, stamp="date") -> DataFrame:
    """Rows of a region, a day and a tier; any may be left open."""
    out = public.dropna(subset=["probability", "region"])
    if region is not None:
        out = out.filter(F.col("region") == region)
    if day is not None:
        # a range test on the text reaches the scan, unlike a substring
        out = out.filter(F.col(stamp).between(day, day + "￿"))
    if level is not None:
        out = out.filter(F.col("risk_level") == level)
    return out


def first_hours(public: DataFrame) -> DataFrame:
    """First hour per region."""
    rest = [c for c in public.columns if c != "region"]
    top = public.groupBy("region").agg(F.min_by(F.struct(*rest), F.col("timestamp")).alias("_r"))
    return top.select("region", "_r.*")
