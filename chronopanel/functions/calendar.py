"""Calendar parts, cyclic encodings, season flags, date text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SUMMER, WINTER, FIRE_SEASON = (6, 7, 8), (12, 1, 2), (5, 6, 7, 8, 9)


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = c * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def season(month: Column) -> Column:
    """0 winter, 1 spring, 2 summer, 3 autumn."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def add_calendar(df: DataFrame, date="Date") -> DataFrame:
    d = F.col(date)
    parts = {
        "Year": F.year(d),
        "Month": F.month(d),
        "DayOfYear": F.dayofyear(d),
        "DayOfWeek": F.weekday(d),
        "WeekOfYear": F.weekofyear(d),
    }
    m = parts["Month"]
    for stem, key, period in (("Month", "Month", 12), ("DoY", "DayOfYear", 365), ("DoW", "DayOfWeek", 7)):
        parts[f"{stem}_sin"], parts[f"{stem}_cos"] = cyclic(parts[key], period)
    parts["Season"] = season(m)
    parts["is_summer"] = flag(m.isin(*SUMMER))
    parts["is_winter"] = flag(m.isin(*WINTER))
    parts["is_fire_season"] = flag(m.isin(*FIRE_SEASON))
    return df.withColumns(parts)


def add_hourly_calendar(df: DataFrame, ts="Timestamp", daytime=(6, 20)) -> DataFrame:
    h = F.hour(ts)
    s, c = cyclic(h, 24)
    return df.withColumns({"Hour": h, "Hour_sin": s, "Hour_cos": c, "is_daytime": flag(h.between(*daytime))})


def floor_day(c: Column) -> Column:
    return F.to_date(c)


def drop_zone(c: Column) -> Column:
    """Wall-clock value without a zone (timestamp_ntz)."""
    return c.cast("timestamp_ntz")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_minute(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm")


def run_time(zone: str) -> Column:
    """Start of the run as wall-clock time in `zone`."""
    return F.date_format(F.convert_timezone(None, F.lit(zone), F.localtimestamp()), "yyyy-MM-dd'T'HH:mm:ss")
