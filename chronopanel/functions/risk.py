"""Probability to tier, confidence, score, text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from chronopanel.functions.columns import clip, round_even
from chronopanel.schema import TIER_COLOURS, TIERS


#: Default wording; both sentences take a table of their own in its place.
PHRASES = {
    "hot": "hot conditions",
    "cool": "cool conditions",
    "mild": "mild temperatures",
    "wind": "strong wind",
    "dry": "dry air",
    "rain": "recent rainfall",
}
WARNINGS = {
    "risk": "Fire danger is high.",
    "wind": "A fire would travel fast in this wind.",
    "dry": "Dry air leaves plants easy to light.",
    "none": "Fire danger is low.",
}
# The weather bounds the phrases stand for.
HOT_C, COOL_C, WINDY_KMH, DRY_PERCENT, WET_MM = 28, 12, 18, 40, 2


def tier(p: Column, closed="left", tiers=TIERS) -> Column:
    """Tier name. closed='left' puts a bound into the upper tier, 'right' into the lower."""
    if closed not in ("left", "right"):
        raise ValueError("closed is 'left' or 'right'")
    out = None
    for name, lo in reversed(tiers[1:]):
        hit = p >= lo if closed == "left" else p > lo
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(p.isNotNull(), out.otherwise(tiers[0][0]))


def confidence(p: Column) -> Column:
    """Distance from the undecided middle, between .55 and .95."""
    return clip(0.55 + F.abs(p - 0.5) * 0.8, 0.55, 0.95)


def risk_score(p: Column) -> Column:
    return round_even(p * 100, 1)


def predicted(p: Column, threshold) -> Column:
    return (p >= threshold).cast("int")


def colour(level: Column, colours=None) -> Column:
    pairs = (colours or TIER_COLOURS).items()
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)]), level)


def climate_summary(t: Column, w: Column, h: Column, r: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """One sentence from the conditions that hold."""
    parts = F.concat_ws(
        ", ",
        F.when(t >= HOT_C, phrases["hot"]).when(t <= COOL_C, phrases["cool"]).otherwise(phrases["mild"]),
        F.when(w >= WINDY_KMH, phrases["wind"]),
        F.when(h <= DRY_PERCENT, phrases["dry"]),
        F.when(r >= WET_MM, phrases["rain"]),
    )
    return F.concat(F.upper(F.left(parts, F.lit(1))), F.substring(parts, F.lit(2), F.length(parts)), F.lit("."))


def warning_text(level: Column, w: Column, h: Column, warnings: dict[str, str] = WARNINGS) -> Column:
    return (
        F.when(level.isin("High", "Extreme"), warnings["risk"])
        .when(w >= WINDY_KMH, warnings["wind"])
        .when(h <= DRY_PERCENT, warnings["dry"])
        .otherwise(warnings["none"])
    )


def hourly_ceiling(p: Column, daily: Column, factor=2.5, floor=0.15) -> Column:
    """Cap an hourly probability by the day's; hours of an unscored day stay as they are."""
    return F.when(daily.isNull(), p).otherwise(F.least(p, F.greatest(daily * factor, F.lit(floor))))
