"""Moisture, drought and comfort indices as Column expressions.

Each takes Columns, so the caller decides the names. The two indices that need a
trailing window (duff moisture, drought) return the per-row term; the window is
added by plans.features together with every other frame of the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chronopanel.functions.columns import clip


def fine_fuel_moisture(t: Column, h: Column, r: Column) -> Column:
    return clip(100 - (h * 0.5 + clip(r, 0.0, 10.0) * 3 - clip(t, 0.0, 40.0) * 0.5), 0.0, 100.0)


def duff_term(t: Column, h: Column, r: Column) -> Column:
    return clip(t, 0.0) * 0.3 - r * 0.8 + (100 - h) * 0.1


def drought_term(t: Column, r: Column) -> Column:
    return clip(t, 0.0) * 0.2 - r * 0.5


def initial_spread(ffmc: Column, w: Column) -> Column:
    return ffmc / 100 * (w * 0.3)


def build_up(dmc: Column, dc: Column) -> Column:
    return (dmc + dc) / 2


def fire_weather(isi: Column, bui: Column) -> Column:
    return clip(isi * bui / 50, 0.0)


def vapour_deficit(t: Column, h: Column) -> Column:
    """Saturation pressure less actual pressure in kPa, never negative."""
    return clip(0.6108 * F.exp(17.27 * t / (t + 237.3)) * (1 - h / 100), 0.0)


def dew_point(t: Column, h: Column) -> Column:
    """Magnus approximation; humidity is floored at one percent."""
    a, b = 17.27, 237.3
    g = a * t / (b + t) + F.ln(clip(h, 1.0) / 100)
    return b * g / (a - g)


# Rothfusz regression, (coefficient, power of Fahrenheit, power of humidity).
ROTHFUSZ = (
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-6.83783e-3, 2, 0),
    (-5.481717e-2, 0, 2),
    (1.22874e-3, 2, 1),
    (8.5282e-4, 1, 2),
    (-1.99e-6, 2, 2),
)


def heat_index(t: Column, h: Column) -> Column:
    """Felt temperature in Celsius, valid above 27 C; below, the temperature itself."""
    f = t * 9 / 5 + 32
    total = None
    for k, i, j in ROTHFUSZ:
        term = F.lit(k)
        for _ in range(i):
            term = term * f
        for _ in range(j):
            term = term * h
        total = term if total is None else total + term
    return F.when(t > 27, (total - 32) * 5 / 9).otherwise(t)


def interactions(t, h, w, streak, ndvi, drought, trees, vpd) -> dict[str, Column]:
    """Product terms, each already divided by 100 where the inputs are percentages."""
    return {
        "temp_x_low_hum": t * (100 - h) / 100,
        "temp_x_wind": t * w / 100,
        "dry_days_x_wind": streak * w / 100,
        "NDVI_x_drought": ndvi * drought / 100,
        "forest_x_dry_days": trees * streak / 100,
        "NDVI_x_VPD": ndvi * vpd,
    }


def extreme_flags(t, h, w, streak, t_high, h_low, w_high, dry_days=7) -> dict[str, Column]:
    """Threshold flags against fitted quantiles, and their product."""
    heat, dry, wind = [F.coalesce(x, F.lit(False)).cast("int") for x in (t > t_high, h < h_low, w > w_high)]
    return {
        "heatwave_flag": heat,
        "low_humidity_flag": dry,
        "high_wind_flag": wind,
        "dry_spell_flag": F.coalesce(streak >= dry_days, F.lit(False)).cast("int"),
        "hot_dry_windy": heat * dry * wind,
    }
