"""Column helpers: clipping, safe casts, presence tests, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def clip(c: Column, lo=None, hi=None) -> Column:
    """Bound a value; null stays null (greatest/least alone would skip it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNotNull(), out)


def clip_columns(df: DataFrame, bounds: dict) -> DataFrame:
    """Clip every column of `bounds` that the frame has."""
    return df.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items() if c in df.columns})


def first_present(df: DataFrame, names, default=None) -> Column:
    """The first of `names` the frame has, else a literal."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def to_number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def to_timestamp(c: Column) -> Column:
    return c.cast("string").try_cast("timestamp_ntz")


def round_even(c: Column, digits: int) -> Column:
    """Half-even rounding, as numpy does."""
    return F.bround(c, digits)


def ratio(num: Column, den: Column, default=0.0) -> Column:
    """Division that gives `default` where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))
