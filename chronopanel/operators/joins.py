"""Equi, dimension, range and semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronopanel.functions.columns import clip
from chronopanel.schema import BUFFER_KM, KM_PER_DEGREE

BROADCAST_ROWS = 200_000
SALTS = 32


def is_small(df: DataFrame, rows=BROADCAST_ROWS) -> bool:
    """Counts at most rows + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows=BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint, given only after a size check; otherwise the frame as it is."""
    return F.broadcast(df) if is_small(df, rows) else df


def left(base: DataFrame, other: DataFrame, on=("City", "Date"), salts=None) -> DataFrame:
    """Left equi join of two panels on their key."""
    return salted(base, other, on, "left", salts) if salts else base.join(other, list(on), "left")


def salted(big: DataFrame, other: DataFrame, on, how="inner", salts=SALTS) -> DataFrame:
    """Shuffled join whose hot keys in `big` spread over `salts` tasks.

    The salt is a hash of the row, so a retried task sends it to the same place.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted join cannot be {how}")
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def dimension(base: DataFrame, dim: DataFrame, on=("City",), how="left", fallback="_static", salts=None) -> DataFrame:
    """Join a dimension. Columns the base has keep their value; the dimension fills nulls.

    No hint: Spark broadcasts a side that is small by its statistics or by its measured
    shuffle size, and splits skewed partitions otherwise. `salts` spreads known hot keys.
    """
    shared = [c for c in dim.columns if c in base.columns and c not in on]
    renamed = dim.withColumnsRenamed({c: c + fallback for c in shared})
    out = salted(base, renamed, on, how, salts) if salts else base.join(renamed, list(on), how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.withColumns({c: F.coalesce(c, c + fallback) for c in shared}).drop(*[c + fallback for c in shared])


def lookup(base: DataFrame, table: DataFrame, on, value: str, default=None) -> DataFrame:
    """Value per key from a table; `default` where the key is absent."""
    out = dimension(base, table.select(*on, value), on)
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def keep_keys(base: DataFrame, keys: DataFrame, on=("City", "Date")) -> DataFrame:
    """Rows whose key is in `keys`."""
    return base.join(keys.select(*on).distinct(), list(on), "left_semi")


def absent_keys(required: DataFrame, present: DataFrame, on=("City",)) -> DataFrame:
    """Keys of `required` without a row in `present`."""
    return required.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")


def common_keys(a: DataFrame, b: DataFrame, on=("City", "Date")) -> DataFrame:
    """Distinct keys of both; each side is reduced before the shuffle."""
    return a.select(*on).distinct().intersect(b.select(*on).distinct())


def box(regions: DataFrame, km=BUFFER_KM, lat="lat", lon="lon") -> DataFrame:
    """Add the edges of a square of `km` to each side of the centre."""
    dlat = F.lit(km / KM_PER_DEGREE)
    dlon = F.lit(km) / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return regions.withColumns(
        {
            "lat_lo": F.col(lat) - dlat,
            "lat_hi": F.col(lat) + dlat,
            "lon_lo": F.col(lon) - dlon,
            "lon_hi": F.col(lon) + dlon,
        }
    )


def geofence(
    points: DataFrame,
    regions: DataFrame,
    km=BUFFER_KM,
    lat="latitude",
    lon="longitude",
    centre=("lat", "lon"),
    method="auto",
) -> DataFrame:
    """Every (point, region) pair with the point inside the region's square, edges included.

    Regions are laid onto grid cells of one box width, which makes an equi join on the
    cell with an exact test after it. A checked-small cell table is broadcast, so the
    points do not move; a large one is joined with salted cells, so one busy cell does
    not become one task.
    """
    size = 2 * km / KM_PER_DEGREE
    cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long")
    boxed = box(regions, km, *centre).drop(*centre)
    cells = (
        boxed.withColumn("_cy", F.explode(F.sequence(cell("lat_lo"), cell("lat_hi"))))
        .withColumn("_cx", F.explode(F.sequence(cell("lon_lo"), cell("lon_hi"))))
    )
    located = points.withColumns({"_cy": cell(lat), "_cx": cell(lon)})
    if method == "auto":
        method = "broadcast" if is_small(cells) else "salted"
    if method == "broadcast":
        pairs = located.join(F.broadcast(cells), ["_cy", "_cx"])
    else:
        pairs = salted(located, cells, ["_cy", "_cx"])
    inside = F.col(lat).between(F.col("lat_lo"), F.col("lat_hi")) & F.col(lon).between(
        F.col("lon_lo"), F.col("lon_hi")
    )
    return pairs.filter(inside).drop("_cy", "_cx", "lat_lo", "lat_hi", "lon_lo", "lon_hi")


def align_forecasts(actual: DataFrame, *forecasts: DataFrame, on=("City", "variable", "t")) -> DataFrame:
    """Inner join of actual values and any number of forecasts on series and time."""
    out = actual
    for f in forecasts:
        out = out.join(f, list(on))
    return out


def month_fill(df: DataFrame, history: DataFrame, value: str, entity="City", time="Date") -> DataFrame:
    """Fill a column from the entity's median of the same month in the history."""
    from chronopanel.operators.quantiles import medians

    table = medians(history.withColumn("_m", F.month(time)), [entity, "_m"], [value], "_med")
    out = dimension(df.withColumn("_m", F.month(time)), table, [entity, "_m"])
    current = F.col(value) if value in df.columns else F.lit(None).cast("double")
    return out.withColumn(value, F.coalesce(current, f"{value}_med")).drop("_m", f"{value}_med")


def agreement(daily: DataFrame, hourly: DataFrame, entity="City", ts="Timestamp", p="probability") -> DataFrame:
    """Daily probability beside the hourly maximum and mean of the same day."""
    rolled = hourly.groupBy(entity, F.to_date(ts).alias("Date")).agg(
        F.max(p).alias("hourly_max"), F.avg(p).alias("hourly_mean")
    )
    return daily.select(entity, "Date", F.col(p).alias("daily_prob")).join(rolled, [entity, "Date"])
