"""Renames, casts, splits, fills and row repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronopanel.functions.columns import clip, to_number, to_timestamp
from chronopanel.operators.joins import absent_keys, dimension, small
from chronopanel.operators.quantiles import medians, quantiles
from chronopanel.schema import KEY_COLUMNS, NOT_FEATURES, SOURCE_NAMES, TEST_START, TRAIN_END

SUFFIXES = ("_mean", "_sum", "_min", "_max")


def rename_sources(df: DataFrame, names=None) -> DataFrame:
    return df.withColumnsRenamed(names or SOURCE_NAMES)


def suffix_means(df: DataFrame, keys=("City", "Date")) -> DataFrame:
    """Bare weather names gain _mean, unless they carry a suffix or the result exists."""
    bare = [
        c
        for c in df.columns
        if c not in keys and not any(s in c for s in SUFFIXES) and c + "_mean" not in df.columns
    ]
    return df.withColumnsRenamed({c: c + "_mean" for c in bare})


def coerce(df: DataFrame, numbers=(), times=(), required=None) -> DataFrame:
    """Cast text, bad values to null, then drop rows null in `required`."""
    made = {c: to_number(F.col(c)) for c in numbers}
    made.update({c: to_timestamp(F.col(c)) for c in times})
    return df.withColumns(made).dropna(subset=list(required if required is not None else [*numbers, *times]))


def temporal_split(df: DataFrame, time="Date", train_end=TRAIN_END, test_start=TEST_START, name="split") -> DataFrame:
    """Label rows train, val or test by date. Null dates get no split."""
    t = F.col(time)
    return df.withColumn(
        name, F.when(t < F.lit(train_end).cast("date"), "train").when(t < F.lit(test_start).cast("date"), "val").when(t.isNotNull(), "test")
    )


def holdout_split(df: DataFrame, time="Date", back="30 day", name="holdout") -> DataFrame:
    """Mark the rows after max(time) less `back`."""
    n, unit = back.split()
    last = df.agg(F.max(F.col(time).cast("timestamp_ntz")).alias("_last"))
    cut = F.col("_last") - F.expr(f"interval {int(n)} {unit}")
    return df.crossJoin(F.broadcast(last)).withColumn(name, (F.col(time) > cut).cast("int")).drop("_last")


def feature_names(df: DataFrame, drop=NOT_FEATURES) -> list[str]:
    """Numeric columns that are no key, label or leak, sorted."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop)


def select_features(df: DataFrame, names, keep=("City", "Date")) -> DataFrame:
    """The saved feature list in order; absent columns become null."""
    have = set(df.columns)
    cols = [F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in names]
    return df.select(*[c for c in keep if c in have], *cols)


def align_features(df: DataFrame, names, keep=("City", "Date")) -> DataFrame:
    """As select_features, with 0 for absent columns and nulls."""
    return select_features(df, names, keep).fillna(0.0, subset=list(names))


def winsorise(df: DataFrame, names, lo=0.01, hi=0.99) -> DataFrame:
    """Clip each column at its global quantiles."""
    wanted = {}
    for c in names:
        wanted[f"{c}_qlo"], wanted[f"{c}_qhi"] = (c, lo), (c, hi)
    q = quantiles(df, [], wanted)
    out = df.crossJoin(F.broadcast(q))
    return out.withColumns({c: clip(F.col(c), F.col(f"{c}_qlo"), F.col(f"{c}_qhi")) for c in names}).drop(*wanted)


def median_fill(df: DataFrame, names, by=("City",)) -> DataFrame:
    """Null to the entity's median, then to 0."""
    out = dimension(df, medians(df, by, names, "_med"), by)
    return out.withColumns({c: F.coalesce(c, f"{c}_med", F.lit(0.0)) for c in names}).drop(*[f"{c}_med" for c in names])


def zero_repair(df: DataFrame, history: DataFrame, base=(), calendar=(), lagged=(), by=("City",)) -> DataFrame:
    """Base columns: null or 0 to the history median. Lagged: only null. Calendar: null to 0."""
    known = [c for c in [*base, *lagged] if c in history.columns]
    out = dimension(df, medians(history, by, known, "_med"), by)
    made: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(0)) for c in calendar}
    for c in [*base, *lagged]:
        value = F.nullif(F.col(c), F.lit(0.0)) if c in base else F.col(c)
        fill = F.col(f"{c}_med") if c in known else F.lit(None)
        made[c] = F.coalesce(value, fill, F.lit(0.0))
    return out.withColumns(made).drop(*[f"{c}_med" for c in known])


def constant_fill(df: DataFrame, names=None, value=0) -> DataFrame:
    """Nulls to a constant in the named columns, or in every numeric one."""
    names = names or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.fillna(value, subset=list(names))


def dedupe(df: DataFrame, keys, order, keep="last") -> DataFrame:
    """One row per key, first or last in `order`.

    An aggregation rather than a window: copies collapse before the shuffle, so a key
    with a third of all rows costs no more than any other. Ties in `order` are settled
    by the remaining columns.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in [*order, *[r for r in rest if r not in order]]])
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def spread_estimate(forecast: DataFrame, history: DataFrame, variables) -> DataFrame:
    """Add _max and _min from the mean historical distance to the mean, each at least 0."""
    aggs = []
    for v in variables:
        up, down = F.col(f"{v}_max") - F.col(f"{v}_mean"), F.col(f"{v}_mean") - F.col(f"{v}_min")
        aggs += [F.avg(clip(up, 0.0)).alias(f"_up_{v}"), F.avg(clip(down, 0.0)).alias(f"_dn_{v}")]
    out = forecast.crossJoin(F.broadcast(history.agg(*aggs)))
    made = {}
    for v in variables:
        made[f"{v}_max"] = F.col(f"{v}_mean") + F.col(f"_up_{v}")
        made[f"{v}_min"] = F.col(f"{v}_mean") - F.col(f"_dn_{v}")
    return out.withColumns(made).drop(*[f"_{k}_{v}" for v in variables for k in ("up", "dn")])


def intraday_proxies(df: DataFrame) -> DataFrame:
    """Hour counts and ranges of a day estimated from its daily values."""
    t, h, w = F.col("Temperature_C_mean"), F.col("Humidity_percent_mean"), F.col("Wind_Speed_kmh_mean")
    count = lambda cond, x, lo, hi: F.when(cond, clip(x, lo, hi)).otherwise(0.0)
    has = lambda c, other: F.col(c) if c in df.columns else other
    return df.withColumns(
        {
            "temp_range": has("Temperature_C_max", t + 3) - has("Temperature_C_min", t - 3),
            "Humidity_percent_diurnal_range": has("Humidity_percent_max", h + 10) - has("Humidity_percent_min", h - 10),
            "hours_temp_above_30": count(t >= 28, (t - 28) * 2, 1.0, 12.0),
            "hours_humidity_below_30": count(h <= 40, (40 - h) * 0.5, 1.0, 10.0),
            "hours_wind_above_20": count(w >= 18, (w - 18) * 0.8, 1.0, 8.0),
            "solar_peak_hour": F.lit(13.0),
            "temp_night_min": has("Temperature_C_min", t - 4),
        }
    )


def daytime_label(df: DataFrame, label="Fire_Occurred", daytime="is_daytime") -> DataFrame:
    return df.withColumn(label, F.when(F.col(daytime) == 0, 0).otherwise(F.col(label)))


def template_rows(df: DataFrame, entities: DataFrame, template=None, key="City") -> DataFrame:
    """Copy one entity's rows to entities without any, marked imputed=1.

    Without a key column every row goes to every entity. The template is the first
    entity in order unless one is named.
    """
    if key not in df.columns:
        return df.crossJoin(small(entities.select(key).distinct())).withColumn("imputed", F.lit(0))
    missing = absent_keys(entities, df, [key])
    if template is None:
        first = df.agg(F.min(key).alias("_t"))
        source = df.crossJoin(F.broadcast(first)).filter(F.col(key) == F.col("_t")).drop("_t")
    else:
        source = df.filter(F.col(key) == template)
    copies = source.drop(key).crossJoin(small(missing)).withColumn("imputed", F.lit(1))
    return df.withColumn("imputed", F.lit(0)).unionByName(copies)


def placeholder_rows(df: DataFrame, entities: DataFrame, names, key="City", value=0.0) -> DataFrame:
    """One row per required entity, constants where the frame has none."""
    return entities.select(key).distinct().join(df, key, "left").fillna(value, subset=list(names))


def drop_null_rows(df: DataFrame, names) -> DataFrame:
    return df.dropna(subset=list(names))


def narrow(df: DataFrame) -> DataFrame:
    """Cast long and double columns to the smallest type that holds every value.

    One aggregation finds the ranges; doubles narrow only where float keeps them exact.
    """
    longs = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    aggs = []
    for c in longs:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    for c in doubles:
        aggs.append(F.bool_and(F.col(c).cast("float").cast("double") == F.col(c)).alias(f"ok_{c}"))
    if not aggs:
        return df
    seen = df.agg(*aggs).first()
    made = {}
    for c in longs:
        lo, hi = seen[f"lo_{c}"], seen[f"hi_{c}"]
        if lo is None:
            continue
        for kind, bits in (("byte", 7), ("short", 15), ("int", 31)):
            if -(2**bits) <= lo and hi < 2**bits:
                made[c] = F.col(c).cast(kind)
                break
    made.update({c: F.col(c).cast("float") for c in doubles if seen[f"ok_{c}"]})
    return df.withColumns(made)


def one_hot(df: DataFrame, column: str, values, prefix: str) -> DataFrame:
    """0/1 column per known value; the source column stays."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def one_hot_inverse(df: DataFrame, values, prefix: str, name: str) -> DataFrame:
    """Name of the first column that is set."""
    return df.withColumn(name, F.coalesce(*[F.when(F.col(f"{prefix}_{v}") == 1, F.lit(v)) for v in values]))


def key_columns(df: DataFrame) -> list[str]:
    return [c for c in KEY_COLUMNS if c in df.columns]
