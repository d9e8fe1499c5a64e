"""Grouped aggregates: panels, profiles, seasonal tables, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from chronopanel.operators.quantiles import medians, quantiles
from chronopanel.schema import HOURLY_WEATHER

MEAN_ONLY = ("Wind_Dir_deg", "Solar_Radiation_Wm2")


def daily_panel(df: DataFrame, entity="City", ts="Timestamp", names=HOURLY_WEATHER, intraday=True) -> DataFrame:
    """Hourly to daily in one aggregation: sums, means, ranges, hour counts, parts of the day.

    Rain is summed, all-null days to 0; direction and solar are averaged; the others get
    mean, min and max.
    """
    aggs = []
    for c in [n for n in names if n in df.columns]:
        if c == "Rain_mm":
            aggs.append(F.coalesce(F.sum(c), F.lit(0.0)).alias("Rain_mm_sum"))
            continue
        aggs.append(F.avg(c).alias(f"{c}_mean"))
        if c not in MEAN_ONLY:
            aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    have = set(df.columns)
    if intraday:
        hour = F.hour(ts)
        if "Temperature_C" in have:
            t = F.col("Temperature_C")
            aggs += [
                F.count_if(t > 30).alias("hours_temp_above_30"),
                (F.max(t) - F.min(t)).alias("temp_range"),
                F.coalesce(F.min(F.when(hour <= 5, t)), F.min(t)).alias("temp_night_min"),
                F.coalesce(F.max(F.when(hour.between(12, 17), t)), F.max(t)).alias("temp_afternoon_max"),
            ]
        if "Humidity_percent" in have:
            h = F.col("Humidity_percent")
            aggs += [
                F.count_if(h < 30).alias("hours_humidity_below_30"),
                (F.max(h) - F.min(h)).alias("Humidity_percent_diurnal_range"),
            ]
        if "Wind_Speed_kmh" in have:
            aggs.append(F.count_if(F.col("Wind_Speed_kmh") > 20).alias("hours_wind_above_20"))
        if "Solar_Radiation_Wm2" in have:
            aggs.append(peak_hour(F.col("Solar_Radiation_Wm2"), hour).alias("solar_peak_hour"))
    return df.groupBy(entity, F.to_date(ts).alias("Date")).agg(*aggs)


def peak_hour(value, hour, default=12):
    """Hour of the greatest positive value, the earliest on a tie, `default` without any."""
    best = F.max(F.when(value > 0, F.struct(value.alias("v"), (-hour).alias("h"))))
    return F.coalesce(-best["h"], F.lit(default))


def event_days(df: DataFrame, entity="City", date="Date") -> DataFrame:
    """Detections per entity and day, with the constant label."""
    return df.groupBy(entity, date).agg(
        F.count(F.lit(1)).alias("fire_count"),
        F.avg("brightness").alias("mean_brightness"),
        F.max("frp").alias("max_frp"),
        F.lit(1).alias("Fire_Occurred"),
    )


def regroup(df: DataFrame, by, maxima=(), means=()) -> DataFrame:
    """Maxima and means per key under their own names."""
    return df.groupBy(*by).agg(*[F.max(c).alias(c) for c in maxima], *[F.avg(c).alias(c) for c in means])


def profile(df: DataFrame, by, names) -> DataFrame:
    """Count, moments and quartiles per group and column, long form.

    Skewness and kurtosis carry the small-sample correction that statistical packages
    apply, since Spark's are population moments.
    """
    by = list(by)
    aggs, wanted = [], {}
    for c in names:
        aggs += [
            F.count(c).alias(f"n_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.skewness(c).alias(f"g1_{c}"),
            F.kurtosis(c).alias(f"g2_{c}"),
        ]
        for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            wanted[f"{q}_{c}"] = (c, p)
    wide = df.groupBy(*by).agg(*aggs).join(quantiles(df, by, wanted), by)
    fields = ("n", "mean", "std", "min", "q25", "median", "q75", "max", "g1", "g2")
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{f}_{c}").alias(f) for f in fields]) for c in names])
    long = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return long.withColumns({"skew": skew, "kurtosis": kurt}).drop("g1", "g2")


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, null count, null percent."""
    n = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.lit(t).alias("dtype"), F.col(c).alias("nulls"))
            for c, t in df.dtypes
        ]
    )
    long = n.select("_rows", F.explode(rows).alias("r")).select("r.*", "_rows")
    return long.select("variable", "dtype", "nulls", F.coalesce(F.try_divide(F.col("nulls") * 100.0, "_rows"), F.lit(0.0)).alias("percent"))


def null_counts_by(df: DataFrame, by, names) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])


def duplicate_rows(df: DataFrame, keys) -> DataFrame:
    """Rows beyond the first per key, as one number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def curve(df: DataFrame, value: str, by) -> DataFrame:
    """Mean of a variable by hour, label or both."""
    return df.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.count(F.lit(1)).alias("n"))


def rates(df: DataFrame, label: str, by) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(label).cast("long").alias("events"), F.avg(label).alias("rate"))


def month_matrix(df: DataFrame, label="Fire_Occurred", entity="City", month="Month") -> DataFrame:
    """Entities by twelve months, mean label in percent."""
    wide = df.groupBy(entity).pivot(month, list(range(1, 13))).agg(F.avg(label) * 100)
    return wide.select(entity, *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def outliers(df: DataFrame, by, names) -> DataFrame:
    """Count and percent of values beyond 1.5 interquartile ranges, long form."""
    by = list(by)
    boxes = box_bounds(df, by, names)
    long = melt(df, by, names)
    joined = long.join(F.broadcast(boxes) if not by else boxes, [*by, "variable"])
    out = F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    return joined.groupBy(*by, "variable").agg(
        out.alias("outliers"), (out * 100.0 / F.count(F.lit(1))).alias("percent")
    )


def melt(df: DataFrame, by, names) -> DataFrame:
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(by), list(names), "variable", "value")


def box_bounds(df: DataFrame, by, names) -> DataFrame:
    """Quartiles and outlier fences per group and column, long form."""
    by = list(by)
    wanted = {f"{q}_{c}": (c, p) for c in names for q, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    wide = quantiles(df, by, wanted)
    rows = F.array(
        *[F.struct(F.lit(c).alias("variable"), *[F.col(f"{q}_{c}").alias(q) for q in ("q1", "q2", "q3")]) for c in names]
    )
    iqr = F.col("q3") - F.col("q1")
    return (
        wide.select(*by, F.explode(rows).alias("r"))
        .select(*by, "r.*")
        .withColumns({"lower": F.col("q1") - iqr * 1.5, "upper": F.col("q3") + iqr * 1.5})
    )


def box_stats(df: DataFrame, by, names) -> DataFrame:
    """Quartiles, whisker ends (last values inside the fences) and outlier count."""
    by = list(by)
    joined = melt(df, by, names).join(box_bounds(df, by, names), [*by, "variable"])
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    return joined.groupBy(*by, "variable", "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )


def climatology(df: DataFrame, names, by=("City", "Month")) -> DataFrame:
    """Mean of each column by entity and month; fit on the training rows only."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names])


def tier_counts(df: DataFrame, level="risk_level") -> DataFrame:
    return df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def risk_by_entity(df: DataFrame, p="probability", entity="City") -> DataFrame:
    return df.groupBy(entity).agg(F.avg(p).alias("mean_probability"), F.max(p).alias("max_probability"))


def top(df: DataFrame, order, k: int, descending=True) -> DataFrame:
    """First k rows; Spark keeps k per task rather than sorting everything."""
    cols = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*[F.desc(c) if descending and i == 0 else F.asc(c) for i, c in enumerate(cols)]).limit(k)


def sample_rows(df: DataFrame, n: int, key, seed=42) -> DataFrame:
    """n rows without replacement, the same ones on every run: smallest keyed hashes first."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(h, *keys).limit(n)


def histogram(df: DataFrame, value: str, bins: int, by=()) -> DataFrame:
    """Equal-width bins over the overall range with count and density per group."""
    by = list(by)
    edge = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = F.col(value).cast("double")
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_ = F.least(F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = (
        df.filter(F.col(value).isNotNull())
        .crossJoin(F.broadcast(edge))
        .withColumns({"bin": bin_, "width": width.cast("double"), "lo": F.col("_lo").cast("double")})
        .groupBy(*by, "bin", "width", "lo")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if by:
        counted = counted.join(counted.groupBy(*by).agg(F.sum("n").alias("_all")), by)
    else:
        counted = counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("_all"))))
    return counted.select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
        "n",
        F.try_divide(F.col("n").cast("double"), F.col("_all") * F.col("width")).alias("density"),
    )


def distinct_count(df: DataFrame, column: str, by=(), approx=False) -> DataFrame:
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(f(column).alias("n_distinct"))


def first_non_null(df: DataFrame, variables, by=("City", "Date"), value="value", order=None) -> DataFrame:
    """Long to wide, one row per key. Of several values of a cell the first in `order` stands (a
    column or columns), without an order the smallest; nulls don't count."""
    at = F.struct(*([order] if isinstance(order, str) else order)) if order else F.col(value)

    def cell(v):
        here = (F.col("variable") == v) & F.col(value).isNotNull()
        return F.min_by(F.when(here, F.col(value)), F.when(here, at)).alias(v)

    return df.groupBy(*by).agg(*[cell(v) for v in variables])


def entity_medians(df: DataFrame, by=("City",)) -> DataFrame:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in by]
    return medians(df, by, names)


def window_means(df: DataFrame, value: str, entity="City") -> DataFrame:
    return df.groupBy(entity).agg(F.avg(value).alias(value))


def versus_last_year(forecast: DataFrame, history: DataFrame, value: str, entity="City", date="Date") -> DataFrame:
    """Forecast mean per entity against the same dates one year back."""
    # two scalars first: as literals they reach the scan of the history
    first, last = forecast.agg(F.add_months(F.min(date), -12), F.add_months(F.max(date), -12)).first()
    past = history.filter(F.col(date).between(F.lit(first), F.lit(last)))
    return _compare(forecast, past, value, entity, "last_year")


def forecast_months(forecast: DataFrame, date="Date") -> DataFrame:
    """Distinct months the forecast touches, right over the turn of the year too."""
    return forecast.select(F.month(date).alias("_m")).distinct()


def versus_years(forecast: DataFrame, history: DataFrame, value: str, first=2015, last=2024, entity="City", date="Date") -> DataFrame:
    """Forecast mean per entity against the same months of a range of years."""
    start, end = (F.lit(f"{y:04d}-01-01").cast("date") for y in (first, last + 1))
    past = history.filter((F.col(date) >= start) & (F.col(date) < end)).withColumn("_m", F.month(date))
    past = past.join(F.broadcast(forecast_months(forecast, date)), "_m", "left_semi")
    return _compare(forecast, past, value, entity, "decade")


def _compare(forecast, past, value, entity, name):
    now = forecast.groupBy(entity).agg(F.avg(value).alias("forecast"))
    then = past.groupBy(entity).agg(F.avg(value).alias(name))
    return now.join(then, entity).withColumn("diff", F.col("forecast") - F.col(name))


def risk_change(forecast: DataFrame, history: DataFrame, p="fire_probability", label="Fire_Occurred", first=2015, last=2024, entity="City", date="Date") -> DataFrame:
    """Mean forecast risk less last year's and the decade's event rate, in percent with one decimal."""
    events = history.withColumnRenamed(label, p)
    ly = versus_last_year(forecast, events, p, entity, date).select(entity, "forecast", "last_year")
    dec = versus_years(forecast, events, p, first, last, entity, date).select(entity, "decade")
    pct = lambda c: F.bround(c * 100, 1)
    return ly.join(dec, entity).select(
        entity,
        pct(F.col("forecast")).alias("risk_percent"),
        pct(F.col("forecast") - F.col("last_year")).alias("vs_last_year"),
        pct(F.col("forecast") - F.col("decade")).alias("vs_decade"),
    )


def annual_trends(df: DataFrame, entity="City", date="Date") -> DataFrame:
    """Least-squares slope per year of mean temperature, hot days, rain per entity and events."""
    yearly = df.groupBy(F.year(date).alias("year")).agg(
        F.avg("Temperature_C_mean").alias("temperature"),
        F.count_if(F.col("Temperature_C_max") > 35).cast("double").alias("hot_days"),
        (F.sum("Rain_mm_sum") / F.count_distinct(entity)).alias("rain"),
        F.sum("Fire_Occurred").cast("double").alias("events"),
    )
    long = yearly.unpivot("year", ["temperature", "hot_days", "rain", "events"], "signal", "value")
    return long.groupBy("signal").agg(
        F.regr_slope("value", "year").alias("slope"), F.regr_intercept("value", "year").alias("intercept")
    )


def leaderboard_means(df: DataFrame, by, names) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names])
