"""Feature plans: the daily and hourly feature surface of training and serving.

Statistics that a row must not see (quantiles, climatology) are fitted to tables by
`fit_*` on training rows and read by the transforms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from chronopanel.functions import weather
from chronopanel.functions.calendar import add_calendar, add_hourly_calendar
from chronopanel.functions.columns import clip, first_present
from chronopanel.operators import windows as w
from chronopanel.operators.aggregate import climatology
from chronopanel.operators.joins import dimension
from chronopanel.operators.quantiles import quantiles
from chronopanel.schema import DAILY_LAGS, DAILY_WINDOWS, EVENT_WINDOWS, HOURLY_LAGS, HOURLY_WINDOWS, LABEL

T, H, W, R = "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean", "Rain_mm_sum"

# Daily variables with lags and rolling windows.
LAGGED_DAILY = (
    "Temperature_C_mean",
    "Temperature_C_max",
    "Humidity_percent_mean",
    "Humidity_percent_min",
    "Wind_Speed_kmh_mean",
    "Wind_Speed_kmh_max",
    "Rain_mm_sum",
    "Solar_Radiation_Wm2_mean",
    "Soil_Temp_C_mean",
    "Soil_Moisture_mean",
)
LAGGED_HOURLY = ("Temperature_C", "Humidity_percent", "Wind_Speed_kmh", "Rain_mm", "Solar_Radiation_Wm2")


@dataclass(frozen=True)
class Fitted:
    """Statistics of the training rows."""

    thresholds: DataFrame
    climatology: DataFrame


def inputs(df: DataFrame):
    """Temperature, humidity, wind and rain, daily or hourly, with defaults where absent."""
    return (
        first_present(df, [T, "Temperature_C"], 0.0),
        first_present(df, [H, "Humidity_percent"], 50.0),
        first_present(df, [W, "Wind_Speed_kmh"], 0.0),
        first_present(df, [R, "Rain_mm"], 0.0),
    )


def fit_thresholds(train: DataFrame) -> DataFrame:
    """One row: the 95th, 10th and 90th percentile of temperature, humidity and wind."""
    wanted = {"_t_high": (T, 0.95), "_h_low": (H, 0.10), "_w_high": (W, 0.90)}
    return quantiles(train, [], wanted)


def fit(train: DataFrame) -> Fitted:
    names = [c for c in (T, H, R, W, "Solar_Radiation_Wm2_mean") if c in train.columns]
    monthly = train.withColumn("Month", F.month("Date"))
    return Fitted(fit_thresholds(train), climatology(monthly, names))


def index_windows(o, t, h, r):
    """Trailing parts of the moisture and drought codes over the window `o`."""
    return {
        "DMC_proxy": clip(F.avg(weather.duff_term(t, h, r)).over(o.rowsBetween(-13, 0)), 0.0),
        "DC_proxy": clip(F.sum(weather.drought_term(t, r)).over(o.rowsBetween(-29, 0)), 0.0),
    }


def fire_weather_indices(df: DataFrame, s=w.DAILY) -> DataFrame:
    t, h, wind, r = inputs(df)
    return w.bounded(df, s, [lambda o: index_windows(o, t, h, r), lambda o: derived_indices(t, h, wind, r)], 29)


def derived_indices(t, h, wind, r) -> dict:
    ffmc = weather.fine_fuel_moisture(t, h, r)
    isi = weather.initial_spread(ffmc, wind)
    bui = weather.build_up(F.col("DMC_proxy"), F.col("DC_proxy"))
    return {"FFMC_proxy": ffmc, "ISI_proxy": isi, "BUI_proxy": bui, "FWI_proxy": weather.fire_weather(isi, bui)}


def comfort(df: DataFrame) -> DataFrame:
    t, h, _, _ = inputs(df)
    return df.withColumns(
        {"VPD_kPa": weather.vapour_deficit(t, h), "Dew_Point_C": weather.dew_point(t, h), "Heat_Index": weather.heat_index(t, h)}
    )


def extreme_weather(df: DataFrame, thresholds: DataFrame, s=w.DAILY) -> DataFrame:
    """Dry streak, threshold flags and their product."""
    t, h, wind, r = inputs(df)
    out = df if "dry_days_streak" in df.columns else w.streak(df, r < 0.1, "dry_days_streak", s)
    out = out.crossJoin(F.broadcast(thresholds))
    flags = weather.extreme_flags(
        t, h, wind, F.col("dry_days_streak"), F.col("_t_high"), F.col("_h_low"), F.col("_w_high")
    )
    return out.withColumns(flags).drop("_t_high", "_h_low", "_w_high")


def event_trails(label=LABEL):
    return [
        w.since_trail(F.col(label) == 1, "days_since_last_fire"),
        w.mean_trail(label, "city_fire_rate"),
    ]


def daily_trails(df: DataFrame) -> tuple[list, list]:
    """The unlimited features of an entity, and of an entity's month, that the panel's columns allow."""
    trails = [w.streak_trail(inputs(df)[3] < 0.1, "dry_days_streak")]
    if LABEL not in df.columns:
        return trails, []
    return trails + event_trails(LABEL), [w.mean_trail(LABEL, "city_month_fire_rate")]


def daily_reach(events: bool) -> int:
    """Rows behind a row that its limited windows read; codes reach 29 rows, windows over them further."""
    return 29 + max(*DAILY_LAGS, *DAILY_WINDOWS, *(EVENT_WINDOWS if events else ()))


def event_history(df: DataFrame, s=w.DAILY, label=LABEL) -> DataFrame:
    """Past event counts, rows since the last event, past rates; never the row's own label."""
    out = w.indexed(df, s)
    out = w.unlimited(out, s, [w.mean_trail(label, "city_month_fire_rate")], within=["Month"])
    out = w.unlimited(out, s, event_trails(label))
    counts = lambda o: {f"fire_count_{n}d": F.sum(label).over(o.rowsBetween(-n, -1)) for n in EVENT_WINDOWS}
    return w.unindexed(w.bounded(out, s, counts, max(EVENT_WINDOWS)))


def daily_features(
    df: DataFrame,
    fitted: Fitted,
    s=w.DAILY,
    static: DataFrame | None = None,
    lagged=LAGGED_DAILY,
    history=True,
    start: tuple | None = None,
) -> DataFrame:
    """The daily feature surface.

    Rows are counted once. The unlimited features of the entity share one scan, and all
    limited windows share one ordering: the moisture and drought codes first, then the
    lags and rolling statistics over them. `start` holds totals of earlier rows by entity
    and by entity and month (plans.state); the frame then brings its own `_pos`.
    """
    out = w.indexed(comfort(add_calendar(df)), s)
    t, h, wind, r = inputs(out)
    events = history and LABEL in out.columns
    trails, monthly = daily_trails(out if events else out.drop(LABEL))
    before, before_month = start or (None, None)
    if monthly:
        out = w.unlimited(out, s, monthly, within=["Month"], start=before_month)
    out = w.unlimited(out, s, trails, start=before)
    names = [c for c in lagged if c in out.columns] + ["FWI_proxy", "VPD_kPa", "dry_days_streak"]

    def codes(o):
        return index_windows(o, t, h, r)

    def indices(o):
        return derived_indices(t, h, wind, r)

    def trailing(o):
        made = {**w.lag_columns(o, names, DAILY_LAGS), **w.rolling_columns(o, names, DAILY_WINDOWS)}
        if R in out.columns:
            made["Rain_roll30_sum"] = F.sum(R).over(o.rowsBetween(-30, -1))
        if events:
            made.update({f"fire_count_{n}d": F.sum(LABEL).over(o.rowsBetween(-n, -1)) for n in EVENT_WINDOWS})
        return made

    out = w.unindexed(w.bounded(out, s, [codes, indices, trailing], daily_reach(events)))
    out = extreme_weather(out, fitted.thresholds, s)
    out = anomalies(out, fitted.climatology, s)
    if static is not None:
        out = dimension(out, static, list(s.entity))
    ndvi = first_present(out, ["NDVI"], 0.0)
    trees = first_present(out, ["Trees_pct"], 0.0)
    drought = first_present(out, ["Rainfall_Deficit", "DC_proxy"], 0.0)
    return out.withColumns(
        weather.interactions(t, h, wind, F.col("dry_days_streak"), ndvi, drought, trees, F.col("VPD_kPa"))
    )


def anomalies(df: DataFrame, table: DataFrame, s=w.DAILY) -> DataFrame:
    """Anomalies and the rainfall deficit against the fitted climatology."""
    keys = [*s.entity, "Month"]
    names = [c for c in table.columns if c not in keys]
    out = dimension(df, table.withColumnsRenamed({c: f"_clim_{c}" for c in names}), keys)
    made = {f"{c}_anomaly": F.col(c) - F.col(f"_clim_{c}") for c in names}
    if R in names and "Rain_roll30_sum" in df.columns:
        made["Rainfall_Deficit"] = F.col(f"_clim_{R}") * 30 - F.coalesce("Rain_roll30_sum", F.lit(0.0))
    return out.withColumns(made).drop(*[f"_clim_{c}" for c in names])


def hourly_features(df: DataFrame, s=w.HOURLY, static: DataFrame | None = None, daytime=(6, 20)) -> DataFrame:
    """Calendar, lags and rolling windows of the hourly panel in one pass."""
    out = add_hourly_calendar(add_calendar(df, s.time), s.time, daytime)
    names = [c for c in LAGGED_HOURLY if c in df.columns]

    def build(o):
        return {**w.lag_columns(o, names, HOURLY_LAGS, "h"), **w.rolling_columns(o, names, HOURLY_WINDOWS, "h")}

    out = w.bounded(out, s, build, max(*HOURLY_LAGS, *HOURLY_WINDOWS))
    return out if static is None else dimension(out, static, list(s.entity))


def serving_features(forecast: DataFrame, history: DataFrame, fitted: Fitted, s=w.DAILY, static=None) -> DataFrame:
    """Features of the forecast rows, with the whole history as context, as in training.

    Labels of forecast rows stay null: rates leave them out, and counts are null where the
    window holds no known label.
    """
    both = w.splice(history, forecast, s, None)
    carried = [c for c in ("NDVI", "EVI", "NDBI") if c in both.columns]
    if carried:
        both = w.fill(both, carried, s)
    made = daily_features(both, fitted, s, static)
    return made.filter("is_forecast = 1").drop("is_forecast")
