"""The master panels: measurements, event labels, burned area, vegetation, geography, calendar.

One builder serves the daily and the hourly panel; daily tables meet hours by their day.
Detections become labels by the regions' squares. Sparse vegetation is carried forward, so no
row sees a later value; what is still unknown is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from chronopanel.functions.calendar import add_calendar, add_hourly_calendar
from chronopanel.operators import windows as w
from chronopanel.operators.aggregate import daily_panel, event_days, regroup
from chronopanel.operators.joins import dimension, geofence
from chronopanel.schema import BUFFER_KM, EVENTS_DAILY, LABEL

KEYS = ("City", "Date")
BURNED = "Burned_Area_hectares"


def event_labels(points: DataFrame, regions: DataFrame, km=BUFFER_KM) -> DataFrame:
    """Detections (acq_date, latitude, longitude, brightness, frp) to days of regions (City, lat, lon).

    A detection in the squares of several regions counts in each.
    """
    found = geofence(points, regions, km).withColumnRenamed("acq_date", "Date")
    return event_days(found).select(*EVENTS_DAILY.names)


def _joined(panel: DataFrame, s: w.Series, events, burned, vegetation, static) -> DataFrame:
    """A panel with a Date, joined with the daily tables that are given, filled."""
    out = panel
    if events is not None:
        out = out.join(events, list(KEYS), "left")
        made = {c: F.coalesce(F.col(c), F.lit(0).cast(events.schema[c].dataType)) for c in events.columns if c not in KEYS}
        out = out.withColumns(made)
    if LABEL not in out.columns:
        out = out.withColumn(LABEL, F.lit(0))
    if burned is not None:
        out = out.join(regroup(burned, KEYS, maxima=[BURNED]), list(KEYS), "left").fillna(0.0, subset=[BURNED])
    sparse = []
    for table in vegetation:
        names = [f.name for f in table.schema if f.name not in KEYS]
        out = out.join(regroup(table, KEYS, means=names), list(KEYS), "left")
        sparse += names
    if sparse:
        out = w.fill(out, sparse, s)
    if static is not None:
        out = dimension(out, static, ["City"])
    numbers = [f.name for f in out.schema if isinstance(f.dataType, T.NumericType)]
    return out.fillna(0, subset=numbers)


def master_hourly(weather: DataFrame, events=None, burned=None, vegetation=(), static=None, s=w.HOURLY) -> DataFrame:
    """Every hour with its day's labels and the calendar of both."""
    panel = weather.withColumn("Date", F.to_date(s.time))
    return add_hourly_calendar(add_calendar(_joined(panel, s, events, burned, vegetation, static)), s.time)


def master_daily(weather: DataFrame, events=None, burned=None, vegetation=(), static=None, s=w.DAILY) -> DataFrame:
    """The hours' daily panel with labels and calendar.

    Days come from the hours; an event on a day without any measurement has no row.
    """
    return add_calendar(_joined(daily_panel(weather), s, events, burned, vegetation, static))
