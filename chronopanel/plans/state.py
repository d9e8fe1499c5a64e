"""Serving state: what features of new rows need to know of all rows before them.

Two tables stand for an entity's history, however long it is. The tail holds its last rows,
as many as the longest window reaches back. The totals hold what the rows before the tail
add to unlimited features: sums and counts of labels, the last event, the last day that was
not dry, the last known values, by entity and by entity and month, and how many rows they
were. Totals of parts merge, so new days move the state forward without the history: they
join the tail, and rows that leave it are added to the totals. Features of the tail and of
forecast rows after it then go on from the totals and equal windows over the whole history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronopanel.functions.calendar import add_calendar
from chronopanel.operators import windows as w
from chronopanel.operators.repair import dedupe
from chronopanel.operators.scan import Prefix, merged, row_rank, totals
from chronopanel.plans import features
from chronopanel.schema import HOURLY_LAGS, HOURLY_WINDOWS
from chronopanel.session import stage
from chronopanel.sources import tables

#: Columns known less often than daily, carried forward.
CARRIED = ("NDVI", "EVI", "NDBI")
#: The tables of a state; saved versions of each that stay readable.
PARTS, STATES = ("tail", "entity", "month"), 8
#: Rows that hourly windows read behind a row.
HOURLY_REACH = max(*HOURLY_LAGS, *HOURLY_WINDOWS)


@dataclass(frozen=True)
class State:
    """The tail's rows, totals by entity (with the number of rows before the tail) and by
    entity and month."""

    tail: DataFrame
    entity: DataFrame
    month: DataFrame

    def save(self, path: str) -> None:
        """A new version of each table, then one row that names the three; that row makes the
        state current. Readers of an older state are not disturbed."""
        made = [tables.overwrite(getattr(self, name), f"{path}/{name}", keep=STATES) for name in PARTS]
        spark = self.tail.sparkSession
        tables.overwrite(spark.createDataFrame([made], ", ".join(f"{name} long" for name in PARTS)), f"{path}/current")


def load(spark: SparkSession, path: str) -> State:
    """The state saved last."""
    versions = tables.read(spark, f"{path}/current").first()
    return State(*[tables.read(spark, f"{path}/{name}", versions[name]) for name in PARTS])


def _prefixes(rows: DataFrame, s: w.Series) -> tuple[list[Prefix], list[Prefix]]:
    """Prefixes by entity and by entity and month that the columns of the rows allow."""
    carried = w.fill_prefixes([c for c in CARRIED if c in rows.columns])
    if s.step != "day":
        return carried, []
    trails, monthly = features.daily_trails(rows)
    return [p for t in trails for p in t.prefixes] + carried, [p for t in monthly for p in t.prefixes]


def _reach(rows: DataFrame, s: w.Series) -> int:
    return features.daily_reach(features.LABEL in rows.columns) if s.step == "day" else HOURLY_REACH


def _placed(rows: DataFrame, s: w.Series, entity: DataFrame | None) -> DataFrame:
    """Rows with their position in the entity's whole history."""
    timed = rows.withColumn("_seg", F.floor(w.time_index(s) / s.chunk).cast("long"))
    out = row_rank(timed, s.entity, "_seg", s.time, "_pos").drop("_seg")
    if entity is not None:
        out = out.join(entity.select(*s.entity, F.col("_t_rows").alias("_before")), list(s.entity), "left")
        out = out.withColumn("_pos", F.col("_pos") + F.coalesce("_before", F.lit(0))).drop("_before")
    out = out.withColumn("_pos", F.col("_pos").cast("long") - 1)
    return out.withColumn("_chunk", F.floor(F.col("_pos") / s.chunk).cast("long"))


def _split(rows: DataFrame, s: w.Series, old: State | None) -> State:
    """The state after `rows`, which follow what the old totals stand for."""
    dated = add_calendar(rows) if s.step == "day" else rows
    placed = _placed(dated, s, old.entity if old else None)
    last = placed.groupBy(*s.entity).agg((F.max("_pos") + 1).alias("_upto"))
    marked = stage(placed.join(last, list(s.entity)).withColumn("_kept", F.col("_pos") >= F.col("_upto") - _reach(rows, s)), "placed")
    gone = marked.where(~F.col("_kept"))
    by_entity, by_month = _prefixes(dated, s)
    # the first position behind a part is the number of rows before it
    before = Prefix("rows", "max", F.col("_pos") + 1)
    entity = totals(gone, s.entity, "_pos", [*by_entity, before])
    months = [*s.entity, *(["Month"] if by_month else [])]
    month = totals(gone, months, "_pos", by_month) if by_month else gone.select(*s.entity).distinct()
    if old:
        entity = merged(entity.unionByName(old.entity), s.entity, [*by_entity, before])
        month = merged(month.unionByName(old.month), months, by_month) if by_month else old.month
    tail = marked.where("_kept").select(*rows.columns)
    return State(tail, entity, month)


def fit(history: DataFrame, s=w.DAILY) -> State:
    """The state after all rows of a history."""
    return _split(history, s, None)


def advance(state: State, new: DataFrame, s=w.DAILY) -> State:
    """The state after further rows. A row whose key is in the tail replaces it.

    Rows from before the tail cannot be taken in: their history is gone. They raise an error
    where the state is used.
    """
    tail = state.tail.withColumn("_source", F.lit(0))
    both = tail.unionByName(new.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    rows = dedupe(both, [*s.entity, s.time], order="_source").drop("_source").select(*state.tail.columns)
    return _split(_not_before(rows, state, s), s, state)


def _not_before(rows: DataFrame, state: State, s: w.Series) -> DataFrame:
    """Rows as they are; one that lies before its entity's tail is an error."""
    first = state.tail.groupBy(*s.entity).agg(F.min(s.time).alias("_first"))
    known = rows.join(first, list(s.entity), "left")
    early = F.raise_error(F.concat(F.lit("a row lies before the serving state's tail: "), F.col(s.time).cast("string")))
    at = F.when(F.col(s.time) < F.col("_first"), early.cast(rows.schema[s.time].dataType)).otherwise(F.col(s.time))
    return known.withColumn(s.time, at).drop("_first")


def _ahead(forecast: DataFrame, state: State, s: w.Series) -> DataFrame:
    """Tail and forecast rows with positions; the forecast wins on a shared key."""
    both = w.splice(state.tail, forecast, s, None)
    out = _placed(_not_before(both, state, s), s, state.entity)
    carried = [c for c in CARRIED if c in out.columns]
    return w.fill(out, carried, s, start=state.entity) if carried else out


def daily(forecast: DataFrame, state: State, fitted: features.Fitted, s=w.DAILY, static=None) -> DataFrame:
    """Daily features of forecast rows, equal to those after the whole history."""
    made = features.daily_features(_ahead(forecast, state, s), fitted, s, static, start=(state.entity, state.month))
    return made.filter("is_forecast = 1").drop("is_forecast", "_pos", "_chunk")


def hourly(forecast: DataFrame, state: State, s=w.HOURLY, static=None, repair=()) -> DataFrame:
    """Hourly features of forecast rows, equal to those after the whole history.

    `repair` names columns whose zeros are missing values; the entity's median over the tail
    stands in for them.
    """
    from chronopanel.operators.repair import zero_repair

    rows = _ahead(forecast, state, s)
    if repair:
        rows = zero_repair(rows, state.tail, base=repair, by=s.entity)
    made = features.hourly_features(rows, s, static)
    return made.filter("is_forecast = 1").drop("is_forecast", "_pos", "_chunk")
