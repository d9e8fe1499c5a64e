"""Lag, rolling, streak and expanding features over entity series.

A series is cut into chunks of `chunk` steps and windows run per (entity, chunk),
so one long or hot entity spreads over many tasks. Frames of fixed reach get the
rows they need from the neighbouring chunk as a halo; unlimited frames carry a
total over chunk borders (operators.scan). Both give the result of one window over
the whole series.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronopanel.functions.columns import clip
from chronopanel.operators.scan import Prefix, row_rank, running


@dataclass(frozen=True)
class Series:
    """How a frame is ordered.

    regular=True says every step between an entity's first and last row is present
    (see `spine`); positions then come from the time itself without a shuffle.
    Otherwise rows are counted first, so lags count rows whatever the gaps.
    """

    entity: tuple = ("City",)
    time: str = "Date"
    step: str = "day"
    regular: bool = False
    chunk: int = 4096

    def with_(self, **kw) -> "Series":
        return replace(self, **kw)


DAILY = Series()
HOURLY = Series(time="Timestamp", step="hour", chunk=8192)


def time_index(s: Series) -> Column:
    """Whole steps since 1970-01-01, the same in every session zone."""
    days = F.datediff(F.to_date(s.time), F.lit("1970-01-01").cast("date"))
    return (days if s.step == "day" else days * 24 + F.hour(s.time)).cast("long")


def _cut(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def indexed(df: DataFrame, s: Series, reach: int = 0) -> DataFrame:
    """Add _pos (step or row number) and _chunk, unless the frame has them.

    A plan of several operators calls this first, so rows are counted once; operators
    keep the columns they find and drop the ones they added.
    """
    if "_pos" in df.columns:
        return df
    size = chunk_size(s, reach)
    if s.regular:
        return df.withColumn("_pos", time_index(s)).withColumn("_chunk", _cut(F.col("_pos"), size))
    timed = df.withColumn("_seg", _cut(time_index(s), size))
    ranked = row_rank(timed, s.entity, "_seg", s.time, "_pos").drop("_seg")
    ranked = ranked.withColumn("_pos", F.col("_pos") - 1)
    return ranked.withColumn("_chunk", _cut(F.col("_pos"), size))


def unindexed(df: DataFrame) -> DataFrame:
    return df.drop("_pos", "_chunk")


def chunk_size(s: Series, reach: int = 0) -> int:
    return max(s.chunk, reach)


def bounded(df: DataFrame, s: Series, build, behind: int, ahead: int = 0, keep=False) -> DataFrame:
    """Add columns from frames that reach at most `behind` rows back and `ahead` forward.

    `build(w)` gets the ordered window and returns {name: Column}. A list of such
    functions runs one after the other on the same rows, each seeing the columns of the
    one before; `behind` is then the sum of their reaches.
    """
    had = keep or "_pos" in df.columns
    if "_pos" in df.columns and max(behind, ahead) > s.chunk:
        raise ValueError("chunk is shorter than the frame's reach")
    size = chunk_size(s, max(behind, ahead))
    rows = indexed(df, s, max(behind, ahead))
    offset = F.col("_pos") - F.col("_chunk") * size
    targets = [F.col("_chunk")]
    if behind:
        targets.append(F.when(offset >= size - behind, F.col("_chunk") + 1))
    if ahead:
        targets.append(F.when(offset < ahead, F.col("_chunk") - 1))
    out = rows.withColumn("_part", F.explode(F.array_compact(F.array(*targets))))
    w = W.partitionBy(*s.entity, "_part").orderBy("_pos")
    for stage in build if isinstance(build, (list, tuple)) else [build]:
        out = out.withColumns(stage(w))
    out = out.filter(F.col("_part") == F.col("_chunk")).drop("_part")
    return out if had else unindexed(out)


def lag_columns(w, names, lags, suffix="") -> dict[str, Column]:
    return {f"{v}_lag{k}{suffix}": F.lag(v, k).over(w) for v in names for k in lags}


def rolling_columns(w, names, windows, suffix="") -> dict[str, Column]:
    """Mean and sample deviation over the n rows before the current one."""
    out = {}
    for v in names:
        for n in windows:
            f = w.rowsBetween(-n, -1)
            out[f"{v}_roll{n}{suffix}_mean"] = F.avg(v).over(f)
            out[f"{v}_roll{n}{suffix}_std"] = F.stddev_samp(v).over(f)
    return out


def strict_columns(w, names, windows) -> dict[str, Column]:
    """As rolling_columns, but null until the window is full of values."""
    out = {}
    for v in names:
        for n in windows:
            f = w.rowsBetween(-n, -1)
            full = F.count(v).over(f) == n
            out[f"{v}_full{n}_mean"] = F.when(full, F.avg(v).over(f))
            out[f"{v}_full{n}_std"] = F.when(full, F.stddev_samp(v).over(f))
    return out


def current_columns(w, means=(), sums=()) -> dict[str, Column]:
    """Windows that include the current row; pairs of (column, length)."""
    out = {f"{v}_mean{n}": F.avg(v).over(w.rowsBetween(1 - n, 0)) for v, n in means}
    out.update({f"{v}_sum{n}": F.sum(v).over(w.rowsBetween(1 - n, 0)) for v, n in sums})
    return out


def sum_columns(w, names, windows) -> dict[str, Column]:
    """Sums over the n rows before the current one."""
    return {f"{v}_sum{n}": F.sum(v).over(w.rowsBetween(-n, -1)) for v in names for n in windows}


def lags(df, names, ks, s=DAILY, suffix=""):
    return bounded(df, s, lambda w: lag_columns(w, names, ks, suffix), max(ks))


def rolling(df, names, windows, s=DAILY, suffix=""):
    return bounded(df, s, lambda w: rolling_columns(w, names, windows, suffix), max(windows))


def strict_rolling(df, names, windows, s=DAILY):
    return bounded(df, s, lambda w: strict_columns(w, names, windows), max(windows))


def current_rolling(df, s=DAILY, means=(), sums=()):
    return bounded(df, s, lambda w: current_columns(w, means, sums), max(n for _, n in [*means, *sums]))


def rolling_sums(df, names, windows, s=DAILY):
    return bounded(df, s, lambda w: sum_columns(w, names, windows), max(windows))


@dataclass(frozen=True)
class Trail:
    """A feature over all rows before (or up to) the current one."""

    name: str
    prefixes: tuple
    value: Column


def streak_trail(cond: Column, name: str) -> Trail:
    """Rows since the condition last failed; 0 where it fails or is unknown."""
    miss, first = f"_miss_{name}", f"_first_{name}"
    holds = F.coalesce(cond, F.lit(False))
    parts = (Prefix(miss, "max", F.when(~holds, F.col("_pos"))), Prefix(first, "min", F.col("_pos")))
    return Trail(name, parts, F.col("_pos") - F.coalesce(F.col(miss), F.col(first) - 1))


def since_trail(event: Column, name: str, never=9999, cap=365) -> Trail:
    """Rows since the previous event; `never` where there is none, then capped."""
    hit = f"_hit_{name}"
    gap = F.coalesce(F.col("_pos") - F.col(hit), F.lit(never))
    return Trail(name, (Prefix(hit, "max", F.when(event, F.col("_pos")), False),), F.least(gap, F.lit(cap)))


def mean_trail(value: str, name: str, default=0.0) -> Trail:
    """Mean of all earlier values."""
    total, n = f"_sum_{name}", f"_n_{name}"
    parts = (Prefix(total, "sum", F.col(value), False), Prefix(n, "count", F.col(value), False))
    return Trail(name, parts, F.coalesce(F.try_divide(F.col(total).cast("double"), F.col(n)), F.lit(default)))


def unlimited(df: DataFrame, s: Series, trails, within=(), start: DataFrame | None = None) -> DataFrame:
    """Add all trails of the entity, or of the entity and `within` columns, in one scan.

    `start` holds totals of earlier rows (operators.scan), from which the trails go on.
    """
    had = "_pos" in df.columns
    prefixes = [p for t in trails for p in t.prefixes]
    out = running(indexed(df, s), [*s.entity, *within], "_chunk", "_pos", prefixes, start=start)
    out = out.withColumns({t.name: t.value for t in trails}).drop(*[p.name for p in prefixes])
    return out if had else unindexed(out)


def streak(df: DataFrame, cond: Column, name: str, s=DAILY) -> DataFrame:
    return unlimited(df, s, [streak_trail(cond, name)])


def rows_since(df: DataFrame, event: Column, name: str, s=DAILY, never=9999, cap=365) -> DataFrame:
    return unlimited(df, s, [since_trail(event, name, never, cap)])


def expanding_mean(df: DataFrame, value: str, name: str, s=DAILY, within=(), default=0.0) -> DataFrame:
    return unlimited(df, s, [mean_trail(value, name, default)], within)


def fill_prefixes(names) -> list[Prefix]:
    return [Prefix(f"_f_{c}", "last", F.col(c)) for c in names]


def fill(df: DataFrame, names, s=DAILY, leak_free=True, start: DataFrame | None = None) -> DataFrame:
    """Carry the last known value forward; leak_free=False then also the next one back.

    `start` holds totals of earlier rows (operators.scan).
    """
    had = "_pos" in df.columns
    out = running(indexed(df, s), s.entity, "_chunk", "_pos", fill_prefixes(names), start=start)
    value = {c: F.col(f"_f_{c}") for c in names}
    made = [f"_f_{c}" for c in names]
    if not leak_free:
        back = [Prefix(f"_b_{c}", "last", F.col(c)) for c in names]
        out = running(out, s.entity, "_chunk", "_pos", back, descending=True)
        value = {c: F.coalesce(v, F.col(f"_b_{c}")) for c, v in value.items()}
        made += [f"_b_{c}" for c in names]
    out = out.withColumns(value).drop(*made)
    return out if had else unindexed(out)


def spine(df: DataFrame, s: Series) -> DataFrame:
    """Every step between an entity's first and last row, missing ones as null rows."""
    edge = df.groupBy(*s.entity).agg(F.min(s.time).alias("_lo"), F.max(s.time).alias("_hi"))
    unit = F.expr(f"interval 1 {s.step}")
    # steps are laid out year by year so that no single row grows into a long series
    years = edge.withColumn("_y", F.explode(F.sequence(F.year("_lo"), F.year("_hi"))))
    jan = F.make_date("_y", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    dec = F.make_date(F.col("_y") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz") - unit
    lo, hi = F.col("_lo").cast("timestamp_ntz"), F.col("_hi").cast("timestamp_ntz")
    steps = years.select(
        *s.entity, F.explode(F.sequence(F.greatest(lo, jan), F.least(hi, dec), unit)).alias(s.time)
    )
    steps = steps.withColumn(s.time, F.col(s.time).cast(df.schema[s.time].dataType))
    return steps.join(df, [*s.entity, s.time], "left")


def expected_steps(df: DataFrame, s: Series, until: Column) -> DataFrame:
    """Rows found per entity against the steps from its first row to `until`."""
    found = df.groupBy(*s.entity).agg(
        F.count(F.lit(1)).alias("rows"), F.min(s.time).alias("first"), F.max(s.time).alias("last")
    )
    hours = F.datediff(F.to_date(until), F.to_date("first")) * 24 + F.hour(until) - F.hour("first")
    expected = (hours if s.step == "hour" else F.datediff(F.to_date(until), F.to_date("first"))) + 1
    return found.withColumn("expected", expected).withColumn(
        "percent", clip(F.try_divide(F.col("rows") * 100.0, F.col("expected")), None, 100.0)
    )


def group_mean(df: DataFrame, names, by, suffix="_group_mean") -> DataFrame:
    """Mean of each column over `by`, on every row. Aggregates first, so a hot group is one row."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in names])
    return df.join(means, list(by), "left")


def anomaly(df: DataFrame, names, by=("City", "Month"), climatology: DataFrame | None = None) -> DataFrame:
    """Value less its climatology; from a fitted table when serving, in-frame when exploring."""
    if climatology is None:
        out = group_mean(df, names, by, "_clim")
    else:
        fitted = climatology.select(*by, *[F.col(c).alias(f"{c}_clim") for c in names])
        out = df.join(fitted, list(by), "left")
    made = {f"{c}_anomaly": F.col(c) - F.col(f"{c}_clim") for c in names}
    return out.withColumns(made).drop(*[f"{c}_clim" for c in names])


def rainfall_deficit(
    df: DataFrame, s=DAILY, rain="Rain_mm_sum", month="Month", climatology: DataFrame | None = None
) -> DataFrame:
    """Monthly mean rain of the entity times 30, less the 30 rows before."""
    summed = rolling_sums(df, [rain], [30], s).withColumnRenamed(f"{rain}_sum30", "Rain_roll30_sum")
    by = [*s.entity, month]
    if climatology is None:
        climatology = df.groupBy(*by).agg(F.avg(rain).alias(rain))
    out = summed.join(climatology.select(*by, F.col(rain).alias("_clim")), by, "left")
    deficit = F.col("_clim") * 30 - F.coalesce("Rain_roll30_sum", F.lit(0.0))
    return out.withColumn("Rainfall_Deficit", deficit).drop("_clim")


def decompose(df: DataFrame, value: str, period: int, s=DAILY) -> DataFrame:
    """Additive trend, seasonal and residual parts per entity.

    Trend is the centred moving mean over one period, null where it does not fit.
    An even period halves the weight of its two end rows. The seasonal part is the
    mean detrended value per phase, centred on the mean over phases.
    """
    half = period // 2

    def trend(w):
        inner = w.rowsBetween(-half, half) if period % 2 else w.rowsBetween(1 - half, half - 1)
        total = F.sum(value).over(inner)
        n = F.count(F.lit(1)).over(w.rowsBetween(-half, half))
        if period % 2 == 0:
            total = total + (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        return {"trend": F.when(n == 2 * half + 1, total / period)}

    out = bounded(df, s, trend, half, half, keep=True)
    base = out.groupBy(*s.entity).agg(F.min("_pos").alias("_p0"))
    out = out.join(base, list(s.entity), "left").withColumn("_phase", F.pmod(F.col("_pos") - F.col("_p0"), F.lit(period)))
    keys = [*s.entity, "_phase"]
    phase = out.groupBy(*keys).agg(F.avg(F.col(value) - F.col("trend")).alias("_m"))
    centre = phase.groupBy(*s.entity).agg(F.avg("_m").alias("_centre"))
    phase = phase.join(centre, list(s.entity)).select(*keys, (F.col("_m") - F.col("_centre")).alias("seasonal"))
    out = out.join(phase, keys, "left")
    return out.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_pos", "_chunk", "_p0", "_phase")


def history_tail(history: DataFrame, forecast: DataFrame, s=DAILY, steps=45) -> DataFrame:
    """The history rows within `steps` before the forecast's first step.

    That step is looked up first, so the bound is a literal that reaches the history's scan.
    """
    kind = history.schema[s.time].dataType
    start = F.min(F.col(s.time).cast("timestamp_ntz")) - F.expr(f"interval {steps} {s.step}")
    back = forecast.agg(start.cast("string")).first()[0]
    if back is None:
        return history.limit(0)
    return history.filter(F.col(s.time) >= F.lit(back).cast("timestamp_ntz").cast(kind))


def splice(history: DataFrame, forecast: DataFrame, s=DAILY, steps=45) -> DataFrame:
    """History tail, or with steps=None all of it, followed by the forecast; the forecast wins on a shared key."""
    from chronopanel.operators.repair import dedupe

    tail = history if steps is None else history_tail(history, forecast, s, steps)
    tail = tail.withColumn("_source", F.lit(0))
    both = tail.unionByName(forecast.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return dedupe(both, [*s.entity, s.time], order="_source").withColumnRenamed("_source", "is_forecast")


def last_known(df: DataFrame, names, s=DAILY) -> DataFrame:
    """Per entity, the last non-null value of each column."""
    return df.groupBy(*s.entity).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(s.time))).alias(c) for c in names]
    )


def latest(df: DataFrame, by, order) -> DataFrame:
    """One row per key, the greatest in `order`; partial aggregation keeps hot keys small."""
    rest = [c for c in df.columns if c not in by]
    top = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order) if not isinstance(order, str) else F.col(order)).alias("_r"))
    return top.select(*by, "_r.*")


def every_nth(df: DataFrame, time: str, n: int, offset=0, ends=True) -> DataFrame:
    """Rows whose distinct time is every n-th, plus the first and last one."""
    times = df.select(time).distinct().withColumn("_y", F.year(time))
    ranked = row_rank(times, [], "_y", time, "_i")
    edge = times.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    pick = F.pmod(F.col("_i") - 1 - offset, F.lit(n)) == 0
    pick = pick & (F.col("_i") > offset)
    if ends:
        pick = pick | (F.col(time) == F.col("_a")) | (F.col(time) == F.col("_b"))
    chosen = ranked.crossJoin(F.broadcast(edge)).filter(pick).select(time)
    return df.join(chosen, time, "left_semi")
