"""Ordered prefix operations in two levels.

A window ordered over a whole group runs in one task, which fails when one group
holds a large share of the rows. Here the ordered group is cut into blocks by a
function of the row's own value, so a retried task always rebuilds the same block:

1. a window inside (group, block) gives the local prefix;
2. one row of totals per (group, block) gives, by a window over the few blocks of
   a group, what came before the block;
3. the two are combined on (group, block).

Only step 1 touches every row, and its tasks are as large as a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class Prefix:
    """A running value. kind: sum, count, max, min, or last (last non-null value).

    inclusive says whether a row's own value counts.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True


_FOLD = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": F.max}


def _total(p: Prefix, order: Column) -> Column:
    if p.kind == "last":
        # max over (position, value) is the value at the greatest position
        return F.max(F.when(p.value.isNotNull(), F.struct(order.alias("o"), p.value.alias("v"))))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[p.kind](p.value)


def _local(p: Prefix, w) -> Column:
    if p.kind == "last":
        return F.last(p.value, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[p.kind](p.value).over(w)


def _merge(p: Prefix, local: Column, before: Column) -> Column:
    if p.kind == "last":
        return F.coalesce(local, before["v"])
    if p.kind in ("sum", "count"):
        both = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        return F.when(local.isNotNull() | before.isNotNull(), both)
    return (F.greatest if p.kind == "max" else F.least)(local, before)


def totals(df: DataFrame, group, order: str, prefixes) -> DataFrame:
    """What the rows of each group add to later running values: one row, `_t_` columns."""
    return df.groupBy(*group).agg(*[_total(p, F.col(order)).alias(f"_t_{p.name}") for p in prefixes])


def merged(parts: DataFrame, group, prefixes) -> DataFrame:
    """Totals of several parts of a group as one row."""
    return parts.groupBy(*group).agg(*[_FOLD[p.kind](f"_t_{p.name}").alias(f"_t_{p.name}") for p in prefixes])


def running(df: DataFrame, group, block: str, order: str, prefixes, descending=False, start: DataFrame | None = None) -> DataFrame:
    """Add running values over `group` ordered by `order`.

    `order` is unique within a group and `block` is monotone in it. `start` holds the
    totals of rows that came before and are not read again, one row a group.
    """
    group = list(group)
    keys = group + [block]
    sign = F.desc if descending else F.asc
    ordered = W.partitionBy(*keys).orderBy(sign(order))
    frames = {i: ordered.rowsBetween(W.unboundedPreceding, 0 if i else -1) for i in (True, False)}
    # a descending scan needs the value at the smallest position, so negate it
    pos = -F.col(order) if descending else F.col(order)
    parts = df.groupBy(*keys).agg(*[_total(p, pos).alias(f"_t_{p.name}") for p in prefixes])
    if start is not None:
        first = F.lit(-(1 << 62)).cast(df.schema[block].dataType).alias(block)
        parts = parts.unionByName(start.select(*group, first, *[f"_t_{p.name}" for p in prefixes]))
    before = W.partitionBy(*group).orderBy(sign(block)).rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(
        *keys, *[_FOLD[p.kind](f"_t_{p.name}").over(before).alias(f"_c_{p.name}") for p in prefixes]
    )
    local = df.withColumns({f"_l_{p.name}": _local(p, frames[p.inclusive]) for p in prefixes})
    out = local.join(carried, keys, "left")
    made = {p.name: _merge(p, F.col(f"_l_{p.name}"), F.col(f"_c_{p.name}")) for p in prefixes}
    drop = [f"_{k}_{p.name}" for p in prefixes for k in "lc"]
    return out.withColumns(made).drop(*drop)


def row_rank(df: DataFrame, group, block: str, order, name="_rank") -> DataFrame:
    """Dense row number over `group`, counted block by block."""
    group = list(group)
    keys = group + [block]
    order = [order] if isinstance(order, (str, Column)) else list(order)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(w))
        .join(offsets, keys, "left")
        .withColumn(name, F.col(name) + F.col("_off"))
        .drop("_off")
    )


def balanced_blocks(df: DataFrame, by, value: str, blocks=64, name="_block", totals=None) -> DataFrame:
    """Block number from approximate quantiles of the group's values.

    Boundaries are at most `blocks` numbers per group. Equal values share a block, so
    aggregate to one row per value first. `totals` are aggregates of the whole group,
    taken in the same pass and added to every row.
    """
    by = list(by)
    probs = [i / blocks for i in range(1, blocks)]
    extra = [c.alias(n) for n, c in (totals or {}).items()]
    bounds = df.groupBy(*by).agg(F.percentile_approx(value, probs, 2000).alias("_bounds"), *extra)
    joined = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))
    below = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    return joined.withColumn(name, F.coalesce(below, F.lit(0))).drop("_bounds")
