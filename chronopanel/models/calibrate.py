"""Isotonic calibration and the decision to keep it.

Equal scores become one weighted point. Points are cut into ranges of scores; a task pools
adjacent violators of its range and returns the stack of blocks that are left. Stacks of
neighbouring ranges are put together and pooled again, a few at a time, level by level.
Pooling what is pooled already gives the same blocks as pooling all points, so every level
is exact, and only blocks move: one for each step of the curve of a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronopanel.functions.columns import clip
from chronopanel.operators import metrics
from chronopanel.operators.joins import is_small
from chronopanel.operators.scan import Prefix, running
from chronopanel.session import stage

BLOCK = "part long, g string, lo double, hi double, total double, weight double"


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order, with every one that is not above its forerunner pooled with it.

    Means of one group rise from block to block afterwards; groups are not pooled together.
    """
    stack: list[list] = []
    for g, lo, hi, total, weight in blocks[["g", "lo", "hi", "total", "weight"]].itertuples(index=False):
        while stack and stack[-1][0] == g and stack[-1][3] * weight >= total * stack[-1][4]:
            _, lo, _, t, w = stack.pop()
            total, weight = total + t, weight + w
        stack.append([g, lo, hi, total, weight])
    return pd.DataFrame(stack, columns=["g", "lo", "hi", "total", "weight"])


def _group(by) -> Column:
    return F.coalesce(F.to_json(F.struct(*by)), F.lit("")) if by else F.lit("")


def fit_isotonic(df: DataFrame, y="y", p="p", by=(), fan: int = 8) -> DataFrame:
    """The knots (g, x, v) of a monotone curve from score to rate, one curve for each group of `by`.

    Between knots the curve is straight; steps have a knot at either end. Rows without score
    or label don't count.
    """
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    s = F.col(p).cast("double")
    points = known.groupBy(_group(by).alias("g"), s.alias("lo")).agg(F.sum(F.col(y).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    ranged = points.repartitionByRange("g", "lo").withColumn("part", F.spark_partition_id().cast("long"))
    now = stage(ranged.select("part", "g", "lo", F.col("lo").alias("hi"), "total", "weight"), "points")

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        return pooled(pdf.sort_values(["g", "lo"])).assign(part=pdf["part"].iloc[0])[["part", "g", "lo", "hi", "total", "weight"]]

    now = stage(now.groupBy("part").applyInPandas(pool, BLOCK), "blocks")
    parts = now.agg(F.max("part")).first()[0]
    while parts:
        now = now.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        now, parts = stage(now.groupBy("part").applyInPandas(pool, BLOCK), "blocks"), parts // fan
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    return now.select("g", F.explode(ends).alias("x"), (F.col("total") / F.col("weight")).alias("v"))


def apply(knots: DataFrame, df: DataFrame, p="p", by=()) -> DataFrame:
    """Replace the score by the curve's rate; beyond the knots the end values hold.

    A score of a group without a curve, and a null one, become null. Knots are broadcast where they
    are counted to be few; else scores and knots are scanned together in order.
    """
    rows = df.withColumn("_g", _group(by)).withColumn("_s", F.col(p).cast("double"))
    if is_small(knots):
        curves: dict = {}
        for r in knots.orderBy("g", "x").collect():
            curves.setdefault(r["g"], ([], []))[0].append(r["x"])
            curves[r["g"]][1].append(r["v"])
        shared = df.sparkSession.sparkContext.broadcast(curves)

        @F.pandas_udf("double")
        def rate(g: pd.Series, s: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=s.index)
            known = s[s.notna()]
            for name, at in known.groupby(g[known.index]).groups.items():
                if name in shared.value:
                    out[at] = np.interp(known[at], *shared.value[name])
            return out.astype(object).where(out.notna(), None)

        made = rows.withColumn("_cal", rate("_g", "_s"))
    else:
        scores = _scanned(rows.select(F.col("_g").alias("g"), F.col("_s").alias("x")).where("x IS NOT NULL").distinct(), knots)
        made = rows.join(scores.select(F.col("g").alias("_g"), F.col("x").alias("_s"), F.col("rate").alias("_cal")), ["_g", "_s"], "left")
    return made.withColumn(p, clip(F.col("_cal"), 0.0, 1.0)).drop("_cal", "_g", "_s")


def _scanned(scores: DataFrame, knots: DataFrame) -> DataFrame:
    """(g, x, rate) of each distinct score, from the knots next to it on either side."""
    both = scores.join(knots.withColumn("known", F.lit(True)), ["g", "x"], "full")
    ranged = stage(both.repartitionByRange("g", "x").withColumn("part", F.spark_partition_id().cast("long")), "scores")
    knot = F.when(F.col("known"), F.struct(F.col("x").alias("kx"), F.col("v").alias("kv")))
    out = running(ranged, ["g"], "part", "x", [Prefix("below", "last", knot)])
    out = running(out, ["g"], "part", "x", [Prefix("above", "last", knot)], descending=True)
    way = (F.col("x") - F.col("below.kx")) / (F.col("above.kx") - F.col("below.kx"))
    between = F.when(F.col("above.kx") == F.col("below.kx"), F.col("below.kv")).otherwise(F.col("below.kv") + (F.col("above.kv") - F.col("below.kv")) * way)
    return out.select("g", "x", F.coalesce(between, "below.kv", "above.kv").alias("rate"))


def keep_calibrated(raw: DataFrame, calibrated: DataFrame, share=0.95) -> DataFrame:
    """Composite of both score tables at their own gated thresholds, and which one stays."""
    both = raw.select("y", "p", F.lit("raw").alias("kind")).unionByName(calibrated.select("y", "p", F.lit("calibrated").alias("kind")))
    table = metrics.choose_gated(metrics.sweep(both, by=["kind"], grid=metrics.GATE_GRID), ["kind"])
    table = table.withColumn("composite", F.col("recall") * 0.6 + F.col("f1") * 0.4)
    wide = table.agg(
        F.max(F.when(F.col("kind") == "raw", F.col("composite"))).alias("raw"),
        F.max(F.when(F.col("kind") == "calibrated", F.col("composite"))).alias("calibrated"),
    )
    return wide.withColumn("keep", (F.col("calibrated") >= F.col("raw") * share).cast("int"))
