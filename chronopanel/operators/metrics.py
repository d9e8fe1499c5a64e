"""Rare-event metrics, curves and threshold choice over long prediction tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronopanel.functions.columns import ratio
from chronopanel.operators.scan import Prefix, balanced_blocks, running

# Threshold grids, exact doubles shared by every caller.
SWEEP_GRID = tuple(float(x) for x in np.arange(0.01, 0.80, 0.005))
GATE_GRID = tuple(float(x) for x in np.arange(0.05, 0.95, 0.005))
SCORE_GRID = tuple(float(x) for x in np.arange(0.05, 0.85, 0.005))
# Precision and recall floors in the order they are tried.
GATES = ((0.30, 0.70), (0.20, 0.70), (0.20, 0.50))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Recall, precision, F1, F2 and accuracy, 0 where undefined."""
    return {
        "recall": ratio(tp, tp + fn),
        "precision": ratio(tp, tp + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
    }


def f2_score(precision: Column, recall: Column) -> Column:
    return ratio(5 * precision * recall, 4 * precision + recall)


def _counts(y: Column, yhat: Column):
    hit = lambda a, b: F.count_if((y == a) & (yhat == b))
    return {"tp": hit(1, 1), "fp": hit(0, 1), "tn": hit(0, 0), "fn": hit(1, 0)}


def confusion(df: DataFrame, y="y", yhat="yhat", by=()) -> DataFrame:
    """Counts and rates per group, one partial aggregation."""
    base = df.groupBy(*by).agg(*[c.alias(n) for n, c in _counts(F.col(y), F.col(yhat)).items()])
    return base.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def by_threshold(df: DataFrame, y="y", p="p", by=(), blocks=128, rows=None) -> DataFrame:
    """One row per distinct score: rows with it, and how many are at or above it.

    `rows` names a column that tells how many rows one stands for.
    Scores are aggregated first; the descending running sums go block by block, so
    no task sees the whole curve.
    """
    by = list(by)
    known = F.col(p).isNotNull() & F.col(y).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    # every later step reads all four columns, so the shuffle of this table is made once
    scores = (
        df.filter(known)
        .groupBy(*by, F.col(p).alias("threshold"))
        .agg(
            (F.sum(rows) if rows else F.count(F.lit(1))).alias("n"),
            F.sum(F.col(y) * F.col(rows) if rows else F.col(y)).cast("long").alias("pos"),
        )
    )
    totals = {"rows": F.sum("n"), "positives": F.sum("pos")}
    blocked = balanced_blocks(scores, by, "threshold", blocks, totals=totals)
    cum = running(
        blocked,
        by,
        "_block",
        "threshold",
        [Prefix("above", "sum", F.col("n")), Prefix("tp", "sum", F.col("pos"))],
        descending=True,
    )
    return cum.drop("_block").withColumn("fp", F.col("above") - F.col("tp"))


def curves(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """Precision, recall and false positive rate at each distinct score."""
    c = by_threshold(df, y, p, by)
    return c.select(
        *by,
        "threshold",
        "tp",
        "fp",
        ratio(F.col("tp"), F.col("above")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(F.col("fp"), F.col("rows") - F.col("positives")).alias("fpr"),
    )


def ranking(df: DataFrame, y="y", p="p", by=(), rows=None) -> DataFrame:
    """Average precision and area under the ROC curve, ties shared.

    Average precision is the step sum of precision over recall; the ROC area is the
    share of (positive, negative) pairs in order, half for ties. `rows` names a column that
    tells how many rows one stands for.
    """
    c = by_threshold(df, y, p, by, rows=rows)
    neg = F.col("n") - F.col("pos")
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("above"))
    wins = F.sum(neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") * 0.5)
    pairs = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))
    out = c.groupBy(*by, "positives", "rows").agg(ap.alias("_ap"), wins.alias("_wins"))
    return out.select(
        *by,
        ratio(F.col("_ap"), F.col("positives")).alias("pr_auc"),
        ratio(F.col("_wins"), pairs).alias("roc_auc"),
    )


def sweep(df: DataFrame, y="y", p="p", by=(), grid=SWEEP_GRID) -> DataFrame:
    """Counts and rates at every grid threshold from one pass over the rows.

    Rows fall into the grid's intervals; sums from the right over at most one row per
    interval give the counts at or above each threshold.
    """
    by = list(by)
    splits = [float("-inf"), *grid, float("inf")]
    rows = df.select(*by, F.col(y).alias("_y"), F.col(p).cast("double").alias("_p")).dropna()
    bucketed = Bucketizer(splits=splits, inputCol="_p", outputCol="_b", handleInvalid="skip").transform(rows)
    hist = bucketed.groupBy(*by, F.col("_b").cast("int").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").cast("long").alias("_pos")
    )
    totals = hist.groupBy(*by).agg(F.sum("_n").alias("rows"), F.sum("_pos").alias("positives"))
    # interval i starts at the i-th threshold; every group gets every threshold
    points = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("_b"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]))
    every = totals.withColumn("_g", points).select(*by, "rows", "positives", "_g.*")
    right = W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, 0)
    upward = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(right)
    counts = every.join(hist, [*by, "_b"], "left").withColumns({"_above": upward("_n"), "tp": upward("_pos")})
    counts = counts.drop("_b", "_n", "_pos")
    fp, fn = F.col("_above") - F.col("tp"), F.col("positives") - F.col("tp")
    out = counts.withColumns({"fp": fp, "fn": fn, "tn": F.col("rows") - F.col("positives") - fp})
    out = out.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))
    return out.withColumn("positive_rate", ratio(F.col("_above"), F.col("rows"))).drop("_above", "positives", "rows")


def rounded_sweep(table: DataFrame, digits=4) -> DataFrame:
    names = ("threshold", "recall", "precision", "f1", "f2", "positive_rate")
    return table.withColumns({c: F.bround(c, digits) for c in names})


def choose_f2(table: DataFrame, by=(), min_recall=0.70, min_precision=0.30) -> DataFrame:
    """Best F2 among thresholds with enough recall, preferring enough precision; else the
    greatest recall. The lowest threshold wins a tie."""
    ok, good = F.col("recall") >= min_recall, F.col("precision") >= min_precision
    level = F.when(ok & good, 0).when(ok, 1).otherwise(2)
    score = F.when(ok, F.col("f2")).otherwise(F.col("recall"))
    return _choose(table, by, level, score)


def choose_gated(table: DataFrame, by=(), score: Column | None = None, gates=GATES) -> DataFrame:
    """First gate any threshold meets, then the best score in it; without any, the best F1."""
    if score is None:
        score = F.col("recall") * 0.6 + F.col("f1") * 0.4
    level = None
    for i, (prec, rec) in enumerate(gates):
        hit = (F.col("precision") >= prec) & (F.col("recall") >= rec)
        level = F.when(hit, i) if level is None else level.when(hit, i)
    level = level.otherwise(len(gates))
    return _choose(table, by, level, F.when(level < len(gates), score).otherwise(F.col("f1")))


def _choose(table, by, level, score):
    rest = [c for c in table.columns if c not in by]
    rank = F.struct(level.alias("a"), (-F.round(score, 12)).alias("b"), F.col("threshold").alias("c"))
    best = table.groupBy(*by).agg(F.min_by(F.struct(*rest, level.alias("gate")), rank).alias("_r"))
    return best.select(*by, "_r.*")


def gate_score(pr_auc: Column, f1=None, recall=None, precision=None) -> Column:
    """Selection score of a model: .35 AP + .30 F1 + .20 recall + .15 precision."""
    f1, recall, precision = f1 if f1 is not None else F.col("f1"), recall if recall is not None else F.col("recall"), precision if precision is not None else F.col("precision")
    return pr_auc * 0.35 + f1 * 0.30 + recall * 0.20 + precision * 0.15


def leaderboard(df: DataFrame, model="model", y="y", p="p", yhat="yhat") -> DataFrame:
    """Metrics, composite .6 recall + .4 F1, and selection score per model."""
    base = confusion(df, y, yhat, [model]).join(ranking(df, y, p, [model]), model)
    return base.withColumns(
        {
            "composite": F.col("recall") * 0.6 + F.col("f1") * 0.4,
            "selection_score": gate_score(F.col("pr_auc")),
        }
    )


def qualified(board: DataFrame, min_precision=0.30, min_recall=0.70, min_f1=0.20) -> DataFrame:
    ok = (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall) & (F.col("f1") >= min_f1)
    return board.withColumn("qualified", ok.cast("int"))


def best_model(board: DataFrame, score="selection_score") -> DataFrame:
    return board.orderBy(F.desc(score), "model").limit(1)


def by_entity(df: DataFrame, entity="City", y="y", yhat="yhat", p="p", null_without_events=True) -> DataFrame:
    """Events, rates and score range per entity; rates are null where nothing happened."""
    out = confusion(df, y, yhat, [entity]).join(
        df.groupBy(entity).agg(F.avg(p).alias("mean_p"), F.max(p).alias("max_p")), entity
    )
    out = out.withColumn("events", F.col("tp") + F.col("fn"))
    if null_without_events:
        out = out.withColumns({c: F.when(F.col("events") > 0, F.col(c)) for c in ("recall", "precision", "f1")})
    return out


def overfit_gap(df: DataFrame, by=("model",), split="split", y="y", yhat="yhat", limit=0.15) -> DataFrame:
    """Train F1 less test F1 per model in one aggregation."""
    def f1(name):
        here = F.col(split) == name
        tp = F.count_if(here & (F.col(y) == 1) & (F.col(yhat) == 1))
        wrong = F.count_if(here & (F.col(y) != F.col(yhat)))
        return ratio(2 * tp, 2 * tp + wrong)

    out = df.groupBy(*by).agg(f1("train").alias("train_f1"), f1("test").alias("test_f1"))
    gap = F.col("train_f1") - F.col("test_f1")
    return out.withColumns({"gap": gap, "overfit": (gap > limit).cast("int")})


def regression(df: DataFrame, y="y", yhat="yhat", by=()) -> DataFrame:
    """MAE, RMSE, R2 and MAPE over finite rows; MAPE only where the truth is not 0."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(yhat).cast("double").alias("_h"))
    rows = rows.filter(finite("_y") & finite("_h"))
    err = F.col("_y") - F.col("_h")
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(n > 1, 1 - F.try_divide(F.sum(err * err), F.var_pop("_y") * n)).otherwise(0.0).alias("r2"),
        (F.avg(F.when(F.col("_y") != 0, F.abs(err / F.nullif(F.col("_y"), F.lit(0.0))))) * 100).alias("mape"),
    )


def limits(table: DataFrame, by=(), recall=0.70, precision=0.30) -> DataFrame:
    """Greatest precision with enough recall and greatest recall with enough precision."""
    return table.groupBy(*by).agg(
        F.max(F.when(F.col("recall") >= recall, F.col("precision"))).alias("max_precision"),
        F.max(F.when(F.col("precision") >= precision, F.col("recall"))).alias("max_recall"),
    )


def export(df: DataFrame, entity="City", date="Date", y="y", yhat="yhat", p="p", digits=4) -> DataFrame:
    return df.select(
        entity, F.month(date).alias("month"), F.col(y).alias("y_true"), F.col(yhat).alias("y_pred"), F.bround(p, digits).alias("probability")
    )
