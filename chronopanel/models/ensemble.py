"""Ensembles over long score tables and out-of-fold stacking."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from chronopanel.models.folds import stratified_folds
from chronopanel.models.training import LABEL, balanced_weights, score, spread
from chronopanel.operators.quantiles import quantiles


def soft_vote(scores: DataFrame, keys, model="model", p="p", members=None) -> DataFrame:
    """Mean probability of the members per row."""
    rows = scores.filter(F.col(model).isin(*members)) if members else scores
    return rows.groupBy(*keys).agg(F.avg(p).alias(p))


def top_models(board: DataFrame, k=3, by="pr_auc") -> list[str]:
    """Names of the k best; the board has one row per model."""
    return [r["model"] for r in board.orderBy(F.desc(by), "model").limit(k).select("model").collect()]


def role_weights(board: DataFrame) -> DataFrame:
    """Role and normalised weight per model.

    Recall models have at least median recall and less than median precision and weigh
    2, precision models the reverse and 1, others 1.5; each times .5 + average precision.
    """
    med = quantiles(board, [], {"_r": ("recall", 0.5), "_p": ("precision", 0.5)})
    high_r, high_p = F.col("recall") >= F.col("_r"), F.col("precision") >= F.col("_p")
    role = F.when(high_r & ~high_p, "recall").when(high_p & ~high_r, "precision").otherwise("balanced")
    base = F.when(F.col("role") == "recall", 2.0).when(F.col("role") == "precision", 1.0).otherwise(1.5)
    raw = board.crossJoin(F.broadcast(med)).withColumn("role", role)
    raw = raw.withColumn("_w", base * (F.coalesce("pr_auc", F.lit(0.3)) + 0.5))
    total = raw.agg(F.sum("_w").alias("_total"))
    return raw.crossJoin(F.broadcast(total)).select("model", "role", (F.col("_w") / F.col("_total")).alias("weight"))


def role_blend(scores: DataFrame, weights: DataFrame, keys, vote=0.15, share=0.6, boost=1.10, strong=0.5, floor=0.10) -> DataFrame:
    """Weighted mean, raised where most models agree, floored where a recall model is sure."""
    joined = scores.join(F.broadcast(weights), "model")
    out = joined.groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("p")).alias("_b"),
        F.avg((F.col("p") > vote).cast("double")).alias("_votes"),
        F.max(F.when(F.col("role") == "recall", F.col("p"))).alias("_sure"),
    )
    p = F.when(F.col("_votes") >= share, F.least(F.col("_b") * boost, F.lit(1.0))).otherwise(F.col("_b"))
    p = F.when(F.col("_sure") > strong, F.greatest(p, F.lit(floor))).otherwise(p)
    return out.select(*keys, p.alias("p"))


class Stack:
    """Out-of-fold scores of the bases, a logistic model over them.

    A row's final score is `meta` times the logistic score plus the rest times the mean
    of the fold models.
    """

    def __init__(self, bases: dict, keys, folds=5, meta=0.6):
        self.bases, self.keys, self.folds, self.meta = bases, list(keys), folds, meta
        self.fitted: dict = {}
        self.model = None

    def _assembler(self):
        return VectorAssembler(inputCols=list(self.bases), outputCol="features")

    def fit(self, train: DataFrame) -> "Stack":
        rows = spread(stratified_folds(balanced_weights(train), LABEL, self.keys, self.folds)).persist()
        try:
            oof = None
            for f in range(self.folds):
                fit_rows, held = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
                part = held
                for name, pipe in self.bases.items():
                    m = pipe.fit(fit_rows)
                    self.fitted.setdefault(name, []).append(m)
                    kept = [c for c in part.columns]
                    part = score(m, part, kept, name)
                part = part.select(*self.keys, LABEL, *self.bases)
                oof = part if oof is None else oof.unionByName(part)
            self.model = LogisticRegression(labelCol=LABEL, maxIter=1000).fit(self._assembler().transform(oof))
        finally:
            rows.unpersist()
        return self

    def score(self, df: DataFrame, keep) -> DataFrame:
        out = df
        for name, models in self.fitted.items():
            parts = []
            for i, m in enumerate(models):
                out = score(m, out, out.columns, f"_{name}_{i}")
                parts.append(F.col(f"_{name}_{i}"))
            out = out.withColumn(name, sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_{name}_{i}" for i in range(len(models))])
        scored = self.model.transform(self._assembler().transform(out))
        mean = sum((F.col(n) for n in list(self.bases)[1:]), F.col(list(self.bases)[0])) / len(self.bases)
        p = vector_to_array("probability")[1] * self.meta + mean * (1 - self.meta)
        return scored.select(*keep, p.alias("p"))
