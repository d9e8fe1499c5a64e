"""Node tables of tree ensembles: evaluation and attributions over arrays of rows.

A fitted ensemble becomes one array per property of its nodes. Batches of rows walk all
trees at once. Attributions are the path-dependent Shapley values of each row: a feature's
share of the difference between the row's score and the mean score of the training rows,
where absent features follow both branches of a split by the rows that took them in
training. They are summed leaf by leaf: a leaf's path meets some features, each of which
the row either satisfies or not, and the sum over subsets of these features is a polynomial
product, computed for all rows of a batch together.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from chronopanel.session import scratch


@dataclass(frozen=True)
class Nodes:
    """Trees laid out one after the other; leaves have feature -1. `value` counts in the score."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The sum over trees of the values of the leaves that each row of `x` reaches."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at].sum(axis=1)
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)

    def base(self) -> float:
        """The mean score of the training rows, as the covers weigh them."""
        return float(sum(self._mean(int(r)) for r in self.roots))

    def _mean(self, node: int) -> float:
        if self.feature[node] < 0:
            return float(self.value[node])
        a, b = int(self.left[node]), int(self.right[node])
        return (self.cover[a] * self._mean(a) + self.cover[b] * self._mean(b)) / (self.cover[a] + self.cover[b])

    def leaves(self):
        """(value, {feature: ([(threshold, goes left)], share of training rows)}) of every leaf."""
        for root in self.roots:
            stack = [(int(root), {})]
            while stack:
                node, path = stack.pop()
                f = int(self.feature[node])
                if f < 0:
                    yield float(self.value[node]), path
                    continue
                a, b = int(self.left[node]), int(self.right[node])
                whole = self.cover[a] + self.cover[b]
                for child, is_left in ((a, True), (b, False)):
                    tests, share = path.get(f, ((), 1.0))
                    stack.append((child, {**path, f: ((*tests, (float(self.threshold[node]), is_left)), share * float(self.cover[child] / whole))}))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """One Shapley value for each row and feature; with `base` they add up to the score."""
        out = np.zeros(x.shape)
        for value, path in self.leaves():
            m = len(path)
            if not m:
                continue
            names = list(path)
            share = [path[f][1] for f in names]
            holds = np.ones((m, len(x)))
            for j, f in enumerate(names):
                for threshold, is_left in path[f][0]:
                    holds[j] *= (x[:, f] <= threshold) == is_left
            weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
            for j, f in enumerate(names):
                # coefficient k: the sum over sets of k other features that are present
                terms = np.zeros((m, len(x)))
                terms[0] = 1.0
                for i in range(m):
                    if i != j:
                        terms[1:] = terms[1:] * share[i] + terms[:-1] * holds[i]
                        terms[0] *= share[i]
                out[:, f] += value * (weight @ terms) * (holds[j] - share[j])
        return out


def export(model, spark: SparkSession | None = None) -> Nodes:
    """The node table of a fitted tree model, or of a pipeline that ends with one.

    Scores are probabilities of the positive class for forests and single trees of classes,
    predictions for regressors, and for boosted classifiers the margin, whose logistic
    function of twice its size is the probability. The table has as many rows as the model
    has nodes, which its parameters bound.
    """
    learner = model.stages[-1] if isinstance(model, PipelineModel) else model
    spark = spark or SparkSession.getActiveSession()
    path = scratch(spark, "nodes")
    learner.write().overwrite().save(path)
    found = spark.read.parquet(f"{path}/data")
    if "treeID" not in found.columns:
        # a single tree's nodes
        found = found.select(F.lit(0).alias("treeID"), F.struct(*found.columns).alias("nodeData"))
    rows = found.select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"])
    weights = np.array(learner.treeWeights) if hasattr(learner, "treeWeights") else np.ones(1)
    boosted = "GBT" in type(learner).__name__
    classes = not boosted and hasattr(learner, "numClasses")
    of = rows["treeID"].to_numpy()
    first = np.searchsorted(of, np.arange(len(weights)))
    if (rows["id"].to_numpy() != np.arange(len(rows)) - first[of]).any():
        raise ValueError("node numbers of a tree have gaps")
    value = np.array([s[1] / sum(s) for s in rows["impurityStats"]]) if classes else rows["prediction"].to_numpy()
    value = value * (weights if boosted else weights / weights.sum())[of]
    split = rows["split"]
    return Nodes(
        first,
        np.array([s["featureIndex"] for s in split]),
        np.array([s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in split]),
        rows["leftChild"].to_numpy() + first[of],
        rows["rightChild"].to_numpy() + first[of],
        value,
        rows["rawCount"].to_numpy().astype(float),
    )


def attributions(model: PipelineModel, df: DataFrame, names, keys) -> DataFrame:
    """keys, score, base and one attribution `phi_<feature>` for each feature, of every row.

    The pipeline's preparation runs as in scoring, so imputed values are attributed as the
    model saw them. base + the attributions = score.
    """
    nodes = export(model, df.sparkSession)
    base = nodes.base()
    rows = df
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    shared = df.sparkSession.sparkContext.broadcast(nodes)
    made = [f"phi_{n}" for n in names]

    @F.pandas_udf("array<double>")
    def explain(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = np.stack(x.to_numpy())
        return pd.Series(list(np.column_stack([shared.value.scores(m), shared.value.attributions(m)])))

    rows = rows.select(*keys, explain(vector_to_array("features")).alias("_e"))
    return rows.select(*keys, F.col("_e")[0].alias("score"), F.lit(base).alias("base"), *[F.col("_e")[i + 1].alias(n) for i, n in enumerate(made)])
