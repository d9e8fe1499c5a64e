"""Rare-event classifiers as Spark ML pipelines, long score tables, seeded search."""

from __future__ import annotations

import math
import random
from multiprocessing.pool import ThreadPool

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol
from pyspark.sql import DataFrame, functions as F

from chronopanel.functions.columns import ratio
from chronopanel.operators import metrics
from chronopanel.schema import SEED

LABEL, WEIGHT = "y", "weight"


def imbalance(df: DataFrame, label=LABEL, cap=None) -> DataFrame:
    """Rows per class and negatives per positive, each side at least one."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    r = F.greatest("negatives", F.lit(1)) / F.greatest("positives", F.lit(1))
    return n.withColumn("ratio", F.least(r, F.lit(float(cap))) if cap else r)


def balanced_weights(df: DataFrame, label=LABEL, name=WEIGHT) -> DataFrame:
    """Weight of each row so that both classes add up to half of all rows."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    table = n.crossJoin(F.broadcast(total)).select(label, ratio(F.col("_all"), F.col("_n") * F.col("_k")).alias(name))
    return df.join(F.broadcast(table), label)


def oversample(df: DataFrame, copies: int, label=LABEL) -> DataFrame:
    """Repeat positive rows, for learners without weights."""
    n = F.when(F.col(label) == 1, F.lit(max(1, int(copies)))).otherwise(F.lit(1))
    return df.withColumn("_c", F.explode(F.sequence(F.lit(1), n))).drop("_c")


def prepare(names, scaled=False) -> list:
    """Median imputation and assembly; scaled adds unit variance and zero mean."""
    filled = [f"{c}__f" for c in names]
    stages = [
        Imputer(strategy="median", inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features" if scaled else "features"),
    ]
    if scaled:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"))
    return stages


# Settings of the candidate models.
FOREST = {"numTrees": 260, "maxDepth": 16, "minInstancesPerNode": 3}
EXTRA = {"numTrees": 320, "maxDepth": 18, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}
BALANCED = {"numTrees": 500, "maxDepth": 16, "minInstancesPerNode": 3, "subsamplingRate": 0.5}
BOOSTED = {
    "HistGradientBoosting": {"maxIter": 220, "maxDepth": 5, "stepSize": 0.055},
    "XGBoost": {"maxIter": 260, "maxDepth": 5, "stepSize": 0.045, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"},
    "LightGBM": {"maxIter": 360, "maxDepth": 7, "stepSize": 0.04, "subsamplingRate": 0.85},
    "CatBoost": {"maxIter": 280, "maxDepth": 6, "stepSize": 0.045},
}
HIDDEN = (256, 128, 64)


def logistic(names, **kw) -> Pipeline:
    p = {"maxIter": 1000, "weightCol": WEIGHT, "labelCol": LABEL, **kw}
    return Pipeline(stages=[*prepare(names, scaled=True), LogisticRegression(**p)])


def forest(names, **kw) -> Pipeline:
    p = {**FOREST, "weightCol": WEIGHT, "labelCol": LABEL, "seed": SEED, **kw}
    return Pipeline(stages=[*prepare(names), RandomForestClassifier(**p)])


def boosted(names, validation=None, **kw) -> Pipeline:
    """Gradient boosted trees; `validation` names a boolean column for early stopping."""
    p = {"weightCol": WEIGHT, "labelCol": LABEL, "seed": SEED, **kw}
    if validation:
        p["validationIndicatorCol"] = validation
    return Pipeline(stages=[*prepare(names), GBTClassifier(**p)])


def neural(names, hidden=HIDDEN, **kw) -> Pipeline:
    p = {"maxIter": 300, "labelCol": LABEL, "seed": SEED, **kw}
    return Pipeline(
        stages=[*prepare(names, scaled=True), MultilayerPerceptronClassifier(layers=[len(names), *hidden, 2], **p)]
    )


def candidates(names, validation=None) -> dict[str, Pipeline]:
    """The full set of baseline models."""
    out = {
        "LogisticRegression": logistic(names),
        "RandomForest": forest(names),
        "ExtraTrees": forest(names, **EXTRA),
        "BalancedRF": forest(names, **BALANCED),
    }
    out.update({k: boosted(names, validation, **v) for k, v in BOOSTED.items()})
    out["MLP_Neural"] = neural(names)
    return out


#: Values (rows times columns) in a partition of a fit, beyond which there are more partitions than cores.
CELLS = 1 << 23


def spread(df: DataFrame, keys=(), rows: int | None = None, keep=()) -> DataFrame:
    """At least one partition per core, and as many as keep each at `CELLS` values.

    Rows go by a hash of their values, so a recomputed partition holds the same rows. Only
    the columns of `keep` (all, if none) move; `rows` is the count of rows where it is known.
    """
    kept = list(keep) or df.columns
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(cores, math.ceil((df.count() if rows is None else rows) * len(kept) / CELLS))
    if len(df.inputFiles()) >= n:
        return df.select(*kept)
    return df.select(*kept, F.xxhash64(*(keys or df.columns)).alias("_h")).repartition(n, "_h").drop("_h")


def preparation(pipeline: Pipeline):
    """Stages before the learner, and a key equal for equal preparations.

    Defaults may hold a stage's own id, which tells no difference.
    """
    stages = pipeline.getStages()[:-1]
    key = tuple((type(s).__name__, str(sorted((p.name, str(v).replace(s.uid, "")) for p, v in s.extractParamMap().items()))) for s in stages)
    return stages, key


def fit_all(models: dict, train: DataFrame) -> dict[str, PipelineModel]:
    """Fit each model on the weighted rows.

    Models with the same preparation share its fit and its output, which stays in memory
    or on disk while they train.
    """
    weighted = balanced_weights(train)
    rows = spread(weighted, rows=train.count(), keep=_read(models.values(), weighted.columns))
    prepared: dict = {}
    out = {}
    try:
        for name, m in models.items():
            stages, key = preparation(m)
            if key not in prepared:
                fitted = Pipeline(stages=stages).fit(rows)
                ready = learned(fitted.transform(rows), models.values()).persist()
                prepared[key] = (fitted, ready)
            fitted, ready = prepared[key]
            out[name] = PipelineModel([*fitted.stages, m.getStages()[-1].fit(ready)])
    finally:
        for _, ready in prepared.values():
            ready.unpersist()
    return out


def _read(pipelines, columns) -> list[str]:
    """The columns that the pipelines take from a table; all, if a stage does not tell its own."""
    names = {LABEL, WEIGHT}
    for m in pipelines:
        names.add(_indicator(m))
        for s in m.getStages()[:-1]:
            told = [s.getOrDefault(p) for p in ("inputCol", "inputCols") if s.hasParam(p) and s.isDefined(p)]
            if not told:
                return list(columns)
            names |= {c for v in told for c in ([v] if isinstance(v, str) else v)}
    return [c for c in columns if c in names]


def learned(prepared: DataFrame, pipelines) -> DataFrame:
    """The columns that the learners take from prepared rows."""
    wanted = dict.fromkeys([LABEL, WEIGHT, *map(_indicator, pipelines)])
    return prepared.select("features", *[c for c in wanted if c in prepared.columns])


def _indicator(m: Pipeline):
    learner = m.getStages()[-1]
    p = "validationIndicatorCol"
    return learner.getOrDefault(p) if learner.hasParam(p) and learner.isSet(p) else None


def probability(scored: DataFrame, name="p") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def score(model: PipelineModel, df: DataFrame, keep, name="p") -> DataFrame:
    return probability(model.transform(df), name).select(*keep, name)


def score_all(models: dict, df: DataFrame, keep) -> DataFrame:
    """Long score table: kept columns, model, p. Models add columns to one pass over the rows."""
    out, cols = df, list(keep)
    for i, (name, m) in enumerate(models.items()):
        scored = m.transform(out)
        out = scored.select(*df.columns, *[f"_p{k}" for k in range(i)], vector_to_array("probability")[1].alias(f"_p{i}"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p{i}").alias("p")) for i, n in enumerate(models)]))
    return out.select(*cols, rows.alias("_r")).select(*cols, "_r.model", "_r.p")


class AveragePrecision(Evaluator, HasLabelCol):
    """Step-wise average precision of the positive class."""

    @keyword_only
    def __init__(self, *, labelCol=LABEL):
        super().__init__()
        self._setDefault(labelCol=LABEL)
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset):
        rows = probability(dataset).select(F.col(self.getLabelCol()).alias("y"), "p")
        return metrics.ranking(rows).first()["pr_auc"]

    def isLargerBetter(self):
        return True


def draw(space: dict, n: int, seed=SEED) -> list[dict]:
    """n seeded draws. A range is (kind, low, high) with kind int, float or log."""
    rng = random.Random(seed)
    pick = {
        "int": lambda a, b: rng.randint(a, b),
        "float": rng.uniform,
        "log": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b))),
    }
    return [{k: pick[kind](a, b) for k, (kind, a, b) in space.items()} for _ in range(n)]


# Ranges of the boosted-tree search.
BOOSTED_SPACE = {
    "maxIter": ("int", 150, 600),
    "maxDepth": ("int", 3, 8),
    "stepSize": ("log", 0.01, 0.15),
    "subsamplingRate": ("float", 0.6, 1.0),
    "minInstancesPerNode": ("int", 1, 100),
}
# The same for a forest, which has no step size, and the published trials.
FOREST_SPACE = {"numTrees": BOOSTED_SPACE["maxIter"], **{k: v for k, v in BOOSTED_SPACE.items() if k not in ("maxIter", "stepSize")}}
TRIALS = 100


def search(build, trials, train: DataFrame, val: DataFrame, objective=None, parallelism=2):
    """Fit every trial on train and rate it on val: (best model, [(params, value)]).

    The first trial wins a tie. Trials run as concurrent Spark jobs.
    """
    objective = objective or AveragePrecision().evaluate
    rows, held = spread(balanced_weights(train)).persist(), spread(val).persist()

    def one(params):
        model = build(**params).fit(rows)
        return model, objective(model.transform(held))

    try:
        with ThreadPool(parallelism) as pool:
            done = pool.map(one, trials)
    finally:
        rows.unpersist()
        held.unpersist()
    best = max(range(len(done)), key=lambda i: (done[i][1], -i))
    return done[best][0], [(p, v) for p, (_, v) in zip(trials, done)]


def gated_objective(scored: DataFrame) -> float:
    """.6 recall + .4 F1 at the threshold the gates choose."""
    rows = probability(scored).select(F.col(LABEL).alias("y"), "p")
    best = metrics.choose_gated(metrics.sweep(rows, grid=metrics.GATE_GRID)).first()
    return 0.6 * best["recall"] + 0.4 * best["f1"]


def importances(model: PipelineModel, names) -> DataFrame:
    """Native importances of a tree model, or absolute coefficients, ranked."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, abs(float(v))) for n, v in zip(names, values.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, df: DataFrame, names, keys, label=LABEL, seed=SEED) -> DataFrame:
    """Loss of average precision when a feature's values come from other rows.

    One shuffled self-join serves all features; every variant is scored in the same pass
    over the rows, and one metric aggregation takes them all.
    """
    from chronopanel.models.folds import permuted

    rows = permuted(df.select(*keys, label, *names), names, keys, seed)
    rows = score(model, rows, rows.columns, "_full")
    for c in names:
        swapped = rows.withColumns({c: F.col(f"{c}__p"), f"{c}__p": F.col(c)})
        rows = score(model, swapped, swapped.columns, f"_s_{c}")
        rows = rows.withColumns({c: F.col(f"{c}__p"), f"{c}__p": F.col(c)})
    variants = [("", "_full"), *[(c, f"_s_{c}") for c in names]]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(p).alias("p")) for n, p in variants])
    scores = rows.select(label, F.explode(pairs).alias("_r")).select(label, "_r.*")
    ap = metrics.ranking(scores, label, "p", ["feature"])
    full = ap.filter("feature = ''").select(F.col("pr_auc").alias("_full"))
    drop = F.col("_full") - F.col("pr_auc")
    return ap.filter("feature <> ''").crossJoin(F.broadcast(full)).select("feature", drop.alias("importance"))
