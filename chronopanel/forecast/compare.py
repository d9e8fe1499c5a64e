"""Pooled regressors over autoregressive features, one fit for all series."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from chronopanel.operators.metrics import regression
from chronopanel.schema import SEED


def regressors() -> dict:
    """The compared families; linear ones differ in their penalty."""
    return {
        "Linear": LinearRegression(regParam=0.0),
        "Ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "Lasso": LinearRegression(regParam=0.01, elasticNetParam=1.0),
        "ElasticNet": LinearRegression(regParam=0.01, elasticNetParam=0.5),
        "DecisionTree": DecisionTreeRegressor(maxDepth=8, seed=SEED),
        "RandomForest": RandomForestRegressor(numTrees=100, maxDepth=12, seed=SEED),
        "GradientBoosting": GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, seed=SEED),
    }


def compare(train: DataFrame, test: DataFrame, names, entity="City", y="value", models=None) -> DataFrame:
    """MAE, RMSE, R2 and MAPE per model and entity on the held-out rows."""
    prep = [
        StringIndexer(inputCol=entity, outputCol="_e", handleInvalid="keep"),
        OneHotEncoder(inputCol="_e", outputCol="_eh"),
        VectorAssembler(inputCols=[*names, "_eh"], outputCol="features", handleInvalid="skip"),
    ]
    ready = Pipeline(stages=prep).fit(train)
    fit_rows, held = ready.transform(train).persist(), ready.transform(test)
    out = []
    try:
        for name, r in (models or regressors()).items():
            m = r.copy({r.labelCol: y, r.predictionCol: "yhat"}).fit(fit_rows)
            out.append(m.transform(held).select(entity, F.col(y).alias("y"), "yhat", F.lit(name).alias("model")))
    finally:
        fit_rows.unpersist()
    scored = reduce(lambda a, b: a.unionByName(b), out)
    return regression(scored, by=["model", entity])


def direct_rows(df: DataFrame, horizons, keys=("City", "variable"), time="Date", value="value", step="day") -> DataFrame:
    """Features of a row beside the value `h` steps later, the horizon as a feature.

    A join on the later time, so no step-by-step feedback is needed.
    """
    later = df.select(*keys, F.col(time).alias("_t"), F.col(value).alias("target"))
    spread = df.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    if step == "day":
        at = F.date_add(F.col(time), F.col("h"))
    else:
        at = F.col(time) + F.make_dt_interval(hours=F.col("h"))
    return spread.withColumn("_t", at).join(later, [*keys, "_t"]).drop("_t")
