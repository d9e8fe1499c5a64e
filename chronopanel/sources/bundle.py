"""A scoring bundle: pipeline, calibrator, threshold and ordered features in one folder."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from chronopanel.functions.risk import predicted
from chronopanel.models import calibrate
from chronopanel.models.training import score as raw_score
from chronopanel.operators.repair import align_features
from chronopanel.sources import tables, writers


@dataclass
class Bundle:
    name: str
    model: PipelineModel
    threshold: float
    features: list
    calibrator: DataFrame | None = None  # knots of models.calibrate


def save(bundle: Bundle, path: str, spark: SparkSession) -> None:
    bundle.model.write().overwrite().save(f"{path}/model")
    if bundle.calibrator is not None:
        tables.overwrite(bundle.calibrator, f"{path}/calibrator")
    record = {
        "model_name": bundle.name,
        "optimal_threshold": bundle.threshold,
        "features": list(bundle.features),
        "calibrated": bundle.calibrator is not None,
    }
    writers.manifest(spark, record, f"{path}/manifest")


def load(path: str, spark: SparkSession) -> Bundle:
    record = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    calibrator = tables.read(spark, f"{path}/calibrator") if record["calibrated"] else None
    return Bundle(
        record["model_name"], PipelineModel.load(f"{path}/model"), record["optimal_threshold"], record["features"], calibrator
    )


def score(bundle: Bundle, df: DataFrame, keys) -> DataFrame:
    """Align features, predict, calibrate, label. Scores stay beside their keys."""
    rows = align_features(df, bundle.features, keys)
    out = raw_score(bundle.model, rows, keys, "probability")
    if bundle.calibrator is not None:
        out = calibrate.apply(bundle.calibrator, out, "probability")
    return out.withColumn("predicted_fire", predicted(out["probability"], bundle.threshold))
