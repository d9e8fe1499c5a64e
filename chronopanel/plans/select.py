"""The train-and-select run: prune, fit, vote, calibrate, choose thresholds, report.

Everything is decided on training and validation rows: features are pruned on the training
rows; on validation rows each model's scores are calibrated, the calibration is kept or not,
a threshold is chosen behind the gates, and the model with the best composite at its own
threshold is selected. Test rows are only reported on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from chronopanel.models import calibrate, training
from chronopanel.operators import metrics, stats
from chronopanel.session import stage

LABEL = "y"
#: The soft vote's name among the models; the share of the raw composite that calibration must reach.
VOTE, SHARE = "vote", 0.95


@dataclass
class Selected:
    """Fitted models, features, knots of the calibration, and one row of choices a model."""

    models: dict
    names: list[str]
    knots: DataFrame
    choices: DataFrame

    def score(self, df: DataFrame, keys) -> DataFrame:
        """keys, model, p (calibrated where that was kept) and yhat at the model's threshold."""
        raw = _scores(self.models, df, keys)
        both = _kinds(raw, self.knots)
        return both.join(F.broadcast(self.choices), ["model", "kind"]).withColumn("yhat", (F.col("p") >= F.col("threshold")).cast("int"))


def prune(train: DataFrame, names, flat: float = 0.001, alike: float = 0.95) -> list[str]:
    """The features that vary and are no copies of one another, in their order."""
    still = {r["variable"] for r in stats.low_variance(train, names, flat).filter("dropped = 0").collect()}
    kept = [c for c in names if c in still]
    gone = set(stats.prune_correlated(train, kept, LABEL, alike)) if len(kept) > 1 else set()
    return [c for c in kept if c not in gone]


def _scores(models: dict, df: DataFrame, keys) -> DataFrame:
    """keys, model, p of every model and of their soft vote."""
    each = training.score_all(models, df, list(keys))
    vote = each.groupBy(*keys).agg(F.avg("p").alias("p")).withColumn("model", F.lit(VOTE))
    return each.unionByName(vote) if len(models) > 1 else each


def _kinds(raw: DataFrame, knots: DataFrame) -> DataFrame:
    """Raw and calibrated scores, one below the other."""
    made = calibrate.apply(knots, raw, by=["model"]).withColumn("kind", F.lit("calibrated"))
    return raw.withColumn("kind", F.lit("raw")).unionByName(made)


def choose(both: DataFrame) -> DataFrame:
    """model, kind, threshold, composite, selected: one row a model, from validation scores."""
    by = ["model", "kind"]
    best = metrics.choose_gated(metrics.sweep(both, LABEL, "p", by, metrics.GATE_GRID), by)
    best = best.withColumn("composite", F.col("recall") * 0.6 + F.col("f1") * 0.4)
    row = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("composite", "threshold")))
    wide = best.groupBy("model").agg(row("raw").alias("raw"), row("calibrated").alias("calibrated"))
    keep = F.col("calibrated.composite") >= F.col("raw.composite") * SHARE
    chosen = F.when(keep, F.struct(F.lit("calibrated").alias("kind"), "calibrated.*")).otherwise(F.struct(F.lit("raw").alias("kind"), "raw.*"))
    one = wide.select("model", chosen.alias("c")).select("model", "c.kind", "c.threshold", "c.composite")
    top = one.agg(F.max_by("model", F.struct("composite", "model")).alias("_top"))
    return one.crossJoin(F.broadcast(top)).withColumn("selected", (F.col("model") == F.col("_top")).cast("int")).drop("_top")


def fit(train: DataFrame, val: DataFrame, names, build, keys) -> Selected:
    """`build(names)` gives the candidate models for the features that are left."""
    kept = prune(train, names)
    models = training.fit_all(build(kept), train)
    raw = stage(_scores(models, val, [*keys, LABEL]), "validation")
    knots = stage(calibrate.fit_isotonic(raw, LABEL, "p", ["model"]), "knots")
    return Selected(models, kept, knots, stage(choose(_kinds(raw, knots)), "choices"))


def report(selected: Selected, test: DataFrame, keys) -> DataFrame:
    """The leaderboard of test rows, each model at its own threshold, with the choices made before."""
    scored = stage(selected.score(test, [*keys, LABEL]), "test")
    board = metrics.leaderboard(scored, y=LABEL).drop("composite", "selection_score")
    return board.join(selected.choices, "model")
