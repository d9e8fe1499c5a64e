"""The train-and-select run: what it drops, what it decides on, what it reports."""

import numpy as np
import pytest
from chronopanel.models import training as t
from chronopanel.plans import select
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=900) * 0.6 > 0.8).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id int, a double, b double, y int")
    return df.withColumns({"same": F.col("a") * 2 + 1, "flat": F.lit(3.0)})


def test_run(rows):
    train, val, test = (rows.where(f"id % 3 = {k}") for k in range(3))
    build = lambda names: {"lin": t.logistic(names, maxIter=20), "rf": t.forest(names, numTrees=5, maxDepth=3)}
    chosen = select.fit(train, val, ["a", "b", "same", "flat"], build, ["id"])
    assert sorted(chosen.names) in (["a", "b"], ["b", "same"])
    board = {r.model: r for r in select.report(chosen, test, ["id"]).collect()}
    assert set(board) == {"lin", "rf", "vote"} and sum(r.selected for r in board.values()) == 1
    assert max(board.values(), key=lambda r: r.composite).selected == 1
    assert all(r.roc_auc > 0.75 and 0 < r.threshold < 1 and r.kind in ("raw", "calibrated") for r in board.values())
    # the choices don't know the test rows
    turned = {r.model: r for r in select.report(chosen, test.withColumn("y", 1 - F.col("y")), ["id"]).collect()}
    assert all(turned[m].threshold == board[m].threshold and turned[m].selected == board[m].selected for m in board)
    assert chosen.score(test, ["id"]).where("yhat <> CAST(p >= threshold AS INT)").count() == 0
    assert chosen.score(test, ["id"]).count() == 3 * test.count()
