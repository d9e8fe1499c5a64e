"""Node tables against Spark's own scores, attributions against subsets, the pooled recursion."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from chronopanel.forecast import recursive
from chronopanel.models import nodes, training as t
from chronopanel.operators import windows as w
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4)).round(2)
    y = ((x[:, 0] * x[:, 1] + x[:, 2] > 0.3) ^ (rng.random(600) < 0.05)).astype(int)
    data = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    data[5] = (5, None, *data[5][2:])
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, y int")


def conditional(n: nodes.Nodes, x, present, node):
    """The score of a row when only some features are known."""
    f = n.feature[node]
    if f < 0:
        return n.value[node]
    a, b = n.left[node], n.right[node]
    if f in present:
        return conditional(n, x, present, a if x[f] <= n.threshold[node] else b)
    return (n.cover[a] * conditional(n, x, present, a) + n.cover[b] * conditional(n, x, present, b)) / (n.cover[a] + n.cover[b])


def brute(n: nodes.Nodes, x):
    out = np.zeros(len(x))
    v = lambda s: sum(conditional(n, x, s, r) for r in n.roots)
    for f in range(len(x)):
        rest = [g for g in range(len(x)) if g != f]
        for k in range(len(rest) + 1):
            for s in combinations(rest, k):
                out[f] += factorial(k) * factorial(len(rest) - k) / factorial(len(x)) * (v({*s, f}) - v(set(s)))
    return out


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_equal_subsets_and_add_up(spark, rows, kind):
    build = t.forest(NAMES, numTrees=4, maxDepth=5) if kind == "forest" else t.boosted(NAMES, maxIter=5, maxDepth=4)
    model = t.fit_all({"m": build}, rows)["m"]
    p = {r.id: r.p for r in t.score(model, rows, ["id"]).collect()}
    told = nodes.attributions(model, rows, NAMES, ["id"]).collect()
    n = nodes.export(model, spark)
    for r in told:
        total = r.base + sum(r[f"phi_{c}"] for c in NAMES)
        assert total == pytest.approx(r.score, abs=1e-10)
        assert (r.score if kind == "forest" else 1 / (1 + np.exp(-2 * r.score))) == pytest.approx(p[r.id], abs=1e-10)
    plain = {r.id: [r[c] for c in NAMES] for r in rows.where("a IS NOT NULL").collect()}
    for r in told[:40]:
        if r.id in plain:
            np.testing.assert_allclose([r[f"phi_{c}"] for c in NAMES], brute(n, np.array(plain[r.id])), atol=1e-10)


def test_single_tree_and_regression(spark, rows):
    ready = VectorAssembler(inputCols=["b", "c", "d"], outputCol="features").transform(rows)
    x = np.array([[r.b, r.c, r.d] for r in ready.collect()])
    for learner in (DecisionTreeRegressor(labelCol="y", maxDepth=4), GBTRegressor(labelCol="y", maxIter=4, maxDepth=3), DecisionTreeRegressor(labelCol="y", maxDepth=0)):
        model = learner.fit(ready)
        want = [r.prediction for r in model.transform(ready).collect()]
        np.testing.assert_allclose(nodes.export(model, spark).scores(x), want, atol=1e-12)


def wave(spark, n, step, cities=3):
    rng = np.random.default_rng(4)
    unit = "day" if step == "day" else "hour"
    period = 7 if step == "day" else 24
    rows = [(f"c{c}", "t", k, 10.0 * c + (c + 1) * np.sin(2 * np.pi * k / period) + 0.05 * rng.normal()) for c in range(cities) for k in range(n)]
    df = spark.createDataFrame([(a, b, k, float(v)) for a, b, k, v in rows], "City string, variable string, k int, value double")
    at = F.expr(f"timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval({'k' if unit == 'day' else '0'}, {'k' if unit == 'hour' else '0'}, 0, 0)")
    return df.withColumn("Date" if step == "day" else "Timestamp", at.cast("date") if step == "day" else at)


def test_first_pooled_step_is_the_models_own_prediction(spark):
    df = wave(spark, 200, "day").drop("k")
    fitted = recursive.fit_pooled(df, maxIter=6, maxDepth=4)
    got = {r.City: r.yhat for r in recursive.forecast_pooled(fitted, 60).where("Date = '2023-07-20'").collect()}
    scale = {r.City: (r._mean, r._std) for r in fitted.series.collect()}
    last = df.select("City", "variable", "Date", "value")
    ahead = last.unionByName(last.select("City", "variable").distinct().selectExpr("City", "variable", "DATE'2023-07-20' AS Date", "0.0 AS value"))
    scaled = ahead.join(fitted.series.select("City", "_mean", "_std"), "City").withColumn("value", (F.col("value") - F.col("_mean")) / F.col("_std"))
    ready = recursive.ar_features(scaled).where("Date = '2023-07-20'")
    own = fitted.model.transform(VectorAssembler(inputCols=recursive.feature_names(), outputCol="features").transform(ready))
    want = {r.City: r.prediction * scale[r.City][1] + scale[r.City][0] for r in own.collect()}
    assert len(want) == 3 and all(got[c] == pytest.approx(v, abs=1e-9) for c, v in want.items())
    assert recursive.forecast_pooled(fitted, 60).count() == 180


def test_pooled_hours_keep_the_row_gate(spark):
    hours = w.HOURLY
    long, short = wave(spark, 800, "hour", 2).drop("k"), wave(spark, 719, "hour", 1).drop("k").withColumn("City", F.lit("short"))
    fitted = recursive.fit_pooled(long.unionByName(short), hours, maxIter=5, maxDepth=4)
    out = recursive.forecast_pooled(fitted, 336, hours).toPandas()
    assert set(out.City) == {"c0", "c1"} and len(out) == 2 * 336 and out.yhat.notna().all()
    # the daily wave goes on
    c1 = out[out.City == "c1"].sort_values("Timestamp").yhat.to_numpy()
    assert np.corrcoef(c1[:24], c1[-24:])[0, 1] > 0.8
