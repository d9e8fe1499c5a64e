"""Properties of training, ensembles and forecasts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.forecast import blend, recursive, ridge, seasonal
from chronopanel.models import calibrate, ensemble, folds, training as t
from chronopanel.operators import metrics

X = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=1500) * 0.7 > 1.2).astype(int)
    pdf = pd.DataFrame({"id": range(1500), "a": x[:, 0], "b": x[:, 1], "y": y})
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return t.fit_all({"forest": t.forest(X, numTrees=5, maxDepth=4), "linear": t.logistic(X, maxIter=20)}, rows)


def test_scores_are_probabilities_and_rank(rows, fitted):
    s = t.score_all(fitted, rows, ["id", "y"]).cache()
    lo, hi, n = s.agg(F.min("p"), F.max("p"), F.count("*")).first()
    assert 0 <= lo and hi <= 1 and n == 3000
    assert all(x["roc_auc"] > 0.8 for x in metrics.ranking(s, by=["model"]).collect())


def test_class_weights_balance(rows):
    w = t.balanced_weights(rows).groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert w[0]["w"] == pytest.approx(w[1]["w"])


def test_folds_are_stratified(rows):
    n = folds.stratified_folds(rows, "y", ["id"]).groupBy("y", "fold").count().toPandas()
    assert (n.groupby("y")["count"].agg(lambda c: c.max() - c.min()) <= 1).all() and len(n) == 10


def test_permutation_keeps_values(rows):
    p = folds.permuted(rows, ["a"], ["id"]).toPandas()
    assert len(p) == 1500 and sorted(p["a"]) == sorted(p["a__p"]) and (p["a"] != p["a__p"]).mean() > 0.9


def test_permutation_importance_finds_the_driver(rows, fitted):
    imp = {x["feature"]: x["importance"] for x in t.permutation_importance(fitted["forest"], rows, X, ["id"]).collect()}
    assert imp["a"] > imp["b"] > -0.05


def test_search_picks_the_best_trial(rows):
    train, val = rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")
    _, tried = t.search(lambda **kw: t.forest(X, **kw), [{"numTrees": 1, "maxDepth": 1}, {"numTrees": 6, "maxDepth": 4}], train, val)
    assert tried[1][1] >= tried[0][1]
    assert t.draw(t.BOOSTED_SPACE, 3) == t.draw(t.BOOSTED_SPACE, 3)


def test_stack_scores(rows):
    train, test = rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")
    stack = ensemble.Stack({"forest": t.forest(X, numTrees=3, maxDepth=3), "linear": t.logistic(X, maxIter=10)}, ["id"], folds=2).fit(train)
    s = stack.score(test, ["id", "y"])
    assert s.count() == 500 and metrics.ranking(s).first()["roc_auc"] > 0.8


def test_isotonic_equals_the_min_max_formula(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rising = [("rising", k / 500, k) for k in range(500)]
    rows = [("noisy", float(rng.integers(0, 300)) / 300, int(rng.random() < 0.3)) for _ in range(2000)] + rising
    rows += [("falling", k / 90, int(k < 30)) for k in range(90)] + [("one", 0.5, 1), ("noisy", None, 1), (None, 0.2, 0), (None, 0.7, 1)]
    df = spark.createDataFrame(rows, "m string, p double, y int")
    for parts, fan in ((13, 2), (4, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            knots = calibrate.fit_isotonic(df, by=["m"], fan=fan)
            got = {(r.g, r.x): r.v for r in knots.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        for name in ("noisy", "rising", "falling"):
            pts: dict = {}
            for m, p, y in rows:
                if m == name and p is not None:
                    pts.setdefault(p, []).append(y)
            xs = sorted(pts)
            t, n = np.r_[0, np.cumsum([sum(pts[x]) for x in xs])], np.r_[0, np.cumsum([len(pts[x]) for x in xs])]
            mean = np.full((len(xs), len(xs)), np.inf)
            for i in range(len(xs)):
                mean[i, i:] = (t[i + 1 :] - t[i]) / (n[i + 1 :] - n[i])
            least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
            want = [least[: i + 1, i].max() for i in range(len(xs))]
            own = sorted((x, v) for (g, x), v in got.items() if g == f'{{"m":"{name}"}}')
            np.testing.assert_allclose(np.interp(xs, *zip(*own)), want, rtol=1e-12)
    probe = spark.createDataFrame([(m, p) for m in ("noisy", "falling", "one", "absent", None) for p in (-1.0, 0.1, 0.3337, 0.5, 2.0, None)], "m string, p double")
    probe = probe.withColumn("raw", F.col("p"))
    small = sorted(map(str, calibrate.apply(knots, probe, by=["m"]).collect()))
    monkeypatch.setattr(calibrate, "is_small", lambda df: False)
    large = calibrate.apply(knots, probe, by=["m"]).select("m", "p", "raw")
    assert sorted(map(str, large.collect())) == small
    assert all((r.p is None) == (r.raw is None or r.m == "absent") for r in large.collect())


def test_isotonic_is_monotone_and_clipped(rows, fitted):
    s = t.score(fitted["forest"], rows, ["id", "y"])
    cal = calibrate.apply(calibrate.fit_isotonic(s), s.withColumn("raw", F.col("p"))).orderBy("raw").toPandas()
    assert (np.diff(cal["p"]) >= -1e-12).all() and cal["p"].between(0, 1).all()


def test_bundle_round_trip(spark, rows, fitted, tmp_path):
    from chronopanel.sources import bundle

    b = bundle.Bundle("forest", fitted["forest"], 0.4, X, None)
    bundle.save(b, str(tmp_path / "b"), spark)
    back = bundle.load(str(tmp_path / "b"), spark)
    a, c = (bundle.score(x, rows, ["id"]).orderBy("id").toPandas() for x in (b, back))
    pd.testing.assert_frame_equal(a, c)


def test_role_weights_sum_to_one(spark):
    board = spark.createDataFrame([("r", 0.9, 0.2, 0.3), ("p", 0.4, 0.6, 0.4), ("b", 0.7, 0.4, 0.5)], "model string, recall double, precision double, pr_auc double")
    w = {x["model"]: (x["role"], x["weight"]) for x in ensemble.role_weights(board).collect()}
    assert [w[k][0] for k in "rpb"] == ["recall", "precision", "balanced"]
    assert sum(v for _, v in w.values()) == pytest.approx(1.0)
    scores = spark.createDataFrame([(1, "r", 0.9), (1, "p", 0.0), (1, "b", 0.0), (2, "r", 0.9), (2, "p", 0.9), (2, "b", 0.2)], "id int, model string, p double")
    got = {x["id"]: x["p"] for x in ensemble.role_blend(scores, ensemble.role_weights(board), ["id"]).collect()}
    plain = sum(w[k][1] * p for k, p in (("r", 0.9), ("p", 0.9), ("b", 0.2)))
    assert got[2] == pytest.approx(min(plain * 1.1, 1.0)) and got[1] == pytest.approx(max(w["r"][1] * 0.9, 0.10))


def test_grouped_ridge_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    parts, want = [], {}
    for k in ("u", "v"):
        x = np.column_stack([np.ones(400), rng.normal(size=(400, 2))])
        y = x @ rng.normal(size=3) + rng.normal(size=400) * 0.1
        want[k] = np.linalg.lstsq(x, y, rcond=None)[0]
        parts.append(pd.DataFrame({"k": k, "x1": x[:, 1], "x2": x[:, 2], "y": y}))
    df = spark.createDataFrame(pd.concat(parts)).repartition(5)
    got = ridge.fit(df.withColumn("x", F.array(F.lit(1.0), "x1", "x2")), ["k"], "x", "y", [0.0, 0.0, 0.0]).collect()
    for r in got:
        np.testing.assert_allclose(r["beta"], want[r["k"]], atol=1e-6)


def wave(spark, n=400):
    days = pd.date_range("2022-01-01", periods=n)
    i = np.arange(n)
    pdf = pd.DataFrame({"City": "a", "variable": "Temperature_C_mean", "Date": days.date, "value": 10 + 0.01 * i + 5 * np.sin(2 * np.pi * i / 7)})
    return pdf, spark.createDataFrame(pdf)


def test_seasonal_forecast_follows_a_weekly_wave(spark):
    pdf, df = wave(spark)
    out = seasonal.forecast(seasonal.fit(df.filter("Date < '2023-01-15'")), 20).toPandas().merge(pdf, on="Date")
    assert len(out) == 20 and (out["yhat"] - out["value"]).abs().mean() < 0.6
    assert (out["lower"] <= out["upper"]).all()


def test_a_seeded_break_is_found_and_bounds_widen(spark):
    """One change of slope among ten knots; a straight series has none, and narrower bounds."""
    rng = np.random.default_rng(3)
    days = pd.date_range("2022-01-01", periods=600)
    at = 0.8 * 5 / 11 * 599  # the fifth knot
    rows = []
    for name, slope in (("broken", 0.09), ("straight", 0.0)):
        y = 0.02 * np.arange(600) + slope * np.maximum(np.arange(600) - at, 0) + rng.normal(size=600) * 0.5
        rows += [(name, "t", d.date(), float(v)) for d, v in zip(days, y)]
    fitted = seasonal.fit(spark.createDataFrame(rows, "City string, variable string, Date date, value double"))
    found = {r.City: r for r in fitted.collect()}
    changes = np.abs(found["broken"].beta[2 : 2 + seasonal.KNOTS])
    assert changes.argmax() in (3, 4, 5) and np.sort(changes)[::-1][:3].sum() > 0.9 * changes.sum()
    assert changes[changes.argsort()[-3:]].sum() == pytest.approx(0.09 * 599, rel=0.25)
    assert (np.abs(found["straight"].beta[2 : 2 + seasonal.KNOTS]) < 0.05 * changes.max()).all()
    out = seasonal.forecast(fitted, 90).toPandas().sort_values("Date")
    wide = {c: (g.upper - g.lower).to_numpy() for c, g in out.groupby("City")}
    assert (np.diff(wide["broken"]) > 0).all() and wide["broken"][-1] > 1.5 * wide["broken"][0]
    assert wide["straight"][-1] < 1.2 * wide["straight"][0]


def test_changes_solve_the_penalised_equations():
    """Stationarity: at changes that are not 0 the pull equals the limit, elsewhere it stays under it."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5, 80, 6))
    beta = np.where(rng.random((5, 6)) < 0.4, rng.normal(size=(5, 6)), 0)
    y = np.einsum("njk,nk->nj", x, beta) + rng.normal(size=(5, 80)) * 0.1
    xx, xy, limit = np.einsum("nji,njk->nik", x, x), np.einsum("nji,nj->ni", x, y), np.full(5, 4.0)
    got = ridge.sparse_changes(xx, xy, limit, np.zeros((5, 6)))
    pull = xy - np.einsum("nik,nk->ni", xx, got)
    assert np.allclose(pull[got != 0], 4.0 * np.sign(got[got != 0]), atol=1e-6) and (np.abs(pull[got == 0]) <= 4.0 + 1e-6).all()
    assert (got == 0).any()


def test_recursive_forecast_follows_a_weekly_wave(spark):
    pdf, df = wave(spark)
    out = recursive.forecast(recursive.fit(df.filter("Date < '2023-01-15'")), 20).toPandas().merge(pdf, on="Date")
    assert len(out) == 20 and (out["yhat"] - out["value"]).abs().mean() < 0.6


def test_short_series_get_no_forecast(spark):
    _, df = wave(spark, 60)
    assert seasonal.forecast(seasonal.fit(df), 5).count() == 0
    assert recursive.forecast(recursive.fit(df), 5).count() == 0


def test_blend_prefers_the_exact_forecast(spark):
    df = spark.createDataFrame([("a", "t", float(i), float(i), 0.0) for i in range(6)], "City string, variable string, y double, a double, b double")
    assert blend.weights(df).first()["weight"] == 1.0
    assert blend.weights(df.limit(4)).count() == 0


def test_serving_features_equal_training_features(spark, sf):
    """The first forecast day has the unlimited features that the same row has in training."""
    from catalog.base import long_panel
    from chronopanel.plans import features
    from chronopanel.session import stage

    df = stage(long_panel(spark, sf).drop("n"))
    last = df.agg({"Date": "max"}).first()[0]
    history, forecast = df.filter(df.Date < last), df.filter(df.Date == last).drop("Fire_Occurred")
    fitted, names = features.fit(history), ["dry_days_streak", "days_since_last_fire", "city_fire_rate", "city_month_fire_rate"]
    want = features.daily_features(df, fitted).filter(df.Date == last).select("City", *names)
    got = features.serving_features(forecast, history, fitted).select("City", *names)
    rows = sorted(map(tuple, want.collect()))
    assert rows and sorted(map(tuple, got.collect())) == rows


def test_partitions_of_a_fit_grow_with_its_rows(spark, monkeypatch):
    from chronopanel.models import training

    df = spark.createDataFrame([(float(i), i % 2, str(i)) for i in range(3000)], "a double, y int, other string").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert training.spread(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(training, "CELLS", 100)
    dealt = training.spread(df, keep=["a", "y"])
    assert dealt.rdd.getNumPartitions() == 60 and dealt.columns == ["a", "y"]
    assert sorted(r.a for r in dealt.collect()) == [float(i) for i in range(3000)]


def test_a_fit_moves_the_columns_it_reads(spark):
    from chronopanel.models import training
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer

    columns = ["a", "b", "key", "y", "weight", "early"]
    assert training._read([training.forest(["a"]), training.boosted(["b"], "early")], columns) == ["a", "b", "y", "weight", "early"]
    # a stage that does not tell its columns gets them all
    free = Pipeline(stages=[SQLTransformer(statement="SELECT *, a + b AS c FROM __THIS__"), LogisticRegression()])
    assert training._read([free], columns) == columns


def test_the_network_query_fits_the_published_network(spark, monkeypatch):
    from catalog import models

    seen = {}
    monkeypatch.setattr(models, "report", lambda spark, sf, fits, **kw: seen.update(fits))
    models.m8_neural(None, None)
    learner = seen["MLP_Neural"].getStages()[-1]
    assert learner.getLayers() == [len(models.X), 256, 128, 64, 2] and learner.getMaxIter() == 300


def test_the_search_query_makes_the_published_trials(spark, monkeypatch):
    from catalog import models

    seen = {}

    def search(build, space, trials, train, val, **kw):
        seen.update(space=space, trials=trials, learner=build(numTrees=200, maxDepth=4).getStages()[-1])
        return None, train

    monkeypatch.setattr(models, "split", lambda spark, sf: (spark.range(1),) * 3)
    monkeypatch.setattr(models.guided, "search", search)
    models.m9_search(spark, None)
    assert seen["trials"] == 100 and isinstance(seen["learner"], t.RandomForestClassifier)
    assert seen["space"] == {"numTrees": ("int", 150, 600), "maxDepth": ("int", 3, 8), "subsamplingRate": ("float", 0.6, 1.0), "minInstancesPerNode": ("int", 1, 100)}
