"""Chunked windows against pandas, for chunks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import windows as w
from chronopanel.operators.scan import Prefix, running


def panel(spark, gaps=True, n=90):
    rng = np.random.default_rng(3)
    days = pd.date_range("2023-12-20", periods=n)
    parts = []
    for c in ("a", "b", "c"):
        keep = rng.random(n) > (0.3 if gaps else -1)
        v = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(3))
        parts.append(pd.DataFrame({"City": c, "Date": days.date, "v": v, "e": (rng.random(n) < 0.1).astype(int)})[keep])
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf, "City string, Date date, v double, e int").replace(float("nan"), None)
    return pdf.sort_values(["City", "Date"]).reset_index(drop=True), df


def sorted_rows(df, names):
    return df.select("City", "Date", *names).orderBy("City", "Date").toPandas()


@pytest.mark.parametrize("chunk", [5, 7, 4096])
def test_lag_and_rolling_match_pandas_rows(spark, chunk):
    pdf, df = panel(spark)
    s = w.DAILY.with_(chunk=chunk)

    def build(o):
        return {**w.lag_columns(o, ["v"], [1, 4]), **w.rolling_columns(o, ["v"], [3, 5]), **w.strict_columns(o, ["v"], [3])}

    got = sorted_rows(w.bounded(df, s, build, 5), ["v_lag1", "v_lag4", "v_roll3_mean", "v_roll5_std", "v_full3_mean"])
    g = pdf.groupby("City")["v"]
    want = {
        "v_lag1": g.shift(1),
        "v_lag4": g.shift(4),
        "v_roll3_mean": g.transform(lambda x: x.shift(1).rolling(3, min_periods=1).mean()),
        "v_roll5_std": g.transform(lambda x: x.shift(1).rolling(5, min_periods=1).std()),
        "v_full3_mean": g.transform(lambda x: x.shift(1).rolling(3).mean()),
    }
    assert len(got) == len(pdf)
    for c, x in want.items():
        np.testing.assert_allclose(got[c].astype(float), x, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("regular", [False, True])
def test_unlimited_features_cross_chunks(spark, regular):
    pdf, df = panel(spark, gaps=not regular)
    s = w.DAILY.with_(chunk=6, regular=regular)
    trails = [w.streak_trail(F.col("v") < 0, "streak"), w.since_trail(F.col("e") == 1, "since"), w.mean_trail("e", "rate")]
    out = w.fill(w.unlimited(df, s, trails), ["v"], s, leak_free=False)
    got = sorted_rows(out, ["streak", "since", "rate", "v"])
    g = pdf.groupby("City")

    def streak(x):
        run, res = 0, []
        for v in x:
            run = run + 1 if v < 0 else 0
            res.append(run)
        return pd.Series(res, index=x.index)

    def since(x):
        last, res = None, []
        for i, v in enumerate(x):
            res.append(365 if last is None else min(i - last, 365))
            last = i if v == 1 else last
        return pd.Series(res, index=x.index)

    assert (got["streak"].to_numpy() == g["v"].transform(streak).to_numpy()).all()
    assert (got["since"].to_numpy() == g["e"].transform(since).to_numpy()).all()
    np.testing.assert_allclose(got["rate"], g["e"].transform(lambda x: x.shift(1).expanding().mean()).fillna(0))
    np.testing.assert_allclose(got["v"].astype(float), g["v"].transform(lambda x: x.ffill().bfill()), equal_nan=True)


def test_no_event_is_capped(spark):
    df = spark.createDataFrame([("a", f"2024-01-0{i}", int(i == 5)) for i in range(1, 6)], "City string, Date string, e int")
    df = df.withColumn("Date", F.to_date("Date"))
    got = [r["x"] for r in w.rows_since(df, F.col("e") == 1, "x").orderBy("Date").collect()]
    assert got == [365] * 5


def test_null_rain_is_not_dry(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 0.0), ("a", "2024-01-02", None), ("a", "2024-01-03", 0.0)], "City string, Date string, r double")
    df = df.withColumn("Date", F.to_date("Date"))
    assert [r["x"] for r in w.streak(df, F.col("r") < 0.1, "x").orderBy("Date").collect()] == [1, 0, 1]


def test_future_rows_do_not_change_the_past(spark):
    from chronopanel.plans import features

    pdf, df = panel(spark, gaps=False, n=60)
    base = df.select("City", "Date", (F.coalesce("v", F.lit(0.0)) * 10).alias("Temperature_C_mean"), F.col("e").alias("Fire_Occurred"))
    base = base.withColumns({"Rain_mm_sum": F.abs("Temperature_C_mean") / 5, "Humidity_percent_mean": F.lit(50.0), "Wind_Speed_kmh_mean": F.lit(9.0)})
    cut = F.lit("2024-01-25").cast("date")
    fitted = features.fit(base.filter(F.col("Date") < cut))
    changed = base.withColumn("Temperature_C_mean", F.when(F.col("Date") >= cut, 99.0).otherwise(F.col("Temperature_C_mean")))
    changed = changed.withColumn("Fire_Occurred", F.when(F.col("Date") >= cut, 1).otherwise(F.col("Fire_Occurred")))
    s = w.DAILY.with_(chunk=120)
    made = [features.daily_features(x, fitted, s).filter(F.col("Date") < cut) for x in (base, changed)]
    names = [c for c in made[0].columns if c not in ("City", "Date")]
    a, b = (sorted_rows(m, names) for m in made)
    pd.testing.assert_frame_equal(a, b)


def test_spine_fills_gaps(spark):
    _, df = panel(spark)
    out = w.spine(df, w.DAILY)
    per = out.groupBy("City").agg(F.count("*").alias("n"), (F.datediff(F.max("Date"), F.min("Date")) + 1).alias("d")).collect()
    assert all(r["n"] == r["d"] for r in per)
    assert out.filter("e is not null").count() == df.count()


def test_running_sum_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.floor(F.col("id") / 37).alias("b"))
    out = running(df, ["g"], "b", "id", [Prefix("s", "sum", F.col("id")), Prefix("x", "sum", F.col("id"), False)])
    pdf = out.orderBy("g", "id").toPandas()
    want = pdf.groupby("g")["id"].cumsum()
    assert (pdf["s"] == want).all()
    assert (pdf["x"].fillna(0) == want - pdf["id"]).all()


def test_feature_plan_has_no_python_and_no_single_task_window(spark, sf):
    import catalog

    df = catalog.QUERIES["feature_surface"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert not any("Window" in x for x in lines[max(0, i - 3) : i])
