"""The serving state against features of the whole history."""

import random

import pytest
from chronopanel.operators import windows as w
from chronopanel.plans import features, state
from chronopanel.session import stage
from pyspark.sql import functions as F

NAMES = [
    "dry_days_streak", "days_since_last_fire", "city_fire_rate", "city_month_fire_rate", "fire_count_90d", "FWI_proxy_lag30",
    "Temperature_C_mean_roll30_std", "dry_days_streak_lag14", "NDVI", "temp_x_wind",
]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(8), []
    for city, first, n in (("a", 0, 420), ("b", 100, 320), ("late", 400, 20), ("gaps", 0, 420)):
        for k in range(first, first + n):
            if city == "gaps" and k % 3 == 1:
                continue
            rain = 0.0 if rng.random() < 0.8 else rng.random() * 9
            ndvi = rng.random() if k % 16 == 0 and k < 200 else None
            rows.append((city, k, 20 + rng.random() * 9, 40 + rng.random() * 30, 5 + rng.random(), rain, int(rng.random() < 0.03), ndvi))
    df = spark.createDataFrame(rows, "City string, k int, Temperature_C_mean double, Humidity_percent_mean double, Wind_Speed_kmh_mean double, Rain_mm_sum double, Fire_Occurred int, NDVI double")
    return stage(df.withColumn("Date", F.date_add(F.lit("2022-01-01").cast("date"), F.col("k"))))


def compared(df):
    out = []
    for r in df.select("City", "Date", *NAMES).collect():
        out.append((r.City, str(r.Date), *[None if r[n] is None else round(float(r[n]), 9) for n in NAMES]))
    return sorted(out)


def test_state_moved_forward_equals_whole_history(spark, panel, tmp_path):
    path = str(tmp_path / "state")
    forecast = panel.where("k >= 410").drop("k", "Fire_Occurred", "NDVI")
    history = panel.where("k < 410").drop("k")
    fitted = features.fit(history)
    want = compared(features.serving_features(forecast, history, fitted))
    state.fit(panel.where("k < 150").drop("k")).save(path)
    for lo, hi in ((150, 151), (151, 300), (300, 410)):
        state.advance(state.load(spark, path), panel.where(f"k >= {lo} AND k < {hi}").drop("k")).save(path)
    now = state.load(spark, path)
    assert now.tail.groupBy("City").count().agg(F.max("count")).first()[0] <= features.daily_reach(True)
    made = state.daily(forecast, now, fitted)
    assert want and compared(made) == want
    # the history's table is not among the files that serving reads
    kept = {f.split("/data/")[0] for f in made.inputFiles() if "/state/" in f}
    assert {k.rsplit("/", 1)[-1] for k in kept} >= {"tail", "entity", "month"}
    given = spark.createDataFrame(forecast.toPandas(), forecast.schema)
    fixed = features.Fitted(stage(fitted.thresholds), stage(fitted.climatology))
    assert not set(panel.inputFiles()) & set(state.daily(given, now, fixed).inputFiles())


def test_late_correction_in_the_tail(spark, panel):
    history = panel.where("k < 300").drop("k")
    fixed = panel.where("k = 290").drop("k").withColumn("Fire_Occurred", F.lit(1)).withColumn("Rain_mm_sum", F.lit(50.0))
    forecast = panel.where("k >= 300 AND k < 305").drop("k", "Fire_Occurred", "NDVI")
    fitted = features.fit(history)
    whole = w.splice(history, fixed, w.DAILY, None).drop("is_forecast")
    moved = state.advance(state.fit(history), fixed)
    assert compared(state.daily(forecast, moved, fitted)) == compared(features.serving_features(forecast, whole, fitted))


def test_rows_before_the_tail_are_an_error(panel):
    moved = state.fit(panel.where("k < 300").drop("k"))
    with pytest.raises(Exception, match="before the serving state"):
        state.advance(moved, panel.where("k = 3").drop("k")).tail.collect()


def test_entity_unknown_to_the_state(spark, panel):
    fitted = features.fit(panel.drop("k"))
    new = panel.where("City = 'late'").drop("k", "Fire_Occurred", "NDVI").withColumn("City", F.lit("new"))
    out = state.daily(new, state.fit(panel.drop("k")), fitted).where("City = 'new'").orderBy("Date").collect()
    assert len(out) == 20 and out[0].days_since_last_fire == 365 and out[0].city_fire_rate == 0 and out[0].Temperature_C_mean_lag1 is None
