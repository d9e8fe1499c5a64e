"""Micro frames for edges, ties, skew paths and seeded faults."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import columns as fc, risk
from chronopanel.operators import aggregate as a, joins as j, metrics as m, quality as q, quantiles as qt, repair as r, stats
from chronopanel.sources import readers, writers


def one(df, *names):
    row = df.first()
    return [row[n] for n in names] if len(names) > 1 else row[names[0]]


def test_all_null_rain_sums_to_zero(spark):
    df = spark.createDataFrame([("a", "2024-01-01 01:00:00", None), ("a", "2024-01-01 02:00:00", None)], "City string, Timestamp string, Rain_mm double")
    out = a.daily_panel(df.withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz")))
    assert one(out, "Rain_mm_sum") == 0.0


def test_peak_hour_ties_and_dark_days(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", 5.0 if h in (9, 14) else 0.0) for h in range(24)]
    rows += [("a", f"2024-01-02 {h:02d}:00:00", 0.0) for h in range(24)]
    df = spark.createDataFrame(rows, "City string, Timestamp string, Solar_Radiation_Wm2 double")
    out = a.daily_panel(df.withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz"))).orderBy("Date")
    assert [x["solar_peak_hour"] for x in out.collect()] == [9, 12]


def test_tier_edges(spark):
    df = spark.createDataFrame([(0.15,), (0.35,), (0.60,), (None,)], "p double")
    got = df.select(risk.tier(F.col("p")).alias("l"), risk.tier(F.col("p"), "right").alias("r")).collect()
    assert [x["l"] for x in got] == ["Moderate", "High", "Extreme", None]
    assert [x["r"] for x in got] == ["Low", "Moderate", "High", None]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (0.75,)], "x double")
    assert [x[0] for x in df.select(fc.round_even(F.col("x"), 1)).collect()] == [0.2, 0.4, 0.8]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (99.0,)], "x double")
    assert [x[0] for x in df.select(fc.clip(F.col("x"), 0.0, 10.0)).collect()] == [None, 0.0, 10.0]


def test_bad_text_becomes_null_and_is_dropped(spark):
    df = spark.createDataFrame([("2024-01-02", "1.5"), ("2024-13-45", "2"), ("2024-01-03", "x")], "t string, v string")
    assert r.coerce(df, ["v"], ["t"]).count() == 1


def test_point_on_the_edge_and_in_two_regions(spark):
    regions = spark.createDataFrame([("a", 40.0, 49.0), ("b", 40.1, 49.1)], "region string, lat double, lon double")
    edge = 40.0 + 20.0 / 111.32
    points = spark.createDataFrame([(1, edge, 49.0), (2, edge + 1e-9, 49.0), (3, 40.05, 49.05), (4, 30.0, 10.0)], "id int, latitude double, longitude double")
    for method in ("broadcast", "salted"):
        got = sorted((x["id"], x["region"]) for x in j.geofence(points, regions, method=method).collect())
        assert got == [(1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "b")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join_on_a_hot_key(spark, how):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    other = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    got = sorted(map(tuple, j.salted(big, other, ["k"], how).collect()), key=str)
    want = sorted(map(tuple, big.join(other, ["k"], how).collect()), key=str)
    assert got == want


def test_bits_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    powers = [s * 2.0**e * f for e in range(-1074, 1024) for s in (1, -1) for f in (1.0, 1 + 2.0**-52, 1.5) if np.isfinite(2.0**e * f)]
    below = [np.nextafter(2.0**e, 0) for e in range(-1073, 1024)]
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), -float("inf"), 0.1, 1 / 3]
    any_ = rng.integers(-(1 << 63), (1 << 63) - 1, 4000).view(np.float64)
    v = np.array([*powers, *below, *odd, *any_[np.isfinite(any_)]])
    df = spark.createDataFrame([(float(x),) for x in [*v, float("nan")]], "v double")
    rows = [(x["v"], x["b"]) for x in qt.with_ordered_bits(df, "v", "b").collect()]
    got = dict(rows[:-1])
    bits = (np.abs(v)).view(np.int64) * np.where(v < 0, -1, 1)
    assert all(got[x] == b for x, b in zip(v.tolist(), bits.tolist()))
    assert rows[-1][1] > got[float("inf")]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    near = 1e9 + rng.integers(0, 50, 5_000) * 2.0**-20  # only the last bits tell these apart
    signs = np.concatenate([-np.exp(rng.normal(size=900) * 30), np.exp(rng.normal(size=901) * 30), np.zeros(50)])
    data = {"hot": rng.normal(size=40_000).round(3), "tied": rng.integers(0, 4, 9_000).astype(float), "near": near, "signs": signs, "one": np.array([7.0])}
    rows = [(k, float(x), float(-x)) for k, v in data.items() for x in v] + [("none", None, None), (None, 4.0, None), (None, 6.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    wanted = {"a": ("v", 0.01), "b": ("v", 0.5), "c": ("v", 0.99), "lo": ("v", 0.0), "hi": ("v", 1.0), "w": ("w", 0.25)}
    got = {x["g"]: x for x in qt.quantiles(df, ["g"], wanted).collect()}
    assert len(got) == len(data) + 2
    for k, v in data.items():
        np.testing.assert_allclose([got[k][n] for n in ("a", "b", "c", "lo", "hi")], np.quantile(v, [0.01, 0.5, 0.99, 0, 1]), rtol=1e-12)
        np.testing.assert_allclose(got[k]["w"], np.quantile(-v, 0.25), rtol=1e-12)
    assert [got["none"][n] for n in wanted] == [None] * 6 and got[None]["b"] == 5.0 and got[None]["w"] is None


def test_quantiles_of_all_rows_and_of_none(spark):
    v = np.random.default_rng(2).normal(size=30_000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = qt.quantiles(df, [], {"m": ("v", 0.5), "q": ("v", 0.123)}).collect()
    assert len(got) == 1 and (got[0]["m"], got[0]["q"]) == tuple(pytest.approx(x, rel=1e-12) for x in np.quantile(v, [0.5, 0.123]))
    empty = qt.quantiles(df.limit(0), [], {"m": ("v", 0.5)}).collect()
    assert len(empty) == 1 and empty[0]["m"] is None
    # keys that look like the operator's own names
    odd = spark.createDataFrame([(1, 2, 3.0), (1, 2, 5.0)], "c int, digit int, k double")
    assert qt.medians(odd, ["c", "digit"], ["k"]).first()["k"] == 4.0


def test_quantiles_start_no_job_while_planned(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.rand(1).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantile-plan", "plan")
    qt.quantiles(df, ["g"], {"m": ("v", 0.5)})
    assert not tracker.getJobIdsForGroup("quantile-plan")
    spark.sparkContext.setJobGroup("after", "after")


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    total, ap, prev = sum(y), 0.0, 0
    for t in order:
        tp = sum(1 for a_, b in zip(y, p) if b >= t and a_ == 1)
        n = sum(1 for b in p if b >= t)
        ap += (tp - prev) * tp / n
        prev = tp
    return ap / total if total else 0.0


def test_ranking_with_ties_and_degenerate_sets(spark):
    rng = random.Random(5)
    cases = {
        "ties": [(rng.randint(0, 1), rng.randint(0, 6) / 6) for _ in range(80)],
        "equal": [(i % 2, 0.5) for i in range(6)],
        "negatives": [(0, i / 6) for i in range(6)],
    }
    df = spark.createDataFrame([(k, y, p) for k, v in cases.items() for y, p in v], "model string, y int, p double")
    got = {x["model"]: x for x in m.ranking(df, by=["model"]).collect()}
    for k, v in cases.items():
        y, p = zip(*v)
        assert got[k]["pr_auc"] == pytest.approx(brute_ap(y, p))
        pos, neg = [b for a_, b in v if a_ == 1], [b for a_, b in v if a_ == 0]
        if pos and neg:
            auc = sum((x > z) + 0.5 * (x == z) for x in pos for z in neg) / (len(pos) * len(neg))
            assert got[k]["roc_auc"] == pytest.approx(auc)
        else:
            assert got[k]["roc_auc"] == 0.0


def test_threshold_choice_without_any_gate_falls_back(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.8), (0, 0.7), (1, 0.1), (0, 0.6)] * 3, "y int, p double")
    best = m.choose_gated(m.sweep(df, grid=m.GATE_GRID)).first()
    assert best["gate"] == 1 and best["recall"] == 1.0 and best["threshold"] == pytest.approx(0.05)
    none = spark.createDataFrame([(0, 0.9), (0, 0.8)], "y int, p double")
    assert m.choose_gated(m.sweep(none)).first()["gate"] == 3


def test_empty_predictions(spark):
    df = spark.createDataFrame([], "y int, p double, yhat int")
    assert m.sweep(df).count() in (0, len(m.SWEEP_GRID))
    assert one(m.confusion(df), "recall") == 0.0


def test_agreement_without_overlap_fails(spark):
    d = spark.createDataFrame([("a", "2024-01-01", 0.5)], "City string, Date string, probability double").withColumn("Date", F.to_date("Date"))
    h = spark.createDataFrame([("a", "2024-01-02 01:00:00", 0.5)], "City string, Timestamp string, probability double")
    h = h.withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz"))
    assert one(q.agreement_check(q.disagreement(d, h)), "passed") is False


def test_seeded_faults_are_found(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01", 10.0, 0.2, "Low"), ("a", "2024-01-01", 99.0, 1.2, "Odd"), ("b", "2024-01-02", None, 0.4, "High")],
        "City string, Date string, Temperature_C_mean double, probability double, risk_level string",
    )
    need = spark.createDataFrame([("a",), ("b",), ("z",)], "City string")
    checks = q.run_all(
        q.no_nulls(df), q.within_bounds(df), q.unique_keys(df), q.entities_covered(df, need), q.probability_range(df), q.known_levels(df), q.required_columns(df, ["City"])
    )
    got = {x["name"]: x["passed"] for x in checks.collect()}
    faults = "bounds:Temperature_C_mean entities entity no_null prob_range risk_levels unique".split()
    assert {n for n, v in got.items() if not v} == {f"table:{n}" for n in faults} and got["table:columns"]
    assert q.exit_status(checks) == 1


def test_dedupe_keeps_last_source(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, s int, v string")
    assert sorted((x["k"], x["v"]) for x in r.dedupe(df, ["k"], "s").collect()) == [("a", "new"), ("b", "only")]
    assert sorted((x["k"], x["v"]) for x in r.dedupe(df, ["k"], "s", keep="first").collect()) == [("a", "old"), ("b", "only")]


def test_constant_and_identical_columns(spark):
    rows = [(float(i), float(i), 3.0, int(i > 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "x double, copy double, flat double, y int")
    assert {v["variable"]: v["dropped"] for v in stats.low_variance(df, ["x", "flat"]).collect()} == {"x": 0, "flat": 1}
    assert stats.prune_correlated(df, ["x", "copy"], "y") == ["copy"]


def test_correlation_is_pairwise_complete(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)) + 1e6, columns=list("abc"))
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = {(x["a"], x["b"]): x["r"] for x in stats.correlation(df, list("abc")).collect()}
    want = pdf.corr()
    for (x, y), v in got.items():
        assert v == pytest.approx(want.loc[x, y], abs=1e-9)


def test_student_tail(spark):
    # two-sided tails known in closed form: one and two degrees of freedom
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (0.0, 5.0), (-1.0, 1.0)], "t double, df double")
    got = [x[0] for x in df.select(stats.student_p("t", "df")).collect()]
    np.testing.assert_allclose(got, [0.5, 1 - 2 / np.sqrt(6), 1.0, 0.5], atol=1e-10)


def test_forecast_months_over_new_year(spark):
    df = spark.createDataFrame([("2024-12-20",), ("2025-01-10",)], "Date string").withColumn("Date", F.to_date("Date"))
    assert sorted(x[0] for x in a.forecast_months(df).collect()) == [1, 12]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *d: spark.createDataFrame([("a", x) for x in d], "City string, Date string").withColumn("Date", F.to_date("Date"))
    writers.append(rows("2024-01-01", "2024-01-02"), path)
    for _ in range(2):
        writers.append(rows("2024-01-02", "2024-01-03"), path)
    assert spark.read.parquet(path).count() == 3


def test_archive_skips_bad_lines_and_readme(spark, tmp_path):
    d = tmp_path / "x" / "deep"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("Latitude,LONGITUDE ,acq_date,brightness\n1,2,2024-01-01,3\n1,2,2024-01-01,3,9,9\n")
    (d / "README_first.csv").write_text("Latitude,LONGITUDE ,acq_date,brightness\n5,5,2024-01-01,3\n")
    got = readers.points(readers.csv_archive(spark, str(tmp_path)))
    assert got.count() == 1 and one(got, "brightness") == 3.0


def test_archive_with_mixed_headers_loses_no_row(spark, tmp_path):
    deep = tmp_path / "a b"
    deep.mkdir()
    (tmp_path / "x.csv").write_text("Latitude,LONGITUDE ,acq_date,brightness\n1,2,2024-01-01,3\n1,2,2024-01-01,3,9\n")
    (tmp_path / "same.csv").write_text("latitude,longitude,acq_date,brightness\n4,5,2024-01-05,6\n")
    (deep / "z [1],{x}.csv").write_text("\n\ufeffacq_date,brightness,Latitude,LONGITUDE\n2024-01-02,5,7,8\n")
    (deep / "y%20\u00e9.csv").write_text('Latitude,LONGITUDE ,acq_date,brightness,extra,,extra\n1,2,2024-01-03,3,"q,r",s,t\n')
    (deep / "viirs.csv").write_text("latitude,longitude,acq_date,bright_ti4\n1,2,2024-01-04,9\n")
    (tmp_path / "empty.csv").write_text("")
    got = readers.csv_archive(spark, str(tmp_path))
    assert set(got.columns) == {"latitude", "longitude", "acq_date", "brightness", "bright_ti4", "extra", "_c5", "extra_6"}
    assert got.count() == 5 and {x["extra"] for x in got.collect()} == {None, "q,r"}
    rows = {str(x["acq_date"]): (x["latitude"], x["longitude"], x["brightness"]) for x in readers.points(got).collect()}
    assert rows == {"2024-01-01": (1, 2, 3), "2024-01-02": (7, 8, 5), "2024-01-03": (1, 2, 3), "2024-01-04": (1, 2, 9), "2024-01-05": (4, 5, 6)}
    none = tmp_path / "none"
    none.mkdir()
    assert readers.csv_archive(spark, str(none)).columns == []


def test_missing_tables_name_both_paths(spark):
    with pytest.raises(FileNotFoundError):
        readers.with_fallback(spark, "/tmp/none-a", "/tmp/none-b")
