"""Snapshot tables: one version at a time, dead and competing writers, removal of old versions."""

import os

import pytest
from chronopanel.sources import tables
from pyspark.sql import functions as F


def rows(spark, v, *days, cities="ab"):
    df = spark.createDataFrame([(c, d, v) for c in cities for d in days], "City string, Date string, v int")
    return df.withColumn("Date", F.to_date("Date"))


def content(df):
    return sorted((r.City, str(r.Date), r.v) for r in df.collect())


def table(*parts):
    return sorted((c, d, v) for v, days, cities in parts for d in days for c in cities)


def test_reader_sees_one_version_while_many_days_change(spark, tmp_path):
    path, days = str(tmp_path / "t"), [f"2024-01-{k:02d}" for k in range(1, 21)]
    tables.upsert(rows(spark, 1, *days), path)
    before = tables.read(spark, path)
    tables.upsert(rows(spark, 2, *days[5:], cities="a"), path)
    assert content(before) == table((1, days, "ab"))
    assert content(tables.read(spark, path)) == table((1, days[:5], "ab"), (2, days[5:], "a"), (1, days[5:], "b"))


def test_dead_writes_leave_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.upsert(rows(spark, 1, "2024-01-01"), path)

    def die(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tables, "_publish", die)
        with pytest.raises(RuntimeError):
            tables.upsert(rows(spark, 2, "2024-01-01", "2024-01-02"), path)
    (tmp_path / "t/versions/000000000002.json").write_text('{"version": 2, "fol')
    assert content(tables.read(spark, path)) == table((1, ["2024-01-01"], "ab"))
    assert tables.upsert(rows(spark, 3, "2024-01-02"), path) == 3
    assert content(tables.read(spark, path)) == table((1, ["2024-01-01"], "ab"), (3, ["2024-01-02"], "ab"))
    assert len(os.listdir(tmp_path / "t/data")) == 3
    tables.clean(spark, path, orphan_hours=-1)
    assert len(os.listdir(tmp_path / "t/data")) == 2 and tables.read(spark, path).count() == 4


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.upsert(rows(spark, 1, "2024-01-01"), path)
    write = tables._written

    def other_first(df, p, day):
        monkeypatch.setattr(tables, "_written", write)
        tables.upsert(rows(spark, 5, "2024-01-03"), p)
        return write(df, p, day)

    monkeypatch.setattr(tables, "_written", other_first)
    with pytest.raises(tables.Conflict):
        tables.upsert(rows(spark, 2, "2024-01-01"), path)
    assert content(tables.read(spark, path)) == table((1, ["2024-01-01"], "ab"), (5, ["2024-01-03"], "ab"))


def test_old_versions_go_and_shared_folders_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in range(1, 6):
        tables.upsert(rows(spark, v, f"2024-01-{v:02d}"), path)
    assert tables._manifests(spark, path) == [4, 5] and tables.read(spark, path, 4).count() == 8
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path, 3)
    assert tables.overwrite(rows(spark, 9).limit(0), path, "Date") == 6 and tables.read(spark, path).count() == 0
    assert tables.read(spark, path).columns == ["City", "v", "Date"]


def test_append_and_null_days(spark, tmp_path):
    path = str(tmp_path / "t")
    odd = spark.createDataFrame([("n", None, 7), ("n", None, 7)], "City string, Date date, v int")
    tables.append(rows(spark, 1, "2024-01-01").unionByName(odd), path)
    tables.append(rows(spark, 2, "2024-01-01", "2024-01-02"), path)
    assert tables.append(rows(spark, 3, "2024-01-02"), path) is None
    tables.upsert(odd.withColumn("v", F.lit(8)), path)
    # a key with a null matches no stored one, as in any join
    assert content(tables.read(spark, path).dropna()) == table((1, ["2024-01-01"], "ab"), (2, ["2024-01-02"], "ab"))


def test_days_prune_and_names_clash(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(rows(spark, 1, "2024-01-01", "2024-01-02", "2024-01-03"), path)
    plan = tables.read(spark, path).where("Date = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Date" in plan
    with pytest.raises(ValueError):
        tables.upsert(rows(spark, 1, "2024-01-01").withColumn("write_id", F.lit(1)), path)
