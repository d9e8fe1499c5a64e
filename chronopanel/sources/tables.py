"""Snapshot tables: a version is a manifest that names its folders, written after them.

    table/data/write_id=<id>/[day=.../]part-...parquet  files, never changed once written
    table/versions/<number>.json                        one manifest for each version

A write puts its files into a folder of its own and then creates the next manifest, which
fails if another writer was first. A reader takes the newest complete manifest and only the
folders it names: it sees one version whole, however long another write takes. A write that
dies leaves files no manifest names, or a manifest without its end mark; both are ignored
and removed later. An upsert rewrites the days it touches; all other days keep the folders
of the version before. The last `keep` versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chronopanel.operators.repair import dedupe
from chronopanel.sources.readers import _path

#: Versions that stay readable; hours after which files that no version names are removed.
KEEP, ORPHAN_HOURS = 2, 24
#: The partition column that tells writes apart; the last line of a whole manifest.
WRITE, END = "write_id", "end"


class Conflict(RuntimeError):
    """Another writer made the next version first; read again and repeat the write."""


def _manifests(spark: SparkSession, path: str) -> list[int]:
    p, fs = _path(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest, or None if its write did not finish."""
    p, fs = _path(spark, f"{path}/versions/{number:012d}.json")
    stream = fs.open(p)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    return json.loads("".join(lines[:-1])) if lines and lines[-1] == END else None


def current(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest complete manifest, or that of a version; None where there is none."""
    for number in reversed(_manifests(spark, path)):
        if version is None or number == version:
            found = _manifest(spark, path, number)
            if found:
                return found
    return None


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its newest version, or of the given one."""
    found = current(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a table at {path}")
    schema = T.StructType.fromJson(found["schema"])
    if not found["folders"]:
        return spark.createDataFrame([], schema)
    data = f"{path}/data"
    # the write's id is a partition column of the folders, not of the table
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())])).option("basePath", data)
    return rows.parquet(*[f"{data}/{f}" for f in found["folders"]]).select(*[f"`{c}`" for c in schema.names])


def _publish(spark: SparkSession, path: str, base: dict | None, schema: T.StructType, folders: list[str], day: str | None, keep: int) -> int:
    """Create the manifest after `base`; exactly one of several writers succeeds."""
    listed = _manifests(spark, path)
    newest = current(spark, path)
    if (newest or {}).get("version") != (base or {}).get("version"):
        raise Conflict(f"{path} has version {(newest or {}).get('version')}, the write began at {(base or {}).get('version')}")
    # a dead write's manifest keeps its number
    number = listed[-1] + 1 if listed else 1
    record = {"version": number, "base": (base or {}).get("version"), "day": day, "schema": schema.jsonValue(), "folders": sorted(folders)}
    p, fs = _path(spark, f"{path}/versions/{number:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {number} of {path} was made by another writer") from e
        raise
    out.write((json.dumps(record) + "\n" + END + "\n").encode())
    out.close()
    clean(spark, path, keep)
    return number


def clean(spark: SparkSession, path: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> None:
    """Remove versions before the last `keep`, the folders that only they name, and files that
    no version names once they are older than `orphan_hours`."""
    numbers = _manifests(spark, path)
    found = {n: _manifest(spark, path, n) for n in numbers}
    whole = [n for n in numbers if found[n]]
    kept, gone = whole[-keep:], whole[:-keep]
    named = {f for n in kept for f in found[n]["folders"]}
    for n in numbers:
        if not found[n] and whole and n < whole[-1]:
            p, fs = _path(spark, f"{path}/versions/{n:012d}.json")
            fs.delete(p, False)
    for n in gone:
        # the manifest goes first, so no reader resolves folders that are being removed
        p, fs = _path(spark, f"{path}/versions/{n:012d}.json")
        fs.delete(p, False)
        for folder in set(found[n]["folders"]) - named:
            fs.delete(_path(spark, f"{path}/data/{folder}")[0], True)
    data, fs = _path(spark, f"{path}/data")
    if not fs.exists(data):
        return
    writes = {f.split("/")[0] for f in named}
    limit = spark._jvm.java.lang.System.currentTimeMillis() - orphan_hours * 3_600_000
    for f in fs.listStatus(data):
        name = f.getPath().getName()
        if name not in writes and f.getModificationTime() < limit:
            fs.delete(f.getPath(), True)


def _written(df: DataFrame, path: str, day: str | None) -> list[str]:
    """Write rows into a folder of their own; its folders, one a day."""
    name = f"{WRITE}={uuid.uuid4().hex}"
    target = f"{path}/data/{name}"
    (df.write.partitionBy(day) if day else df.write).parquet(target)
    if not day:
        return [name]
    p, fs = _path(df.sparkSession, target)
    return [f"{name}/{f.getPath().getName()}" for f in fs.listStatus(p) if f.isDirectory()]


def _schema(df: DataFrame, day: str | None) -> T.StructType:
    """The table's columns, all nullable, the day last as partition columns are."""
    if WRITE in df.columns:
        raise ValueError(f"a snapshot table cannot have a column called {WRITE}")
    fields = [T.StructField(f.name, f.dataType) for f in df.schema]
    return T.StructType([f for f in fields if f.name != day] + [f for f in fields if f.name == day])


def overwrite(df: DataFrame, path: str, day: str | None = None, keep: int = KEEP) -> int:
    """Replace the whole table; returns the new version. Readers keep what they resolved."""
    spark = df.sparkSession
    base = current(spark, path)
    schema = _schema(df, day)
    return _publish(spark, path, base, schema, _written(df, path, day), day, keep)


def _folder_of(value) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)


def upsert(df: DataFrame, path: str, keys=("City", "Date"), day: str = "Date", files: int = 8, keep: int = KEEP) -> int:
    """Replace rows by key in the days of the input; returns the new version.

    The stored rows of those days are found by the manifest's folders, so no other day is
    listed or read. `day` is a date. Repeating an upsert gives the same rows.
    """
    spark = df.sparkSession
    base = current(spark, path)
    rows = dedupe(df, list(keys), [day])
    schema = _schema(df, day)
    untouched: list[str] = []
    if base:
        if base["day"] != day:
            raise ValueError(f"the table at {path} is not kept by {day}")
        days = {_folder_of(r[0]) for r in df.select(day).distinct().collect()}
        touched = [f for f in base["folders"] if f.split("=")[-1] in days]
        untouched = [f for f in base["folders"] if f.split("=")[-1] not in days]
        if touched:
            data = f"{path}/data"
            old = spark.read.schema(T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())])).option("basePath", data)
            old = old.parquet(*[f"{data}/{f}" for f in touched])
            kept = old.join(rows.select(*keys), list(keys), "left_anti")
            rows = rows.select(*schema.names).unionByName(kept.select(*schema.names))
    rows = rows.select(*schema.names).repartition(F.col(day), F.pmod(F.xxhash64(*keys), F.lit(files)))
    return _publish(spark, path, base, schema, untouched + _written(rows, path, day), day, keep)


def append(df: DataFrame, path: str, keys=("City", "Date"), day: str = "Date", files: int = 8, keep: int = KEEP) -> int | None:
    """Add rows of days after the last stored one; returns the new version, None if there are none.

    The last day is known from the manifest. A second run with the same input adds nothing.
    """
    spark = df.sparkSession
    base = current(spark, path)
    rows = dedupe(df, list(keys), [day])
    schema = _schema(df, day)
    stored = [f for f in (base or {}).get("folders", [])]
    last = max((f.split("=")[-1] for f in stored if not f.endswith(_folder_of(None))), default=None)
    if last is not None:
        rows = rows.where(F.col(day) > F.lit(last).cast("date"))
    rows = rows.select(*schema.names).repartition(F.col(day), F.pmod(F.xxhash64(*keys), F.lit(files)))
    folders = _written(rows, path, day)
    if base and not folders:
        return None
    return _publish(spark, path, base, schema, stored + folders, day, keep)
