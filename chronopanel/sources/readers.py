"""Table scans with declared types, archives of text files, freshness."""

from __future__ import annotations

import csv as text_csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chronopanel.functions.columns import first_present, to_number
from chronopanel.schema import CITIES, PUBLIC_HOURLY


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def parquet(spark: SparkSession, path, columns=None, dates=(), stamps=()) -> DataFrame:
    """Parquet scan; only the named columns are read. Dates and stamps get their types."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if columns:
        df = df.select(*columns)
    casts = {c: F.to_date(c) for c in dates}
    casts.update({c: F.col(c).cast("timestamp_ntz") for c in stamps})
    return df.withColumns(casts) if casts else df


def with_fallback(spark: SparkSession, primary: str, fallback: str | None = None, dates=()) -> DataFrame:
    """The primary table, else the fallback, else an error naming both."""
    for p in (primary, fallback):
        if p and exists(spark, p):
            return parquet(spark, p, dates=dates)
    raise FileNotFoundError(f"neither {primary} nor {fallback}")


def csv(spark: SparkSession, path, schema) -> DataFrame:
    """Header CSV with a declared schema, columns matched by name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def csv_headers(spark: SparkSession, folder: str, pattern="*.csv") -> DataFrame:
    """(path, header) of every file below a folder: its first line that is not blank.

    Tasks read the lines; per file only the first one of its first block moves. Files named
    readme... and files without any text have no row.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("at"))
    usable = (F.col("at") == 0) & (F.trim("value") != "") & ~F.lower("name").startswith("readme")
    # rows of a file's first block are numbered in the order of its lines
    numbered = lines.where(usable).select("path", "value", F.monotonically_increasing_id().alias("line"))
    return numbered.groupBy("path").agg(F.min_by("value", "line").alias("header"))


def header_names(line: str) -> list[str]:
    """Column names of a header line, trimmed and lower-cased; blank ones and repeats get their place."""
    out: list[str] = []
    for k, cell in enumerate(next(text_csv.reader([line.lstrip("\ufeff")]), [])):
        name = cell.strip().lower() or f"_c{k}"
        out.append(name if name not in out else f"{name}_{k}")
    return out


def csv_archive(spark: SparkSession, folder: str, pattern="*.csv") -> DataFrame:
    """Every CSV below a folder as one table, whatever mix of headers its files have.

    Files are grouped by their header: names trimmed and lower-cased, in their order. Each
    group is one scan with its own columns; the scans are united by name, with null where a
    file lacks a column. Values stay text. Of a file, lines with another number of fields
    than its header are dropped; blank and readme files are left out. The driver holds one
    path and header per file, as Spark's own file listing does. A folder without any file
    gives a table without columns.
    """
    groups: dict[tuple, list[str]] = {}
    for r in csv_headers(spark, folder, pattern).toLocalIterator():
        groups.setdefault(tuple(header_names(r["header"])), []).append(_literal_path(r["path"]))
    scans = []
    for names, paths in sorted(groups.items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        # without column pruning every line is parsed whole, so a wrong field count is seen
        options = {"header": True, "mode": "DROPMALFORMED", "columnPruning": False, "ignoreLeadingWhiteSpace": False}
        scans.append(spark.read.schema(schema).options(**options).csv(sorted(paths)))
    if not scans:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _literal_path(uri: str) -> str:
    """The path of a file's address: no escapes, and no sign that a reader takes for a pattern."""
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", unquote(uri))


def normalise_header(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.strip().lower() for c in df.columns})


def points(raw: DataFrame) -> DataFrame:
    """Detections with one brightness: the first known of the sensors' columns.

    Rows without a usable date or position are dropped.
    """
    names = [c for c in ("brightness", "bright_ti4", "bright_t31") if c in raw.columns]
    bright = F.coalesce(*[to_number(F.col(c)) for c in names]) if names else F.lit(None).cast("double")
    out = raw.select(
        first_present(raw, ["acq_date"]).cast("string").try_cast("date").alias("acq_date"),
        to_number(first_present(raw, ["latitude"])).alias("latitude"),
        to_number(first_present(raw, ["longitude"])).alias("longitude"),
        bright.alias("brightness"),
        to_number(first_present(raw, ["frp"])).alias("frp"),
        first_present(raw, ["confidence"]).cast("string").alias("confidence"),
    )
    return out.dropna(subset=["acq_date", "latitude", "longitude"])


def json_records(spark: SparkSession, path, schema=PUBLIC_HOURLY, lines=True) -> DataFrame:
    """JSON lines, or a file holding one array of records with lines=False."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def union_entities(spark: SparkSession, paths) -> DataFrame:
    """One file or folder per entity as one table."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def freshness(df: DataFrame, now, start, ts="Timestamp", entity="City", max_age_hours=24) -> DataFrame:
    """Per entity: first and last time, rows, file age, and whether the cache still serves.

    Complete means the first time is at most a day after `start` and the last at least
    the day before `now`. The age comes from the newest file behind the rows.
    """
    has_files = F.max("_metadata.file_modification_time")
    stats = df.groupBy(entity).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("rows"), has_files.alias("written")
    )
    day = F.expr("interval 1 day")
    late = F.col("first") > F.lit(start).cast("timestamp_ntz") + day
    stale = F.col("last") < F.lit(now).cast("timestamp_ntz") - day
    old = F.col("written") < F.lit(now).cast("timestamp") - F.expr(f"interval {max_age_hours} hour")
    reason = F.when(old, "expired").when(late, "starts late").when(stale, "ends early").otherwise("ok")
    return stats.withColumn("reason", reason).withColumn("valid", (F.col("reason") == "ok").cast("int")).drop("written")


def coordinates(spark: SparkSession, cities=None) -> DataFrame:
    """City, Latitude, Longitude."""
    rows = [(c, *xy) for c, xy in (cities or CITIES).items()]
    return spark.createDataFrame(rows, "City string, Latitude double, Longitude double")
