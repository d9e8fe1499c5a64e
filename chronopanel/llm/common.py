"""Helpers shared by the operators: fixed input columns, lineage cuts, byte classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronopanel.session import scratch, stage

__all__ = ["columns", "utf8", "ascii_lower", "SPACE", "scratch", "stage", "identical_once", "row_hash", "table", "small_batches"]

#: Fixed value: the white space that the operators' contracts name, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows in a batch of whole texts that a Python worker is given at once.
BATCH = 2_500


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches have at most BATCH rows.

    Texts are read whole, so the rows of a batch decide how much of them a worker holds.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return df


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Whatever else the table holds, clashing names included, stays outside the operator.
    """
    return df.select(*[df[f"`{c}`"].alias(name) for name, c in names.items()])


def utf8(text: Column) -> Column:
    """The bytes of a text; null is empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def identical_once(docs: DataFrame, keep: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that `keep` names by (doc_id, row_hash), one for each name.

    Rows alike in id and hash are copies of one row; the aggregation collapses them in
    the partition that the join has already made. Both go by the same plain columns: a
    null-safe comparison of ids, or structs that differ in what may be null, would give the
    join other keys than the aggregation, and every whole row would move a second time.
    """
    cols, keys = [f"`{c}`" for c in docs.columns], ["__hash", "__none", "__id"]

    def key(id, hash):
        return [c.alias(k) for c, k in zip((hash, id.isNull(), F.coalesce(id.cast("string"), F.lit(""))), keys)]

    named = docs.select(*cols, *key(docs[f"`{id}`"], row_hash(docs)))
    names = keep.select(*key(F.col("doc_id"), F.col("row_hash")))
    return named.join(names, keys, "left_semi").dropDuplicates(keys).select(*cols)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
