"""Exact dedup by a tree merge of sorted digest runs.

Every row becomes a digest: SHA-256 of the normalised text, with a 64-bit check and the
length beside it. The rows of each partition are dealt to `runs` runs. The first
aggregation sorts every run by digest and leaves one entry for each digest. Then rounds
follow: in each, `fan` neighbouring runs meet, are merged in digest order, and an entry
stays for every digest whose check and length agree, with the smallest identifier and the
number of rows so far. After log_fan(runs) rounds one run is left. The way back down joins
by (run, digest), so a digest that a third of all rows share is spread over `runs` keys.
Texts never move: only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronopanel.llm.common import SPACE, columns, row_hash, stage, utf8

KEY = ["check", "sha", "length"]


def facts(docs: DataFrame, id: str = "doc_id", text: str = "text", runs: int = 64) -> DataFrame:
    """One light row per document: identifiers, digest, run."""
    rows = columns(docs.withColumn("__row_hash", row_hash(docs)), doc_id=id, text=text, row_hash="__row_hash")
    plain = utf8(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    row = F.monotonically_increasing_id()
    return (
        rows.select("doc_id", "row_hash", plain.alias("plain"), row.alias("row"))
        .select(
            "doc_id",
            "row_hash",
            "row",
            F.xxhash64("plain").alias("check"),
            F.unhex(F.sha2("plain", 256)).alias("sha"),
            F.octet_length("plain").cast("long").alias("length"),
            # rows are dealt in turn, so copies that lie together spread as well
            F.pmod(F.col("row"), F.lit(runs)).cast("int").alias("run"),
        )
    )


def sorted_runs(rows: DataFrame) -> DataFrame:
    """One entry for each digest of a run, in digest order."""
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "row")
    return rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))


def merge(entries: DataFrame, fan: int) -> DataFrame:
    """One round: `fan` neighbouring runs become one."""
    to = F.floor(F.col("run") / fan).cast("int")
    return entries.groupBy(to.alias("run"), *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", runs: int = 64, fan: int = 4) -> DataFrame:
    """Each document with the one that stays for its text.

    Texts are equal when identical after every run of white space (space, tab to carriage
    return) is replaced by one space; nothing is trimmed. Null counts as empty. The row with
    the smallest id stays; null ids come last. Of several rows with that id exactly one
    stays: the one with the smaller hash over all columns, of identical rows the first one
    read. An empty table gives an empty table. Other columns of the input play no part
    but in that hash.

    Returns doc_id, keep_id, group_size, kept, text_sha256, row_hash.
    """
    rows = stage(facts(docs, id, text, runs), "digests")
    leaves = sorted_runs(rows)
    top, left = leaves, runs
    while left > 1:
        top, left = merge(top, fan), -(-left // fan)
    copied = top.where("n > 1").select(*KEY, F.col("best").alias("keep"), F.col("n").alias("size"))
    down = leaves.select("run", *KEY).join(copied, KEY)
    return rows.join(down, ["run", *KEY], "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row_hash",
    )
