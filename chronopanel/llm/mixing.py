"""Mixing sources to target weights by hash thresholds.

A source is taken whole as often as its budget allows; of the last, broken round the
documents under a hash threshold are taken. The threshold is found without sorting: sizes
are summed by source and hash bucket, the bucket in which a source's budget ends is
refined by the next bits of the hash, and so on until that bucket holds one document. Only
the documents of those boundary buckets are read again, about one in 512 of the round
before. Thresholds are nested: a larger budget keeps all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chronopanel.llm.common import columns, stage
from chronopanel.operators.joins import is_small, salted
from chronopanel.operators.scan import row_rank

#: What is no white space, white space.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; how often a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits by which a bucket is refined; bits of the two keys that order a source's documents.
BITS, HASH, ROW = 9, 54, 63


def sized(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, its key, size in words, and two ordering keys: a hash, the place of the row.

    The hash covers id, source and size. Documents alike in all three are interchangeable in
    a mix; the place only tells them apart.
    """
    rows = columns(docs, doc_id=id, source=source, text=text)
    # every word becomes one character, then the gaps go: no list of words is made
    words = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), WORD, "x"), GAP, ""))
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = rows.select("doc_id", "source", key.alias("of"), words.cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "of", F.lit("|"), F.col("size").cast("string"))
    hashed = F.conv(F.substring(F.md5(name.cast("binary")), 1, 14), 16, 10).cast("long")
    return rows.withColumn("hash", F.shiftright(hashed, 56 - HASH))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """of, source_size, target of every (source, of, source_size).

    Weights go to the sources by code point, null last. Targets share the total of all sizes
    by weight and stop at `most` times the source's size; the excess is shared again by
    weight among the others until none is above. Each such round is one aggregation.
    """
    # ranges of sources, written once, are the blocks in which they are numbered
    ranged = sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("block", F.spark_partition_id())
    ranked = row_rank(stage(ranged, "sources"), [], "block", [F.col("source").isNull(), "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = stage(ranked.select("of", "source_size", weight.cast("long").alias("weight")), "weights")
    cap = F.col("source_size") * most
    total, all_weights = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, shared = total, all_weights
    while shared:
        above = F.col("weight").cast("decimal(38,0)") * left > cap.cast("decimal(38,0)") * shared
        stopped = known.where(above).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - stopped[0], all_weights - stopped[1]) == (left, shared):
            break
        left, shared = total - stopped[0], all_weights - stopped[1]
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(shared)) if shared else cap.cast("double")
    return known.select("of", "source_size", F.least(share, cap.cast("double")).alias("target"))


def _by_source(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join rows with a table of sources; a table too large to send spreads each source over salts."""
    return rows.join(F.broadcast(table), on, how) if is_small(table) else salted(rows, table, on, how)


def edges(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """of, edge_hash, edge_row, last for every (of, budget): a source takes what lies before the
    edge, and the document at the edge where `last` holds, which brings it nearer to its budget.
    """
    now = rows.where("size > 0").select("of", "size", "hash", "row")
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    need = budgets.where("budget > 0").withColumn("base", F.lit(0).cast("long"))
    levels = [("hash", at) for at in range(HASH - BITS, -1, -BITS)] + [("row", at) for at in range(ROW - BITS, -1, -BITS)]
    for key, at in levels:
        # at most 512 buckets a source
        bucketed = now.withColumn("bucket", F.shiftright(key, at).bitwiseAND(F.lit((1 << BITS) - 1)))
        sums = bucketed.groupBy("of", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        sums = sums.withColumn("lower", F.coalesce(F.sum("words").over(before), F.lit(0))).join(need, "of")
        lower = F.col("base") + F.col("lower")
        ends = (lower <= F.col("budget")) & (lower + F.col("words") > F.col("budget"))
        found = stage(sums.where(ends).select("of", "budget", lower.alias("base"), "bucket", "docs"), "edges")
        now = stage(_by_source(bucketed, found.select("of", "bucket"), ["of", "bucket"], "left_semi").drop("bucket"), "boundary")
        need = found.select("of", "budget", "base")
        if (found.agg(F.max("docs")).first()[0] or 1) == 1:
            break
    last = F.col("size") <= 2 * (F.col("budget") - F.col("base"))
    return now.join(need, "of").select("of", F.col("hash").alias("edge_hash"), F.col("row").alias("edge_row"), last.alias("last"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Every document with its size and the words that the mix takes of it.

    Size is the number of words; null and empty texts have none and are taken with 0 words.
    A source's documents are all taken equally often, but for those before its edge, once
    more; so a document is taken whole, at most `most` times, and a source misses its target
    by half a document at most. The order within a source is a hash of id, source and size:
    reruns agree, and of rows alike in these three (null ids included) as many are taken,
    whichever they are. A null source is a source. A source without words has target 0. An
    empty table gives an empty table; other columns play no part.

    Returns doc_id, size, source_size, target, taken.
    """
    rows = stage(sized(docs, id, source, text), "sizes")
    sizes = rows.groupBy("of", "source").agg(F.sum("size").alias("source_size"))
    aims = stage(targets(sizes, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("times", whole).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    plan = aims.join(edges(rows, aims.select("of", "budget")), "of", "left").drop("budget")
    hash_, row = F.col("hash"), F.col("row")
    here = (hash_ == F.col("edge_hash")) & ((row < F.col("edge_row")) | ((row == F.col("edge_row")) & F.col("last")))
    more = F.coalesce((hash_ < F.col("edge_hash")) | here, F.lit(False)).cast("long")
    return _by_source(rows, stage(plan, "plan"), ["of"], "inner").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + more)).cast("long").alias("taken")
    )


#: The same in DuckDB's SQL.
SQL = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS of,
    length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || of || '|' || CAST(size AS VARCHAR)), 1, 14) AS BIGINT) // 4 AS hash FROM sized),
sources AS (
  SELECT of, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight
  FROM keyed GROUP BY of, source),
shares AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER poorer, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER poorer, 0) AS weights
  FROM sources WINDOW poorer AS (ORDER BY {MOST} * source_size / weight, of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, weight * rest > {MOST} * source_size * weights AS above FROM shares),
level AS (
  SELECT sum(source_size) - coalesce(sum({MOST} * source_size) FILTER (above), 0) AS left_, sum(weight) - coalesce(sum(weight) FILTER (above), 0) AS others FROM capped),
aims AS (
  SELECT of, source_size, CASE WHEN others > 0 THEN least(weight * CAST(left_ AS DOUBLE) / CAST(others AS DOUBLE), CAST({MOST} * source_size AS DOUBLE)) ELSE {MOST} * source_size END AS target
  FROM capped CROSS JOIN level),
rounds AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM aims),
placed AS (
  SELECT doc_id, size, source_size, target, times, target - times * source_size AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY keyed.of ORDER BY hash, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lower
  FROM keyed JOIN rounds USING (of))
SELECT doc_id, size, source_size, target, CAST(size * (times + CAST(budget > 0 AND size <= 2 * (budget - lower) AS BIGINT)) AS BIGINT) AS taken FROM placed
"""
