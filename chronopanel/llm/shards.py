"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from indivisible groups.

Equal texts form a group, which goes to one shard whole. A partial partition is a list of
shard loads; differencing takes the two with the largest spread (largest minus smallest
load) and adds them in opposite order, the largest load of one to the smallest of the
other, until one is left. Groups too many for one task are first bundled: blocks of groups
are differenced by tasks of their own, and each block's subsets become the items of the
next level. Single items heavier than a small share of a shard skip the bundling, so the
last differencing can put light bundles against them. Every level has bounded blocks and
the last one at most `last` items, whatever the input. Rows are numbered inside their shard
in chunks, whose sizes are then summed up.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from chronopanel.llm.common import columns, stage, utf8

LAW = "bytes"


def differencing(loads: list[int], shards: int) -> list[int]:
    """The shard of each item; items are taken by load, ties in their order."""
    heap: list[tuple[int, int, list[int], list]] = []
    for i, load in enumerate(loads):
        # members are pairs of pairs down to single items; they are walked once at the end
        heap.append((-load, i, [0] * (shards - 1) + [load], [None] * (shards - 1) + [(i,)]))
    heapq.heapify(heap)
    number = len(loads)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        mixed = sorted(((x + y, k) for k, (x, y) in enumerate(zip(a, reversed(b)))))
        sums = [s for s, _ in mixed]
        held = []
        for _, k in mixed:
            x, y = of_a[k], of_b[shards - 1 - k]
            held.append(y if x is None else x if y is None else (x, y))
        heapq.heappush(heap, (sums[0] - sums[-1], number, sums, held))
        number += 1
    out = [0] * len(loads)
    for shard, tree in enumerate(heap[0][3] if heap else []):
        walk = [tree] if tree is not None else []
        while walk:
            node = walk.pop()
            if len(node) == 1:
                out[node[0]] = shard
            else:
                walk.extend(node)
    return out


def _spread(items: DataFrame, shards: int, name: str) -> DataFrame:
    """(item, block, `name`) of the items (item, load, block), each block differenced by itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["load", "item"], ascending=[False, True])
        return pdf[["item", "block"]].assign(**{name: differencing([int(x) for x in pdf["load"]], shards)})

    return items.groupBy("block").applyInPandas(run, f"item string, block long, {name} int")


def assign(groups: DataFrame, shards: int = 16, last: int = 1 << 15, most: int = 1 << 16) -> DataFrame:
    """(item, shard) for every (item, load)."""
    now = stage(groups.select("item", F.col("load").cast("decimal(38,0)").alias("load")), "loads")
    bundled = None  # item -> the bundle that stands for it now
    level = 0
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.coalesce(F.sum("load"), F.lit(0))).first()
        if n > 2 * last:
            # at most 64 * shards items are this heavy
            heavy = F.col("load") > F.lit(total) / (64 * shards)
            light = now.where(~heavy).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(last // shards, -(-n // most)))))
            subsets = stage(_spread(light, shards, "part"), "subsets")
            named = subsets.select("item", F.concat_ws("/", F.lit(f"bundle-{level}"), "block", "part").alias("bundle"))
            loads = now.where(~heavy).join(named, "item").groupBy(F.col("bundle").alias("item")).agg(F.sum("load").cast("decimal(38,0)").alias("load"))
            now = stage(now.where(heavy).unionByName(loads), "loads")
            if bundled is None:
                bundled = groups.select("item").join(named, "item", "left").select("item", F.coalesce("bundle", "item").alias("as"))
            else:
                up = named.withColumnRenamed("item", "as")
                bundled = bundled.join(up, "as", "left").select("item", F.coalesce("bundle", "as").alias("as"))
            level += 1
            continue
        final = _spread(now.withColumn("block", F.lit(0).cast("long")), shards, "shard").select("item", "shard")
        if bundled is None:
            return final
        # the last differencing has at most 2 * last items
        return bundled.join(F.broadcast(stage(final, "shards").withColumnRenamed("item", "as")), "as").select("item", "shard")


def shard(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", chunks: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size is the text's UTF-8 bytes plus one; a null text counts as empty and belongs to the
    group of empty texts. The law is `bytes`: shard sizes as nearly equal as whole groups
    allow, so a group larger than an even share has a shard almost for itself. Slots count
    each shard's rows from 0 without gaps; repeated rows take slots of their own. An empty
    table gives an empty table; other columns play no part. grown_shard is null.
    """
    rows = columns(docs, doc_id=id, text=text).select("doc_id", utf8(F.col("text")).alias("data"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(
        "doc_id",
        "row",
        (F.octet_length("data") + 1).cast("long").alias("size"),
        F.crc32("data").alias("text_crc32"),
        F.sha2("data", 256).alias("item"),
        # the numbering's chunks follow the rows, so a hot group spreads over all of its shard's
        F.pmod(F.col("row"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    rows = stage(rows, "sizes")
    placed = stage(assign(rows.groupBy("item").agg(F.sum("size").alias("load")), shards), "groups")
    rows = rows.join(placed, "item").drop("item")
    rows = stage(rows, "placed")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    # shards times chunks rows
    return rows.withColumn("place", place).join(F.broadcast(starts), ["shard", "chunk"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
