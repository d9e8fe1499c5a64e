"""SimHash near-dedup with multi-index hashing.

Fingerprints of 64 bits are cut into `max_bits // 2 + 1` segments, so of two fingerprints
that differ in at most `max_bits` bits one segment differs in at most one. A table holds
each segment value; every fingerprint enumerates the Hamming ball of radius one around its
own segment values and fetches the table entries found there. A pair of values is found
from both sides, so only the numerically smaller neighbours are fetched. Whole fingerprints
are then compared. Members of one bucket are compared in square cells of at most about two
blocks, and a cell returns a spanning forest of its links instead of all pairs: a bucket of
any size costs rows in proportion to its members times its blocks and never meets in one
task.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chronopanel.llm.common import columns, row_hash, stage
from chronopanel.llm.components import components

#: Seed of the shingle hash, bits of a fingerprint.
SEED, BITS = 42, 64
#: Bytes of text split into words at a time; shingles counted at a time.
PIECE, COUNTED = 1 << 20, 1 << 14


def _words(data: bytes):
    """Lists of lower-cased words, from a bounded piece of the text each."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    ones, total, carried = np.zeros(BITS, np.int64), 0, []
    for words in _words(data or b""):
        words = carried + words
        for i in range(0, len(words) - shingle + 1, COUNTED):
            part = words[i : i + COUNTED + shingle - 1]
            grams = map(b" ".join, zip(*[part[k:] for k in range(shingle)]))
            h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), ">u8")
            ones += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
            total += len(h)
        carried = words[max(0, len(words) - shingle + 1) :]
    if not total and carried:
        return fingerprint_of_hashes([xxhash.xxh64_intdigest(b" ".join(carried), SEED)])
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint_of_hashes(hashes: list[int]) -> int:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS)
    return int.from_bytes(np.packbits(bits.sum(axis=0) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits) and row_hash of every row, repeated rows included."""
    rows = columns(docs.withColumn("__row_hash", row_hash(docs)), doc_id=id, row_hash="__row_hash", text=text)

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()) if pa.types.is_string(b.column(2).type) else b.column(2)
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "row_hash", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row_hash long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    n = max_bits // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _key(shift: int, width: int):
    c = F.shiftrightunsigned("fp", shift)
    return c if width == BITS else c.bitwiseAND(F.lit((1 << width) - 1))


def _forest(fp: np.ndarray, max_bits: int):
    """(root, member) for the links among the values of one cell."""
    left = np.arange(len(fp))
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            # a front larger than the rest is compared in slices, which bounds the matrix
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 512):
                near |= (np.bitwise_count(fp[front[i : i + 512], None] ^ fp[left][None, :]) <= max_bits).any(axis=0)
            front, left = left[near], left[~near]
            for k in front:
                yield fp[root], fp[k]


def links(nodes: DataFrame, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """Edges (a, b) that connect what fingerprints within `max_bits` bits connect.

    `nodes` has one column fp without repeats. An edge joins members of one component,
    directly linked or by way of others.
    """
    table = probes = None
    for k, (shift, width) in enumerate(_segments(max_bits)):
        own = nodes.select(F.lit(k).alias("seg"), _key(shift, width).alias("key"), "fp")
        flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(width)])
        ball = own.select("seg", "key", "fp", F.explode(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))).alias("at"))
        ball = ball.where("at < key").select("seg", F.col("at").alias("key"), "fp")
        table = own if table is None else table.unionByName(own)
        probes = ball if probes is None else probes.unionByName(ball)
    entries = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    fetched = stage(probes.join(entries.select("seg", "key"), ["seg", "key"], "left_semi"), "fetched")
    shared = entries.where("n > 1").select("seg", "key").unionByName(fetched.select("seg", "key")).distinct()
    members = stage(table.join(shared, ["seg", "key"], "left_semi").unionByName(fetched), "members")
    sizes = members.groupBy("seg", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp", "seg"), F.col("blocks")).cast("int")
    cells = (
        members.join(sizes, ["seg", "key"])
        .select("seg", "key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("seg", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    )
    cell = ["seg", "key", "i", "j"]

    def run(batches):
        kept, last = np.empty(0, np.uint64), None

        def emit(found):
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found) if found else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for t in batches:
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in range(4)])
            fp = t.column(4).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(fp)]
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                name = tuple(keys[:, lo])
                if name != last:
                    found += _forest(kept, max_bits)
                    kept, last = fp[lo:hi], name
                else:
                    kept = np.concatenate([kept, fp[lo:hi]])
            yield emit(found)
        yield emit(list(_forest(kept, max_bits)))

    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3, block: int = 1024
) -> DataFrame:
    """Every document with its fingerprint and the group of near copies it belongs to.

    A-Z are lower-cased, words are runs of other than white space (space, tab to carriage
    return), shingles are `shingle` words joined by a space, repeats included; fewer words
    make one shingle, none (null, empty or white text) give fingerprint zero, which links
    like any other. A bit is set if set in over half the XXH64 hashes; a tie clears it.
    Fingerprints link at `max_bits` or fewer differing bits. component_id is the smallest
    doc_id reachable; null ids count last, a group of null ids has a null one. Repeated
    rows each get a row. An empty table gives an empty table. Other columns play no part.

    Returns doc_id, fingerprint (16 hex digits), component_id, row_hash, component (a
    fingerprint that names the group).
    """
    rows = stage(fingerprints(docs, id, text, shingle), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes.select("fp"), max_bits, block))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.select("fp", "component").join(least, "component")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_hash", "component"
    )
