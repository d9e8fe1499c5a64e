"""Ranked lexical search with NRA over document shards.

Documents are reduced once to the counts of the words that items use; numbers of documents
and terms come from all rows. Then every task takes its documents in blocks of bounded
size, builds the block's inverted lists sorted by falling impact and runs NRA for each
item: all lists are read from the top, in rounds that halve the impact down to which they
go. A document's score lies between what was read of it and that plus the next impacts of
the lists in which it was not yet met. A document is given up when its upper bound falls
under the tenth best lower bound; when no document outside can reach that bound any more,
the lists are read on for the documents still held only. Reading ends when the bounds of
all of them meet, so members, ties and scores are final. The best of earlier blocks raise
the bound for later ones. A task returns at most ten documents an item, and the ten best
of these are the result: nothing but counts and such short lists moves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from chronopanel.llm.common import columns, stage

#: Bytes that are no part of a term (ASCII but digits and letters).
APART = bytes(c for c in range(128) if not chr(c).isalnum())
#: A-Z to a-z, what is apart to a space.
FOLD = bytes(32 if c in APART else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text split at a time; documents and postings in a block; entries of items sent at once.
PIECE, DOCS, POSTINGS, ENTRIES = 1 << 20, 1 << 15, 1 << 21, 1 << 22


def terms(data: bytes | None):
    """Lists of the terms of a text in UTF-8, from a bounded piece of it each."""
    data, at = data or b"", 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and FOLD[data[end]] != 32:
            end += 1
        yield data[at:end].translate(FOLD).split()
        at = end


def counted(data: bytes | None) -> dict[bytes, int]:
    """How often each term occurs in the whole text."""
    counts: dict[bytes, int] = {}
    for words in terms(data):
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    return counts


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column


@dataclass
class Queries:
    """A block of items: their places, and term numbers and repeats of each."""

    items: list[int]
    terms: list[tuple[np.ndarray, np.ndarray]]
    number: dict[bytes, int]


def blocks_of(benchmark: DataFrame, item: str, text: str, entries: int):
    """(rows of items with their place, blocks of them with about `entries` terms in all)."""
    rows = columns(benchmark, item_id=item, text=text)
    rows = stage(rows.select("item_id", "text", F.monotonically_increasing_id().alias("place")), "items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (4 * entries)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))

    def made():
        for part in range(parts):
            number: dict[bytes, int] = {}
            items, lists = [], []
            for r in dealt.where(F.col("part") == part).select("place", "text").toLocalIterator():
                counts = counted(None if r["text"] is None else r["text"].encode())
                ids = np.array([number.setdefault(t, len(number)) for t in counts], np.int64)
                order = np.argsort(ids)
                items.append(r["place"])
                lists.append((ids[order], np.fromiter(counts.values(), np.int64, len(ids))[order]))
            if number:
                yield Queries(items, lists, number)

    return rows, made()


def counts_of(docs: DataFrame, number: dict[bytes, int], id: str, text: str) -> DataFrame:
    """doc_id, place, terms in all, and numbers and counts of the items' terms, of every row."""
    rows = columns(docs, doc_id=id, text=text).select("doc_id", F.monotonically_increasing_id().alias("place"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        known = shared.value
        for b in batches:
            total, ids, tfs = [], [], []
            for t in _bytes(b.column(2)):
                n, found = 0, {}
                for words in terms(t.as_py()):
                    n += len(words)
                    for w in words:
                        k = known.get(w)
                        if k is not None:
                            found[k] = found.get(k, 0) + 1
                total.append(n)
                ids.append(np.fromiter(found, np.int32, len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), np.int64, len(found)).tobytes())
            made = [pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "place", "n", "ids", "tfs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, place long, n long, ids binary, tfs binary")


def weights(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and the weight of every numbered term."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["id", "df"])

    docs, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.zeros(size, np.int64)
    for r in counts.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        w[r["id"]] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1)))
    return docs, total, w


@dataclass
class Lists:
    """The inverted lists of a block of documents, each by falling impact (before repeats)."""

    first: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    size: int

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[term], self.first[term + 1])
        return self.docs[at], self.impacts[at]


def inverted(length: np.ndarray, m_docs: int, m_total: int, ids: np.ndarray, tfs: np.ndarray, held: np.ndarray, w: np.ndarray) -> Lists:
    """Lists of a block from its documents' lengths, numbered terms, counts and terms held."""
    doc = np.repeat(np.arange(len(length)), held)
    m = 100 - 75 + (75 * length * m_docs) // max(m_total, 1)
    impact = w[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
    keep = impact > 0
    doc, ids, impact = doc[keep], ids[keep], impact[keep]
    order = np.lexsort((doc, -impact, ids))
    first = np.searchsorted(ids[order], np.arange(len(w) + 1))
    return Lists(first, doc[order], impact[order], len(length))


def nra(lists: Lists, ids: np.ndarray, repeats: np.ndarray, top: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, final scores) that hold every one of the block's `top` best with a score of
    `bound` or more and above 0, documents tied with the last of them included."""
    found = [(*lists.of(t), r) for t, r in zip(ids.tolist(), repeats.tolist())]
    found = [(d, i * r) for d, i, r in found if len(d)]
    lower = np.zeros(lists.size, np.int64)
    if not found:
        return np.zeros(0, np.int64), lower[:0]
    met = np.zeros((len(found), lists.size), bool)
    ahead = np.array([i[0] for _, i in found])  # the next impact of every list
    read = [0] * len(found)
    held = None  # documents that can still be members; None while unread ones can
    step, least = int(ahead.max()), max(bound, 1)
    while True:
        step //= 2
        for k, (d, i) in enumerate(found):
            if ahead[k] < max(step, 1):
                continue
            to = len(i) - int(np.searchsorted(i[::-1], max(step, 1)))
            at, gain = d[read[k] : to], i[read[k] : to]
            if held is not None:
                own = held[at]
                at, gain = at[own], gain[own]
            lower[at] += gain
            met[k, at] = True
            read[k] = to
            ahead[k] = i[to] if to < len(i) else 0
        rest = int(ahead.sum())
        known = np.flatnonzero(lower) if held is None else np.flatnonzero(held)
        if len(known) >= top:
            least = max(least, int(np.partition(lower[known], len(known) - top)[len(known) - top]))
        if held is not None or rest < least:
            # unread documents are out; those met stay while their upper bound allows
            known = known[lower[known] + rest >= least]
            upper = lower[known] + ((~met[:, known]) * ahead[:, None]).sum(axis=0)
            known = known[upper >= least]
            held = np.zeros(lists.size, bool)
            held[known] = True
            if rest == 0 or not len(known) or (upper[upper >= least] == lower[known]).all():
                return known, lower[known]


def search(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10, entries: int = ENTRIES, most_docs: int = DOCS) -> DataFrame:
    """The `top` best documents of every item with score above 0: item_id, rank, doc_id, score.

    Ranks count from 1 without gaps, equal scores by ascending doc_id, null ids last. A term
    is a run of ASCII digits and letters and of all other characters beyond ASCII, A-Z
    lower-cased. Null texts have no terms, whole texts are read, in bounded pieces. Every row
    is a document and every row of `benchmark` an item: repeated rows, and ids that are null
    or repeated, are ranked each (among rows alike in score and id any order holds). An item
    without terms or hits has no rows, an empty table on either side gives none. Other
    columns play no part.

    Items are searched together; beyond about `entries` terms in all, in further passes.
    """
    items, blocks = blocks_of(benchmark, item, item_text, entries)
    kind = columns(docs, doc_id=id).schema["doc_id"].dataType.simpleString()
    found = None
    for q in blocks:
        counts = stage(counts_of(docs, q.number, id, text), "counts")
        m_docs, m_total, w = weights(counts, len(q.number))
        hits = _searched(counts, q, m_docs, m_total, w, top, most_docs, kind)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item long, doc_id {kind}, place long, score long")
    # a partition brings at most `top` rows an item; Spark cuts to `top` before it shuffles
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    named = items.select(F.col("place").alias("item"), "item_id")
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def _searched(counts: DataFrame, q: Queries, m_docs: int, m_total: int, w: np.ndarray, top: int, most_docs: int, kind: str) -> DataFrame:
    """item, doc_id, place, score: the best of every task, a few more where ids tie."""
    shared = counts.sparkSession.sparkContext.broadcast((q.items, q.terms, w))

    def blocks(batches):
        """Record batches cut to bounded numbers of documents and postings."""
        for b in batches:
            held = np.array([len(x) // 4 for x in b.column(3).to_pylist()], np.int64)
            ends = np.cumsum(held)
            lo = 0
            while lo < b.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, min(lo + most_docs, int(np.searchsorted(ends, before + POSTINGS, "right"))))
                yield b.slice(lo, hi - lo), held[lo:hi]
                lo = hi

    def run(batches):
        places, queries, w = shared.value
        best: list = [None] * len(places)  # (scores, null id, doc_id, place) of the best so far
        bound = np.zeros(len(places), np.int64)
        for b, held in blocks(batches):
            ids = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int32).astype(np.int64)
            tfs = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64)
            lists = inverted(b.column(2).to_numpy(), m_docs, m_total, ids, tfs, held, w)
            for k, (t, r) in enumerate(queries):
                at, score = nra(lists, t, r, top, int(bound[k]))
                if not len(at):
                    continue
                more = pa.table([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(score)], ["doc_id", "place", "score"])
                both = more if best[k] is None else pa.concat_tables([best[k], more])
                order = [("score", "descending"), ("doc_id", "ascending"), ("place", "ascending")]
                best[k] = both.take(pc.sort_indices(both, order, null_placement="at_end")[:top])
                if len(best[k]) == top:
                    bound[k] = best[k].column(2)[top - 1].as_py()
        for k, t in enumerate(best):
            if t is not None:
                for c in t.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(c.num_rows, places[k], np.int64)), *c.columns], ["item", "doc_id", "place", "score"])

    return counts.select("doc_id", "place", "n", "ids", "tfs").mapInArrow(run, f"item long, doc_id {kind}, place long, score long")


#: The same in DuckDB's SQL.
SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (
  SELECT item, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(words) > 0) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM t),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df CROSS JOIN s),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(words) * docs) // total AS m FROM t CROSS JOIN s WHERE len(words) > 0),
found AS (
  SELECT item, item_id, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM found WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
