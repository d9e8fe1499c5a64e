"""Ranked search against scoring every document; bounds, ties, null and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from chronopanel.llm import ranking

DOC = "doc_id long, text string, place long, n string, score string, item_id string"
ITEM = "item_id long, text string, doc_id long, place int, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "a", "b", "c") for i, t in docs], DOC)
    return d, spark.createDataFrame([(i, t, 9, 8, 7) for i, t in items], ITEM)


def expected(docs, items):
    words = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    n = sum(bool(c) for _, c in words)
    total = sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, t in items:
        q, found = Counter(TERM.findall((t or "").translate(LOW))), []
        for i, c in words:
            if not c:
                continue
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in q.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(int(rng.pareto(0.7) * 3), 400)}"
    docs = [(k, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for k in range(n)]
    items = [(k, " ".join(word() for _ in range(int(rng.integers(1, 25))))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("shard", [3, 64, 10_000])
def test_against_scoring_everything(spark, shard):
    docs, items = corpus(5, 400)
    docs += [(5000 + k, docs[7][1]) for k in range(150)]  # a large group of copies, tied with each other
    d, b = tables(spark, docs, items)
    assert got(ranking.search(d.repartition(5), b, most_docs=shard)) == expected(docs, items)


def test_blocks_of_items(spark):
    docs, items = corpus(6, 120)
    d, b = tables(spark, docs, items)
    assert got(ranking.search(d, b, entries=40)) == expected(docs, items)


def test_odd_rows(spark):
    docs = [(1, "Alpha beta"), (1, "alpha, BETA!"), (None, "alpha beta"), (3, None), (4, ""), (5, "  ..  "), (6, "Älpha 世界 x"), (7, "alpha " * 400_000), (8, "z" * 3_000_000 + " beta")]
    items = [(1, "ALPHA alpha beta"), (None, "beta"), (2, None), (3, "..."), (4, "ÄLPHA älpha 世界 X"), (1, "z"), (5, "unheard of")]
    d, b = tables(spark, docs, items)
    assert got(ranking.search(d, b)) == expected(docs, items)
    assert got(ranking.search(d.limit(0), b)) == [] == got(ranking.search(d, b.limit(0)))
    assert ranking.search(d.limit(0), b).columns == ["item_id", "rank", "doc_id", "score"]


def test_text_ids(spark):
    docs = [(f"d{k}", f"w{k % 3} common") for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    b = spark.createDataFrame([("i", "w1 common")], "item_id string, text string")
    found = ranking.search(d, b).orderBy("rank").collect()
    assert [r.doc_id for r in found] == sorted(i for i, t in docs if "w1" in t)[:10]


def test_reading_stops_early():
    """Lists are read no further than bounds ask: the long tail of a common word stays unread."""
    w = np.array([1000, 1000])
    ids = np.r_[np.zeros(20, np.int64), np.ones(5000, np.int64)]
    tfs = np.r_[np.full(20, 50), np.ones(5000, np.int64)]
    doc = np.r_[np.arange(20), np.arange(5000)]
    order = np.argsort(doc, kind="stable")
    lists = ranking.inverted(np.full(5000, 60), 5000, 300_000, ids[order], tfs[order], np.bincount(doc), w)
    at, score = ranking.nra(lists, np.array([0, 1]), np.array([1, 1]), 10, 0)
    assert set(at) == set(range(20)) and len(set(score)) == 1
    assert len(ranking.nra(lists, np.array([0, 1]), np.array([1, 1]), 10, int(score[0]) + 1)[0]) == 0
