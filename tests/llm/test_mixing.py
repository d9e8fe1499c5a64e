"""The mix against a plain loop; null, empty, hot and repeated rows."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from chronopanel.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, target int, of string, hash long"


def made(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1, "y", 2) for i, s, t in rows], SCHEMA)


def expected(rows):
    """Sorted (doc_id, size, source_size, target, taken)."""
    of = defaultdict(list)
    for i, s, t in rows:
        of[s].append((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for _, n in of[s]) for s in names}
    target, free, left = {}, set(names), sum(size.values())
    while free:
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * size[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in above}
        left -= sum(3 * size[s] for s in above)
        free -= above
    out = []
    for s in names:
        times = math.floor(target[s] / size[s]) if size[s] else 0
        budget, before = target[s] - times * size[s], 0
        key = "" if s is None else "=" + s
        name = lambda d: f"{'' if d[0] is None else d[0]}|{key}|{d[1]}"
        for i, n in sorted(of[s], key=lambda d: int(hashlib.md5(name(d).encode()).hexdigest()[:14], 16) // 4):
            more = budget > 0 and n <= 2 * (budget - before)
            out.append((i, n, size[s], round(target[s], 6), n * (times + more)))
            before += n
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()), key=str)


def text(n):
    return "wé \t\n" * n


def test_against_a_plain_loop(spark):
    rows = [(k, f"s{k % 7}", text(k * 37 % 50)) for k in range(400)]
    # a source with a third of all rows, one far under its share, letters beyond ASCII, null
    rows += [(1000 + k, "hot", text(k % 9)) for k in range(250)] + [(2000, "a", text(2)), (2001, "ü", text(30)), (2002, "Z", "one")]
    rows += [(3000 + k, None, text(k)) for k in range(20)] + [(4000, "empty", None), (4001, "empty", " \n ")]
    df = made(spark, rows)
    assert got(df) == expected(rows) == got(df.repartition(13))
    taken, target, size = defaultdict(int), {}, {i: n for i, n, *_ in expected(rows)}
    for r in mixing.mix(df).collect():
        key = next(s for i, s, _ in rows if i == r.doc_id)
        taken[key] += r.taken
        target[key] = r.target
        assert r.taken <= 3 * size[r.doc_id]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - t) <= 25 for s, t in target.items())


def test_copies_of_one_row(spark):
    rows = [(1, "a", text(3))] * 300 + [(None, "b", text(4))] * 200 + [(2, "b", text(5)), (2, "b", text(6))]
    assert got(made(spark, rows)) == expected(rows)


def test_one_source_and_none(spark):
    rows = [(k, "only", text(2)) for k in range(5)]
    assert [r[4] for r in got(made(spark, rows))] == [2] * 5
    assert got(made(spark, [])) == [] and got(made(spark, [(1, "a", None)])) == [(1, 0, 0, 0.0, 0)]


def test_large_tables_of_sources_are_joined_by_salts(spark, monkeypatch):
    rows = [(k, f"s{k % 11}", text(k % 13)) for k in range(300)]
    monkeypatch.setattr(mixing, "is_small", lambda df: False)
    assert got(made(spark, rows)) == expected(rows)


def test_budgets_are_nested(spark):
    rows = mixing.stage(mixing.sized(made(spark, [(k, "s", text(k % 17)) for k in range(500)])), "sizes")
    before = -1
    for budget in (0.5, 40.0, 41.0, 900.0, 3000.0):
        edge = mixing.edges(rows, spark.createDataFrame([("=s", budget)], "of string, budget double")).first()
        place = (edge.edge_hash, edge.edge_row, edge["last"])
        assert before == -1 or place >= before
        before = place
