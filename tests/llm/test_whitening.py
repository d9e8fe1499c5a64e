"""Whitening against numpy's own decomposition, and the small cases."""

import math

import numpy as np
import pytest
from chronopanel.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x long, n int, component string"


def made(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 5, 6, "c") for i, v in rows], schema)


def expected(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    c = distinct - total / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(k, int((value > 1e-12 * value[0]).sum()))
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


def check(got, ids, vectors):
    n, deviation, white, explained = expected(vectors)
    place = {i: k for k, i in enumerate(ids)}
    table = np.zeros(white.shape)
    assert len(got) == white.size
    for r in got:
        k = place[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[k]) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-8)
        table[k, r.component - 1] = r.whitened
    sign = np.sign((table * white).sum(axis=0))
    np.testing.assert_allclose(table, white * sign, atol=1e-7)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 60])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    turned, _ = np.linalg.qr(rng.normal(size=(n, n)))
    spread, equal = rng.normal(size=(n, n)), np.r_[np.full(n // 2, 5.0), np.linspace(1, 1.0001, n - n // 2)]
    for a in (spread @ spread.T, np.diag(rng.integers(0, 5, n) + 0.5), np.eye(n), turned @ np.diag(equal) @ turned.T, spread[:, :2] @ spread[:, :2].T):
        a = (a + a.T) / 2
        value, x = whitening.principal(a, 16)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
        want = want[want > 1e-12 * want[0]]
        np.testing.assert_allclose(value.astype(float), want, rtol=1e-10)
        assert np.abs(x.T @ x - np.eye(len(value))).max() < 1e-15
        assert np.abs(a @ x - x * value).max() < 1e-13 * np.abs(a).max()


def test_against_numpy(spark, sf):
    from chronopanel.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(QUERIES["op11_whitening"](spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_copies_count_once_and_unusable_rows_go(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 5)).astype(np.float32).round(3).tolist()
    hot = [(100 + k, base[0]) for k in range(60)]  # more than half of the rows
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan] * 5), (903, [math.inf] + [0.0] * 4), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(made(spark, [*enumerate(base), *hot, *bad])).collect()
    check(got, [*range(40), *range(100, 160)], base + [base[0]] * 60)


def test_null_and_repeated_ids(spark):
    got = whitening.whiten(made(spark, [(None, [0.0, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [-1.0, 0.25])])).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["None", "7", "7", "8"] * 2) and {r.n for r in got} == {3}


def test_rank_below_dimension(spark):
    # the third entry is constant, the second follows the first
    got = whitening.whiten(made(spark, [(k, [float(k), 2.0 * k, 3.0]) for k in range(6)])).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(50, 4)) + 4096).astype(np.float32).tolist()
    check(whitening.whiten(made(spark, enumerate(base))).collect(), range(50), base)


def test_huge_entries(spark):
    base = [[1e12 * k * k, 5.0 * k] for k in range(9)]
    got = whitening.whiten(made(spark, enumerate(base), SCHEMA.replace("float", "double"))).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in base]
    total = [sum(c) for c in zip(*x)]
    exact = [sum((9 * c - s) ** 2 for c, s in zip(v, total)) for v in x]
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in got)
    assert max(exact) >= 1 << 63 and whitening.whiten(made(spark, [(1, [1e17]), (2, [0.0])], SCHEMA.replace("float", "double"))).count() == 0


def test_no_variance_and_empty(spark):
    assert whitening.whiten(made(spark, [])).count() == 0
    assert whitening.whiten(made(spark, [(1, []), (2, None)])).count() == 0
    same = whitening.whiten(made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert same.count() == 0 and same.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
