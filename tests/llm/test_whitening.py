"""Operator 12 against numpy's eigenvalues and exact integers."""

from __future__ import annotations

import numpy as np
import pytest

from emporia.llm import whitening


def spread(d, n=400, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ (rng.normal(size=(d, d)) * np.linspace(2, 0.05, d)) * 0.2


def brute(rows, k=32):
    x = np.floor(64 * np.array(rows, float)).astype(int) + 1000000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, y @ p / np.sqrt(e), e / np.trace(v)


def test_leading_equals_eigh():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 40, 90):
        a = np.cov(rng.normal(size=(d, 3 * d + 2)) * np.linspace(1, 3, d)[:, None]).reshape(d, d)
        values, vectors = whitening.leading(a, 32)
        e, p = np.linalg.eigh(a)
        k = min(32, d)
        assert np.allclose(values, e[::-1][:k], rtol=1e-12) and np.allclose(np.abs((vectors * p[:, ::-1][:, :k]).sum(0)), 1, atol=1e-11)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1], [3, 3 - 1e-9, 3 - 2e-9, 1, 1e-3, 0], [1, 0, 0, 0, 0, 0], [7] * 6, [4, 4, 1e-20, 0, 0, 0],
                                    [1e12, 1e12 - 1, 5, 1e-3, 0, 0]])
def test_equal_and_near_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(6, 6)))
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a)
    kept = [v for v in values if v > 1e-10 * values[0]]
    assert len(got) >= len([v for v in kept if v > 1e-9 * values[0]]) and np.allclose(got, values[: len(got)], atol=1e-14 * values[0] * 20)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-9
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * values[0]
    assert (np.diff(got) <= 0).all()


def test_diagonal_and_split_matrices():
    for a in (np.diag([3.0, 1.0, 2.0]), np.zeros((4, 4)), np.kron(np.eye(3), np.array([[2.0, 1.0], [1.0, 2.0]]))):
        values, vectors = whitening.leading(a)
        e = np.linalg.eigvalsh(a)[::-1]
        assert np.allclose(values, e[e > 0]) and np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-13


def test_counts_are_inertia():
    a = np.cov(np.random.default_rng(2).normal(size=(20, 50)))
    shifts = np.linspace(-1, 6, 300)
    e = np.linalg.eigvalsh(a)
    assert whitening.above(*whitening.tridiagonal(a), shifts).tolist() == [(e > s).sum() for s in shifts]


def test_whitening_equals_brute_force(spark):
    rows = spread(40).tolist()
    odd = [None, [None] + [0.0] * 39, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [1e300] * 40, []]
    data = [(i, v, "x", 1.0) for i, v in enumerate(rows + odd)] + [(7, rows[7], "y", 2.0), (None, rows[3], "z", 3.0)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, n string, d double")
    n, deviation, w, explained = brute(rows + [rows[7], rows[3]])
    got = whitening.components_of(df).collect()
    assert len(got) == 32 * (len(rows) + 2)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = np.array([np.sign(by_id[0][c + 1][0].whitened * w[0, c]) for c in range(32)])
    for i in (0, 5, 7, 399, None):
        at = len(rows) + 1 if i is None else i
        assert len(by_id[i][1]) == (2 if i == 7 else 1)
        for c in range(32):
            r = by_id[i][c + 1][0]
            assert abs(r.whitened - signs[c] * w[at, c]) < 1e-9 and abs(r.explained / explained[c] - 1) < 1e-10
            assert r.n == n and r.deviation == deviation[at] and 0 < r.identity_error < 1e-10
    assert len({r.identity_error for r in got}) == 1


def test_lengths_flat_and_empty(spark):
    few = spread(3, 20).tolist()
    data = [(i, v) for i, v in enumerate(few)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0])] + [(200 + i, [float(i), 5.0, 5.0, 5.0]) for i in range(4)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = whitening.components_of(df).collect()
    assert sorted({(r.vec_id, r.component) for r in got}) == sorted([(i, c) for i in range(20) for c in (1, 2, 3)] + [(200 + i, 1) for i in range(4)])
    assert all(r.n == (20 if r.vec_id < 100 else 4) for r in got)
    assert whitening.components_of(df.limit(0)).count() == 0
    kept = whitening.whiten(df.withColumn("whitened", df["vec_id"]), whitening.fit(whitening.usable(df)))
    assert kept.count() == len(data) and kept.where("size(whitened) = 0").count() == 2


def test_exact_beyond_64_bits():
    x = np.array([[2**50, 3], [-2**50, 4]], np.int64)
    sums = [0, 7]
    y = whitening.centred(x, 2**20, sums)
    assert y[0, 0] == 2**70 and whitening.squares(y)[1] == 2**140 + (4 * 2**20 - 7) ** 2
