"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from regulith.llm import whitening

KIND = "vec_id long, embedding array<double>, label int, i int, cells string, n string, d int"


@pytest.fixture
def make(spark):
    def get(rows):
        return spark.createDataFrame([(i, v, 0, 1, "c", "n", 2) for i, v in rows], KIND).repartition(3)

    return get


def brute(vectors):
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, dev, y, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("d", [1, 5, 40])
def test_whitening_against_numpy(make, d):
    g = np.random.default_rng(d)
    rows = [(i, (g.normal(size=d) * np.logspace(2, -1, d) + 3).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1])]
    junk = [(300, None), (301, [math.nan] * d), (302, [*[1.0] * (d - 1), math.inf]), (303, [None, *[1.0] * (d - 1)]), (304, []), (305, [1.0] * (d + 1))]
    n, dev, y, e, v = brute([r[1] for r in rows])
    got = whitening.whiten(make(rows + junk)).collect()
    m = min(d, 32)
    assert len(got) == n * m and {r.vec_id for r in got} == {r[0] for r in rows} and {r.n for r in got} == {n}
    assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1
    want = y @ v[:, :m] / np.sqrt(e[:m])
    at = {r[0]: k for k, r in enumerate(rows)}
    table = np.zeros((n, m))
    for r in got:
        k = at[r.vec_id]
        table[k, r.component - 1] = r.whitened
        assert r.deviation == dev[k] and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9
    some = sorted(set(at.values()))
    sign = np.sign((table[some] * want[some]).sum(axis=0))
    assert np.abs(table[some] * sign - want[some]).max() < 1e-8


def test_dependent_dimensions_give_no_component(make):
    g = np.random.default_rng(1)
    base = np.floor(g.normal(size=(80, 3)) * 640) / 64
    rows = [(i, [*b, float(b[0]), float(b[0] + b[1]), 7.0, float(b[2] * 1e-1 + b[1])]) for i, b in enumerate(base.tolist())]
    n, _, y, e, _ = brute([r[1] for r in rows])
    found = whitening.fit(make(rows))
    assert len(found.values) == np.linalg.matrix_rank(y) and np.allclose(found.values, e[: len(found.values)], rtol=1e-10)
    assert whitening.whiten(make(rows)).first().identity_error < 1e-8


def test_tiny_directions_are_resolved(make):
    g = np.random.default_rng(2)
    rows = [(i, [float(a * 1e8), float(a * 1e8 + b)]) for i, (a, b) in enumerate(g.integers(-50, 50, (90, 2)).tolist())]
    _, _, y, _, _ = brute([r[1] for r in rows])
    s = np.linalg.svd(y, compute_uv=False)
    assert np.allclose(np.sqrt(whitening.fit(make(rows)).values * 90), s, rtol=1e-6)


def test_empty_equal_and_single(make):
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [math.nan])])).count() == 0


def test_deviation_beyond_64_bits(make):
    got = {r.vec_id: r.deviation for r in whitening.whiten(make([(1, [1e9]), (2, [0.0]), (3, [0.0])])).collect()}
    want = [sum((3 * x - (64 * 10**9 + 3 * 10**6)) ** 2 for x in (v,)) for v in (64 * 10**9 + 10**6, 10**6, 10**6)]
    assert got == {k + 1: w if w < 1 << 63 else None for k, w in enumerate(want)}


def test_solve():
    g = np.random.default_rng(0)
    r = np.triu(g.normal(size=(6, 6))) + 3 * np.eye(6)
    y = g.normal(size=(4, 6))
    assert np.allclose(whitening.solve(y, r) @ r, y)
