from __future__ import annotations

import math

import numpy as np
import pytest

from postmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def brute(rows):
    """Rows that count, whole-number vectors, and the eigenvalues and eigenvectors of their covariance."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in list(v) + [0.0] * (width - len(v))] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    _, s, vt = np.linalg.svd(centred)
    values, vectors = np.pad(s, (0, width - len(s))) ** 2 / n, vt.T
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [i for i, _ in good], deviation, centred, values, vectors


def check(spark, rows, components):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    ids, deviation, centred, values, vectors = brute(rows)
    assert len(got) == len(ids) * components
    want = {}
    for k in range(components):
        w = centred @ vectors[:, k] / math.sqrt(values[k])
        for i, d, x in zip(ids, deviation, w, strict=True):
            want.setdefault((i, k + 1, d), []).append(abs(x))
    for r in got:
        assert r["n"] == len(ids) and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
        assert any(math.isclose(abs(r["whitened"]), x, rel_tol=1e-6, abs_tol=1e-7) for x in want[r["vec_id"], r["component"], int(r["deviation"])])
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r["whitened"])
    for k, w in by_component.items():
        assert math.isclose(sum(x * x for x in w) / len(ids), 1, rel_tol=1e-9), k


@pytest.fixture
def rows():
    g = np.random.default_rng(5)
    m = g.normal(size=(300, 12)) * np.linspace(4, 0.5, 12)
    return [(n, [float(x) for x in v], "x", "y") for n, v in enumerate(m)]


def test_against_eigenvectors(spark, rows):
    odd = [(None, rows[0][1], "x", "y"), (900, None, "x", "y"), (901, [1.0, None], "x", "y"), (902, [math.nan] * 12, None, None), (903, [math.inf] * 12, "x", "y")]
    check(spark, rows + odd + [rows[3], rows[3], (904, [], "x", "y"), (905, [2.0, -1.5], "x", "y")], 8)


def test_few_directions(spark, rows):
    """Dimensions that are constant, or copies of others, give no components."""
    flat = [(i, [v[0], v[0], 1.0, v[1], v[0] * 0], "x", "y") for i, v, *_ in rows]
    check(spark, flat, 2)


def test_steep_values(spark):
    """Eigenvalues over nine orders of size, with a large mean."""
    g = np.random.default_rng(1)
    q, _ = np.linalg.qr(g.normal(size=(6, 6)))
    m = g.normal(size=(400, 6)) * np.array([4000, 400, 40, 4, 1, 0.5]) @ q + 3000
    check(spark, [(n, [float(x) for x in v], "x", "y") for n, v in enumerate(m)], 6)


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None, "x", "y")], [(1, [1.0, 2.0], "x", "y")], [(1, [1.0, 2.0], "x", "y")] * 3, [(1, [], "x", "y")]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_exact_deviation_of_large_numbers(spark):
    rows = [(1, [1e9, -3.5], "x", "y"), (2, [-1e9, 2.5], "x", "y"), (3, [7.0, 0.0], "x", "y")]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids, deviation, *_ = brute(rows)
    assert got == dict(zip(ids, deviation, strict=True))


def test_shifted_factor():
    g = np.random.default_rng(2)
    a = g.normal(size=(200, 5)) @ np.diag([1e9, 1e3, 1, 1e-3, 1e-6])
    r, whole = None, np.eye(5)
    q = a
    for _ in range(5):
        r, _ = whitening.factor(q.T @ q, 200)
        q, whole = whitening.solve_rows(q, r), r @ whole
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-12
    assert np.allclose(np.linalg.svd(whole)[1], np.linalg.svd(a)[1], rtol=1e-6)
