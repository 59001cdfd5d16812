from __future__ import annotations

import math

import numpy as np
import pytest

from postmill.llm import norm_topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, top):
    good = {(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in good:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in good if j != i)[:top]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, top=20):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, norm_topk.top_inner_products(df, "vec_id % 20 = 0", top=top).collect()))


@pytest.fixture
def rows():
    g = np.random.default_rng(3)
    m = g.normal(size=(900, 12)) * g.exponential(size=(900, 1))
    out = [(n, [float(x) for x in v], "x") for n, v in enumerate(m)]
    out += [(1000 + n, out[5][1], "x") for n in range(90)]  # one vector, many ids
    out += [(2000 + n, [0.0] * 12, "x") for n in range(30)] + [out[0], out[20]]
    return out + [(None, out[0][1], "x"), (3000, None, "x"), (3001, [1.0, None, 2.0], "x"), (3020, [float("nan")] * 12, "x"), (3040, [float("inf")] * 12, "x"), (3060, [], "x"), (3080, [-1.5, 2.0], "x"), (-20, out[7][1], "x")]


@pytest.mark.parametrize("blocks", [(8192, 1024, 4096), (50, 7, 25)])
def test_against_brute_force(spark, rows, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "QUERY_ROWS", "SEED_ROWS"), blocks, strict=True):
        monkeypatch.setattr(norm_topk, name, value)
    assert found(spark, rows) == brute(rows, 20)


def test_few(spark):
    assert found(spark, []) == []
    assert found(spark, [(20, [1.0], "x")]) == []
    rows = [(20, [1.0], "x"), (40, [2.0], "x"), (41, [-1.0], "x")]
    assert found(spark, rows) == brute(rows, 20)


def test_long_vectors(spark):
    """Components whose squares sum to nearly 2^63 are scored exactly; longer vectors are refused."""
    rows = [(20 * n, [4.0e6 + 100.0 * n] * 64, "x") for n in range(5)]
    assert found(spark, rows) == brute(rows, 20)
    for big in (1e8, 1e30):
        with pytest.raises(ValueError, match="too long"):
            found(spark, [(20, [big] * 64, "x"), (21, [1.0] * 64, "x")])


def test_rounds(spark, rows, monkeypatch):
    """Many rounds, in each precision that scores need, find what brute force finds."""
    for name, value in {"BLOCK_ROWS": 60, "QUERY_ROWS": 16, "SEED_ROWS": 25, "STEP": 20, "QUERY_STEP": 5, "GROWTH": 4}.items():
        monkeypatch.setattr(norm_topk, name, value)
    for scale in (1.0, 50.0, 1e5):
        some = [(i, None if v is None else [None if x is None else float(np.float32(x)) * scale for x in v], s) for i, v, s in rows]
        assert found(spark, some) == brute(some, 20)


def test_memory():
    """Pairs that all reach the threshold are not gathered component by component."""
    import tracemalloc

    g = np.random.default_rng(1)
    q, c = g.integers(-64, 64, (1024, 512)).astype(np.int8), g.integers(-64, 64, (4096, 512)).astype(np.int8)
    c = c[np.argsort(-(c.astype(np.int64) ** 2).sum(1), kind="stable")]
    tracemalloc.start()
    who, ids, score = norm_topk.search_block(q, np.arange(-1024, 0), np.full(1024, np.iinfo(np.int64).min), c, np.arange(4096), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    full = q.astype(np.int64) @ c.astype(np.int64).T
    assert (who == np.repeat(np.arange(1024), 20)).all() and (score.reshape(-1, 20) == -np.sort(-full, axis=1)[:, :20]).all()
