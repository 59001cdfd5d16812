from __future__ import annotations

import math

import numpy as np
import pytest

from postmill.llm import pq_links

SCHEMA = "vec_id long, embedding array<float>, key string, n_links string"


def brute(rows):
    """Row -> links, smallest id that can be reached, by all cosines."""
    ids = [i for i, *_ in rows]
    good = [k for k, (i, v, *_) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[k][1]) for k in good), default=1)
    m = np.array([list(rows[k][1]) + [0.0] * (width - len(rows[k][1])) for k in good], np.float32).astype(float).reshape(len(good), width)
    u = pq_links.unit(m) if len(m) else m
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, True)
    label = np.array([ids[k] for k in good])
    while True:
        lower = np.array([label[row].min() for row in near]) if len(good) else label
        if (lower == label).all():
            break
        label = lower
    out = {k: (0, ids[k]) for k in range(len(rows))}
    out |= {k: (int(near[n].sum()) - 1, int(label[n])) for n, k in enumerate(good)}
    return sorted(((-1 if ids[k] is None else ids[k]), n, -1 if c is None else c, c == ids[k]) for k, (n, c) in out.items())


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pq_links.linked_vectors(df, **options).collect()
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in got)


def clouds(seed, spread, sizes, width=16, lone=150):
    g = np.random.default_rng(seed)
    parts = [g.normal(size=(lone, width))]
    for n in sizes:
        parts.append(pq_links.unit(g.normal(size=(1, width))) * 3 + g.normal(size=(n, width)) * spread * 3 / math.sqrt(width))
    m = np.concatenate(parts)
    m = m[g.permutation(len(m))]
    return [(10 + n, [float(x) for x in v], "x", "y") for n, v in enumerate(m)]


ODD = [(None, [1.0] * 16, "x", "y"), (5, None, "x", "y"), (6, [0.0] * 16, "x", "y"), (7, [1.0, None], "x", "y"), (8, [math.nan] * 16, None, None), (9, [-math.inf] * 16, "x", "y"), (4, [], "x", "y")]


@pytest.mark.parametrize(("spread", "small"), [(0.05, False), (0.14, True), (0.24, True), (0.34, False)])
def test_against_brute_force(spark, monkeypatch, spread, small):
    """Clouds from tight to wider than a link, with many lists and tiny parts, blocks and batches, or with usual ones."""
    for name, value in {"LIST_ROWS": 40, "BUNDLED": 30, "PART": 12, "PACK": 8, "STEP": 16, "PAIRS": 64}.items() if small else {"LIST_ROWS": 40}.items():
        monkeypatch.setattr(pq_links, name, value)
    rows = clouds(int(spread * 100), spread, [90, 40, 12, 5, 2, 2])
    rows += [(1000 + n, rows[3][1], "x", "y") for n in range(30)]  # copies
    rows += [(2000 + n, [2.0 * x for x in rows[4][1]], "x", "y") for n in range(3)] + [rows[9], rows[9]] + ODD + [(3000, [1.0, 2.0], "x", "y"), (3, [1.0, 2.001], "x", "y"), (3001, [1e-30, 1e-30], "x", "y"), (3002, [1e30, 1e30], "x", "y")]
    assert found(spark, rows, reach=None) == brute(rows)


def test_few(spark):
    assert found(spark, []) == []
    assert found(spark, ODD) == brute(ODD)
    rows = [(2, [1.0, 0.0], "x", "y"), (1, [1.0, 0.3], "x", "y"), (3, [0.0, 1.0], "x", "y")]
    assert found(spark, rows) == brute(rows) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_recall_at_the_default_reach(spark, monkeypatch):
    """Pairs just above the threshold, between points that many lists part: links found, against all cosines."""
    monkeypatch.setattr(pq_links, "LIST_ROWS", 60)
    g = np.random.default_rng(4)
    base = pq_links.unit(g.normal(size=(1500, 64)))
    away = g.normal(size=base.shape)
    away = pq_links.unit(away - (away * base).sum(1, keepdims=True) * base)
    close = g.uniform(0.951, 0.97, size=(len(base), 1))
    m = np.concatenate([base, close * base + np.sqrt(1 - close**2) * away])
    rows = [(n, [float(x) for x in v], "x", "y") for n, v in enumerate(m)]
    want, got = brute(rows), found(spark, rows)
    n_want, n_got = sum(r[1] for r in want), sum(r[1] for r in got)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and n_got >= 0.99 * n_want


def test_a_group_of_near_copies_makes_few_rows(spark, monkeypatch):
    """What the search puts out grows with the rows of a group, not with its pairs."""
    monkeypatch.setattr(pq_links, "LIST_ROWS", 40)
    made = []
    searched = pq_links._searched

    def counted(index, parts):
        def run(batches):
            for batch in searched(index, parts)(batches):
                rows.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(pq_links, "_searched", counted)
    for n in (100, 800):
        table = clouds(3, 0.08, [n, n], lone=60)
        rows = spark.sparkContext.accumulator(0)
        assert found(spark, table) == brute(table)
        made.append(rows.value)
    assert made[1] <= 2 * made[0] + 100
