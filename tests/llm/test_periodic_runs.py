from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from postmill.llm import periodic_runs, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """All runs, from the definition: for each period, the maximal stretches in which words that far apart are equal."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def sequence(rng):
    """A text with planted repeats, nested ones too, over few or many words."""
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        base = [rng.choice("ab" if kind < 0.3 else "abcdefgh") for _ in range(rng.randint(1, 12))]
        out += base * rng.randint(1, 12) if kind < 0.8 else [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.2:
            out = out * rng.randint(2, 4)
    return out[:400]


def test_cover():
    assert {(a - b) % periodic_runs.CYCLE for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.CYCLE))


def test_extensions():
    g = np.random.default_rng(0)
    for size in (1, 5, 40, 700):
        items = np.append(np.tile(g.integers(0, 2, 37), size)[:size], 9).astype(np.int64)
        e = periodic_runs.Extensions(items)
        i, j = g.integers(0, len(items), (2, 300))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(items)) if items[a + k : a + k + 1].tolist() != items[b + k : b + k + 1].tolist()) for a, b in zip(i, j, strict=True)]
        assert e.of(i, j).tolist() == want


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(40):
        texts = [sequence(rng) for _ in range(rng.randint(1, 8))]
        first = np.cumsum([0] + [len(t) for t in texts])
        words = np.array([ord(x) - 97 for t in texts for x in t], np.int64)
        who, *runs = periodic_runs.runs_of(words, first)
        for k, t in enumerate(texts):
            assert list(zip(*(x[who == k].tolist() for x in runs), strict=True)) == brute_runs(t)


def test_rows(spark, rng):
    texts = [" ".join(sequence(rng)) for _ in range(60)] + [None, "", " \n\t", "one", "a " * 23, "a " * 24, "x\x0by\x0c" * 30, "é ñ " * 40, "  lead " + "p q r " * 9 + "tail "]
    rows = [(n, t, n, "k") for n, t in enumerate(texts)] + [(None, "z " * 50, 1, "k"), (3, texts[3], 1, "k"), (3, "other", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(3)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").encode())
        runs = brute_runs(w)
        want.append((-1 if i is None else i, len(w), runs, collapsed(w, runs).decode()))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(df).collect()]
    assert sorted(got) == sorted(want)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_one_word_many_times(spark):
    """Every period divides the text, and each place of the grid is asked for."""
    df = spark.createDataFrame([(1, "spam " * 200_000), (2, "a b " * 100_000 + "c")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 200_000, 1)] and got[1]["collapsed"] == "spam"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 200_000, 2)] and got[2]["collapsed"] == "a b c"


def test_query(spark, tmp_path, rng):
    rows = [(n, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([0, 3, 40, 300]))), n) for n in range(200)]
    rows += [(200 + n, " ".join(sequence(rng)), n) for n in range(60)] + [(500, None, 1), (None, "z " * 50, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, period int").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for i, t, _ in rows:
        w = WORD.findall((t or "").encode())
        n = len(w)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
                planted += 1
        runs = brute_runs(w)
        s, length, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        text = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
        want.append((i, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs)).hexdigest()))
    out = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key) and planted > 10
