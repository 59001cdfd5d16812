from __future__ import annotations

import re
from itertools import combinations
from pathlib import Path

import pytest

from postmill.llm import lsh_forest
from postmill.llm.components import connected_components
from postmill.session import ensure_checkpoint_dir
from tests.llm.conftest import WORDS, prose

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, link=85):
    sets: dict = {}
    for doc, text, _ in rows:
        sets.setdefault(doc, []).append(shingles(text))
    parent = {d: d for d in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in combinations([d for d in sets if d is not None], 2):
        if any(s and t and 100 * len(s & t) >= link * len(s | t) for s in sets[x] for t in sets[y]):
            p, q = root(x), root(y)
            parent[max(p, q)] = min(p, q)
    return sorted(((d, len(shingles(t)), None if d is None else root(d), d is None or root(d) == d) for d, t, _ in rows), key=str)


def found(spark, rows, link=85):
    return sorted(map(tuple, lsh_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), link=link).collect()), key=str)


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture
def rows(rng):
    out = [(n, prose(rng, rng.choice([1, 4, 5, 9, 60, 200])), "x") for n in range(150)]
    for n in range(25):
        base = prose(rng, rng.choice([70, 200, 400]))
        out += [(1000 + 20 * n + k, changed(rng, base, rng.choice([0, 0, 1, 2, 4])), "x") for k in range(rng.choice([2, 3, 12]))]
    out += [(5000 + n, out[n][1].upper(), "x") for n in range(20)]
    out += [(None, out[3][1], "x"), (None, None, "x"), (6000, None, "x"), (6001, "", "x"), (6002, " \t\n", "x"), (6003, "Ä B", "x"), (6004, "ä b", "x"), (6005, "Ä b", "x")]
    out += [(7, prose(rng, 90), "x"), out[8], (-3, out[4][1], "x")]
    rng.shuffle(out)
    return out


def test_against_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_another_threshold(spark, rows):
    assert found(spark, rows, 80) == brute(rows, 80)


def test_cells_put_out_a_forest(spark, rng, monkeypatch):
    """A family whose sets are alike but not linked, in cells of a few sets: no step puts out more rows than its sets, and pairs are found."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 40)
    same, rows = " ".join(f"b{k}" for k in range(300)), []
    for n in range(400):
        rows.append((n, same + " " + " ".join(f"u{n // 2 if n > 1 else n + 1000}x{k}" for k in range(36)) + f" own{n}", "x"))
    made = spark.sparkContext.accumulator(0)
    joined = lsh_forest._joined

    def counted(table, link):
        for batch in joined(table, link):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(lsh_forest, "_joined", counted)
    want = brute(rows)
    assert found(spark, rows) == want and sum(kept for *_, kept in want) == 201
    assert made.value <= 16 * len(rows)


def test_crowded_regions(spark, rng, monkeypatch):
    """Groups far above a region's limit, split at each depth, keep their components."""
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    base, rows = prose(rng, 400), []
    rows = [(n, changed(rng, base, rng.choice([0, 1, 2])), "x") for n in range(220)]
    rows += [(500 + n, prose(rng, 50), "x") for n in range(40)]
    assert found(spark, rows) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None, "x")]) == [(3, 0, 3, True)]


@pytest.mark.parametrize("region", [256, 16])
def test_boilerplate_family(spark, rng, monkeypatch, region):
    """A family just under the limit, the smallest linked with none: its linked pairs are found in whole and in split regions."""
    monkeypatch.setattr(lsh_forest, "REGION", region)
    same, rows = " ".join(f"b{k}" for k in range(500)), []

    def own(n, size):
        return [f"u{n}x{k}" for k in range(size)]

    for n in range(160):
        tail = own(n // 2 if n > 1 else n + 1000, 14) + own(n + 2000, 40)
        rows.append((n, same + " " + " ".join(tail), "x"))
    want = brute(rows)
    assert sum(kept for *_, kept in want) == 81
    assert found(spark, rows) == want


def test_small_rounds_have_few_files(spark):
    """The rounds of a small edge table are written in a file each, not in one for each shuffle partition."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    rounds = set(folder.iterdir())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "a long, b long")
        got = {tuple(r) for r in connected_components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    files = [len(list(x.glob("part-*"))) for x in set(folder.iterdir()) - rounds]
    # Only the edges themselves are written before their number is known.
    assert len(files) > 2 and sum(n > 1 for n in files) <= 1
