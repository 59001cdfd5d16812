from __future__ import annotations

import re
from itertools import combinations

import pytest

from postmill.llm import spaced_seeds
from tests.llm.conftest import WORDS, prose

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def overlap(doc, item):
    """Most equal words of any stretch of at least 13 (or all) words, four fifths of them equal, on any diagonal."""
    best, least = 0, min(13, len(item))
    for shift in range(-len(item), len(doc)):
        equal = [0 <= p + shift < len(doc) and doc[p + shift] == w for p, w in enumerate(item)]
        inside = [0 <= p + shift < len(doc) for p in range(len(item))]
        for i in range(len(item)):
            for j in range(i + least, len(item) + 1):
                n = sum(equal[i:j])
                if all(inside[i:j]) and equal[i] and equal[j - 1] and n >= 0.8 * (j - i):
                    best = max(best, n)
    return best


def test_masks_find_two_replaced_words():
    for lost in combinations(range(13), 2):
        assert any(all(o + p not in lost for p in m) for m in spaced_seeds.MASKS for o in range(13 - m[-1]))


@pytest.mark.parametrize("block", [200_000, 60])
def test_against_brute_force(spark, rng, monkeypatch, block):
    monkeypatch.setattr(spaced_seeds, "BLOCK_WORDS", block)
    items = [(n, prose(rng, rng.choice([4, 12, 13, 20, 30])), "x") for n in range(12)] + [(90, None, "x"), (91, "", "x"), (None, prose(rng, 20), "x")]
    docs = [(n, prose(rng, 60), "x") for n in range(30)]
    for n in range(40):
        item = words(items[n % 12][1])
        part = item[rng.randrange(len(item)) :] if n % 3 == 0 else item
        for _ in range(rng.choice([0, 1, 2]) if len(part) >= 13 else 0):
            part[rng.randrange(len(part))] = rng.choice(WORDS)
        docs.append((100 + n, prose(rng, 15) + " ".join(part).upper() + ", " + prose(rng, 9), "x"))
    docs += [(1, docs[40][1], "x"), (None, docs[41][1], "x"), (200, None, "x"), (201, "", "x"), (202, items[3][1] * 50, "x")]
    got = spaced_seeds.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    best = {(d, i): overlap(words(t), words(x)) for d, t, _ in docs if t and d != 1 for i, x, _ in items if x and i is not None}
    want = {k: n for k, n in best.items() if n}
    assert {(r.doc_id, r.item_id): r.n_equal for r in got if r.doc_id != 1} == want
    assert all(r.similarity >= 0.8 for r in got)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c", "x")], DOCS)
    assert spaced_seeds.find_leaks(docs, items).count() == spaced_seeds.find_leaks(some, items).count() == 0


@pytest.mark.parametrize("n", range(5, 26))
def test_masks_find_a_fifth_replaced(n):
    masks = [(m, range(n - m[-1])) for m in spaced_seeds.MASKS] + [(m, (0,)) for m in getattr(spaced_seeds, "SHORT_MASKS", {}).get(n, ())]
    places = [sum(1 << (o + p) for p in m) for m, offsets in masks for o in offsets]
    for lost in combinations(range(n), n // 5):
        gone = sum(1 << p for p in lost)
        assert any(not gone & p for p in places)


def test_short_items_with_any_words_replaced(spark, rng):
    items, docs, want = [], [], set()
    for n in range(1, 13):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item), "x"))
        for m in (n // 5, n // 5 + 1):
            for k, lost in enumerate(combinations(range(n), m)):
                doc = 10000 * n + 1000 * (m - n // 5) + k
                docs.append((doc, prose(rng, 3) + " ".join("other" if p in lost else w for p, w in enumerate(item)) + " " + prose(rng, 3), "x"))
                want |= {(doc, n, n - m)} if m == n // 5 else set()
    got = spaced_seeds.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.n_equal) for r in got} == want and all(r.similarity >= 0.8 for r in got)
