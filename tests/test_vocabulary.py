"""Skills in text by the automaton, against one pattern per skill."""

from __future__ import annotations

import random

import regex

from postmill.operators import matching

W = r"[\p{L}\p{N}_]"
SKILLS = ["c++", ".net", "asp.net", "node.js", "go", "Machine Learning", "machine  learning", "learning", "for the", "for the win", "the win", "c", "r&d", "ёж в лесу", "x", "co-op", "(ab)", "a_b", "a b c d e", "b c", "+++", "SQL", "sql "]
PARTS = ["c++", "C", ".net", "asp", ".", "net", "node.js", "go", "machine", " ", "  ", "learning", "for", "the", "win", "r&d", "&", "ёж", "в", "лесу", "-", "co-op", "(ab)", "ab", "a_b", "a b", "c d e", "\n", ",", "+", "sql", "é"]


def brute(texts, vocab):
    keys = {}
    for skill, n in sorted(vocab, key=lambda v: (-v[1], v[0])):
        key = skill.strip(" ").lower()
        if regex.search(W, key) and (len(key) > 2 or key in matching.SHORT_SKILLS):
            keys.setdefault(key, skill)
    out = []
    for doc, text in texts:
        hits = [(-len(k), k, s) for k, s in keys.items() if regex.search(rf"(?<!{W}){regex.escape(k)}(?!{W})", (text or "").lower())]
        out += [(doc, s, n + 1) for n, (_, _, s) in enumerate(sorted(hits))]
    return sorted(out)


def check(spark, texts, vocab, **options):
    docs = spark.createDataFrame(texts, "id long, t string").repartition(3)
    got = matching.find_skills(docs, "id", "t", spark.createDataFrame(vocab, "skill string, n_mentions long"), **options)
    return sorted(map(tuple, got.collect()))


def cases():
    rng = random.Random(4)
    texts = [(n, "".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25)))) for n in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "c++"), (1003, "xc++"), (1004, "c++x c+++"), (1005, ".net"), (1006, "x.net ..net"), (1007, "Machine Learning"), (1008, "for the"), (1009, "for the win" * 50)]
    return texts, [(s, 5 + k % 3) for k, s in enumerate(SKILLS)]


def test_against_patterns(spark):
    texts, vocab = cases()
    assert check(spark, texts, vocab) == brute(texts, vocab)


def test_large_vocabulary_and_hot_words(spark, monkeypatch):
    """A vocabulary that is not broadcast, and a share above which words are dealt to several tasks."""
    monkeypatch.setattr(matching, "BROADCAST_STATES", 0)
    monkeypatch.setattr(matching, "HOT_SHARE", 20)
    texts, vocab = cases()
    assert check(spark, texts, vocab) == brute(texts, vocab)


def test_limit_and_nothing(spark):
    texts, vocab = cases()
    assert check(spark, texts, vocab, max_hits=2) == [r for r in brute(texts, vocab) if r[2] <= 2]
    assert check(spark, texts, []) == [] and check(spark, [], vocab) == []
