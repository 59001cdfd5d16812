import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import setsearch


def brute(asked, offered, top):
    out = set()
    for no, part, keys in asked:
        scores = [(len(set(keys) & set(k)) / len(set(keys) | set(k)), t, n) for n, p, k, t in offered if p == part and part is not None and set(keys) & set(k)]
        out |= {(no, n, s) for s, _, n in sorted(scores, key=lambda x: (-x[0], x[1], x[2]))[:top]}
    return out


def sets(rng, n, words, most):
    return [(k, rng.choice(["a", "b", "b", None]), rng.sample(words, min(len(words), rng.randint(0, most)))) for k in range(n)]


@pytest.mark.parametrize("words,sizes", [(12, (20, 16, 4)), (12, (8192, 16384, 512)), (400, (64, 50, 3)), (70_000, (64, 50, 8))])
def test_against_brute_force(spark, monkeypatch, words, sizes):
    """Every best pair is among the rows, with its score, and a pair of blocks puts out no more than the best."""
    rng = random.Random(words)
    for name, value in zip(("ASKED_ROWS", "OFFERED_ROWS", "DENSE"), sizes, strict=True):
        monkeypatch.setattr(setsearch, name, value)
    if sizes[0] < 100:
        for name, value in {"ASKED_STEP": 7, "OFFERED_STEP": 9, "SEEDS": 5}.items():
            monkeypatch.setattr(setsearch, name, value)
    names = [f"wörd{k}" for k in range(words)]
    offered = [(*x, rng.randint(0, 3)) for x in sets(rng, 300, names if words < 1000 else names[:900], 6)]
    asked = sets(rng, 150, names, 12 if words < 1000 else 500)
    left = spark.createDataFrame(asked, "no long, part string, keys array<string>")
    right = spark.createDataFrame(offered, "no long, part string, keys array<string>, t int")
    got = setsearch.best_sets(left, right, [F.asc("t"), F.asc("no")], 4).collect()
    found = {tuple(r) for r in got}
    want = brute(asked, offered, 4)
    assert want <= found and len(found) == len(got)
    blocks = -(-300 // sizes[1]) + 40
    assert len(got) <= 4 * len(asked) * blocks


def test_pairs_are_not_rows(spark):
    """Sets that all share a word give each asked set its few best, not all pairs."""
    asked = spark.range(2000).select(F.col("id").alias("no"), F.lit("").alias("part"), F.array(F.lit("x"), F.concat(F.lit("a"), "id")).alias("keys"))
    offered = spark.range(3000).select(F.col("id").alias("no"), F.lit("").alias("part"), F.array(F.lit("x"), F.concat(F.lit("b"), "id")).alias("keys"))
    got = setsearch.best_sets(asked, offered, [F.asc("no")], 5)
    assert got.count() <= 2000 * 5 * 12


def test_empty(spark):
    none = spark.createDataFrame([], "no long, part string, keys array<string>")
    some = spark.createDataFrame([(1, "", ["x"]), (2, "", [])], "no long, part string, keys array<string>")
    for a, b in ((none, some), (some, none), (none, none)):
        assert setsearch.best_sets(a, b, [F.asc("no")], 5).count() == 0


def test_scores_rise_from_block_to_block(spark):
    """Offered blocks with lower scores than those an asked set has reached give it no rows, whatever the number of blocks."""
    asked = spark.range(200).select(F.col("id").alias("no"), F.lit("").alias("part"), F.array(F.lit("x"), F.concat(F.lit("a"), "id")).alias("keys"))
    words = F.transform(F.sequence(F.lit(0), F.col("id") % 12), lambda k: F.when(k == 0, F.lit("x")).otherwise(F.concat_ws("_", F.lit("b"), "id", k)))
    offered = spark.range(3000).select(F.col("id").alias("no"), F.lit("").alias("part"), words.alias("keys"))
    got = setsearch.best_sets(asked, offered, [F.asc("no")], 5).collect()
    assert {r["score"] for r in got} == {0.5} and len(got) <= 200 * 5 * 3
    assert {(a, 12 * k) for a in range(200) for k in range(5)} <= {(r["ask_no"], r["offer_no"]) for r in got}


def test_words_beyond_the_bits(spark):
    """Sets with more words than a block counts as bits, and with more shared words than a byte holds."""
    words = [f"w{k}" for k in range(900)]
    asked = spark.createDataFrame([(1, "", words[:700]), (2, "", words[100:400])], "no long, part string, keys array<string>")
    offered = spark.createDataFrame([(k, "", words[k : 600 + k]) for k in range(9)], "no long, part string, keys array<string>")
    got = {(r["ask_no"], r["offer_no"]): r["score"] for r in setsearch.best_sets(asked, offered, [F.asc("no")], 3).collect()}
    assert got[1, 0] == 600 / 700 and got[2, 0] == 300 / 600 and {k for _, k in got} == {0, 1, 2}


def test_scores_rise_within_each_part(spark):
    """With parts, each asked set has the few best of its own part, however many blocks the part has."""
    part = F.when(F.col("id") % 2 == 0, F.lit("data")).otherwise(F.lit("qa"))
    asked = spark.range(100).select(F.col("id").alias("no"), part.alias("part"), F.array(F.lit("x"), F.concat(F.lit("a"), "id")).alias("keys"))
    words = F.transform(F.sequence(F.lit(0), F.col("id") % 15), lambda k: F.when(k == 0, F.lit("x")).otherwise(F.concat_ws("_", F.lit("b"), "id", k)))
    offered = spark.range(6000).select(F.col("id").alias("no"), part.alias("part"), words.alias("keys"))
    got = setsearch.best_sets(asked, offered, [F.asc("no")], 5).collect()
    assert {r["score"] for r in got} == {0.5} and len(got) <= 100 * 5 * 3
    want = {(a, o) for a in range(100) for o in [o for o in range(0, 6000, 15) if o % 2 == a % 2][:5]}
    assert want <= {(r["ask_no"], r["offer_no"]) for r in got}
