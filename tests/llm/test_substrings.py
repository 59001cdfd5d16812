"""Both substring operators against brute force."""

from __future__ import annotations

import cProfile
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import phrase_automata, recurrence, suffix_dedup
from postmill.llm.recurrence import Stretches
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, n_bytes string"


def covered(items: list[list], ids: list, size: int) -> list[list[bool]]:
    least: dict = {}
    for seq, doc in zip(items, ids, strict=True):
        for i in range(len(seq) - size + 1) if doc is not None else ():
            key = tuple(seq[i : i + size])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for seq, doc in zip(items, ids, strict=True):
        hit = [False] * len(seq)
        for i in range(len(seq) - size + 1) if doc is not None else ():
            if least[tuple(seq[i : i + size])] < doc:
                hit[i : i + size] = [True] * size
        out.append(hit)
    return out


def rows(rng) -> list[tuple]:
    passage, line = prose(rng, 60), prose(rng, 14)
    out = [(n, prose(rng, rng.choice([3, 12, 13, 40, 150]))) for n in range(120)]
    out += [(200 + n, prose(rng, 30) + passage[n : len(passage) - n] + prose(rng, 20)) for n in range(40)]
    out += [(300 + n, line * rng.randint(1, 4) + prose(rng, 9)) for n in range(30)]
    out += [(400 + n, out[n * 3][1]) for n in range(30)]
    out += [(450 + n, "the " * 2000 + prose(rng, 5)) for n in range(3)]
    out += [(500, None), (501, ""), (502, " \n\t "), (None, passage), (None, None), (503, passage * 30), (503, passage), (503, passage)]
    out += [(-5, passage[:200]), (600, "\x00" * 70), (601, "\x00" * 60 + "é" * 60), (602, "é" * 55)]
    rng.shuffle(out)
    return [(*r, "clash") for r in out]


def test_bytes(spark, rng):
    data = rows(rng)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    want = []
    items = [list((t or "").encode()) for _, t, _ in data]
    for (doc, _, _), seq, hit in zip(data, items, covered(items, [d for d, _, _ in data], 50), strict=True):
        kept = bytes(b for b, h in zip(seq, hit, strict=True) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        want.append((doc, len(seq), len(seq) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_words(spark, rng):
    data = rows(rng)
    got = phrase_automata.dedup_phrases(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    want = []
    items = [(t or "").encode().split() for _, t, _ in data]
    for (doc, _, _), seq, hit in zip(data, items, covered(items, [d for d, _, _ in data], 13), strict=True):
        kept = [w for w, h in zip(seq, hit, strict=True) if not h]
        want.append((doc, len(seq), len(seq) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("make", [suffix_dedup.dedup_substrings, phrase_automata.dedup_phrases])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_order(rng):
    for alphabet in (2, 4, 200):
        text = np.array([rng.randrange(alphabet) for _ in range(700)] * 2, np.uint8)
        order, _ = suffix_dedup.suffix_array(text, 64)
        raw = text.tobytes()
        assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(len(raw)))


def test_ranks_are_those_of_the_depth(rng):
    """Ranks are equal for equal first bytes only, also with room; refinement used to go on to 64 bytes, at every position."""
    for alphabet in (1, 2, 40, 256):
        stretch = [rng.randrange(alphabet) for _ in range(90)]
        sizes, text = [], []
        for _ in range(30):
            a, b = rng.randrange(20), rng.randrange(60, 91)
            text += [*stretch[a:b], *(rng.randrange(alphabet) for _ in range(5))]
            sizes.append(b - a + 5)
        raw = bytes(text)
        text, ends = np.array(text, np.uint8), np.repeat(np.cumsum(sizes), sizes)
        room = ends - np.arange(len(text))
        for depth in (3, 50, 64):
            for at, given in ((range(len(raw)), None), (np.flatnonzero(room >= depth).tolist(), room)):
                order, rank = suffix_dedup.suffix_array(text, depth, given)
                keys = [raw[i : i + depth] for i in at]
                assert sorted(order.tolist()) == list(at) and [raw[i : i + depth] for i in order] == sorted(keys)
                # As many ranks as there are strings, and as many pairs of both.
                assert len(set(keys)) == len({int(rank[i]) for i in at}) == len({(k, int(rank[i])) for k, i in zip(keys, at, strict=True)})
    assert len(suffix_dedup.suffix_array(text[:0], 50)[0]) == 0


def test_long_runs_are_walked_in_parts(rng):
    """One run of 4096 windows in a shard took 4096 steps over all its arrays: 94 708 calls."""
    text = np.array([rng.randrange(97, 123) for _ in range(4145)], np.uint8)
    n = np.array([4096, 4096, *[11] * 200])
    at = np.append(0, np.cumsum(n + 49))
    s = Stretches(np.arange(202), np.zeros(202, np.int64), np.zeros(202, np.int64), n, at, np.concatenate([text, text, *[text[k : k + 60] for k in range(200)]]))
    profile = cProfile.Profile()
    hit = profile.runcall(suffix_dedup.later_windows, s)
    assert not hit[:4096].any() and hit[4096:].all()
    assert sum(e.callcount for e in profile.getstats()) < 10_000


@pytest.mark.parametrize(("later", "size"), [(suffix_dedup.later_windows, 50), (phrase_automata.later_windows, 13)])
def test_sub_shards_meet(rng, later, size):
    """A hash with more stretches than a sub-shard takes gives the same windows."""
    base = [rng.choice("ab") for _ in range(size + 20)]
    join = b" " if size == 13 else b""
    texts, n = [], []
    for _ in range(60):
        a, b = rng.randrange(0, 6), rng.randrange(size + 6, size + 20)
        texts.append(join.join(c.encode() for c in base[a:b]))
        n.append(b - a - size + 1)
    doc = np.array([rng.randrange(20) for _ in texts])
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    s = Stretches(doc, np.full(60, 5), np.zeros(60, np.int64), np.array(n), at, np.frombuffer(b"".join(texts), np.uint8))
    assert (later(s, size, 10**6) == later(s, size, 200)).all()


def _stretch_columns(total):
    """Columns of ``_sent``: stretches of 80 bytes, each of them in two documents."""
    n = total // 160
    text = np.tile(np.random.default_rng(3).integers(97, 123, n * 80, dtype=np.uint8), 2)
    doc = np.repeat(np.arange(2), n)
    code = np.tile(np.arange(n, dtype=np.int64) * 3, 2)
    return [doc, doc + 10, code, np.tile(np.arange(n) * 80, 2), np.full(2 * n, 31), np.full(2 * n, 80), text]


def _peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sent_stretches_take_bounded_memory():
    """A task's gathered stretches are hashed in pieces: the hashes of all of them at once took 45 times their bytes."""
    columns = _stretch_columns(recurrence.SENT_BYTES)
    batches, peak = _peak(lambda: list(recurrence._sent(columns, recurrence.Windows(50, 16, words=False), 4)))
    assert peak < 20 * recurrence.SENT_BYTES
    rows = batches[0].to_pydict()
    sent = [recurrence._unpack(p, doc="<i8") for p, known in zip(rows["packed"], rows["known"], strict=True) if not known]
    told = [recurrence._unpack(p, doc="<i8", i="<i8", j="<i8") for p, known in zip(rows["packed"], rows["known"], strict=True) if known]
    # The first document's stretches go on; the other's are known there and then, whole.
    assert {d for x in sent for d in x["doc"].tolist()} == {0}
    assert {(d, j - i) for x in told for d, i, j in zip(x["doc"].tolist(), x["i"].tolist(), x["j"].tolist(), strict=True)} == {(1, 80)}
    assert sum(len(x["doc"]) for x in told) == len(columns[0]) // 2


def test_found_runs_take_bounded_memory():
    """Finding the runs of a shard takes a few bytes for a byte of its stretches, beside what an operator's method takes."""
    columns = _stretch_columns(4 << 20)
    packed = recurrence._pack(**{k: v.astype("<i4") if k in ("n", "size") else v for k, v in zip(("doc", "ver", "code", "i", "n", "size", "text"), columns, strict=True)})
    table = pa.table({"shard": [0], "known": [False], "packed": [packed]})

    def later(s):
        # All windows of the second document but the first and the last of each stretch.
        nth = np.tile(np.arange(31, dtype=np.int8), len(s.n))
        return np.repeat(s.doc == 1, 31) & (nth > 0) & (nth < 30)

    found, peak = _peak(lambda: recurrence._find(recurrence.Windows(50, 16, words=False), later)(table))
    assert peak < 14 * (4 << 20)
    got = found.to_pydict()
    assert set(got["doc_id"]) == {1} and set(got["ver"]) == {11}
    assert sorted(zip(got["i"], got["j"], strict=True)) == [(80 * k + 1, 80 * k + 79) for k in range(len(columns[0]) // 2)]
