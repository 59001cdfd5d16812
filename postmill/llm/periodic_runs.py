"""Periodic runs of words: longest common extensions from a difference cover, asked for on a harmonic grid of places and periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.text_arrays import bytes_of, pieces, word_bounds

# A perfect difference set. Every difference modulo 31 is that of two of its members.
COVER, CYCLE = (1, 5, 11, 24, 25, 27), 31
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Pairs of the grid, and words of a text, that are worked on at a time.
PAIRS, WORDS = 1 << 20, 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_IN = np.zeros(CYCLE, bool)
_IN[list(COVER)] = True
_STEP = np.arange(CYCLE)
#: Steps from places of two residues to the next two places that are both in the cover.
_SHIFT = np.array([[int(np.flatnonzero(_IN[(a + _STEP) % CYCLE] & _IN[(b + _STEP) % CYCLE])[0]) for b in range(CYCLE)] for a in range(CYCLE)])


class Extensions:
    """Longest common extensions in a sequence of whole numbers (0 or more), whose last one occurs nowhere else.

    Only places whose residue is in the cover are sorted: first by the next CYCLE items, then by doubling. What neighbours in this
    order share comes from the ranks of each doubling, and a sparse table of minima gives what any two of them share.
    """

    def __init__(self, items: np.ndarray):
        self.items, n = np.append(items, np.zeros(CYCLE, items.dtype)), len(items)
        places = np.flatnonzero(_IN[np.arange(n) % CYCLE])
        self.number = np.full(n + 1, -1, np.int32)
        self.number[places] = np.arange(len(places), dtype=np.int32)
        levels = [self._ranked(self._keys(places))]
        reach = CYCLE
        while len(places) and levels[-1].max() + 1 < len(places):
            rank, beyond = levels[-1], self._at(places + reach)
            follow = np.where(beyond >= 0, rank[beyond], -1)
            levels.append(self._ranked([rank.astype(np.int64) * (len(places) + 1) + follow + 1]))
            reach *= 2
        self.rank = levels[-1]
        order = places[np.argsort(self.rank)]
        shared = np.zeros(len(places), np.int32)
        if len(places) > 1:
            shared[1:] = self._shared(order[:-1], order[1:], levels[:-1])
        self.minima = [shared]
        while 2 << (len(self.minima) - 1) <= len(places):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _at(self, places: np.ndarray) -> np.ndarray:
        return self.number[np.minimum(places, len(self.number) - 1)]

    def _keys(self, places: np.ndarray) -> list[np.ndarray]:
        """The CYCLE items from each place on, several in one number, the first ones first."""
        bits = max(1, int(self.items.max(initial=0)).bit_length())
        per = max(1, 63 // bits)
        keys = []
        for a in range(0, CYCLE, per):
            key = np.zeros(len(places), np.int64)
            for k in range(a, min(a + per, CYCLE)):
                key = (key << bits) | self.items[places + k]
            keys.append(key)
        return keys

    @staticmethod
    def _ranked(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(new)
        return rank

    def _shared(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Items that sampled places share, from the ranks of each length downwards; the last few are compared."""
        have = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = self._at(a + have), self._at(b + have)
            same = (x >= 0) & (y >= 0)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            have[same] += CYCLE << k
        return have + self._compared(a + have, b + have, np.full(len(a), CYCLE - 1))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal items from i and j on, up to ``most``, item by item."""
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for step in range(CYCLE):
            live = live[most[live] > step]
            live = live[self.items[i[live] + step] == self.items[j[live] + step]]
            if not len(live):
                break
            out[live] = step + 1
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal items from the places i and j on, i unlike j."""
        shift = _SHIFT[i % CYCLE, j % CYCLE]
        out = self._compared(i, j, shift)
        far = np.flatnonzero(out == shift)
        x, y = (self.rank[self.number[p[far] + shift[far]]] for p in (i, j))
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.log2(high - low).astype(np.int64)
        for k in np.unique(level):
            of, m = level == k, self.minima[k]
            out[far[of]] += np.minimum(m[low[of]], m[high[of] - (1 << k)])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequence, place and period of the pairs to look at, PAIRS or so at a time.

    A run of period p has max(LEAST_WORDS - p, 2 p) or more places whose word recurs p further on, so one of them is
    a multiple of that number.
    """
    long = np.flatnonzero(sizes >= LEAST_WORDS)
    for d in np.split(long, np.flatnonzero(np.diff(np.cumsum(sizes[long]) // PAIRS)) + 1):
        if not len(d):
            continue
        most = sizes[d] // LEAST_PERIODS
        who = np.repeat(d, most)
        period = np.arange(len(who)) - np.repeat(np.cumsum(most) - most, most) + 1
        step = np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
        count = -(-(sizes[who] - period) // step)
        ends = np.cumsum(count)
        a = 0
        while a < len(who):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - count[a] + PAIRS, side="right")))
            n = count[a:b]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(who[a:b], n), nth * np.repeat(step[a:b], n), np.repeat(period[a:b], n)
            a = b


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, start, length and period of all runs, by sequence, start and period.

    ``words`` are whole numbers from 0, those of one sequence after the other; sequence k begins at ``first[k]`` (one more at the
    end). Every start, end and period is exact: the extensions compare words, not hashes.
    """
    sizes = np.diff(first)
    none = np.zeros(0, np.int64)
    if not (sizes >= LEAST_WORDS).any():
        return none, none, none, none
    # A mark of its own stands before each sequence and after the last one, so that nothing reaches across.
    top = int(words.max()) + 1
    items = np.empty(len(words) + len(sizes) + 1, np.int64)
    heads = first[:-1] + np.arange(len(sizes)) + 1
    marks = np.append(heads - 1, len(items) - 1)
    inside = np.ones(len(items), bool)
    inside[marks] = False
    items[inside] = words
    items[marks] = top + np.arange(len(marks))
    forward = backward = None
    found = []
    for who, place, period in _grid(sizes):
        i = heads[who] + place
        same = np.flatnonzero(items[i] == items[i + period])
        if not len(same):
            continue
        who, i, period = who[same], i[same], period[same]
        if forward is None:
            forward, backward = Extensions(items), Extensions(items[::-1].copy())
        after = forward.of(i, i + period)
        # The places before i and i + period, in the reversed sequence.
        back = len(items) - i
        before = backward.of(back, back - period)
        length = before + after + period
        good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        if good.any():
            runs = np.stack([who[good], i[good] - before[good] - heads[who[good]], length[good], period[good]])
            found.append(np.unique(runs, axis=1))
    if not found:
        return none, none, none, none
    who, start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # A stretch with a period has its multiples too, and the same bounds: the smallest one counts.
    least = np.append(True, (who[1:] != who[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    who, start, length, period = (x[least] for x in (who, start, length, period))
    order = np.lexsort((period, start, who))
    return who[order], start[order], length[order], period[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The given words of each of ``n`` texts, joined by single spaces."""
    size = ends - starts + 1
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    size[last] -= 1
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, weights=size, minlength=n).astype(np.int64), out=at[1:])
    data = np.append(data, np.uint8(32))
    out = np.empty(int(at[-1]), np.uint8)
    to = np.cumsum(size) - size
    for a in range(0, len(size), WORDS):
        b = min(a + WORDS, len(size))
        n_bytes = int(size[a:b].sum())
        part = data[np.arange(n_bytes) + np.repeat(starts[a:b] - (to[a:b] - to[a]), size[a:b])]
        part[(to[a:b] + size[a:b] - 1 - to[a])[~last[a:b]]] = 32
        out[to[a] : to[a] + n_bytes] = part
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.binary()).cast(pa.string())


def _found(batches):
    for batch in batches:
        data, at = bytes_of(batch.column("text"))
        for a, b in pieces(at):
            text, n = data[at[a] : at[b]], b - a
            starts, ends, first = word_bounds(text, at[a : b + 1] - at[a])
            solid = np.zeros(len(text) + 1, np.int8)
            solid[starts] = 1
            np.subtract.at(solid, ends, 1)
            letters = text[np.cumsum(solid[:-1], dtype=np.int8) > 0]
            ends_in = np.append(0, np.cumsum(ends - starts))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_in), pa.py_buffer(letters)])
            number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            who, start, length, period = runs_of(number, first)
            owner = np.repeat(np.arange(n), np.diff(first))
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, first[who] + start + period, 1)
            np.add.at(cover, first[who] + start + length, -1)
            keep = np.cumsum(cover[:-1]) == 0
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            of = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n + 1)), pa.int32()), runs)
            yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(np.diff(first)), of, _joined(text, starts[keep], ends[keep], owner[keep], n)], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, collapsed for each row of ``docs``.

    Words are maximal stretches of bytes other than space, tab, newline, vertical tab, form feed and carriage return. A run is a
    stretch of successive words with smallest period q, of at least 24 words and three periods, that no neighbouring word extends; runs
    (start, length, period; words count from 0) come by start, then period. ``collapsed`` are the words that no run contains after its
    first q words, joined by single spaces.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Ids pass through, null and repeated ones too; every row stands for
    itself. Other columns are not read; an empty table gives an empty result. There is no shuffle. Texts are taken together up
    to 256 KB, a longer one alone; its task holds about 120 bytes for each of its words. Time grows with words x log(words), for a text of one word
    repeated as well.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_found, SCHEMA)
