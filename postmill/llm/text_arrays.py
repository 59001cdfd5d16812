"""Texts of an Arrow batch as byte and word arrays, hashed in numpy without a step per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The white space that parts words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that are worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size + 1, _BASE, dtype=np.uint64)
    down = np.full(size + 1, _UNBASE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one text after the other, and where each begins (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts with at most ``most`` bytes, or one text that is longer."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the first word of each text (one more at the end)."""
    solid = ~_IS_SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = solid
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    starts = np.flatnonzero(solid & (~before[:-1] | cut[:-1]))
    after = np.empty(len(data) + 1, dtype=bool)
    after[:-1] = solid
    after[-1] = False
    ends = np.flatnonzero(solid & (~after[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if ``lower``."""
    size = 1 << max(PIECE_BYTES.bit_length() - 1, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolled(items: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` successive items; empty if there are fewer."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += items[j : j + n]
    return mix(out)


def byte_runs(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` successive bytes, for k a multiple of 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    data = np.ascontiguousarray(data)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(0, k, 8):
        out *= np.uint64(_BASE)
        out += np.ndarray((n,), dtype="<u8", buffer=data, offset=j, strides=(1,))
        out ^= out >> np.uint64(29)
    return mix(out)


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``w`` successive values."""
    have = 1
    while have * 2 <= w:
        x = best(x[:-have], x[have:])
        have *= 2
    if have < w:
        x = best(x[: len(x) - (w - have)], x[w - have :])
    return x


def window_runs(hashes: np.ndarray, at: np.ndarray, k: int, window: int, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [i, j) of windows of ``window`` successive items that share their least hash of ``k`` items, and that hash.

    ``hashes`` are those of the runs of k items over all texts, ``at`` the first item of each text. Equal windows have equal
    least hashes, so what two texts share meets under the same hash. No window crosses a text's end; a run has ``most`` windows
    at most.
    """
    none = np.zeros(0, np.int64)
    starts = int(at[-1]) - window + 1
    if starts <= 0:
        return none, none, np.zeros(0, np.uint64)
    least = _slide(hashes[: int(at[-1]) - k + 1], window - k + 1, np.minimum)[:starts]
    inside = np.zeros(starts + 1, dtype=np.int32)
    first, last = at[:-1], at[1:] - window + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    heads = first[some]
    new[heads] = True
    i = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    j = np.flatnonzero(stop) + 1
    if len(i) and int((j - i).max()) > most:
        parts = -(-(j - i) // most)
        which = np.repeat(np.arange(len(i)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        i, j = i[which] + nth * most, np.minimum(j[which], i[which] + (nth + 1) * most)
    return i, j, least[i]


def gather(data: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The stretches data[i:j], one after the other."""
    size = j - i
    at = np.append(0, np.cumsum(size))
    out = np.empty(int(at[-1]), data.dtype)
    # In pieces, as the index of each byte takes sixteen.
    for a, b in pieces(at):
        out[at[a] : at[b]] = data[np.arange(at[a], at[b]) + np.repeat(i[a:b] - at[a:b], size[a:b])]
    return out
