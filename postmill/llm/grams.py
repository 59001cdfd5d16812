"""Hashed counts of byte n-grams and of repetition, for all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.text_arrays import bytes_of, pieces, word_bounds, word_hashes

#: A counter of features: (bytes, first byte of each text) -> a row of counts for each text.
Counter = Callable[[np.ndarray, np.ndarray], np.ndarray]


def letters_only() -> np.ndarray:
    """A byte map for language: a-z for A-Z, bytes of other scripts as they are, everything else a space."""
    to = np.full(256, 32, np.uint8)
    to[97:123] = to[65:91] = np.arange(97, 123)
    to[128:] = np.arange(128, 256)
    return to


def shapes() -> np.ndarray:
    """A byte map for quality: small letters and other scripts as one, capitals as one, digits as one, the rest as it is."""
    to = np.arange(256, dtype=np.uint8)
    to[97:123] = to[128:] = ord("a")
    to[65:91] = ord("A")
    to[48:58] = ord("0")
    return to


def count_grams(data: np.ndarray, at: np.ndarray, width: int, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Counts of the n-grams of each text, hashed to ``width`` (a power of two) columns. N-grams don't cross texts."""
    n, bits = len(at) - 1, width.bit_length() - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(at)) << np.int32(bits)
    out = np.zeros(n * width, np.int64)
    code = np.zeros(len(data), np.uint32)
    inner = at[1:-1]
    for k in range(1, max(sizes) + 1):
        if len(data) < k:
            break
        code = code[: len(data) - k + 1] * np.uint32(257) + data[k - 1 :] + np.uint32(1)
        if k in sizes:
            slot = owner[: len(code)] + ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)
            crossing = (inner[:, None] - np.arange(1, k)).ravel()
            crossing = crossing[(crossing >= 0) & (crossing < len(code))]
            if len(crossing):
                slot = np.delete(slot, np.unique(crossing))
            out += np.bincount(slot, minlength=n * width)
    return out.reshape(n, width)


def count_repeats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each text; words that repeat the one before; the one before that; words that occurred before at all."""
    starts, ends, first = word_bounds(data, at)
    h = word_hashes(data, starts, ends)
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, 4))
    out[:, 0] = np.diff(first)
    for lag in (1, 2):
        same = (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, lag] = np.bincount(owner[lag:][same], minlength=n)
    # Text number and 44 bits of the hash in one sortable number; ``pieces`` keeps the texts of a call far below 2^20.
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    again = keys[1:] == keys[:-1]
    out[:, 3] = np.bincount((keys[1:][again] >> np.uint64(44)).astype(np.int64), minlength=n)
    return out


def counted(column: pa.Array, counter: Counter) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts [i, j) of a batch and their counts, some hundred kB of text at a time."""
    data, at = bytes_of(column)
    for i, j in pieces(at):
        yield i, j, counter(data[at[i] : at[j]], at[i : j + 1] - at[i])


def document_frequencies(texts: DataFrame, counter: Counter, width: int) -> tuple[np.ndarray, int]:
    """Texts that have each feature, and all texts. Each task sums its own; ``width`` numbers reach the driver."""

    def run(batches):
        have, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for _, _, counts in counted(batch.column(0), counter):
                have += (counts > 0).sum(0)
                n += len(counts)
        yield pa.record_batch({"feature": np.arange(-1, width, dtype=np.int32), "n": np.append(n, have)})

    sums = texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    have = np.zeros(width + 1, np.int64)
    have[sums["feature"] + 1] = sums["n"]
    return have[1:], int(have[0])


def inverse_frequency(have: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + have)) + 1).astype(np.float32)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1)
