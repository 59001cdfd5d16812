"""Benchmark decontamination by spaced seeds: hashes that ignore fixed word positions join tests and documents, and overlaps with substitutions are verified."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.text_arrays import bytes_of, mix, pieces, word_bounds, word_hashes
from postmill.session import ensure_checkpoint_dir

#: Word positions that each mask reads. Any 13 to 25 words of which a fifth is replaced agree in at least one mask somewhere.
MASKS = ((0, 1, 2, 7, 8, 9), (0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 8, 9), (0, 2, 3, 4, 6, 7), (0, 1, 3, 4, 5, 6))
#: Positions in items of so many words that are read too, so that the same holds for these. Items of under five words are read as a whole.
SHORT_MASKS = {
    **{n: (tuple(range(n)),) for n in range(1, 5)},
    5: ((2, 3, 4), (0, 1, 4), (1, 2, 3)),
    6: ((2, 3, 4, 5), (0, 1, 4, 5), (0, 1, 2, 3)),
    7: ((2, 3, 4, 5, 6), (0, 1, 2, 4, 6), (1, 2, 3, 4, 5)),
    8: ((1, 2, 3, 4, 5, 7),),
    10: ((1, 2, 3, 4, 5, 9), (3, 5, 6, 7, 8, 9)),
}
#: An overlap counts from this many words (all words of shorter items), of which this share must be equal.
LEAST_WORDS, SIMILARITY = 13, 0.8
#: Words of the benchmark that are broadcast at a time; a larger benchmark is searched in several passes.
BLOCK_WORDS = 200_000
_TABLE_BITS = 22

#: A-Z are read as a-z; ASCII characters other than letters and digits part words.
_TOKENS = np.full(256, 32, np.uint8)
_TOKENS[97:123] = _TOKENS[65:91] = np.arange(97, 123)
_TOKENS[48:58] = np.arange(48, 58)
_TOKENS[128:] = np.arange(128, 256)
LEAKS = "doc_id long, row long, item_id long, word_from int, word_to int, n_equal int, similarity double"


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text (one more at the end)."""
    data = _TOKENS[data]
    starts, ends, first = word_bounds(data, at)
    return word_hashes(data, starts, ends), first


def masked(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the mask's positions from each word on; empty if there are too few words."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[p : p + n]
    return mix(out + np.uint64(sum(1 << p for p in mask)))


def from_zero(mask: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(p - mask[0] for p in mask)


@dataclass(frozen=True)
class SeedBlock:
    """Items' words, and the sorted seed hashes of all masks with the words where they begin."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    at: np.ndarray
    table: np.ndarray


def seed_block(ids: list[int], texts: list[str]) -> SeedBlock:
    data, at = bytes_of(pa.array(texts, pa.string()))
    words, first = tokens(data, at)
    item = np.repeat(np.arange(len(ids)), np.diff(first))
    seeds, where = [], []
    for mask in MASKS:
        h = masked(words, mask)
        here = np.flatnonzero(item[: len(h)] == item[mask[-1] :])
        seeds.append(h[here])
        where.append(here)
    for n, masks in SHORT_MASKS.items():
        for k in np.flatnonzero(np.diff(first) == n):
            for mask in masks:
                a = int(first[k]) + mask[0]
                seeds.append(masked(words[a : int(first[k]) + mask[-1] + 1], from_zero(mask)))
                where.append(np.array([a]))
    seed, at = np.concatenate(seeds), np.concatenate(where)
    order = np.argsort(seed, kind="stable")
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[seed >> np.uint64(64 - _TABLE_BITS)] = True
    return SeedBlock(np.array(ids, np.int64), words, first, seed[order], at[order], table)


def _hits(words: np.ndarray, block: SeedBlock, masks) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts and words of the items at which a seed agrees."""
    docs, items = [], []
    for mask in masks:
        h = masked(words, mask)
        i = np.flatnonzero(block.table[h >> np.uint64(64 - _TABLE_BITS)])
        lo, hi = np.searchsorted(block.seeds, h[i], "left"), np.searchsorted(block.seeds, h[i], "right")
        i, lo, n = i[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        docs.append(np.repeat(i, n))
        items.append(block.at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(docs), np.concatenate(items)


def best_overlap(equal: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """The stretch [i, j) with the most equal words of which ``similarity`` are equal, and that number; the first of ties.

    A stretch qualifies if its sum of (1 - similarity) for an equal word and -similarity for another is not negative.
    """
    total = np.append(0, np.cumsum(np.where(equal, 1000 - round(1000 * similarity), -round(1000 * similarity))))
    count = np.append(0, np.cumsum(equal))
    best = (0, 0, 0)
    for i in np.flatnonzero(equal):
        j = np.flatnonzero(total[i + 1 :] >= total[i])
        if len(j):
            j = int(j[-1]) + i + 1
            while not equal[j - 1]:
                j -= 1
            if count[j] - count[i] > best[2]:
                best = (int(i), j, int(count[j] - count[i]))
    return best


def _leaks(block: SeedBlock):
    masks = list(MASKS) + sorted({from_zero(m) for n in np.unique(np.diff(block.first)) for m in SHORT_MASKS.get(int(n), ())} - set(MASKS))

    def verified(words, a, b, i, p):
        """Leaks of one text [a, b): item number, first word, end, equal words."""
        k = np.searchsorted(block.first, p, side="right") - 1
        found: dict[int, tuple[int, int, int]] = {}
        for item, shift in np.unique(np.stack([k, i - p], 1), axis=0):
            x, y = int(block.first[item]), int(block.first[item + 1])
            lo, hi = max(x, a - shift), min(y, b - shift)
            equal = words[lo + shift : hi + shift] == block.words[lo:hi]
            if y - x < LEAST_WORDS:
                # A short item counts as a whole, whichever of its words are replaced.
                s, e, n = (0, y - x, int(equal.sum())) if hi - lo == y - x and 1000 * int(equal.sum()) >= round(1000 * SIMILARITY) * (y - x) else (0, 0, 0)
            else:
                s, e, n = best_overlap(equal)
            if e - s >= min(LEAST_WORDS, y - x) and n > found.get(int(item), (0, 0, 0))[2]:
                found[int(item)] = (int(lo + shift - a) + s, int(lo + shift - a) + e, n)
        return found

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for r, t in pieces(at):
                words, first = tokens(data[at[r] : at[t]], at[r : t + 1] - at[r])
                i, p = _hits(words, block, masks)
                if not len(i):
                    continue
                order = np.argsort(i, kind="stable")
                i, p = i[order], p[order]
                doc = np.searchsorted(first, i, side="right") - 1
                out = []
                for d in np.unique(doc).tolist():
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    for item, (s, e, n) in sorted(verified(words, int(first[d]), int(first[d + 1]), i[lo:hi], p[lo:hi]).items()):
                        out.append((ids[r + d], keys[r + d], int(block.ids[item]), s, e, n, n / (e - s)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "row", "item_id", "word_from", "word_to", "n_equal", "similarity"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", row=None) -> DataFrame:
    """doc_id, row, item_id, word_from, word_to, n_equal, similarity: the best overlap of each document with each item it leaks.

    Words are runs of letters and digits, A-Z as a-z. An overlap is a stretch of the document's words against as many of the item's,
    in order, with at least 80 % equal, from 13 words on (the whole item with any of its words replaced, if shorter); the one with the most equal words is
    returned, counted in the document's words. Every seed hit of the whole text is verified. Null and empty texts and items, and
    items without id, leak nothing. ``row`` may name what else a row is told apart by (null if not given); rows that repeat an
    id each give their own leaks. Items that repeat an id count one by one. Other columns are not read.

    The benchmark is broadcast in blocks of at most BLOCK_WORDS words, one pass over the documents for each; when there are
    several, each pass is written before the next, so the driver holds one block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(None) if row is None else row).cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length(item_text_col) - F.length(F.translate(item_text_col, " \n\t\r", "")) + 1
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"), size.alias("words"))
    n = items.agg(F.sum("words")).first()[0] or 0
    parts, out = max(1, -(-n // BLOCK_WORDS)), None
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        got = sorted((r["id"], r["text"]) for r in mine.select("id", "text").collect())
        if not got:
            continue
        leaks = rows.mapInArrow(_leaks(seed_block([r[0] for r in got], [r[1] for r in got])), LEAKS)
        if parts > 1:
            ensure_checkpoint_dir(spark)
            leaks = leaks.checkpoint()
        out = leaks if out is None else out.union(leaks)
    return out if out is not None else spark.createDataFrame([], LEAKS)
