"""Best sets per set by Jaccard, exactly, in blocks: no pair of sets is ever a row, only what can be among the best is.

Sets of both sides are packed into blocks by part and size, with the block's own words. Every asked set first gets a score that it
surely reaches, from the largest sets of its part; a pair of blocks meets only where the sizes allow one of these scores. An asked block meets
its offered blocks in one task, the largest sets first, so that its scores rise and fewer of the smaller sets count. Inside a pair of
blocks, overlaps of tiles are counted bits of the frequent common words, and the rest are added word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import ensure_checkpoint_dir

#: Sets of a block at most, asked and offered; the largest sets of a part that give the first scores.
ASKED_ROWS, OFFERED_ROWS, SEEDS = 8192, 16384, 2048
#: Asked sets of a block at least, but for the last ones.
LEAST_ROWS = 1024
#: Asked and offered sets of a tile, offered sets of a size that make a tile of their own, and words that are compared as bits.
ASKED_STEP, OFFERED_STEP, LEAST_STEP, DENSE = 256, 1024, 128, 512
#: Tasks at most in which asked blocks meet offered ones.
MOST_TASKS = 4096
PACKED = "ids binary, sizes binary, codes binary, words array<string>"


def _pack(ids: np.ndarray, lists: pa.ListArray) -> list[pa.Array]:
    """Ids, set sizes, words as numbers and the words of a block, as one row."""
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    kind = np.uint8 if len(coded.dictionary) < 1 << 8 else np.uint16 if len(coded.dictionary) < 1 << 16 else np.int32
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int32)
    words = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
    return [pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, codes.astype(kind))] + [words]


class _Block:
    def __init__(self, ids: bytes, sizes: bytes, codes: bytes, words: list[str]):
        self.ids, self.sizes, self.words = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), words
        self.codes = np.frombuffer(codes, np.uint8 if len(words) < 1 << 8 else np.uint16 if len(words) < 1 << 16 else np.int32)
        self.row = np.repeat(np.arange(len(self.ids)), self.sizes)

    def entries(self, dims: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, dimension) of the words that have one."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        at, dim = place[self.row], dims[self.codes]
        keep = (at >= 0) & (dim >= 0)
        return at[keep], dim[keep]


def _bits(at: np.ndarray, dim: np.ndarray, n: int, width: int) -> np.ndarray:
    """Frequent words of each set as bits, 64 to a lane."""
    out = np.zeros((n, max(1, -(-width // 64))), np.uint64)
    np.add.at(out, (at, dim >> 6), np.uint64(1) << (dim & 63).astype(np.uint64))
    return out


def _tiles(sizes: np.ndarray) -> list[slice]:
    """Cuts of falling sizes: of OFFERED_STEP sets at most, and where the size changes if that leaves no tiny tile."""
    cuts = [0]
    for end in [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]:
        if end - cuts[-1] >= LEAST_STEP or end == len(sizes):
            cuts += [*range(cuts[-1] + OFFERED_STEP, end, OFFERED_STEP), end]
    return [slice(x, y) for x, y in zip(cuts, cuts[1:])]


def search(c: _Block, floor: np.ndarray, p: _Block, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of asked sets, places of offered sets and scores of the pairs that can be among an asked set's ``top``.

    Offered sets come in the order that settles equal scores. ``floor`` is a score that the asked set reaches ``top`` times, or 0. Only
    pairs that share a word count.
    """
    at = {w: k for k, w in enumerate(c.words)}
    both_have = [(k, at[w]) for k, w in enumerate(p.words) if w in at]
    counts = np.bincount(p.codes, minlength=len(p.words))
    both_have.sort(key=lambda x: -counts[x[0]])
    p_dims, c_dims = np.full(len(p.words), -1), np.full(len(c.words), -1)
    for d, (k, i) in enumerate(both_have):
        p_dims[k], c_dims[i] = d, d
    width = min(len(both_have), DENSE)
    by_size = np.argsort(-p.sizes, kind="stable")
    sizes = p.sizes[by_size]
    o_at, o_dim = p.entries(p_dims, by_size)
    offered = _bits(o_at[o_dim < width], o_dim[o_dim < width], len(by_size), width)
    o_at, o_dim = o_at[o_dim >= width], o_dim[o_dim >= width]
    order = np.argsort(o_dim, kind="stable")
    o_at, o_dim = o_at[order], o_dim[order]
    s_at, s_dim = c.entries(c_dims, np.arange(len(c.ids)))
    asked = _bits(s_at[s_dim < width], s_dim[s_dim < width], len(c.ids), width)
    s_at, s_dim = s_at[s_dim >= width], s_dim[s_dim >= width]

    tiles = []
    for cut in _tiles(sizes):
        mine = (o_at >= cut.start) & (o_at < cut.stop)
        tiles.append((by_size[cut], sizes[cut], offered[cut], o_at[mine] - cut.start, o_dim[mine]))
    out = []
    for a in range(0, len(c.ids), ASKED_STEP):
        rows = slice(a, min(a + ASKED_STEP, len(c.ids)))
        cn, f = c.sizes[rows], floor[rows].astype(np.float64)
        bits, own = asked[rows], slice(*np.searchsorted(s_at, [rows.start, rows.stop]))
        words = s_at[own] - a, s_dim[own]
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for cols, pn, tile, t_at, t_dim in tiles:
            if not (pn[0] >= f * cn - 1e-9).any():
                break  # the rest is smaller still
            live = np.flatnonzero((pn[0] >= f * cn - 1e-9) & (pn[-1] * f <= cn + 1e-9))
            if not len(live):
                continue
            both = _overlap(bits, tile, *words, t_at, t_dim, live)
            new = np.flatnonzero(f[live] == 0)
            if len(new) and len(cols) >= top:
                first = both[new, : max(top, LEAST_STEP)].astype(np.float64)
                score = first / (cn[live[new], None] + pn[: first.shape[1]] - first)
                f[live[new]] = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
            # Shared words >= f / (1 + f) * (both sizes), by the least size of the tile; what is left is settled by its score.
            r = f[live] / (1 + f[live])
            need = np.maximum(np.ceil(r * (cn[live] + pn[-1]) - 1e-6), 1)
            hits = np.flatnonzero(both >= np.minimum(need, np.iinfo(both.dtype).max).astype(both.dtype)[:, None])
            i, j = np.divmod(hits, len(cols))
            both = both.ravel()[hits].astype(np.float64)
            i = live[i]
            score = both / (cn[i] + pn[j] - both)
            keep = score >= f[i]
            if not keep.any():
                continue
            held = _heads(*(np.concatenate(x) for x in zip(held, (i[keep], cols[j[keep]], score[keep]), strict=True)), top)
            full = np.flatnonzero(np.bincount(held[0], minlength=len(cn)) == top)
            f[full] = np.maximum(f[full], held[2][np.searchsorted(held[0], full, side="right") - 1])
        out.append((held[0] + a, held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _overlap(bits, tile, s_at, s_dim, o_at, o_dim, live) -> np.ndarray:
    """Shared words of the ``live`` asked sets and a tile: bits of the frequent words, a lane at a time, then the others word by word."""
    mine = bits if len(live) == len(bits) else bits[live]
    out = np.bitwise_count(mine[:, :1] & tile[:, 0])
    for lane in range(1, bits.shape[1]):
        out = np.add(out, np.bitwise_count(mine[:, lane : lane + 1] & tile[:, lane]), dtype=np.uint16)
    if len(s_dim) and len(o_dim):
        place = np.full(len(bits), -1)
        place[live] = np.arange(len(live))
        row, dim = place[s_at], s_dim
        row, dim = row[row >= 0], dim[row >= 0]
        lo, hi = (np.searchsorted(o_dim, dim, side=s) for s in ("left", "right"))
        size = hi - lo
        j = o_at[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        out = out.astype(np.int32)
        np.add.at(out, (np.repeat(row, size), j), 1)
    return out


def _heads(row, place, score, top):
    order = np.lexsort((place, -score, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < top
    return row[keep], place[order][keep], score[order][keep]


def _parts(batches, rows: int) -> Iterator[pa.Table]:
    """Rows of a partition that is sorted by part, up to ``rows`` of one part at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = batch.column("part").to_pylist()
        a = 0
        while a < batch.num_rows:
            room = rows - sum(b.num_rows for b in held)
            b = next((k for k in range(a, min(batch.num_rows, a + room)) if names[k] != names[a]), min(batch.num_rows, a + room))
            if held and (held[0].column("part")[0].as_py() != names[a]):
                yield pa.Table.from_batches(held)
                held = []
                continue
            held.append(batch.slice(a, b - a))
            a = b
            if sum(x.num_rows for x in held) >= rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _columns(some: pa.Table) -> list[pa.Array]:
    lists = some.column("keys").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else pa.concat_arrays([lists])
    return _pack(some.column("no").to_numpy().astype(np.int64), lists)


NAMES = ["ids", "sizes", "codes", "words"]


def _offer(batches):
    for some in _parts(batches, OFFERED_ROWS):
        packed = _columns(some)
        sizes = np.frombuffer(packed[1][0].as_py(), np.int32)
        yield pa.record_batch([some.column("part")[:1].combine_chunks(), pa.array([int(sizes.max())], pa.int32()), pa.array([int(sizes.min())], pa.int32()), *packed], names=["part", "hi", "lo", *(f"p_{n}" for n in NAMES)])


def _ask(rows: int, seeds: dict[str, tuple], top: int):
    """Blocks of asked sets with their floors, and the sizes between which one of their sets may find something."""

    def run(batches):
        blocks = {part: _Block(*x) for part, x in seeds.items()}
        for some in _parts(batches, rows):
            packed, part = _columns(some), some.column("part")[0].as_py()
            c = _Block(*(x[0].as_py() for x in packed))
            floor = np.zeros(len(c.ids))
            if part in blocks:
                who, _, score = search(c, floor, blocks[part], top)
                full = np.flatnonzero(np.bincount(who, minlength=len(floor)) == top)
                floor[full] = score[np.searchsorted(who, full, side="right") - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.where(floor > 0, c.sizes / floor + 1e-6, np.inf).max()
            yield pa.record_batch([some.column("part")[:1].combine_chunks(), pa.array([float((floor * c.sizes).min() - 1e-6)]), pa.array([float(most)]), pa.array([floor.tobytes()], pa.binary()), *packed], names=["part", "least", "most", "floors", *(f"c_{n}" for n in NAMES)])

    return run


def _compare(top: int):
    """Each asked block (it has floors) comes before the offered blocks that it meets, which come by falling size: floors rise from block to block."""

    def met(c: _Block, held: list[np.ndarray]):
        return pa.record_batch({"ask_no": c.ids[held[0]], "offer_no": held[1], "score": held[2]})

    def run(batches):
        c = None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                block = _Block(*(get(n) for n in NAMES))
                if (floors := get("floors")) is not None:
                    if c is not None:
                        yield met(c, held)
                    c, floor, best = block, np.frombuffer(floors, np.float64).copy(), np.zeros((len(block.ids), top))
                    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                    continue
                who, what, score = search(c, floor, block, top)
                if not len(who):
                    continue
                new = np.zeros_like(best)
                order = np.argsort(who, kind="stable")
                new[who[order], np.arange(len(who)) - np.searchsorted(who[order], who[order])] = score[order]
                best = np.partition(np.hstack([best, new]), top, axis=1)[:, top:]
                floor = np.maximum(floor, best[:, 0])
                held = [np.concatenate(x) for x in zip(held, (who, block.ids[what], score), strict=True)]
                keep = held[2] >= floor[held[0]]
                held = [x[keep] for x in held]
        if c is not None:
            yield met(c, held)

    return run


def best_sets(asked: DataFrame, offered: DataFrame, ties: Sequence[Column], top: int) -> DataFrame:
    """(ask_no, offer_no, score): pairs of sets of one part that share a word, among them each asked set's ``top`` by score and ``ties``.

    Both tables have (no, part, keys), of distinct keys, and must give the same rows whenever they are read; ``offered`` may have further columns that
    ``ties`` reads. Rows without part or keys take no part. Each pair of blocks gives at most ``top`` rows for an asked set, and only those that
    reach the ``top`` best scores of all its blocks are left.
    """
    spark = asked.sparkSession
    ensure_checkpoint_dir(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked, offered = (x.filter(F.col("part").isNotNull() & (F.size("keys") > 0)) for x in (asked, offered))
    n_asked, n_offered = asked.count(), offered.count()
    size = F.size("keys")
    w = Window.partitionBy("part").orderBy(size.desc(), "no")
    seeds = offered.select("part", "no", "keys").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= SEEDS)
    seeds = {b.column("part")[0].as_py(): tuple(b.column(f"p_{n}")[0].as_py() for n in NAMES) for b in _seed_blocks(seeds)}

    dealt = max(1, min(-(-n_offered // OFFERED_ROWS) + 32, -(-n_offered // 256)))
    p = offered.withColumn("_n", size).repartitionByRange(dealt, "part", F.desc("_n"), "no").sortWithinPartitions("part", *ties).select("no", "part", "keys")
    p = p.mapInArrow(_offer, "part string, hi int, lo int, " + ", ".join(f"p_{x}" for x in PACKED.split(", "))).withColumn("p_no", F.monotonically_increasing_id()).checkpoint()
    rows = min(ASKED_ROWS, max(LEAST_ROWS, -(-n_asked // tasks)))
    blocks = max(1, -(-n_asked // rows))
    q = asked.withColumn("_n", size).repartitionByRange(blocks, "part", "_n", "no").sortWithinPartitions("part", "_n", "no").select("no", "part", "keys")
    q = q.mapInArrow(_ask(rows, seeds, top), "part string, least double, most double, floors binary, " + ", ".join(f"c_{x}" for x in PACKED.split(", "))).withColumn("c_no", F.monotonically_increasing_id()).checkpoint()

    # An asked block and the offered blocks that it meets go to one task, dealt by number so that size in bytes does not choose how many run.
    # Where asked blocks are fewer than tasks, lanes share the offered ones.
    lanes = -(-tasks // blocks)
    meet = (F.col("hi") >= F.col("least")) & (F.col("lo") <= F.col("most"))
    pairs = q.select("c_no", "part", "least", "most").join(p.select("p_no", "part", "hi", "lo"), "part").filter(meet).select("c_no", "p_no")
    met = pairs.join(p, "p_no").select("c_no", F.pmod("p_no", F.lit(lanes)).cast("int").alias("lane"), "hi", "lo", F.lit(None).cast("binary").alias("floors"), *(F.col(f"p_{n}").alias(n) for n in NAMES))
    none = F.lit(None).cast("int")
    work = q.select("c_no", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), none.alias("hi"), none.alias("lo"), "floors", *(F.col(f"c_{n}").alias(n) for n in NAMES)).unionByName(met)
    work = work.repartition(min(MOST_TASKS, 2 * blocks * lanes), "c_no", "lane").sortWithinPartitions("c_no", "lane", F.desc_nulls_first("hi"), F.desc("lo"))
    return work.select("floors", *NAMES).mapInArrow(_compare(top), "ask_no long, offer_no long, score double")


def _seed_blocks(seeds: DataFrame) -> list[pa.RecordBatch]:
    """The largest sets of each part, packed: SEEDS of them for each of a closed set of parts reach the driver."""
    table = seeds.orderBy("part", "nth").select("no", "part", "keys").toArrow()
    return [b for b in _offer(table.to_batches()) if b.num_rows]
