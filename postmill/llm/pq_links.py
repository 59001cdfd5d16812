"""Embedding near-duplicates by product quantisation: inverted lists of residual codes, table distances over enough probes, exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import connected_components
from postmill.llm.vectors import dense
from postmill.operators.spread import attach_group
from postmill.session import ensure_checkpoint_dir

LINK = 0.95
#: Vectors that are fitted on at most, rows of a list, lists at most, rounds of the fits.
SAMPLE, LIST_ROWS, LISTS, ROUNDS = 32768, 1024, 4096, 10
#: Subspaces of a residual and codes of each.
SUBSPACES, CODES = 8, 256
#: How far across the border of two lists a pair's ends may lie, in standard deviations of a difference without direction.
REACH = 4.0
#: Vectors of the sample that make a place dense.
DENSE = 8
#: Members of a bundle that one task packs, members of a part of a list, vectors of a packed block, rows and pairs worked on at a time.
BUNDLED, PART, PACK, STEP, PAIRS = 1 << 18, 4096, 1024, 256, 1 << 15
#: Angles of bundles are compared with this much to spare.
SLACK = 1e-6
BLOCKS = "bundle binary, keys array<binary>, weights array<long>, vectors binary"
CODED = "home int, probes array<int>, code binary, err double"
FOUND = "kind int, a binary, b binary, x long, y long"


@dataclass(frozen=True)
class Index:
    """Unit centroids of the lists, codebooks of the residuals, pivots of the dense places, and the links that are looked for."""

    centroids: np.ndarray
    books: np.ndarray
    pivots: np.ndarray
    link: float
    margin: float

    @property
    def angle(self) -> float:
        return math.acos(self.link)


# ---- vectors ---------------------------------------------------------------


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their scale."""
    m = m / np.abs(m).max(1, keepdims=True, initial=0)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def unpacked(column: pa.Array | list[bytes], width: int) -> np.ndarray:
    """Unit vectors of packed ones, of single or double precision."""
    values = column if isinstance(column, list) else column.to_pylist()
    out = np.empty((len(values), width))
    single = np.array([len(v) == 4 * width for v in values], bool)
    for which, kind in ((single, "<f4"), (~single, "<f8")):
        at = np.flatnonzero(which)
        if len(at):
            out[at] = np.frombuffer(b"".join(values[k] for k in at), kind).reshape(len(at), width)
    return unit(out) if len(out) else out


def _packed(width: int, kind: str):
    """Id, key and bytes of each row; the key is null for ids and vectors that are linked with nothing."""

    def run(batches):
        for batch in batches:
            rows, m = dense(batch.column("v"), width)
            some = np.abs(m).max(1, initial=0) > 0
            rows, m = rows[some], (m[some] + 0.0).astype(kind)
            raw: list[bytes | None] = [None] * batch.num_rows
            key: list[bytes | None] = [None] * batch.num_rows
            named = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            for r, row in zip(rows.tolist(), m, strict=True):
                if named[r]:
                    raw[r] = row.tobytes()
                    key[r] = hashlib.blake2b(raw[r], digest_size=16).digest()
            yield pa.record_batch([batch.column("vec_id"), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "raw"])

    return run


# ---- index -----------------------------------------------------------------


def _means(x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((n, x.shape[1]))
    np.add.at(sums, owner, x)
    return sums, np.bincount(owner, minlength=n)


def cluster(x: np.ndarray, n: int, sphere: bool) -> np.ndarray:
    """``n`` centroids of the rows of x, which come in a random order; of length 1 on the sphere."""
    c = x[:n].copy()
    for _ in range(ROUNDS):
        owner = np.concatenate([np.argmax(x[a : a + 4096] @ c.T - (0 if sphere else (c * c).sum(1) / 2), 1) for a in range(0, len(x), 4096)])
        sums, size = _means(x, owner, len(c))
        some = size > 0
        if sphere:
            some &= np.abs(sums).max(1) > 1e-9
            c[some] = unit(sums[some])
        else:
            c[some] = sums[some] / size[some, None]
    return c


def _split(m: np.ndarray) -> np.ndarray:
    """Rows in SUBSPACES parts, with zeros behind: subspace, row, coordinate."""
    part = -(-m.shape[1] // SUBSPACES)
    out = np.zeros((len(m), part * SUBSPACES))
    out[:, : m.shape[1]] = m
    return out.reshape(len(m), SUBSPACES, part).transpose(1, 0, 2)


def dense_places(x: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the places where DENSE or more of the unit vectors x lie within ``angle``, and which vectors are in none."""
    found, left, least = [], np.ones(len(x), bool), math.cos(angle)
    for a in range(0, len(x), 512):
        seeds = np.flatnonzero(left[a : a + 512]) + a
        near = x[seeds] @ x.T >= least
        for s, row in zip(seeds.tolist(), near, strict=True):
            row &= left
            if not left[s] or row.sum() < DENSE:
                continue
            mean = x[row].sum(0)
            centre = mean / np.sqrt(mean @ mean)
            within = left & (x @ centre >= least)
            if within.sum() >= DENSE:
                found.append(centre)
                left &= ~within
    return np.array(found).reshape(-1, x.shape[1]), left


def build(sample: np.ndarray, rows: int, link: float, reach: float | None) -> Index:
    """Pivots, lists and codebooks fitted on unit vectors, for a table of ``rows`` of them."""
    pivots, left = dense_places(sample, math.acos(link) / 2 - 2 * SLACK)
    # What the pivots stand for is one vector each from here on, so that large groups don't get lists of their own.
    fit = np.concatenate([sample[left], pivots])
    lists = max(1, min(LISTS, int(rows * left.mean()) // LIST_ROWS, len(fit)))
    centroids = cluster(fit, lists, True)
    home = np.concatenate([np.argmax(fit[a : a + 4096] @ centroids.T, 1) for a in range(0, len(fit), 4096)])
    rest = _split(fit - centroids[home])
    books = np.stack([cluster(part, min(CODES, len(fit)), False) for part in rest])
    chord = math.sqrt(2 - 2 * link)
    margin = chord / 2
    if reach is not None:
        margin = min(margin, reach / 2 * chord / math.sqrt(sample.shape[1]))
    return Index(centroids, books, pivots, link, margin)


def encoded(index: Index, u: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """List, lists to probe, code, and length of what the code leaves, of unit vectors.

    A list is probed if the border between it and the vector's own list is at most ``index.margin`` + rho away.
    """
    home, probes = np.empty(len(u), np.int32), []
    code, err = np.empty((len(u), SUBSPACES), np.uint8), np.empty(len(u))
    for a in range(0, len(u), STEP):
        x, r = u[a : a + STEP], rho[a : a + STEP]
        dot = x @ index.centroids.T
        h = np.argmax(dot, 1)
        gap = dot[np.arange(len(x)), h][:, None] - dot
        i, j = np.nonzero(gap <= 2 * (index.margin + r)[:, None])
        apart = np.sqrt(((index.centroids[h[i]] - index.centroids[j]) ** 2).sum(1))
        near = (gap[i, j] <= (index.margin + r[i]) * apart + 1e-12) | (j == h[i])
        i, j = i[near], j[near].astype(np.int32)
        probes += np.split(j, np.searchsorted(i, np.arange(1, len(x))))
        rest = _split(x - index.centroids[h])
        left = np.zeros(len(x))
        for s, (part, book) in enumerate(zip(rest, index.books, strict=True)):
            best = np.argmin((book * book).sum(1) - 2 * part @ book.T, 1)
            code[a : a + len(x), s] = best
            left += ((part - book[best]) ** 2).sum(1)
        home[a : a + len(x)], err[a : a + len(x)] = h, np.sqrt(left)
    return home, probes, code, err


def _encode(index: Index, vector: str, keep: tuple[str, ...]):
    width = index.centroids.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unpacked(batch.column(vector), width)
            rho = batch.column("rho").to_numpy() if "rho" in batch.schema.names else np.zeros(len(u))
            home, probes, code, err = encoded(index, u, rho)
            ends = np.append(0, np.cumsum([len(p) for p in probes])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(probes), pa.int32()))
            out = [pa.array(home), lists, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err)]
            yield pa.record_batch([batch.column(c) for c in keep] + out, names=[*keep, "home", "probes", "code", "err"])

    return run


# ---- bundles ---------------------------------------------------------------


def _placed(index: Index):
    """Rows with the nearest pivot within half a link's angle, and that angle; null if there is none."""
    width, most = index.centroids.shape[1], index.angle / 2 - 2 * SLACK

    def run(batches):
        for batch in batches:
            u = unpacked(batch.column("raw"), width)
            pivot, away = np.full(len(u), -1, np.int32), np.full(len(u), 10.0)
            for a in range(0, len(u), STEP) if len(index.pivots) else ():
                dot = u[a : a + STEP] @ index.pivots.T
                best = np.argmax(dot, 1)
                pivot[a : a + STEP] = best
                away[a : a + STEP] = np.arccos(np.clip(dot[np.arange(len(best)), best], -1, 1))
            none = away > most
            yield pa.record_batch([*batch.columns, pa.array(pivot, mask=none), pa.array(away, mask=none)], names=[*batch.schema.names, "pivot", "away"])

    return run


def _blocks(batches):
    """Members of bundles, PACK or fewer of one bundle in a row; a partition's rows come sorted by bundle."""
    held: dict[bytes, list[tuple]] = {}

    def table() -> pa.RecordBatch:
        names, rows = zip(*((name, zip(*rows, strict=True)) for name, rows in held.items() if rows), strict=True)
        keys, weights, raws = zip(*rows, strict=True)
        return pa.record_batch([pa.array(names, pa.binary()), pa.array(map(list, keys), pa.list_(pa.binary())), pa.array(map(list, weights), pa.list_(pa.int64())), pa.array([b"".join(r) for r in raws], pa.binary())], names=["bundle", "keys", "weights", "vectors"])

    for batch in batches:
        for name, *row in zip(*[batch.column(c).to_pylist() for c in ("bundle", "key", "weight", "raw")], strict=True):
            if held and (name not in held or len(held[name]) == PACK):
                yield table()
                held.clear()
            held.setdefault(name, []).append(tuple(row))
    if held:
        yield table()


# ---- search ----------------------------------------------------------------


def _words(keys: list[bytes]) -> np.ndarray:
    """Names of bundles as numbers that are equal for equal names."""
    return np.frombuffer(b"".join(k.ljust(24, b"\0") for k in keys), "<u8").reshape(-1, 3)


class _Cell:
    """One part of a list: its members, the links found so far, and what connects them."""

    def __init__(self, index: Index, home: int, rows: dict):
        self.index, self.home, self.rows = index, home, rows
        self.u = unpacked(rows["vector"], index.centroids.shape[1])
        self.name = _words(rows["bundle"])
        self.rho, self.total = np.array(rows["rho"]), np.array(rows["total"], np.int64)
        self.code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(-1, SUBSPACES)
        self.err = np.array(rows["err"])
        self.extra = np.zeros(len(self.u), np.int64)
        self.parent = np.arange(len(self.u))
        lists = len(index.centroids)
        self.probed = np.sort(np.concatenate([np.asarray(p, np.int64) + lists * k for k, p in enumerate(rows["probes"])]))

    def near(self, q: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and members whose distance, by the tables, may be that of a link: at most its chord and what the code leaves."""
        rest = _split(q - self.index.centroids[self.home])
        far = np.zeros((len(q), len(self.u)), np.float32)
        for s, (part, book) in enumerate(zip(rest, self.index.books, strict=True)):
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            far += np.take(table.astype(np.float32), self.code[:, s], axis=1)
        angle = np.minimum(self.index.angle + rho[:, None] + self.rho, math.pi)
        chord = (2 * np.sin(angle / 2) + self.err + 1e-3).astype(np.float32)
        return np.nonzero(far <= chord * chord)

    def ask(self, rows: dict) -> Iterator[tuple]:
        """Links of some queries with the members: their number by query, the edges that connect, and pairs that need a closer look."""
        q, rho, total = unpacked(rows["vector"], self.u.shape[1]), np.array(rows["rho"]), np.array(rows["total"], np.int64)
        name, home, node = _words(rows["bundle"]), np.array(rows["home"], np.int64), rows["node"]
        i, j = self.near(q, rho)
        other = (name[i] != self.name[j]).any(1)
        i, j = i[other], j[other]
        cos = np.empty(len(i))
        for a in range(0, len(i), PAIRS):
            cos[a : a + PAIRS] = np.einsum("ij,ij->i", q[i[a : a + PAIRS]], self.u[j[a : a + PAIRS]])
        wide = rho[i] + self.rho[j]
        angle = np.arccos(np.clip(cos, -1, 1))
        alone = wide == 0
        sure = np.where(alone, cos >= self.index.link, angle <= self.index.angle - wide - SLACK)
        open_ = ~alone & ~sure & (angle <= self.index.angle + wide + SLACK)
        for x, y in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            a, b = rows["bundle"][x], self.rows["bundle"][y]
            yield 2, min(a, b), max(a, b), None, None
        i, j = i[sure], j[sure]
        if not len(i):
            return
        links = np.zeros(len(q), np.int64)
        np.add.at(links, i, self.total[j])
        for x in np.flatnonzero(links).tolist():
            yield 0, rows["bundle"][x], None, int(links[x]), None
        # A member that doesn't probe the query's list won't find it there: its side is counted here.
        code = j * len(self.index.centroids) + home[i]
        at = np.minimum(np.searchsorted(self.probed, code), len(self.probed) - 1)
        unasked = (home[i] != self.home) & (self.probed[at] != code)
        np.add.at(self.extra, j[unasked], total[i[unasked]])
        heads = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(i)).tolist(), strict=True):
            roots = np.unique(self.parent[j[a:b]])
            for r in roots.tolist():
                yield 1, None, None, node[i[a]], self.rows["node"][r]
            if len(roots) > 1:
                self.parent[np.isin(self.parent, roots)] = roots[0]

    def close(self) -> Iterator[tuple]:
        for k in np.flatnonzero(self.extra).tolist():
            yield 0, self.rows["bundle"][k], None, int(self.extra[k]), None


def _searched(index: Index, parts: int):
    """Links within the cells; rows come sorted by cell, a cell's members first, and then its queries, however many."""
    names = ("bundle", "node", "total", "rho", "vector", "home", "probes", "code", "err")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kind, a, b, x, y = zip(*rows, strict=True)
        return pa.record_batch([pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["kind", "a", "b", "x", "y"])

    def run(batches):
        now, members, cell, out = None, None, None, []
        for batch in batches:
            cells, roles = batch.column("cell").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != now:
                    if cell is not None:
                        out += cell.close()
                    now, members, cell = int(cells[a]), {c: [] for c in names}, None
                part = batch.slice(a, b - a)
                if roles[a] == 0:
                    for c in names:
                        members[c] += part.column(c).to_pylist()
                    continue
                if not members["bundle"]:
                    continue
                if cell is None:
                    cell = _Cell(index, now // parts, members)
                for at in range(0, b - a, STEP):
                    some = part.slice(at, STEP)
                    out += cell.ask({c: some.column(c).to_pylist() for c in names[:6]})
                if len(out) >= PAIRS:
                    yield table(out)
                    out = []
        if cell is not None:
            out += cell.close()
        if out:
            yield table(out)

    return run


def _expanded(index: Index):
    """Links between the members of two blocks, for bundles that are neither wholly linked nor wholly apart."""
    width = index.centroids.shape[1]

    def read(row, side):
        keys = row[f"keys_{side}"]
        kind = "<f4" if len(row[f"vectors_{side}"]) == 4 * width * len(keys) else "<f8"
        return keys, np.array(row[f"weights_{side}"], np.int64), unit(np.frombuffer(row[f"vectors_{side}"], kind).reshape(-1, width).astype(float))

    def run(batches):
        for batch in batches:
            keys, links, x, y = [], [], [], []
            for row in batch.to_pylist():
                (ka, wa, a), (kb, wb, b) = read(row, "a"), read(row, "b")
                near = (a @ b.T) >= index.link
                if near.any():
                    x.append(row["node_a"])
                    y.append(row["node_b"])
                for names, n in ((ka, near @ wb), (kb, near.T @ wa)):
                    some = np.flatnonzero(n).tolist()
                    keys += [names[k] for k in some]
                    links += [int(n[k]) for k in some]
            yield pa.record_batch([pa.array([0] * len(keys) + [1] * len(x), pa.int32()), pa.array(keys + [None] * len(x), pa.binary()), pa.nulls(len(keys) + len(x), pa.binary()), pa.array(links + x, pa.int64()), pa.array([None] * len(keys) + y, pa.int64())], names=["kind", "a", "b", "x", "y"])

    return run


def linked_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", link: float = LINK, reach: float | None = REACH) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``df``; two vectors are linked if their cosine, in doubles, is ``link`` or more.

    n_links counts the other rows that a row is linked with, copies among them; component_id is the smallest id that can be reached, kept whether
    that is the row's own. Vectors that are null, zero, or hold null or non-finite components are linked with nothing, and neither is a
    row without id (which has no component, and is kept); shorter vectors are read as if zeros followed. Every row is a vector of its
    own, also where ids repeat; vectors whose smallest id is the same share a component. Pairs at ``link`` itself are linked, as far as
    doubles can tell. Other columns are not read; an empty table gives an empty result.

    1. Equal vectors are one. SAMPLE of them at most, the first by their hash, fit unit centroids, one for about LIST_ROWS vectors and LISTS at
       most, and the codebooks of the residuals.
    2. Where DENSE vectors of the sample lie within half the angle of a link, their mean is a pivot. All vectors of the table that close
       to it are a *bundle*: linked with each other, without comparing them. So a group of near copies that holds some thousandth of
       all vectors, or more, is one bundle or a few.
    3. Each bundle, by its pivot, and each other vector is put into the list of the nearest centroid, and coded. It probes the lists whose border with its own list is near. Per list, table distances leave out the
       members that cannot be linked (the distance to a member's code less what its code leaves is a lower bound, so this loses nothing), and
       exact cosines decide the rest. Bundles are linked as a whole, or not at all, where their angles say so; the others' members meet in blocks.
    4. A list of more than PART bundles is searched in parts. A cell sends the links of a vector as a number, and edges for what is not connected
       yet, so its output grows with its rows, not with pairs.

    A pair is counted for both its ends if either of them probes the other's list. So a pair is missed only if both ends are
    further from the border between their lists than the margin: never at ``reach`` = None (half a link's chord), and at the default only
    where the difference of the two points across that border by more than REACH standard deviations of a difference without direction.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    width = max(df.select(F.max(F.size(vector_col)).alias("w")).first()["w"] or 0, 0)
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(F.col(vector_col).cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    rows = every.mapInArrow(_packed(max(width, 1), "<f4" if single else "<f8"), "vec_id long, key binary, raw binary").checkpoint()
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("raw").alias("raw")).checkpoint()
    n = classes.count()
    apart = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return apart
    sample = classes.select("key", "raw").orderBy("key").limit(SAMPLE).toArrow()
    index = build(unpacked(sample.column("raw").combine_chunks(), width), n, link, reach)

    # Bundles: at most one for DENSE vectors of the sample. Those of more than BUNDLED members are packed by several tasks.
    placed = classes.mapInArrow(_placed(index), "key binary, node long, weight long, raw binary, pivot int, away double").checkpoint()
    name = F.concat(F.lit("pivot "), F.col("pivot").cast("string")).cast("binary")
    sums = placed.where("pivot IS NOT NULL").groupBy("pivot").agg(F.min("node").alias("node"), F.sum("weight").alias("total"), F.max("away").alias("away"), F.count("*").alias("size"))
    bundles = sums.select(name.alias("bundle"), "node", "total", (F.col("away") + SLACK).alias("rho"), "pivot", "size").collect()
    heads = spark.createDataFrame([(bytes(r["bundle"]), r["node"], r["total"], r["rho"], index.pivots[r["pivot"]].astype("<f8").tobytes()) for r in bundles], "bundle binary, node long, total long, rho double, vector binary")
    alone = placed.where("pivot IS NULL")
    heads = heads.union(alone.select("key", "node", "weight", F.lit(0.0), "raw"))
    salts = {r["pivot"]: -(-r["size"] // BUNDLED) for r in bundles}
    deal = F.get(F.array(*[F.lit(salts.get(k, 1)) for k in range(max(len(index.pivots), 1))]), F.col("pivot"))
    packed = placed.where("pivot IS NOT NULL").select(name.alias("bundle"), "key", "weight", "raw", F.pmod(F.xxhash64("key"), deal).alias("salt"))
    packed = packed.repartition("bundle", "salt").sortWithinPartitions("bundle", "salt").drop("salt").mapInArrow(_blocks, BLOCKS)
    blocks = packed.union(alone.select("key", F.array("key"), F.array("weight"), "raw")).checkpoint()
    kept = ("bundle", "node", "total", "rho", "vector")
    nodes = heads.mapInArrow(_encode(index, "vector", kept), f"bundle binary, node long, total long, rho double, vector binary, {CODED}").checkpoint()

    # Cells: a list, or a part of one. LISTS numbers at most reach the driver.
    sizes = {r["home"]: r["n"] for r in nodes.groupBy("home").agg(F.count("*").alias("n")).collect()}
    parts = -(-max(sizes.values()) // PART)
    of = F.array(*[F.lit(-(-sizes.get(k, 1) // PART)) for k in range(len(index.centroids))])
    mine = F.pmod(F.xxhash64("bundle"), F.get(of, F.col("home")))
    members = nodes.select((F.col("home").cast("long") * parts + mine).alias("cell"), F.lit(0).alias("role"), *kept, "home", "probes", "code", "err")
    asked = nodes.select(*kept, "home", F.explode("probes").alias("probe"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.get(of, F.col("probe")) - 1)).alias("part"))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("probes", "array<int>"), ("code", "binary"), ("err", "double"))]
    queries = asked.select((F.col("probe").cast("long") * parts + F.col("part")).alias("cell"), F.lit(1).alias("role"), *kept, "home", *none)
    found = members.union(queries).repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(_searched(index, parts), FOUND).checkpoint()

    # Bundles that need a closer look, block by block.
    near = found.where("kind = 2").select("a", "b").distinct()
    named = nodes.select("bundle", "node")
    for side in "ab":
        renamed = blocks.join(named, "bundle").select(F.col("bundle").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("keys", "weights", "vectors", "node")])
        near = near.join(renamed, side)
    closer = near.mapInArrow(_expanded(index), FOUND).checkpoint()

    links = found.where("kind = 0").groupBy(F.col("a").alias("bundle")).agg(F.sum("x").alias("links"))
    further = closer.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("x").alias("further"))
    edges = found.union(closer).where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
    component = connected_components(edges).withColumnRenamed("node", "at")
    whole = nodes.select("bundle", "node", "total").join(links, "bundle", "left").join(component, F.col("at") == F.col("node"), "left")
    whole = whole.select("bundle", (F.col("total") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    result = blocks.select("bundle", "keys").join(whole, "bundle").select(F.explode("keys").alias("key"), "n", "component")
    result = result.join(further, "key", "left").select("key", (F.col("n") + F.coalesce("further", F.lit(0))).alias("n"), "component")
    # Copies of one vector may be many: each key's result joins its rows as one more of them, and is spread as they are.
    both = rows.where("key IS NOT NULL").select("vec_id", "key", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("component"), F.lit(False).alias("own"))
    both = both.union(result.select(F.lit(None).cast("long"), "key", "n", "component", F.lit(True))).checkpoint()
    done = attach_group(both, ["key"], [F.max("n").alias("n_links"), F.max("component").alias("component_id")], "vec_id").where("NOT own")
    return done.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(apart)
