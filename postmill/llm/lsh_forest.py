"""MinHash near-duplicates by an LSH forest: sorted signature orders whose neighbours are compared, deeper where it is crowded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import connected_components
from postmill.llm.text_arrays import bytes_of, mix, pieces, rolled, word_bounds, word_hashes
from postmill.session import compact_checkpoint, ensure_checkpoint_dir

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= LINK * union.
LINK = 85
#: Values of a signature (16 bits each) and the orders in which it is sorted; order t starts at value t * HASHES / TREES.
HASHES, TREES = 64, 16
#: Values that a region shares: the first depth for all, the further ones for regions of more than REGION sets.
DEPTHS, REGION = (4, 8, 16, 64), 256
#: Neighbours in a sorted region with which a set is compared; how far below the wanted similarity the share of equal values may lie for a
#: pair to be confirmed (five standard deviations of it), and the share from which two sets are taken to be linked with a third alike.
REACH, BELOW, CERTAIN = 24, 0.23, 0.97
#: Sets of a block, where a region is compared as a whole.
BLOCK = 2048
#: The same for parts of a crowded region, where a set has a common neighbour and as many others in each tree.
CROWDED_REACH = 3

_SALTS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))
SIGNED = "doc_id long, n_shingles long, set_key binary, sig binary"
EDGES = "chunk long, a long, b long, kind int"


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: five successive words, or all words if there are fewer."""
    starts, ends, first = word_bounds(data, at)
    words = word_hashes(data, starts, ends, lower=True)
    runs = rolled(words, SHINGLE_WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            yield np.unique(runs[a : b - SHINGLE_WORDS + 1])
        elif b > a:
            yield rolled(words[a:b], b - a) + np.uint64(b - a)
        else:
            yield words[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits each."""
    flat = np.concatenate(sets)
    heads = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _SALTS[k]) >> np.uint64(32), heads).astype(np.uint16)
    return out


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits of a set's hashes; None for the empty set."""
    return np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes() if len(s) else None


def _signed(batches):
    for batch in batches:
        data, at = bytes_of(batch.column("text"))
        for i, j in pieces(at):
            sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            some = [s for s in sets if len(s)]
            sig = iter(signatures(some)) if some else iter(())
            keys, sigs = [], []
            for s in sets:
                keys.append(set_key(s))
                sigs.append(next(sig).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("doc_id")[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = bytes_of(column)
    return data.view(np.uint16).reshape(-1, HASHES)


def _turned(sig: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` values of each signature in the order of its tree."""
    at = (tree[:, None] * (HASHES // TREES) + np.arange(depth)) % HASHES
    return np.take_along_axis(sig, at, 1)


def _regions(depth: int):
    """Region of each set in each tree (or in the tree that a row names): what sets share that agree in the first ``depth`` values."""

    def run(batches):
        for batch in batches:
            sig, node = _matrix(batch.column("sig")), batch.column("node").to_numpy()
            if "tree" in batch.schema.names:
                tree = batch.column("tree").to_numpy().astype(np.int64)
            else:
                tree = np.tile(np.arange(TREES), len(node))
                sig, node = np.repeat(sig, TREES, 0), np.repeat(node, TREES)
            region = rolled_rows(_turned(sig, tree, depth), tree, depth)
            yield pa.record_batch({"region": region.astype(np.int64), "tree": tree.astype(np.int32), "node": node})

    return run


def rolled_rows(values: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    out = mix(tree.astype(np.uint64) * np.uint64(131) + np.uint64(depth))
    for k in range(values.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, k].astype(np.uint64) + np.uint64(1))
    return out


def _likely(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, link: int) -> np.ndarray:
    """Share of equal values of pairs; 0 where the sets' sizes rule a link out."""
    share = (sig_a == sig_b).mean(1)
    return np.where(100 * np.minimum(n_a, n_b) >= link * np.maximum(n_a, n_b), share, 0.0)


def _by_region(pairs: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """``pairs`` over whole regions; a partition's rows come sorted by region."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            region = batch.column("region").to_numpy()
            last = int(np.searchsorted(region == region[-1], True)) if region[0] != region[-1] else 0
            if last:
                held[-1] = batch.slice(0, last)
                yield from pairs(pa.Table.from_batches(held))
                held = [batch.slice(last)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _pairs(rows: pa.Table, link: int):
    likely = link / 100 - BELOW
    region, tree, node, n, salt = (rows.column(c).to_numpy() for c in ("region", "tree", "node", "n", "salt"))
    sig = _matrix(rows.column("sig"))
    front = np.ascontiguousarray(_turned(sig, tree.astype(np.int64), 8)[:, ::-1]).view(np.uint64)
    order = np.lexsort((node, front[:, 0], front[:, 1], region))
    region, node, n, salt, sig = region[order], node[order], n[order], salt[order], sig[order]
    heads = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(region))))
    # The region's smallest set is a hub: pairs with it mostly connect the rest, and recur in other trees.
    by_node = np.lexsort((node, group))
    hub = by_node[heads][group]
    to_hub = _likely(sig, sig[hub], n, n[hub], link)
    star = np.flatnonzero((hub != np.arange(len(hub))) & (to_hub >= likely))
    out = [(star, hub[star], np.zeros(len(star), np.int32))]
    for lag in range(1, REACH + 1):
        i = np.flatnonzero((region[lag:] == region[:-lag]) & ((salt[lag:] == 0) | (lag <= CROWDED_REACH)))
        if not len(i):
            break
        i = i[~((to_hub[i] >= CERTAIN) & (to_hub[i + lag] >= CERTAIN))]
        i = i[_likely(sig[i], sig[i + lag], n[i], n[i + lag], link) >= likely]
        i = i[(hub[i] != i) & (hub[i] != i + lag)]
        out.append((i, i + lag, np.ones(len(i), np.int32)))
    i, j, kind = (np.concatenate(c) for c in zip(*out, strict=True))
    if len(i):
        a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
        some = a != b
        chunk = mix((node[hub[i]] + salt[i]).astype(np.uint64)).astype(np.int64)
        yield pa.record_batch({"chunk": chunk[some], "a": a[some], "b": b[some], "kind": kind[some]})


class _Cell:
    """Sets of a region, or of two of its blocks, and the likely links between those of them that are in unlike components.

    A pair counts in the first tree in which its ends share a region, so no two cells look at one pair.
    """

    def __init__(self, rows: pa.Table, link: int):
        order = np.argsort(rows.column("node").to_numpy(), kind="stable")
        self.rows, self.link = rows.take(pa.array(order)), link
        self.node, self.n, self.component, side, block, tree = (self.rows.column(c).to_numpy() for c in ("node", "n", "component", "side", "block", "tree"))
        self.component, self.tree, self.sig = self.component.copy(), int(tree[0]), _matrix(self.rows.column("sig"))
        self.apart = block[0] >= 0
        self.left = np.flatnonzero(side == 0) if self.apart else np.arange(len(self.node))
        self.right = np.flatnonzero(side == 1) if self.apart else self.left

    def partners(self, k: int) -> np.ndarray:
        """Sets that the left set number ``k`` is likely linked with, the most likely first; those of its component are left out."""
        i, j = self.left[k], self.right if self.apart else self.right[k + 1 :]
        j = j[self.component[j] != self.component[i]]
        j = j[100 * np.minimum(self.n[j], self.n[i]) >= self.link * np.maximum(self.n[j], self.n[i])]
        same = self.sig[j] == self.sig[i]
        share = same.mean(1)
        near = share >= self.link / 100 - BELOW
        j, same, share = j[near], same[near], share[near]
        shared = same.reshape(len(j), TREES, HASHES // TREES)[:, :, : DEPTHS[0]].all(2)
        first = np.argmax(shared, 1) == self.tree
        return j[first][np.argsort(-share[first], kind="stable")]


def _cells_of(rows: pa.Table, link: int) -> Iterator[_Cell]:
    order = np.argsort(rows.column("region").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    region = rows.column("region").to_numpy()
    cuts = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield _Cell(rows.slice(lo, hi - lo), link)


def _asked(rows: pa.Table, link: int):
    """The rows of each cell that have a likely link with an unlike component there."""
    for cell in _cells_of(rows, link):
        some = np.zeros(len(cell.node), bool)
        for k in range(len(cell.left)):
            j = cell.partners(k)
            some[j] = True
            some[cell.left[k]] |= len(j) > 0
        if some.any():
            yield from cell.rows.filter(pa.array(some)).combine_chunks().to_batches()


def _joined(rows: pa.Table, link: int):
    """Links that the full sets confirm and that join components: no more of them than sets."""
    for cell in _cells_of(rows, link):
        packed = cell.rows.column("packed")
        sets = [np.frombuffer(packed[k].as_py(), np.uint64) for k in range(len(cell.node))]
        a, b = [], []
        for k in range(len(cell.left)):
            i = int(cell.left[k])
            for j in cell.partners(k).tolist():
                if cell.component[j] != cell.component[i] and linked(sets[i], sets[j], link):
                    cell.component[cell.component == cell.component[j]] = cell.component[i]
                    a.append(max(cell.node[i], cell.node[j]))
                    b.append(min(cell.node[i], cell.node[j]))
        if a:
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _keyed_sets(batches):
    """Key and set of each text."""
    for batch in batches:
        data, at = bytes_of(batch.column("text"))
        for i, j in pieces(at):
            sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            yield pa.record_batch([batch.column("doc_id")[i:j], pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set_key", "packed"])


def _sets(batches):
    """The set of each text, for each chunk in which it is compared."""
    for batch in batches:
        data, at = bytes_of(batch.column("text"))
        for i, j in pieces(at):
            packed = [s.tobytes() for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])]
            none = pa.nulls(j - i, pa.int64())
            yield pa.record_batch([batch.column("chunk")[i:j], batch.column("doc_id")[i:j], none, pa.array([-1] * (j - i), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "a", "b", "kind", "packed"])


def linked(x: np.ndarray, y: np.ndarray, link: int = LINK) -> bool:
    """Whether two sets of distinct sorted hashes are linked."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= link * (len(x) + len(y) - shared)


def _confirmed(batches, link: int):
    """Links that the full sets confirm; rows come sorted by chunk, a chunk's sets first.

    Pairs whose ends are already connected in their chunk need no look: they change no component.
    """
    now, sets, parent = None, {}, {}

    def root(v):
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        return v

    for batch in batches:
        a, b = [], []
        cols = [batch.column(c).to_pylist() for c in ("chunk", "a", "b", "kind", "packed")]
        for chunk, x, y, kind, packed in zip(*cols, strict=True):
            if chunk != now:
                now, sets, parent = chunk, {}, {}
            if kind < 0:
                sets.setdefault(x, []).append(np.frombuffer(packed, np.uint64))
                continue
            p, q = root(x), root(y)
            if p != q and any(linked(s, t, link) for s in sets.get(x, ()) for t in sets.get(y, ())):
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(rows: DataFrame, edges: DataFrame, link: int) -> DataFrame:
    """Those of the pairs ``edges`` that the full sets confirm."""
    compared = edges.select("chunk", F.col("a").alias("doc_id")).union(edges.select("chunk", "b")).distinct()
    sets = rows.join(compared, "doc_id").select("chunk", "doc_id", "text").mapInArrow(_sets, EDGES + ", packed binary")
    met = sets.union(edges.withColumn("packed", F.lit(None).cast("binary")))
    return met.repartition("chunk").sortWithinPartitions("chunk", "kind", "a", "b").mapInArrow(partial(_confirmed, link=link), "a long, b long")


CELLS = "region long, tree int, node long, component long, side int, block int, n long, set_key binary, sig binary"


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of regions, those of more than BLOCK sets once for each cell of two blocks; every two sets of a region share a cell."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(mine, k).alias("p"), F.greatest(mine, k).alias("q"))))
    dealt = rows.withColumn("mine", mine).withColumn("cell", cell)
    region = F.when(F.col("size") <= BLOCK, F.col("region")).otherwise(F.xxhash64("region", "cell"))
    block = F.when(F.col("cell.p") == F.col("cell.q"), -1).otherwise(F.col("mine"))
    return dealt.select(region.alias("region"), "tree", "node", "component", (F.col("mine") == F.col("cell.q")).cast("int").alias("side"), block.alias("block"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    A text's set are its distinct shingles of five lower-cased words (all words, if fewer); texts without words have none and are
    linked with nothing. Two documents are linked if their sets' similarity is ``link`` percent or more, which full sets confirm.
    component_id is the smallest id that can be reached, kept whether that is the row's own. Rows with one id are one document for
    the links, whatever their texts. A row without id is linked with nothing, has no component, and is kept. Other columns
    are not read. An empty table gives an empty result.

    Equal sets are one node. A node has a 64-value signature, which TREES orders sort from different starting points. Nodes that
    agree in the first four values of an order form a region; regions of more than REGION nodes are split by more values, in
    the end by a hash, and keep their smallest node as a common neighbour. Within a region, in sorted order, a node is compared with
    its REACH next ones. After these links, all nodes of a region of depth 4 that are in unlike components are compared, whatever its
    size: a large one in cells of two blocks of about BLOCK nodes. A pair of similarity s shares a region of depth 4 with probability 1 - (1 - s^4)^16,
    which is 0.999993 at 0.85 and 0.9998 at 0.8. Pairs whose signatures agree in all but BELOW of ``link`` are confirmed on the full sets, which meet in
    chunks named after the regions' smallest nodes, so that a group's sets are sent together. What is left of large regions is confirmed in the
    cells: nodes without a likely partner in another component go first, then the others' sets come, and a cell puts out only links
    that join components. So the rows of every step grow with the sets, but for the copies of a region's signatures, one for each BLOCK of its nodes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = rows.mapInArrow(_signed, SIGNED).checkpoint()
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = real.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    docs_n = signed.count()
    nodes = compact_checkpoint(classes.select("node", "n", "sig", "set_key"), docs_n)

    part = nodes.select("node", "sig").mapInArrow(_regions(DEPTHS[0]), "region long, tree int, node long")
    groups, hubs, whole, salt = None, None, None, F.lit(0).cast("long")
    for depth in DEPTHS:
        sizes = part.groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
        crowded = compact_checkpoint(part.join(sizes, "region"), docs_n * TREES)
        whole = crowded if depth == DEPTHS[0] else whole
        small = crowded.where(F.col("size") <= REGION).select("region", "tree", "node", salt.alias("salt"))
        groups = small if groups is None else groups.union(small)
        large = crowded.where(F.col("size") > REGION)
        if large.isEmpty():
            break
        salt = F.col("region")
        # As many chunks as a power of two, so that regions of like sizes in several trees share theirs.
        chunk = F.xxhash64("least", F.pmod(F.xxhash64("node"), F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / REGION))).cast("long")))
        star = large.where("node <> least").select(chunk.alias("chunk"), F.col("node").alias("a"), F.col("least").alias("b"), F.lit(0).alias("kind"))
        hubs = star if hubs is None else hubs.union(star)
        if depth == DEPTHS[-1]:
            # Nodes that agree in every value: any share of them will do.
            groups = groups.union(large.select(F.xxhash64("region", chunk).alias("region"), "tree", "node", salt.alias("salt")))
            break
        deeper = DEPTHS[DEPTHS.index(depth) + 1]
        part = large.select("tree", "node").join(nodes.drop("set_key"), "node").select("node", "tree", "sig").mapInArrow(_regions(deeper), "region long, tree int, node long")
    full = groups.join(nodes, "node").select("region", "tree", "node", "n", "salt", "sig")
    edges = full.repartition("region").sortWithinPartitions("region").mapInArrow(_by_region(partial(_pairs, link=link)), EDGES)
    if hubs is not None:
        edges = edges.union(hubs)
    edges = compact_checkpoint(edges.groupBy("chunk", "a", "b").agg(F.min("kind").alias("kind")), docs_n * TREES)

    links = _links(rows, edges, link).checkpoint()
    # What the orders and splits above left apart: pairs of unlike components in the regions of the first depth, all of them.
    found = connected_components(links)
    labelled = whole.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region")
    cells = _cells(labelled.join(mixed, "region")).join(nodes, "node").select(*[c.split()[0] for c in CELLS.split(", ")])
    asked = cells.repartition("region").sortWithinPartitions("region").mapInArrow(_by_region(partial(_asked, link=link)), CELLS).checkpoint()
    compared = rows.join(asked.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    sets = compared.mapInArrow(_keyed_sets, "node long, set_key binary, packed binary").dropDuplicates(["node", "set_key"])
    full = asked.join(sets, ["node", "set_key"])
    links = links.union(full.repartition("region").sortWithinPartitions("region").mapInArrow(_by_region(partial(_joined, link=link)), "a long, b long"))

    # Documents of equal sets are linked to the smallest of them.
    same = real.join(classes.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = connected_components(links.union(same))
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates_sql() -> str:
    """DuckDB SQL for ``near_duplicates`` over ``documents`` with distinct ids: all pairs that share a shingle, on small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    k = SHINGLE_WORDS
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= {k} THEN range(1, len(w) - {k - 2}) WHEN len(w) > 0 THEN [1::BIGINT] ELSE [] END) AS i FROM t),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS shingle FROM u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {LINK} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS origin FROM n UNION SELECT e.b, r.origin FROM reach r JOIN e ON e.a = r.node),
c AS (SELECT node, min(origin) AS component_id FROM reach GROUP BY node)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, t.doc_id) AS component_id, coalesce(component_id, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.node = t.doc_id"""
