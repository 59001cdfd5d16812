"""Exact top-k inner products: vectors in blocks of falling length, Cauchy-Schwarz bounds, whole-number scores, thresholds that rise in rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import ensure_checkpoint_dir

TOP = 20
#: Vectors of a block of candidates, queries of a block (both at most), and the longest vectors that give every query its first threshold.
BLOCK_ROWS, QUERY_ROWS, SEED_ROWS = 65536, 8192, 4096
#: Bytes of a block's vectors at most.
BLOCK_BYTES = 4 << 20
#: Candidates and queries that are scored at a time inside a block.
STEP, QUERY_STEP = 4096, 1024
#: A round has so many times the candidates of all before it.
GROWTH = 8
BLOCKS = "no long, longest double, ids binary, vectors binary"
MET = "need double, q_ids binary, q_vectors binary, q_least binary"
PAIRS = "q_no long, pos int, query_id long, vec_id long, score long"
_LEAST = np.iinfo(np.int64).min


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; without null ids, null vectors and vectors with null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(good)
    return ints.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros up to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _kind(biggest: int) -> np.dtype:
    """The smallest whole numbers that hold all components."""
    return next(np.dtype(k) for k in (np.int8, np.int16, np.int32, np.int64) if biggest <= np.iinfo(k).max)


def _packed(width: int, kind: np.dtype, rows: int):
    """Rows of a sorted partition in blocks."""

    def block(no: int, ids: np.ndarray, m: np.ndarray):
        return pa.record_batch([pa.array([no], pa.int64()), pa.array([float(_lengths(m).max())], pa.float64()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["no", "longest", "ids", "vectors"])

    def run(batches):
        part = None
        for n, (ids, m, first) in enumerate(_gathered(batches, width, kind, rows)):
            part = first["part"][0].as_py() if part is None else part
            yield block((part << 33) + n, ids, m)

    return run


def _gathered(batches, width: int, kind: np.dtype, rows: int):
    """Ids and vectors of a partition, ``rows`` at a time, with the batch that the last of them came in."""
    ids, parts, held, batch = [], [], 0, None
    for batch in batches:
        a = 0
        while a < batch.num_rows:
            piece = batch.slice(a, rows - held)
            ids.append(piece.column("vec_id").to_numpy())
            parts.append(_matrix(piece.column("v"), width).astype(kind))
            a, held = a + piece.num_rows, held + piece.num_rows
            if held == rows:
                yield np.concatenate(ids), np.concatenate(parts), batch
                ids, parts, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(parts), batch


def _lengths(m: np.ndarray) -> np.ndarray:
    out = np.empty(len(m))
    for a in range(0, len(m), STEP):
        out[a : a + STEP] = np.sqrt((m[a : a + STEP].astype(np.float64) ** 2).sum(1))
    return out


def _own(qid: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a query and a candidate with its id."""
    order = np.argsort(cid, kind="stable")
    lo, hi = (np.searchsorted(cid[order], qid, side=s) for s in ("left", "right"))
    n = hi - lo
    return np.repeat(np.arange(len(qid)), n), order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _heads(row: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` of each row, in the order of rows, scores and ids."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < top
    return row[keep], ids[order][keep], score[order][keep]


def _exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number products of pairs, a bounded number at a time."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), STEP):
        out[a : a + STEP] = np.einsum("ij,ij->i", q[i[a : a + STEP]].astype(np.int64), c[j[a : a + STEP]].astype(np.int64))
    return out


def search_block(q: np.ndarray, qid: np.ndarray, least: np.ndarray, c: np.ndarray, cid: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries, ids and scores of the candidates that can be among a query's ``top``.

    Candidates are sorted by falling length, and a query is done where its length times theirs stays below its threshold. ``least`` is a
    score that ``top`` other candidates are known to reach. Products are taken as floating numbers, single ones where these hold every score
    exactly and doubles beyond; where doubles don't either, pairs within their error of the threshold are scored again in whole numbers.
    The threshold rises with what is found. Memory is bounded by a tile of QUERY_STEP queries and STEP candidates.
    """
    out = []
    reach = float(np.abs(q, dtype=np.float64).max(initial=0)) * float(np.abs(c, dtype=np.float64).max(initial=0)) * q.shape[1]
    real = np.float32 if reach < 2**24 else np.float64
    c_len = [float(_lengths(c[a : a + 1])[0]) for a in range(0, len(c), STEP)]
    for at in range(0, len(q), QUERY_STEP):
        rows = slice(at, at + QUERY_STEP)
        qf, q_len = q[rows].astype(real), _lengths(q[rows])
        low = np.where(least[rows] == _LEAST, -np.inf, least[rows].astype(np.float64))
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a in range(0, len(c), STEP):
            error = 1e-9 * (q_len * c_len[a // STEP] + 1)
            live = np.flatnonzero(q_len * c_len[a // STEP] + error >= low)
            if not len(live):
                break  # the rest is shorter still
            error = error[live] if reach >= 2**53 else np.zeros(len(live))
            some = cid[a : a + STEP]
            s = qf[live] @ c[a : a + STEP].astype(real).T
            s[_own(qid[rows][live], some)] = -np.inf
            new = np.flatnonzero(np.isneginf(low[live]))
            if len(new) and len(some) >= top:
                low[live[new]] = np.partition(s[new], len(some) - top, axis=1)[:, len(some) - top] - error[new]
            cut = np.maximum(low[live] - error, np.finfo(real).min).astype(real)
            i, j = np.nonzero(s >= cut[:, None])
            if not len(i):
                continue
            score = s[i, j].astype(np.int64) if reach < 2**53 else _exact(q[rows][live], c[a : a + STEP], i, j)
            held = _heads(*(np.concatenate(x) for x in zip(held, (live[i], some[j], score), strict=True)), top)
            full = np.flatnonzero(np.bincount(held[0], minlength=len(qf)) == top)
            last = np.searchsorted(held[0], full, side="right") - 1
            low[full] = np.maximum(low[full], held[2][last].astype(np.float64))
        out.append((held[0] + at, held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _read(ids: bytes, vectors: bytes, width: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, width)


def _need(m: np.ndarray, least: np.ndarray) -> float:
    """The length that candidates must have for one of the queries: a block meets every candidate block as long as this."""
    norm = _lengths(m)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(least > 0, least.astype(np.float64) / norm, 0.0)
    return float(need.min()) * (1 - 1e-9)


def _thresholds(width: int, kind: np.dtype, rows: int, top: int, seed: tuple[bytes, bytes]):
    """Queries in blocks with, for each, the top-th score among the longest vectors of all."""

    def run(batches):
        cid, c = _read(*seed, width, kind)
        for ids, m, _ in _gathered(batches, width, kind, rows):
            who, _, score = search_block(m, ids, np.full(len(ids), _LEAST), c, cid, top)
            least = np.full(len(ids), _LEAST)
            full = np.flatnonzero(np.bincount(who, minlength=len(ids)) == top)
            least[full] = score[np.searchsorted(who, full, side="right") - 1]
            yield pa.record_batch([pa.array([_need(m, least)], pa.float64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, m, least))], names=["need", "q_ids", "q_vectors", "q_least"])

    return run


def _raised(width: int, kind: np.dtype):
    """Blocks of queries with the thresholds that a round has shown."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m, least = _read(row["q_ids"], row["q_vectors"], width, kind)[1], np.frombuffer(row["q_least"], np.int64).copy()
                for x in row["shown"] or ():
                    least[x["pos"]] = max(least[x["pos"]], x["score"])
                yield pa.record_batch([pa.array([row["q_no"]], pa.int64()), pa.array([_need(m, least)], pa.float64()), *(pa.array([x], pa.binary()) for x in (row["q_ids"], row["q_vectors"], least.tobytes()))], names=["q_no", "need", "q_ids", "q_vectors", "q_least"])

    return run


def _search(width: int, kind: np.dtype, top: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                cid, c = _read(get("ids"), get("vectors"), width, kind)
                qid, q = _read(get("q_ids"), get("q_vectors"), width, kind)
                who, cand, score = search_block(q, qid, np.frombuffer(get("q_least"), np.int64), c, cid, top)
                yield pa.record_batch({"q_no": np.full(len(who), get("q_no"), np.int64), "pos": who.astype(np.int32), "query_id": qid[who], "vec_id": cand, "score": score})

    return run


def top_inner_products(df: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` integer inner products, ties to the smaller vec_id.

    ``queries`` is a condition on ``vec_id``; candidates are all rows but those with the query's own id. Components are
    floor(scale * x). Vectors that are null or hold null or non-finite components, and null ids, take no part; shorter
    vectors are read as if zeros followed. Rows that repeat id and vector count once. Of equal vectors a query can only meet the
    ``top`` + 1 smallest ids, so only those are candidates. An empty table, or one vector alone, gives an empty result. Scores are longs: a
    vector whose scaled length is 2^31.5 or more is an error that says so, as its product with itself, the largest score there can be, fits none.

    Candidates are sorted into blocks by falling length. The longest ``SEED_ROWS`` give each query a threshold; a block of
    queries then goes only to the candidate blocks whose longest vector can reach one of its thresholds. Blocks are met in rounds, each
    of GROWTH times the rows before it, with the thresholds that the rounds before have shown: so a round puts out little.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    vectors = integer_vectors(df, id_col, vector_col, scale).checkpoint()
    # In doubles, as the squares of large components don't fit a long.
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    shape = vectors.agg(
        F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.max(norm).alias("longest"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")).first()
    if (shape["longest"] or 0.0) >= 2.0**63:
        raise ValueError("a vector is too long: its inner product with itself does not fit a long")
    width, out = max(shape["width"] or 1, 1), "query_id long, rank int, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], out)
    kind = _kind(max(shape["most"] or 0, -(shape["least"] or 0)))
    fit = max(1, BLOCK_BYTES // (width * kind.itemsize))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = min(BLOCK_ROWS, fit, max(STEP, -(-shape["n"] // tasks)))

    few = Window.partitionBy("v").orderBy("vec_id")
    candidates = vectors.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= top + 1).select("vec_id", "v", norm.alias("norm"))
    parts = max(1, -(-shape["n"] // rows))
    sorted_ = candidates.repartitionByRange(parts, F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id").select("vec_id", "v", F.spark_partition_id().alias("part"))
    blocks = sorted_.mapInArrow(_packed(width, kind, rows), BLOCKS).checkpoint()

    longest = candidates.orderBy(F.col("norm").desc(), "vec_id").limit(SEED_ROWS).select("vec_id", "v").toArrow()
    seed = (longest.column("vec_id").to_numpy().tobytes(), _matrix(longest.column("v"), width).astype(kind).tobytes())
    met = vectors.where(queries).select("vec_id", "v").mapInArrow(_thresholds(width, kind, min(QUERY_ROWS, fit), top, seed), MET).withColumn("q_no", F.monotonically_increasing_id()).checkpoint()

    best = Window.partitionBy("q_no", "pos").orderBy(F.col("score").desc(), "vec_id")
    done, begun = None, 0
    while begun < parts:
        end = GROWTH * max(begun, 1)
        # The last round has all the rest.
        some = blocks.where(F.shiftright("no", 33) >= begun).where(F.shiftright("no", 33) < end if end < parts else F.lit(True))
        pairs = met.select("q_no", "need").join(some.select("no", "longest"), F.col("longest") >= F.col("need")).select("q_no", "no")
        work = pairs.join(met, "q_no").join(some.drop("longest"), "no")
        found = work.mapInArrow(_search(width, kind, top), PAIRS)
        done = (found if done is None else found.unionByName(done.drop("rank"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        begun = end
        if begun < parts:
            done = done.checkpoint()
            shown = done.where(F.col("rank") == top).groupBy("q_no").agg(F.collect_list(F.struct("pos", "score")).alias("shown"))
            met = met.join(shown, "q_no", "left").mapInArrow(_raised(width, kind), "q_no long, " + MET).checkpoint()
    return done.select("query_id", "rank", "vec_id", "score")


def topk_sql(top: int = TOP, modulus: int = 20) -> str:
    """DuckDB SQL for ``top_inner_products`` over ``embeddings``, by brute force."""
    return f"""
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % {modulus} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {top}"""
