"""Embedding whitening by shifted CholeskyQR: Gram passes orthogonalise the centred rows, and the composed R factor is decomposed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.vectors import dense, vector_rows

#: Entries become floor(SCALE * c) + OFFSET before anything is fitted.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Rows that are worked on at a time, Gram passes at most, and the departure from orthogonality at which they end.
STEP, PASSES, ORTHOGONAL = 4096, 5, 1e-13
#: A component counts if its eigenvalue is at least this share of the first; below it there is only rounding.
LEAST = 1e-12
#: A deviation is high * 2^52 + middle * 2^27 + low.
SCHEMA = "vec_id long, component int, high long, middle long, low long, whitened double"
_LIMB = 26


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` rows: exact sums per dimension, eigenvectors as columns, their eigenvalues, the trace, the error of the identity."""

    n: int
    sums: list[int]
    limit: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def grid(m: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET as whole numbers."""
    scaled = np.floor(m * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component times 1024 does not fit a long")
    return scaled.astype(np.int64) + OFFSET


def _sums(batches):
    """Rows, and per dimension the sum, least and greatest entry, of a partition. Missing entries are read as zeros later."""
    n, total, low, high = 0, [], [], []
    for batch in batches:
        rows, m = dense(batch.column("v"))
        x = grid(m)
        n += len(rows)
        for k in range(len(total), x.shape[1]):
            total.append(0)
            low.append(OFFSET)
            high.append(OFFSET)
        if len(rows):
            half = x >> 31
            sums, rest = half.sum(0).tolist(), (x & ((1 << 31) - 1)).sum(0).tolist()
            for k in range(x.shape[1]):
                total[k] += (sums[k] << 31) + rest[k] - len(rows) * OFFSET
                low[k], high[k] = min(low[k], int(x[:, k].min())), max(high[k], int(x[:, k].max()))
    # Sums leave in two halves, so that adding those of many partitions cannot overflow.
    top, bottom = [t >> 31 for t in total], [t & ((1 << 31) - 1) for t in total]
    yield pa.record_batch({"dim": pa.array([-1, *range(len(total))], pa.int32()), "top": pa.array([0, *top], pa.int64()), "bottom": pa.array([n, *bottom], pa.int64()), "least": pa.array([0, *low], pa.int64()), "most": pa.array([0, *high], pa.int64())})


def _centred(v: pa.Array, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that count, and x - S / n of each entry, rounded once."""
    rows, m = dense(v, len(sums))
    floor = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return rows, (grid(m) - floor).astype(np.float64) - rest


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The q with q r = a, for an upper triangular r."""
    q = np.empty_like(a)
    for k in range(len(r)):
        q[:, k] = (a[:, k] - q[:, :k] @ r[:k, k]) / r[k, k]
    return q


def _gram_of(n: int, sums: list[int], turn: Callable[[np.ndarray], np.ndarray]):
    """The upper half of the Gram matrix of a partition's rows, centred and turned, as one row per matrix row."""

    def run(batches):
        total = None
        for batch in batches:
            _, a = _centred(batch.column("v"), n, sums)
            for at in range(0, len(a), STEP):
                y = turn(a[at : at + STEP])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "x": total[i, j]})

    return run


def _gram(rows: DataFrame, n: int, sums: list[int], turn, width: int) -> np.ndarray:
    found = rows.mapInArrow(_gram_of(n, sums, turn), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    i, j, x = (found.column(c).to_numpy() for c in ("i", "j", "x"))
    out = np.zeros((width, width))
    out[i, j] = out[j, i] = x
    return out


def factor(gram: np.ndarray, rows: int) -> tuple[np.ndarray, bool]:
    """Upper triangular r with r'r = gram, and whether the diagonal had to be shifted for that."""
    width = len(gram)
    try:
        r = np.linalg.cholesky(gram).T
        if (np.diag(r) ** 2 > width * np.finfo(float).eps * np.diag(gram).max()).all():
            return r, False
    except np.linalg.LinAlgError:
        pass
    shift = 11 * (rows * width + width * (width + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    # The bound grows with the rows; a share of the norm is enough for sums that are taken in blocks.
    shift = min(shift, 1e-6 * np.linalg.norm(gram, 2))
    return np.linalg.cholesky(gram + shift * np.eye(width)).T, True


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of all rows of ``df`` whose vector has only finite components; None without rows or without variance.

    A first pass takes exact sums. Then up to PASSES Gram passes: the centred rows a are divided by the factors found so far through
    triangular solves, their Gram matrix is factorised (with its diagonal shifted where the plain factorisation breaks down), and the
    factor joins the others, until the rows are orthogonal. With a = q r, the singular values and right singular vectors of the small
    r are those of a; squares over n are eigenvalues of the covariance (divisor n). A last pass measures the covariance of the whitened rows.
    What reaches the driver, and what each task sends, is at most a matrix of dimension x dimension.
    """
    rows = vector_rows(df, id_col, vector_col)
    got = rows.mapInArrow(_sums, "dim int, top long, bottom long, least long, most long").groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("top", "bottom")], F.min("least").alias("least"), F.max("most").alias("most")).collect()
    n = sum(int(r["bottom"]) for r in got if r["dim"] < 0)
    dims = sorted((r for r in got if r["dim"] >= 0), key=lambda r: r["dim"])
    width = len(dims)
    if not n or not width:
        return None
    # A dimension that some rows lack has the entry OFFSET in them.
    sums = [(int(r["top"]) << 31) + int(r["bottom"]) + n * OFFSET for r in dims]
    spread = max(max(r["most"], OFFSET) - min(r["least"], OFFSET) for r in dims)
    factors: list[np.ndarray] = []
    whole = np.eye(width)
    for _ in range(PASSES):

        def turn(a, factors=tuple(factors)):
            for r in factors:
                a = solve_rows(a, r)
            return a

        gram = _gram(rows, n, sums, turn, width)
        if not factors and not np.trace(gram):
            return None
        if factors and np.abs(gram - np.eye(width)).max() < ORTHOGONAL * width:
            break
        r, shifted = factor(gram, n)
        factors.append(r)
        whole = r @ whole
        if len(factors) > 2 and not shifted and np.abs(gram - np.eye(width)).max() < 1e-8:
            break
    _, s, vt = np.linalg.svd(whole)
    values = s**2 / n
    trace = float(values.sum())
    keep = min(components, int((values > LEAST * values[0]).sum()))
    vectors = vt[:keep].T
    # Either sign is right; the largest entry is made positive, so that reruns agree.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)])
    values = values[:keep]
    white = _gram(rows, n, sums, lambda a: a @ vectors / np.sqrt(values), keep) / n
    return Whitening(n, sums, spread * n + n, vectors, values, trace, float(np.abs(white - np.eye(keep)).max()))


def _applied(w: Whitening):
    """Whitened rows, one for each component, with the deviation of the row in three parts."""
    width, keep = len(w.sums), len(w.values)
    floor, rest = [s // w.n for s in w.sums], [s % w.n for s in w.sums]

    def parts(x: np.ndarray) -> list[np.ndarray]:
        if w.limit < 1 << 52 and width < 1 << 10:
            d = (x - np.array(floor, np.int64)) * w.n - np.array(rest, np.int64)
            high, low = d >> _LIMB, d & ((1 << _LIMB) - 1)
            return [(high * high).sum(1), (high * low).sum(1), (low * low).sum(1)]
        d = (x.astype(object) - np.array(floor, object)) * w.n - np.array(rest, object)
        total = [int(t) for t in (d * d).sum(1)]
        return [np.array([t >> 52 for t in total], np.int64), np.zeros(len(total), np.int64), np.array([t & ((1 << 52) - 1) for t in total], np.int64)]

    def run(batches):
        for batch in batches:
            rows, m = dense(batch.column("v"), width)
            for at in range(0, len(rows), STEP):
                x = grid(m[at : at + STEP])
                high, middle, low = (np.repeat(p, keep) for p in parts(x))
                white = ((x - np.array(floor, np.int64)).astype(np.float64) - np.array(rest) / w.n) @ w.vectors / np.sqrt(w.values)
                ids = batch.column("vec_id").take(pa.array(np.repeat(rows[at : at + STEP], keep)))
                number = np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))
                yield pa.record_batch([ids, pa.array(number), pa.array(high), pa.array(middle), pa.array(low), pa.array(white.ravel())], names=["vec_id", "component", "high", "middle", "low", "whitened"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``components`` rows for each row of ``df``.

    Rows whose vector is null, or holds null or non-finite components, are neither fitted nor returned; shorter vectors are read as if
    zeros followed. Repeated rows count, and are returned, each for itself; a null id is returned as null. Equal eigenvalues (ties) leave their order, and the
    directions within them, open. Where the data vary in fewer directions, there are fewer components; an empty table, one
    row, and equal rows give an empty result. Other columns are not read. A component beyond 2^52 is an error.
    ``deviation`` is an exact decimal(38,0). Sums of doubles follow the order of tasks: reruns agree up to the last few bits.
    """
    w = fit(df, id_col, vector_col, components)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None:
        return df.sparkSession.createDataFrame([], out)
    whole = lambda name, power: F.col(name).cast("decimal(20,0)") * F.lit(1 << power).cast("decimal(17,0)")
    deviation = (whole("high", 52) + whole("middle", 27) + F.col("low")).cast("decimal(38,0)")
    share = F.element_at(F.array(*[F.lit(float(e / w.trace)) for e in w.values]), F.col("component"))
    rows = vector_rows(df, id_col, vector_col).mapInArrow(_applied(w), SCHEMA)
    return rows.select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", share.alias("explained"), F.lit(w.identity_error).alias("identity_error"))
