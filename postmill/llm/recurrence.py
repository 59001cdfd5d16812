"""Bring together every place where two documents share a window of successive items, without shuffling all windows.

A window of W items (bytes or words) is routed by the least hash among its runs of k items. Successive windows mostly have the same
least hash, so a text gives one *run* of windows per 15 to 20 bytes. First only the hashes of runs meet; those that one
document alone has are done. The texts of the others, their *stretches*, meet by hash in shards, where an operator's own
method finds the windows that a document with a smaller id has too. What equal windows need is never split, as they always share
their hash.

Copies of a whole text are found first, by digest: only the first of them takes part. Within one Arrow batch a hash or a
stretch that many documents have goes on once or twice; for the rest the answer is known there and then. So a passage that
a third of all documents share costs each shard a row per batch, not per document.

Shuffled: hashes of runs (about 6 bytes for 18 bytes of text), the texts once (read by both joins), the shared stretches,
and the found runs. Nothing goes through the driver, and no task holds more than one shard. ``spark.sql.shuffle.partitions``
should grow with the data as for any shuffle; there are ``SHARDS_PER_PARTITION`` times as many shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.text_arrays import bytes_of, byte_runs, gather, pieces, rolled, window_runs, word_bounds, word_hashes

SHARDS_PER_PARTITION = 4
#: Low bits of a hash that are sent; the shard's number carries further ones.
SENT_BITS = 40
#: Bytes of stretches that a task gathers before it sends them, and of texts that it finishes at a time.
SENT_BYTES = 3 << 20
_LOW = np.uint64((1 << SENT_BITS) - 1)
ROUTE = pa.schema([("shard", pa.int32()), ("known", pa.bool_()), ("packed", pa.binary())])
HITS = "doc_id long, code long, kind int"
FOUND = "doc_id long, ver long, i long, j long"


@dataclass(frozen=True)
class Windows:
    """What a window is: ``size`` successive words or bytes; ``k`` of them are hashed together."""

    size: int
    k: int
    words: bool

    def cut(self, data: np.ndarray, at: np.ndarray):
        """Runs of windows [i, j) and their hashes, in items; then the items' first bytes and ends, and each text's first item."""
        if self.words:
            starts, ends, first = word_bounds(data, at)
            hashes = rolled(word_hashes(data, starts, ends), self.k)
        else:
            starts = ends = None
            first, hashes = at, byte_runs(data, self.k)
        i, j, value = window_runs(hashes, first, self.k, self.size)
        return i, j, value, starts, ends, first


def _pack(**columns: np.ndarray) -> bytes:
    """Arrays of one record, as a compressed Arrow stream."""
    batch = pa.record_batch({k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes, **kinds: str) -> dict[str, np.ndarray]:
    with pa.ipc.open_stream(packed) as r:
        batch = r.read_next_batch()
    return {k: np.frombuffer(batch.column(k)[0].as_py(), dtype=kind) for k, kind in kinds.items()}


def _code(value: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (value >> np.uint64(SENT_BITS)) % np.uint64(shards)
    return shard.astype(np.int32), ((shard << np.uint64(SENT_BITS)) | (value & _LOW)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(shard[part[0]]), part


def _low5(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(code.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5])


def _route(windows: Windows, shards: int):
    """Hashes of the runs of every document, packed by shard. ``known``: the batch itself shows that several documents have them."""

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs, codes = [], []
            for a, b in pieces(at):
                i, _, value, _, _, first = windows.cut(data[at[a] : at[b]], at[a : b + 1] - at[a])
                docs.append(ids[a:b][np.searchsorted(first, i, side="right") - 1])
                codes.append(_code(value, shards)[1])
            if not docs:
                continue
            doc, code = np.concatenate(docs), np.concatenate(codes)
            order = np.lexsort((doc, code))
            doc, code = doc[order], code[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            doc, code = doc[new], code[new]
            head = np.ones(len(doc), dtype=bool)
            head[1:] = code[1:] != code[:-1]
            tail = np.append(head[1:], True) if len(head) else head
            ask = head | tail
            rows = [(*x, False) for x in _packed_hits(doc[ask], code[ask], (code[ask] >> SENT_BITS).astype(np.int32))]
            if not ask.all():
                doc, code = doc[~ask], code[~ask]
                rows += [(*x, True) for x in _packed_hits(doc, code, (doc % shards).astype(np.int32), whole=True)]
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.binary())], schema=ROUTE)

    return run


def _packed_hits(doc: np.ndarray, code: np.ndarray, shard: np.ndarray, whole: bool = False) -> Iterator[tuple[int, bytes]]:
    for s, part in _by_shard(shard):
        part = part[np.argsort(doc[part], kind="stable")]
        step = np.diff(doc[part], prepend=0)
        yield s, _pack(doc=step, code=code[part] if whole else _low5(code[part]))


def _shared(table: pa.Table) -> pa.Table:
    """Documents and hashes of one shard whose hash at least two documents have."""
    docs, codes, done, sure = [], [], [], []
    for s, known, packed in zip(*(table.column(c).to_pylist() for c in ("shard", "known", "packed")), strict=True):
        if known:
            x = _unpack(packed, doc="<i8", code="<i8")
            done.append(np.cumsum(x["doc"]))
            sure.append(x["code"])
        else:
            x = _unpack(packed, doc="<i8", code="u1")
            low = np.zeros((len(x["doc"]), 8), np.uint8)
            low[:, :5] = x["code"].reshape(-1, 5)
            docs.append(np.cumsum(x["doc"]))
            codes.append(low.view("<i8")[:, 0] | (np.int64(s) << SENT_BITS))
    empty = [np.zeros(0, np.int64)]
    doc, code = np.concatenate(docs or empty), np.concatenate(codes or empty)
    order = np.argsort(code)
    doc, code = doc[order], code[order]
    if len(code):
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        many = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
        many = np.repeat(many, np.diff(np.append(heads, len(code))))
        doc, code = doc[many], code[many]
    doc, code = np.concatenate([doc, *done]), np.concatenate([code, *sure])
    return pa.table({"doc_id": doc, "code": code, "kind": np.zeros(len(doc), np.int32)})


def _stretches(windows: Windows, shards: int):
    """The texts of the runs whose hash other documents have too, packed by shard."""

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            ids, vers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "ver"))
            wanted, wat = _lists(batch.column("codes"))
            copies, cat = _lists(batch.column("copies"))
            out = []
            for a, b in pieces(at):
                piece = data[at[a] : at[b]]
                i, j, value, starts, ends, first = windows.cut(piece, at[a : b + 1] - at[a])
                doc = np.searchsorted(first, i, side="right") - 1
                code = _code(value, shards)[1]
                owner = np.repeat(np.arange(a, b), np.diff(wat[a : b + 1]))
                asked = np.isin(_pair(doc + a, code), _pair(owner, wanted[wat[a] : wat[b]]))
                for d in np.flatnonzero(np.diff(cat[a : b + 1])):
                    if vers[a + d] in copies[cat[a + d] : cat[a + d + 1]]:
                        asked &= doc != d
                i, j, doc, code = i[asked], j[asked], doc[asked], code[asked]
                if windows.words:
                    x, y = starts[i] if len(i) else i, ends[j + windows.size - 2] if len(i) else j
                else:
                    x, y = i, j + windows.size - 1
                text = gather(piece, x, y)
                out.append((ids[a:b][doc], vers[a:b][doc], code, i - first[doc], j - i, y - x, text))
                if sum(len(c[-1]) for c in out) >= SENT_BYTES:
                    yield from _sent([np.concatenate(c) for c in zip(*out, strict=True)], windows, shards)
                    out = []
            if out:
                yield from _sent([np.concatenate(c) for c in zip(*out, strict=True)], windows, shards)

    return run


def _pair(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One number for a row of the batch and a hash. Should two fall together, a stretch more is sent, and no result changes."""
    return code * np.int64(0x9E3779B1) + row * np.int64(0x2545F4914F6CDD1D)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin; null: none."""
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


def _sent(columns: list[np.ndarray], windows: Windows, shards: int):
    doc, ver, code, i, n, size, text = columns
    if not len(doc):
        return
    at = np.append(0, np.cumsum(size))
    # Two hashes of a stretch's bytes: equal ones of a batch are one stretch, which goes on for the smallest document only.
    low, high = np.empty(len(doc), np.uint64), np.empty(len(doc), np.uint64)
    for a, b in pieces(at):
        piece, cut = text[at[a] : at[b]], at[a : b + 1] - at[a]
        low[a:b] = word_hashes(piece, cut[:-1], cut[1:])
        high[a:b] = np.add.reduceat((piece.astype(np.uint64) + np.uint64(7)) ** np.uint64(3) * (np.arange(len(piece)) - np.repeat(cut[:-1], size[a:b]) + 11).astype(np.uint64), cut[:-1])
    order = np.lexsort((doc, high, low, code))
    new = np.ones(len(doc), dtype=bool)
    o = order
    new[1:] = (code[o[1:]] != code[o[:-1]]) | (low[o[1:]] != low[o[:-1]]) | (high[o[1:]] != high[o[:-1]]) | (size[o[1:]] != size[o[:-1]])
    least = doc[o[new]][np.cumsum(new) - 1]
    later = np.zeros(len(doc), dtype=bool)
    later[o] = doc[o] > least
    rows = []
    for s, part in _by_shard((code >> SENT_BITS).astype(np.int32)):
        part = part[~later[part]]
        if len(part):
            part = part[np.argsort(code[part], kind="stable")]
            rows.append((s, False, _pack(doc=doc[part], ver=ver[part], code=code[part], i=i[part], n=n[part].astype(np.int32), size=size[part].astype(np.int32), text=gather(text, at[part], at[part + 1]))))
    if later.any():
        for s, part in _by_shard((doc[later] % shards).astype(np.int32)):
            part = np.flatnonzero(later)[part]
            rows.append((s, True, _pack(doc=doc[part], ver=ver[part], i=i[part], j=i[part] + n[part] + windows.size - 1)))
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], schema=ROUTE)


@dataclass
class Stretches:
    """Stretches of one shard in the order of their hashes: document, first window (in items), windows, bytes."""

    doc: np.ndarray
    code: np.ndarray
    i: np.ndarray
    n: np.ndarray
    at: np.ndarray
    text: np.ndarray


def _find(windows: Windows, later: Callable[[Stretches], np.ndarray]):
    """Runs of items of one shard that a smaller document has too. ``later``: for each window of the shard, whether one has."""

    def run(table: pa.Table) -> pa.Table:
        parts, known = [], []
        for k, packed in zip(table.column("known").to_pylist(), table.column("packed").to_pylist(), strict=True):
            if k:
                known.append(_unpack(packed, doc="<i8", ver="<i8", i="<i8", j="<i8"))
            else:
                parts.append(_unpack(packed, doc="<i8", ver="<i8", code="<i8", i="<i8", n="<i4", size="<i4", text="u1"))
        out = [(x["doc"], x["ver"], x["i"], x["j"]) for x in known]
        if parts:
            x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            at = np.append(0, np.cumsum(x["size"], dtype=np.int64))
            order = np.lexsort((x["doc"], x["code"]))
            code, doc = x["code"][order], x["doc"][order]
            head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
            order = order[np.repeat(many, np.diff(np.append(head, len(code))))]
            if len(order):
                text = gather(x["text"], at[order], at[order + 1])
                s = Stretches(x["doc"][order], x["code"][order], x["i"][order], x["n"][order].astype(np.int64), np.append(0, np.cumsum(x["size"][order], dtype=np.int64)), text)
                hit = later(s)
                base = np.append(0, np.cumsum(s.n))
                edge = np.zeros(len(hit), dtype=bool)
                edge[base[:-1]] = True
                first = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
                last = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True))
                o = np.searchsorted(base, first, side="right") - 1
                out.append((s.doc[o], x["ver"][order][o], s.i[o] + first - base[o], s.i[o] + last - base[o] + windows.size))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("doc_id", "ver", "i", "j"), cols, strict=True)))

    return run


def repeats(docs: DataFrame, id_col: str, text_col: str, windows: Windows, later: Callable[[Stretches], np.ndarray], finish: Callable, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` with what ``finish`` makes of its text and the items that earlier documents have too.

    ``later(stretches)`` marks the windows of a shard that a document with a smaller id has. ``finish(text, copy, runs)`` gets
    the bytes of a text, whether a smaller id has that whole text, and the merged runs of items [i, j); it returns the values
    of ``schema``. Columns named in ``carry`` come along in a struct, ``carried``. A null text is empty. A null id is neither smaller nor larger than others: such a row keeps all its text
    and takes nothing from others. Rows with one id do not count against each other, whatever their texts.
    """
    shards = SHARDS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Without a needless alias, both joins below have the same shuffle of the texts, and Spark does it once.
    same = dict(docs.select(id_col).dtypes) == {"doc_id": "bigint"}
    base = docs.select("doc_id" if same else F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    whole = base.select("doc_id", F.xxhash64("text").alias("ver"), "text", *base.columns[2:])
    alone = whole.where("doc_id IS NULL")
    base, whole = base.where("doc_id IS NOT NULL"), whole.where("doc_id IS NOT NULL")

    digest = base.select("doc_id", F.xxhash64("text").alias("ver"), F.unhex(F.md5("text")).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = digest.join(first, "digest").where("doc_id > first").select("doc_id", "ver").distinct()

    routed = base.select("doc_id", "text").mapInArrow(_route(windows, shards), "shard int, known boolean, packed binary")
    hits = routed.groupBy("shard").applyInArrow(_shared, HITS)
    asked = (
        hits.unionByName(copies.select("doc_id", F.col("ver").alias("code"), F.lit(1).alias("kind")))
        .groupBy("doc_id")
        .agg(F.collect_list(F.expr("CASE WHEN kind = 0 THEN code END")).alias("codes"), F.collect_list(F.expr("CASE WHEN kind = 1 THEN code END")).alias("copies"))
        .where(F.size("codes") > 0)
    )
    sent = whole.join(asked, "doc_id").mapInArrow(_stretches(windows, shards), "shard int, known boolean, packed binary")
    found = sent.groupBy("shard").applyInArrow(_find(windows, later), FOUND)
    told = (
        found.unionByName(copies.select("doc_id", "ver", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
        .groupBy("doc_id")
        .agg(F.collect_list("ver").alias("vers"), F.collect_list("i").alias("froms"), F.collect_list("j").alias("tos"))
    )
    nothing = F.array().cast("array<bigint>")
    rows = whole.join(told, "doc_id", "left").unionByName(alone.select("*", *(nothing.alias(c) for c in ("vers", "froms", "tos"))))
    if carry:
        schema += ", carried " + base.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(_finish(finish, schema), schema)


def merged(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Runs [i, j) that touch or overlap made one, in order."""
    if not len(i):
        return []
    order = np.argsort(i, kind="stable")
    i, j = i[order], np.maximum.accumulate(j[order])
    new = np.append(True, i[1:] > j[:-1])
    ends = j[np.append(new[1:], True)]
    return list(zip(i[new].tolist(), ends.tolist(), strict=True))


def _finish(finish: Callable, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            vers = batch.column("ver").to_numpy(zero_copy_only=False)
            told = [_lists(batch.column(c)) for c in ("vers", "froms", "tos")]
            ends = told[0][1]
            ids = batch.column("doc_id").to_pylist()
            for x, y in pieces(at, SENT_BYTES):
                rows = []
                for n in range(x, y):
                    text = data[at[n] : at[n + 1]].tobytes()
                    a, b = ends[n], ends[n + 1]
                    runs, copy = [], False
                    if b > a:
                        mine = told[0][0][a:b] == vers[n]
                        i, j = told[1][0][a:b][mine], told[2][0][a:b][mine]
                        copy = bool((i < 0).any())
                        runs = merged(i[i >= 0], j[i >= 0])
                    rows.append((ids[n], *finish(text, copy, runs)))
                made = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(arrow) if f.name != "carried"]
                carried = [batch.column("carried").slice(x, y - x)] if "carried" in arrow.names else []
                yield pa.record_batch(made + carried, names=arrow.names)

    return run


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
