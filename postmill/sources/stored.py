"""A table of Parquet files that changes file by file: buckets by key, days by event time, and a manifest that is swapped as a whole.

Files are never written over. A change writes new files and then a new manifest, which lists the files that count and what is known of
them: bucket, rows, earliest and latest time, rows without time. The manifest counts from the moment its commit file is there, and that
file can be created only once. So readers see the table before a change or after it, a failed change leaves nothing but files nobody
lists, and of two writers that start from the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.spread import keep_first
from postmill.session import ensure_checkpoint_dir
from postmill.sources.tables import expire, upsert_by_key

#: Rows of a file at most; bits of a key filter for each key, at least and at most; probes of a key.
FILE_ROWS = 1 << 21
KEY_BITS, LEAST_BITS, MOST_BITS, PROBES = 10, 1 << 13, 1 << 26, 3
MANIFEST = "file string, bucket int, n_rows long, low timestamp, high timestamp, n_untimed long"


# ---- files -------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if it is there already."""
    fs, target = _path(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


# ---- key filter ----------------------------------------------------------------


def _positions(keys: Sequence[str], bits: int) -> list[Column]:
    """Bits of a key in a filter of ``bits``, a power of two."""
    first, second = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    return [(first.bitwiseXOR(F.shiftrightunsigned(second, 21 * i))).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def key_filter(df: DataFrame, keys: Sequence[str], n_keys: int) -> Column:
    """A condition that holds for all keys of ``df`` and for few others (a Bloom filter), to be used on another table with these columns.

    The filter has KEY_BITS for each of the ``n_keys`` keys, but MOST_BITS (8 MB) at most; with more keys it lets more others pass.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * n_keys).bit_length()))
    set_ = df.select(F.explode(F.array(*_positions(keys, bits))).alias("p"))
    words = set_.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    every = df.sparkSession.range(bits >> 6).join(words, F.col("id") == F.col("w"), "left")
    array = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("a"))
    filled = array.select(F.transform("a", lambda x: x["b"]).alias("words")).scalar()
    out = F.lit(True)
    for p in _positions(keys, bits):
        out = out & (F.getbit(F.get(filled, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
    return out


# ---- table -----------------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """What a change did: files of the version before that were read, went unread, and stayed as they are; files written."""

    version: int
    read: int
    dropped: int
    kept: int
    written: int


class StoredTable:
    """Rows by key bucket and day. ``keys`` may be empty (one bucket), ``ts`` may be None (one day)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str] = (), ts: str | None = None, buckets: int = 64) -> StoredTable:
        """A new table with the rows of ``df``, which has one row per key."""
        table = cls(df.sparkSession, path)
        about = {"schema": df.schema.jsonValue(), "keys": list(keys), "ts": ts, "buckets": buckets if keys else 1, "applied": {}}
        table._commit(0, about, table._write(*table._split(df, about), about))
        return table

    # -- versions --

    def version(self) -> int:
        """Number of the last change; 0 if the table is not there."""
        commits = [n for n in _names(self.spark, f"{self.path}/commits") if n.endswith(".json")]
        return int(commits[-1][:-5]) if commits else 0

    def _about(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:020d}.json", wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files that count, with their bucket, rows and times."""
        about = self._about(version or self.version())
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{about['manifest']}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the last version, or of an earlier one."""
        version = version or self.version()
        return self._rows(self._about(version), [r["file"] for r in self.manifest(version).select("file").collect()])

    def _rows(self, about: dict, files: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(about["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    # -- changes --

    def _bucket(self, about: dict) -> Column:
        """Bucket of a row; -1 without a key."""
        keys = about["keys"]
        if not keys:
            return F.lit(0)
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        return F.when(whole, F.pmod(F.xxhash64(*keys), F.lit(about["buckets"])).cast("int")).otherwise(F.lit(-1))

    def _write(self, keyed: DataFrame, keyless: DataFrame | None, about: dict) -> DataFrame:
        """New files with these rows, and their manifest rows.

        Rows are rebalanced by bucket: small buckets share a task and large ones are split, by size, so that neither a day nor a bucket is
        one task's work. Rows without key stay in the tasks they are in.
        """
        ts, folder = about["ts"], f"{self.path}/data/{uuid.uuid4().hex}"
        place = {"_bucket": self._bucket(about), "_day": F.to_date(F.col(ts)) if ts else F.lit(None).cast("date")}
        rows = keyed.withColumns(place)
        rows = rows.hint("rebalance", "_bucket") if about["keys"] else rows
        if keyless is not None:
            rows = rows.unionByName(keyless.withColumns(place))
        rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_bucket", "_day").parquet(folder)
        if not any(n.startswith("_bucket=") for n in _names(self.spark, folder)):
            return self.spark.createDataFrame([], MANIFEST)
        part = self.spark.read.schema(T.StructType([f for f in keyed.schema.fields if f.name == ts])).parquet(f"{folder}/*/*/*.parquet")
        time = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
        stats = part.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("low"), F.max(time).alias("high"), F.count_if(time.isNull()).alias("n_untimed"))
        return stats.select("file", F.regexp_extract("file", "/_bucket=(-?\\d+)/", 1).cast("int").alias("bucket"), "n_rows", "low", "high", "n_untimed")

    def _commit(self, version: int, about: dict, files: DataFrame) -> int:
        """Version ``version`` + 1, of these files; an error if someone else was first."""
        about = about | {"manifest": f"manifests/{uuid.uuid4().hex}"}
        files.write.parquet(f"{self.path}/{about['manifest']}")
        _create(self.spark, f"{self.path}/commits/{version + 1:020d}.json", json.dumps(about))
        return version + 1

    def _swap(self, version: int, about: dict, listed: DataFrame, gone: Sequence[str], keyed: DataFrame | None, keyless: DataFrame | None, read: int) -> Change:
        """Replace the files ``gone`` by new ones with these rows."""
        lost = self.spark.createDataFrame([(f,) for f in gone], "file string")
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        files = listed.join(lost, "file", "left_anti").select(*names, F.lit(False).alias("new"))
        if keyed is not None:
            files = files.union(self._write(keyed, keyless, about).select(*names, F.lit(True)))
        counts = Observation()
        files = files.observe(counts, F.count_if(~F.col("new")).alias("kept"), F.count_if("new").alias("written")).drop("new")
        return Change(self._commit(version, about, files), read, len(gone) - read, counts.get["kept"], counts.get["written"])

    def _split(self, df: DataFrame, about: dict) -> tuple[DataFrame, DataFrame | None]:
        """Rows with a key, and rows without."""
        bucket = self._bucket(about)
        return (df.where(bucket >= 0), df.where(bucket < 0)) if about["keys"] else (df, None)

    def upsert(self, batch: DataFrame, order: str, token: tuple[str, int] | None = None) -> Change | None:
        """Merge a batch by key; only files that hold one of its keys are read and replaced.

        The last batch row of a key, by ``order``, replaces the columns the batch has; a column that only the batch has joins the table.
        If ``order`` is a column of the table too, whole rows are versions: the one with the greatest order counts, of equal ones the
        batch's, so an older version that arrives late changes nothing. Rows with a null in a key are always added.

        The buckets of the batch's keys name the files that may matter. Of these only the key columns are read, against a filter of the
        batch's keys; files without a hit stay as they are. ``token`` (a name and a rising number) marks the change: one that the table
        has seen under this name, or a later one, is left out (None), so a replay changes nothing.
        """
        ensure_checkpoint_dir(self.spark)
        version = self.version()
        about, listed = self._about(version), self.manifest(version)
        if token and about["applied"].get(token[0], -1) >= token[1]:
            return None
        keys = about["keys"]
        if not keys:
            raise ValueError("the table has no key")
        if token:
            about["applied"][token[0]] = token[1]
        schema = T.StructType.fromJson(about["schema"])
        versions = order in schema.names
        keyed, keyless = self._split(batch, about)
        latest = keep_first(keyed, keys, [F.desc(order)]).checkpoint()
        hit = {r["b"]: r["n"] for r in latest.groupBy(self._bucket(about).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        names = [r["file"] for r in listed.where(F.col("bucket").isin(list(hit))).select("file").collect()] if hit else []
        if names:
            may = key_filter(latest, keys, sum(hit.values()))
            probed = self._rows(about, names).select(*keys, F.col("_metadata.file_path").alias("_file")).where(may)
            names = [r["_file"] for r in probed.select("_file").distinct().collect()]
        old = self._rows(about, names)
        if versions:
            both = old.withColumn("_new", F.lit(0)).unionByName(latest.withColumn("_new", F.lit(1)), allowMissingColumns=True)
            merged = keep_first(both, keys, [F.desc_nulls_last(order), F.desc("_new")]).drop("_new")
        else:
            merged = upsert_by_key(old, latest, keys, order)
        about["schema"] = T.StructType([*schema.fields, *[f for f in merged.schema.fields if f.name not in schema.names]]).jsonValue()
        blank = self.spark.createDataFrame([], T.StructType.fromJson(about["schema"]))
        keyless = blank.unionByName(keyless if versions else keyless.drop(order), allowMissingColumns=True)
        return self._swap(version, about, listed, names, merged.select(*blank.columns), keyless.select(*blank.columns), len(names))

    def expire(self, now: Column, days: int = 7) -> Change:
        """Drop the rows that are older than ``days`` before ``now``, a constant; rows without time stay.

        Files whose latest row is too old, and that have no row without time, go unread; those whose earliest row is young enough stay as
        they are. Only files across the edge are read and replaced.
        """
        version = self.version()
        about, listed = self._about(version), self.manifest(version)
        if not about["ts"]:
            raise ValueError("the table has no time")
        cutoff = now - F.make_dt_interval(F.lit(days))
        old = listed.where(F.col("low") < cutoff).select("file", ((F.col("high") < cutoff) & (F.col("n_untimed") == 0)).alias("past")).collect()
        if not old:
            return Change(version, 0, 0, listed.count(), 0)
        edge = [r["file"] for r in old if not r["past"]]
        rows = self._split(expire(self._rows(about, edge), about["ts"], now, days), about) if edge else (None, None)
        return self._swap(version, about, listed, [r["file"] for r in old], *rows, len(edge))

    def compact(self, least_rows: int = FILE_ROWS // 8) -> Change:
        """Replace the files of fewer than ``least_rows`` rows, in buckets that have several of them, by larger ones."""
        version = self.version()
        about, listed = self._about(version), self.manifest(version)
        small = listed.where(F.col("n_rows") < least_rows)
        several = small.groupBy("bucket", F.to_date("low").alias("day")).agg(F.collect_list("file").alias("files")).where(F.size("files") > 1)
        names = [r["file"] for r in several.select(F.explode("files").alias("file")).collect()]
        if not names:
            return Change(version, 0, 0, listed.count(), 0)
        return self._swap(version, about, listed, names, *self._split(self._rows(about, names), about), len(names))

    def vacuum(self, keep: int = 2) -> int:
        """Remove data files that none of the last ``keep`` versions lists; returns their number. No change may be under way."""
        last = self.version()
        listed = None
        for v in range(max(1, last - keep + 1), last + 1):
            files = self.manifest(v).select("file")
            listed = files if listed is None else listed.union(files)
        every = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/data").select(F.col("path").alias("at"))
        same = F.regexp_replace("at", "^file:/+", "/") == F.regexp_replace("file", "^file:/+", "/")
        gone = [r["at"] for r in every.join(listed.distinct(), same, "left_anti").collect()]
        for name in gone:
            fs, target = _path(self.spark, name)
            fs.delete(target, False)
        return len(gone)
