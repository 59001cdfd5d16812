"""Postings arriving as files → a landing table or a keyed table, one row per posting, expired by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.spread import keep_first
from postmill.sources.stored import StoredTable
from postmill.sources.tables import expire


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_upsert(arrivals: DataFrame, out_dir: str, checkpoint: str, ts: str) -> StreamingQuery:
    """Start the ingest: every version of a row lands, in its batch's folder and under the date of its event.

    Only exact repeats within a batch are dropped, as a later edit of a key must win. A batch replaces its folder, so a
    replay after a lost executor changes nothing. Rewriting the table per batch is avoided; ``current`` resolves keys on
    read, from the dates it needs.
    """
    rows = arrivals.withColumn(ts, F.col(ts).cast("timestamp"))

    def land(batch: DataFrame, batch_id: int) -> None:
        dated = batch.dropDuplicates().withColumn("event_date", F.to_date(ts))
        # Rebalancing splits a large day over several tasks, by size.
        dated.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(f"{out_dir}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out_dir: str, keys: list[str], ts: str, order: str, days: int | None = 7) -> DataFrame:
    """Latest row per key of the landed batches, by ``order`` and then by batch, without rows older than ``days`` before the newest.

    With ``days``, only folders of the dates that can count are read, and those of rows without a time; older versions of a
    row that has a later one in them don't matter.
    """
    landed = spark.read.parquet(out_dir)
    if days is not None:
        newest = landed.agg(F.max("event_date")).scalar()
        landed = landed.filter(F.col("event_date").isNull() | (F.col("event_date") >= F.date_sub(newest, days)))
    latest = keep_first(landed, keys, [F.desc_nulls_last(order), F.desc("batch_id")]).drop("batch_id", "event_date")
    return latest if days is None else expire(latest, ts, landed.agg(F.max(ts)).scalar(), days)


def stream_into(arrivals: DataFrame, table: StoredTable, keys: list[str], ts: str, staging: str, checkpoint: str, days: int = 7) -> StreamingQuery:
    """Start the ingest into a keyed table whose rows are versions by ``ts``: the latest version of a key counts.

    The stream keeps the versions of the last ``days`` of event time in its state store, so a version that arrives again, in whatever batch, is
    dropped there; the watermark follows the latest time seen by ``days``, rows behind it are late and dropped (``late_rows`` counts
    them), and state behind it is forgotten. Rows without time have no place in that state; they go to the table as they come, which
    keeps one per key. Each batch is staged once, merged by key into the table, which notes the batch's number: a batch that is
    replayed after a failure, or after a restart from the checkpoint, changes nothing. Then the table drops what the watermark has passed.
    """
    rows = arrivals.withColumn(ts, F.col(ts).cast("timestamp"))
    version = F.xxhash64(*[F.col(c) for c in rows.columns])
    timed = rows.where(F.col(ts).isNotNull()).withColumn("_version", version).withWatermark(ts, f"{days} days")
    timed = timed.dropDuplicatesWithinWatermark([*keys, ts, "_version"]).drop("_version")
    untimed = rows.where(F.col(ts).isNull())

    def merge(batch: DataFrame, batch_id: int) -> None:
        # The state store must not be asked twice, so the batch is read back from where it is staged.
        batch.write.mode("overwrite").parquet(f"{staging}/batch_id={batch_id}")
        staged = batch.sparkSession.read.schema(rows.schema).parquet(f"{staging}/batch_id={batch_id}")
        if not staged.isEmpty():
            table.upsert(staged, ts, (checkpoint, batch_id))
            table.expire(table.manifest().agg(F.max("high")).scalar(), days)

    return timed.union(untimed).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped since the query was started."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
