"""The stored table against plain merges, and what it reads and leaves; the stream into it with late rows, replays and a restart."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmill.sources import stored, tables
from postmill.sources.stored import StoredTable
from postmill.streaming import ingest

SCHEMA = "k string, n int, v string, t timestamp"
DAY = datetime(2024, 3, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(table):
    return {r["file"] for r in table.manifest().select("file").collect()}


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(f"k{n}", n, "old", DAY + timedelta(hours=n)) for n in range(400)], SCHEMA)


def test_upsert_equals_the_plain_merge(spark, tmp_path, base):
    table = StoredTable.create(base, f"{tmp_path}/t", ["k"], "t", 8)
    plain = base
    rng = random.Random(3)
    for step in range(3):
        batch = [(rng.choice([None, f"k{rng.randint(0, 500)}"]), s, rng.choice(["a", "b", None]), step) for s in range(40)]
        df = spark.createDataFrame(batch, "k string, seq int, v string, extra int")
        plain = tables.upsert_by_key(plain, df, ["k"], "seq")
        table.upsert(df, "seq")
        assert rows_of(table.read().select(plain.columns)) == rows_of(plain)
    assert table.read(1).count() == 400 and table.version() == 4


def test_untouched_files_keep_their_names(spark, tmp_path, base):
    table = StoredTable.create(base, f"{tmp_path}/t", ["k"], "t", 16)
    before = files_of(table)
    change = table.upsert(spark.createDataFrame([("k5", 1, "new"), ("k7", 1, "new"), ("brand new", 1, "new")], "k string, seq int, v string"), "seq")
    after = files_of(table)
    # Two keys have a file each to be read; the filter may name another one now and then.
    assert len(before) > 100 and 2 <= change.read <= 6 and len(before - after) == change.read and len(before & after) == change.kept
    assert table.read().where("v = 'new'").count() == 3
    change = table.upsert(spark.createDataFrame([("k900", 1, "x")], "k string, seq int, v string"), "seq")
    assert change.read <= 2 and change.written >= 1


def test_key_filter(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    every = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    passed = {int(r.k) for r in every.where(stored.key_filter(keys, ["k"], 1000)).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 1200
    assert every.where(stored.key_filter(keys.limit(0), ["k"], 0)).count() == 0


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x", DAY), ("b", 1, "x", None)], SCHEMA)
    table = StoredTable.create(df, f"{tmp_path}/t", ["k"], "t", 2)
    later = [("a", 2, "old version", DAY - timedelta(days=1)), ("b", 2, "dated", DAY), ("c", 1, "first", DAY), ("c", 2, "last", DAY + timedelta(hours=1)), (None, 0, "no key", DAY)]
    assert table.upsert(spark.createDataFrame(later, SCHEMA), "t", ("s", 5)).version == 2
    assert sorted(r.v for r in table.read().collect()) == ["dated", "last", "no key", "x"]
    assert table.upsert(spark.createDataFrame(later, SCHEMA), "t", ("s", 5)) is None and table.version() == 2
    assert table.upsert(spark.createDataFrame(later[:1], SCHEMA), "t", ("other", 1)).version == 3


def test_expiry_reads_only_the_edge(spark, tmp_path, base):
    untimed = spark.createDataFrame([("u", 0, "no time", None)], SCHEMA)
    table = StoredTable.create(base.union(untimed), f"{tmp_path}/t", ["k"], "t", 2)
    now = F.lit(DAY + timedelta(hours=399))
    days = 400 // 24 + 1
    before = files_of(table)
    change = table.expire(now, 7)
    assert rows_of(table.read()) == rows_of(tables.expire(base.union(untimed), "t", now, 7))
    # Two buckets by day: nine days are past, one lies across the edge, seven are young, and the rows without time stay.
    assert len(before) == 2 * days + 1 and change.read == 2 and change.dropped >= 2 * 8 and change.kept == len(before) - change.read - change.dropped
    assert files_of(table) & before and table.expire(now, 7).read == 0


def test_two_writers(spark, tmp_path, base):
    table = StoredTable.create(base, f"{tmp_path}/t", ["k"], "t", 2)
    about = table._about(1)
    table.expire(F.lit(DAY + timedelta(hours=399)), 7)
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit(1, about, table.manifest(1))
    assert table.version() == 2


def test_empty_and_keyless(spark, tmp_path, base):
    table = StoredTable.create(base.limit(0), f"{tmp_path}/t", ["k"], "t", 4)
    assert table.read().count() == 0 and table.expire(F.lit(DAY), 7).written == 0
    table.upsert(base.withColumn("seq", F.col("n")), "seq")
    assert rows_of(table.read().select(base.columns)) == rows_of(base)
    plain = StoredTable.create(base, f"{tmp_path}/p", ts="t")
    assert plain.read().count() == 400
    with pytest.raises(ValueError, match="no key"):
        plain.upsert(base, "n")
    with pytest.raises(ValueError, match="no time"):
        StoredTable.create(base, f"{tmp_path}/q", ["k"]).expire(F.lit(DAY), 7)


def test_compact_and_vacuum(spark, tmp_path, base):
    table = StoredTable.create(base.where("n < 20"), f"{tmp_path}/t", ["k"], "t", 2)
    for n in range(4):
        table.upsert(base.where(f"n >= {20 + n} AND n < {21 + n}"), "t")
    many = len(files_of(table))
    change = table.compact()
    assert len(files_of(table)) < many and change.read > 2 and rows_of(table.read()) == rows_of(base.where("n < 24"))
    assert table.vacuum(keep=1) > 0 and rows_of(table.read()) == rows_of(base.where("n < 24")) and table.vacuum(keep=1) == 0


# ---- stream ----------------------------------------------------------------------


def start(spark, tmp_path, table):
    arrivals = ingest.read_arrivals(spark, f"{tmp_path}/in", table.read().schema)
    query = ingest.stream_into(arrivals, table, ["k"], "t", f"{tmp_path}/staging", f"{tmp_path}/progress")
    query.awaitTermination()
    return query


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_stream_with_late_rows_replay_and_restart(spark, tmp_path, monkeypatch):
    table = StoredTable.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/t", ["k"], "t", 4)
    at = lambda d: DAY + timedelta(days=d)
    arrive(spark, tmp_path, [("a", 1, "first", at(20)), ("a", 1, "first", at(20)), ("b", 1, "kept", at(14)), ("u", 0, "no time", None)])
    start(spark, tmp_path, table)
    assert {(r.k, r.v) for r in table.read().collect()} == {("a", "first"), ("b", "kept"), ("u", "no time")}

    # A repeat of the first batch, a newer version, an older one within the watermark, and two rows that are late.
    arrive(spark, tmp_path, [("a", 1, "first", at(20)), ("b", 2, "edited", at(15)), ("a", 0, "older", at(18)), ("late", 1, "x", at(5)), ("late", 2, "y", at(12))])
    query = start(spark, tmp_path, table)
    assert ingest.late_rows(query) == 2
    assert {(r.k, r.v) for r in table.read().collect()} == {("a", "first"), ("b", "edited"), ("u", "no time")}
    staged = spark.read.parquet(f"{tmp_path}/staging").where("k = 'a' AND v = 'first'").count()
    assert staged == 1  # the repeat was dropped by the state, a batch later

    # The table takes the batch, then the query dies before its checkpoint knows: the batch is replayed and changes nothing.
    arrive(spark, tmp_path, [("c", 1, "new", at(30))])
    seen = StoredTable.expire
    monkeypatch.setattr(StoredTable, "expire", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path, table)
    version = table.version()
    monkeypatch.setattr(StoredTable, "expire", seen)
    start(spark, tmp_path, table)
    # The replay adds nothing; only what the failure left undone, the expiry, makes a version.
    assert table.version() == version + 1 and sorted(r.k for r in table.read().collect()) == ["c", "u"]
    arrive(spark, tmp_path, [("d", 1, "after", at(31))])
    start(spark, tmp_path, table)
    assert {(r.k, r.v) for r in table.read().collect()} == {("u", "no time"), ("c", "new"), ("d", "after")}


def test_a_day_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(DAY).alias("t"))
        table = StoredTable.create(df, f"{tmp_path}/t", ["k"], "t", 1)
        assert len(files_of(table)) > 3 and table.read().count() == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
