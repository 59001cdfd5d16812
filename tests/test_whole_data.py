"""No prefix decides, the last edit wins, exports are sorted, scratch data needs a shared folder."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postmill import session
from postmill.operators import curate, matching
from postmill.sources import tables, unify
from postmill.streaming import ingest


def test_keys_see_whole_texts(spark):
    lead = "same opening " * 60
    df = spark.createDataFrame([(lead + "pay 100",), (lead + "pay 200",)], "t string")
    x = F.lit("x")
    for key in (curate.text_key(F.col("t")), unify.fingerprint(x, x, x, F.col("t"))):
        assert df.select(key.alias("k")).distinct().count() == 2
    for key in (curate.text_key(F.col("t"), 500, 12), unify.fingerprint(x, x, x, F.col("t"), 400)):
        assert df.select(key.alias("k")).distinct().count() == 1


def test_rows_without_order_stay(spark):
    df = spark.createDataFrame([(1, "k", 1.0), (2, "k", 2.0), (None, "k", 9.0), (None, "z", 1.0)], "o long, key string, score double")
    got = curate.keep_best(df, "key", "score", "o").collect()
    assert sorted((str(r.o), r.dedup_keep_for_analytics) for r in got) == [("1", False), ("2", True), ("None", True), ("None", True)]


def test_export_is_sorted_inside_files(spark, tmp_path):
    df = spark.range(5000).select(
        "id", (F.col("id") * 7 % 3).cast("string").alias("source"), (F.col("id") * 11 % 13).cast("string").alias("category"), (F.col("id") * 5 % 4).cast("string").alias("level"))
    tables.export_unified(df.repartition(6), f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/source=*/*.parquet")
    read = [list(zip(*(t.column(x).to_pylist() for x in ("category", "level")), strict=True)) for t in map(pq.ParquetFile, files) for t in [t.read()]]
    assert sum(map(len, read)) == 5000 and all(rows == sorted(rows) for rows in read)


def test_cyrillic_bytes(spark):
    texts = [bytes(range(32, 152)).decode("windows-1251", "ignore"), "Вакансия № 5 — Ёлка", ""]
    df = spark.createDataFrame([(t.encode("windows-1251"), t) for t in texts], "b binary, t string")
    got = df.select(tables.decode_cyrillic(F.col("b")).alias("d"), tables.encode_cyrillic(F.col("t")).alias("e"), "b", "t").collect()
    assert all(r.d == r.t and bytes(r.e) == bytes(r.b) for r in got)


def test_last_edit_wins_and_unknown_times_stay(spark, tmp_path):
    schema = "k long, v string, ts timestamp"
    first = "SELECT * FROM VALUES (1L, 'old', TIMESTAMP'2024-01-09 10:00:00'), (1L, 'old', TIMESTAMP'2024-01-09 10:00:00'), (2L, 'no time', NULL), (3L, 'expired', TIMESTAMP'2024-01-01 00:00:00') AS t(k, v, ts)"
    second = "SELECT * FROM VALUES (1L, 'edited', TIMESTAMP'2024-01-10 10:00:00'), (4L, 'new', TIMESTAMP'2024-01-10 11:00:00') AS t(k, v, ts)"
    for batch in (first, second):
        spark.sql(batch).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals = ingest.read_arrivals(spark, f"{tmp_path}/in", spark.sql(batch).schema)
        ingest.stream_upsert(arrivals, f"{tmp_path}/out", f"{tmp_path}/progress", "ts").awaitTermination()
    got = ingest.current(spark, f"{tmp_path}/out", ["k"], "ts", "ts", 7)
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "edited"), (2, "no time"), (4, "new")], schema


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_postings_are_narrowed(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5.0), (3, "a", 50.0), (4, "b", 50.0)], "id long, city_norm string, salary_avg_clean double")
    assert sorted(r.id for r in matching.narrow_postings(df, city="a", salary_min=10).collect()) == [1, 3]


def test_rules_run_once(spark, monkeypatch):
    """Audits and marts read the rows of a rule chain, not the chain again."""
    from pyspark.sql import functions as F

    from postmill.operators import curate

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(x):
        seen.add(1)
        return x

    rows = [(k, "chat", f"text {k}", "a" if k % 2 else "no_match", None if k % 3 else "t", "c") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, source string, description_clean_v2 string, p string, title_final string, company_clean string")
    audit = curate.header_audit(df.withColumn("header_parse_pattern", once(F.col("p"))), "id")
    assert [audit[x].count() for x in ("summary", "patterns", "examples", "samples")] == [1, 1, 5, 26]
    assert audit["summary"].first().matched_rows == 20 and audit["patterns"].first().n_rows == 20
    assert seen.value == 40
