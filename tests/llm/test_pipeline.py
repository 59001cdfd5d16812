"""The pipeline's stages, each on its own input, against brute force; and its decisions on the small table."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_leaks import overlap, words
from tests.llm.test_near_duplicates import brute
from tests.llm.test_substrings import covered

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = "SELECT * FROM VALUES (CAST(NULL AS BIGINT), 'no id but a text', 'en', 's', 16L), (900001L, NULL, NULL, NULL, NULL), (900002L, '', 'en', 's', 0L), (900003L, 'twice', 'en', 's', 5L), (900003L, 'twice', 'en', 's', 5L) AS t(doc_id, text, lang, source, n_chars)"
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.sql(odd)).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality(spark, docs):
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == COLUMNS and kept.schema == docs.schema
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r.doc_id for r in kept.collect()}
    judged = [(r.doc_id in left, r.quality == 1) for r in labels.collect()]
    assert sum(x == y for x, y in judged) / len(judged) > 0.95
    assert set(rows(kept)) <= set(rows(docs))


def test_near_dedup(spark, docs):
    data = [tuple(r)[:3] for r in docs.collect()]
    keep = {d for d, _, _, kept in brute(data, corpus_pipeline.NEAR) if kept}
    want = {r for r in rows(docs) if r[0] in keep}
    got = rows(corpus_pipeline.near_dedup(spark, docs, SF))
    assert set(got) == want and len(got) == len(set(got))


def test_substring_dedup(spark, docs):
    data = docs.collect()
    items = [list((r.text or "").encode()) for r in data]
    want = []
    for r, seq, hit in zip(data, items, covered(items, [r.doc_id for r in data], 50), strict=True):
        kept = bytes(b for b, h in zip(seq, hit, strict=True) if not h).decode("utf-8", "ignore")
        if not any(hit):
            want.append(tuple(r))
        elif kept.strip(" \t\n\v\f\r"):
            want.append((r.doc_id, kept, r.lang, r.source, len(kept)))
    got = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert got.columns == COLUMNS and rows(got) == sorted(want, key=str)


def test_decontaminate(spark, docs, tmp_path):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = items[:6]
    spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = docs.where("doc_id % 29 = 1 AND length(text) < 900 OR length(text) < 60 OR text IS NULL").collect()
    some += [r for r in docs.where("length(text) < 3000").collect() if any(" ".join(i[:6]) in " ".join(words(r.text)) for i in items)]
    ids = {r.doc_id for r in some}
    left = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert left & ids == {r.doc_id for r in some if not any(overlap(words(r.text), i) for i in items)}


def test_mix(spark, docs):
    mixed = corpus_pipeline.mix(spark, docs, SF)
    got = mixed.toPandas()
    size = {t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in got.text}
    assert (got["size"] == got.text.map(size)).all() and (got.taken > 0).all() and (got.taken <= 3 * got["size"]).all()
    most = max(len((r.text or "").split()) for r in docs.collect())
    for _, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= most


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "source", "lang", "text"]
    assert 0 < got.count() < 200 and got.where(F.col("taken") <= 0).isEmpty()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty(spark, docs, stage):
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns(spark, docs, stage):
    """Columns with the names of helpers pass, and change nothing."""
    names = ["dropped_id", "dropped_version", "text_version", "n_removed", "kept", "carried", "absent", "id", "c0", "row", "ver", "_n_removed", "Component", "n", "a.b"]
    odd = docs
    for k, name in enumerate(names):
        odd = odd.withColumn(name, F.lit(f"x{k}"))
    got = stage(spark, odd, SF)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert all(got.where(F.col(f"`{name}`") != f"x{k}").isEmpty() for k, name in enumerate(names))
    assert rows(got.select(*COLUMNS)) == rows(stage(spark, docs, SF))


def test_many_dropped_ids_are_joined(spark, docs, monkeypatch):
    want = rows(corpus_pipeline.decontaminate(spark, docs, SF)), rows(corpus_pipeline.near_dedup(spark, docs, SF))
    monkeypatch.setattr(corpus_pipeline, "DROPPED", 0)
    assert (rows(corpus_pipeline.decontaminate(spark, docs, SF)), rows(corpus_pipeline.near_dedup(spark, docs, SF))) == want
