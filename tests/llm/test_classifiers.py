"""Quality, toxicity and language: held-out accuracy on the small table, and defined results for odd rows."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from postmill.llm import centroid_langid, labelled, neighbour_quality, ordinal_toxicity, queries

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (None, "The of and.", "x"), (4, "12345 !!! ###", "x"), (5, "Que los ciónadora de las " * 40_000, "x"), (6, "日本語", "x"), (6, "日本語", "x")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def test_quality(spark, tables, odd):
    docs, labels = tables
    got = queries.QUERIES["op1_neighbour_quality"](spark, SF).join(labels, "doc_id").toPandas()
    assert got.held_out.equals(got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0))
    test = got[got.held_out & got.quality.notna()]
    assert (test.predicted == test.quality).mean() > 0.95
    assert ((got.score >= 0) & (got.score <= 1) & (got.predicted == (got.score >= 0.3))).all()
    model = neighbour_quality.train(docs, labels)
    rows = neighbour_quality.score_quality(odd, model).toPandas()
    assert len(rows) == len(ODD) and rows.score.between(0, 1).all()
    assert rows.score[0] == rows.score[1] and rows.score[6] == rows.score[7] and not rows.held_out[3]


def test_quality_votes_match_brute_force(tables):
    docs, labels = tables
    model = neighbour_quality.train(docs, labels, most=200)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    import numpy as np

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    counts = neighbour_quality._counts(data, at)
    got = model.scores(counts)
    v = model.weighted(counts) @ model.axes
    for n in range(len(texts)):
        cosine = model.voters @ (v[n] / np.linalg.norm(v[n]))
        near = np.argsort(-cosine)[: neighbour_quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-6) ** 4
        assert got[n] == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-4)


def test_quality_of_equal_texts(spark, tables):
    """Copies among the voters are ties: the first ones count, and equal texts get equal scores in whatever batch they come."""
    docs, labels = tables
    model = neighbour_quality.train(docs, labels)
    some = docs.limit(120).select("text")
    both = some.unionByName(some).selectExpr("row_number() OVER (ORDER BY text) AS doc_id", "text").repartition(7)
    got = neighbour_quality.score_quality(both, model).join(both, "doc_id").groupBy("text").agg(F.count_distinct("score").alias("n"))
    assert got.where("n > 1").isEmpty()
    import numpy as np

    tied = neighbour_quality.QualityModel(model.idf, model.axes, np.repeat(model.voters[:1], 40, 0), np.array([1.0] * 15 + [0.0] * 25))
    counts = np.ones((3, neighbour_quality.GRAM_WIDTH + neighbour_quality._EXTRA))
    assert tied.scores(counts).tolist() == [1.0] * 3


def test_toxicity(spark, tables, odd):
    docs, labels = tables
    got = queries.QUERIES["op2_ordinal_toxicity"](spark, SF).join(labels, "doc_id").toPandas()
    assert set(got.grade) <= {0, 1, 2} and got.severity.between(0, 2).all()
    model = ordinal_toxicity.train(docs, labels)
    scored = ordinal_toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "said").join(labels, "doc_id").toPandas()
    test = scored[scored.held_out]
    assert (test.said == (test.toxic == 1)).mean() > 0.9
    assert scored[scored.toxic == 1].severity.mean() > 4 * scored[scored.toxic == 0].severity.mean()
    rows = ordinal_toxicity.score_toxicity(odd, model).toPandas()
    assert len(rows) == len(ODD) and not rows.toxic.any()


def test_ordinal_thresholds_are_ordered():
    import numpy as np

    g = np.random.default_rng(1)
    grades = g.integers(0, 4, 800)
    rows = np.repeat(np.arange(800), 6)
    columns = np.where(g.random(4800) < 0.25 * np.repeat(grades, 6), g.integers(0, 5, 4800), g.integers(10, 400, 4800))
    model = ordinal_toxicity.fit_ordinal(rows, columns, grades)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[:5].min() > 0
    p = model.exceeds(np.bincount(rows, weights=model.weights[columns]))
    assert (np.diff(p, axis=1) <= 0).all() and np.corrcoef(p.sum(1), grades)[0, 1] > 0.8


def test_language(spark, tables, odd):
    docs, _ = tables
    got = queries.QUERIES["op6_centroid_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.97 and got.score.between(0, 1).all()
    model = centroid_langid.train(docs, docs, "lang")
    rows = centroid_langid.identify(odd, model, reject=False).toPandas()
    assert list(rows.lang_pred[[0, 1, 2, 4]]) == ["und"] * 4 and rows.lang_pred[5] == "es" and rows.lang_pred[6] in model.languages
    assert centroid_langid.identify(odd, model).toPandas().lang_pred[6] == "und"


def test_language_learns_from_labelled_rows_only(spark, tables):
    """Texts without a language, and those of the held-out fold, change nothing that is learned."""
    docs, _ = tables
    docs = docs.select("doc_id", "text", "lang").limit(300)
    odd = docs.selectExpr("doc_id + 1000000 AS doc_id", "reverse(text) AS text", "CAST(NULL AS STRING) AS lang")
    held = docs.where(labelled.held_out()).selectExpr("doc_id", "upper(text) AS text", "'xx' AS lang")
    a, b = centroid_langid.train(docs, docs, "lang"), docs.unionByName(odd).unionByName(held)
    b = centroid_langid.train(b, b, "lang")
    assert a.languages == b.languages and (a.idf == b.idf).all() and (a.centroids == b.centroids).all()
    c = centroid_langid.train(docs.select("doc_id", "text"), docs.select("doc_id", "lang"), "lang")
    assert (a.idf == c.idf).all() and (a.centroids == c.centroids).all()


def test_language_against_a_loop(spark, tables):
    """The nearest centroid of each text by one cosine at a time; at equal cosines the smaller language."""
    import numpy as np

    docs, _ = tables
    model = centroid_langid.train(docs, docs, "lang")
    texts = [r.text for r in docs.select("text").limit(40).collect()]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    counts = centroid_langid._counts(data, at)
    got, cosine = model.nearest(counts)
    vectors = model.vectors(counts)
    for n in range(len(texts)):
        every = [float(np.dot(vectors[n].astype(float), c.astype(float))) for c in model.centroids]
        assert cosine[n] == pytest.approx(max(every), abs=1e-5) and every[int(np.argmax(every))] - max(x for x, k in zip(every, model.of, strict=True) if k == got[n]) < 1e-5
    twice = centroid_langid.LanguageModel(["a", "b"], np.repeat(model.centroids[:1], 2, 0), np.array([0, 1]), model.idf, np.zeros(2))
    assert (twice.nearest(counts)[0] == 0).all()


def test_nothing_to_learn_or_score(spark, tables, odd):
    docs, labels = tables
    none = docs.limit(0)
    assert neighbour_quality.score_quality(none, neighbour_quality.train(docs, labels.limit(0))).count() == 0
    assert set(neighbour_quality.score_quality(odd, neighbour_quality.train(none, labels)).toPandas().score) == {0.5}
    assert not ordinal_toxicity.score_toxicity(odd, ordinal_toxicity.train(none, labels)).where("toxic").count()
    nulls = docs.withColumn("lang", F.lit(None).cast("string"))
    assert set(centroid_langid.identify(odd, centroid_langid.train(none, nulls, "lang")).toPandas().lang_pred) == {"und"}
