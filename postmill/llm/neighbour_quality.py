"""Quality by nearest-neighbour voting: labelled latent-semantic vectors vote on every document, weighted by cosine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.grams import count_grams, count_repeats, counted, document_frequencies, inverse_frequency, shapes, unit
from postmill.llm.labelled import held_out, sample_rows

#: Labelled documents that vote (a bound on what is broadcast), coordinates of a vector, neighbours that are asked.
LABELLED, DIMENSIONS, NEIGHBOURS = 4096, 48, 15
GRAM_WIDTH = 1024
GOOD_FROM = 0.3
#: Columns after the n-grams: words, repeats at lag one and two, words seen before, and one that every text has.
_EXTRA = 5
_SHAPES = shapes()


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return count_grams(_SHAPES[data], at, GRAM_WIDTH)


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([_grams(data, at), count_repeats(data, at).astype(np.int64), np.ones((len(at) - 1, 1), np.int64)], axis=1)


@dataclass(frozen=True)
class QualityModel:
    """Inverse document frequencies, the projection to latent coordinates, labelled unit vectors and their labels (0 or 1)."""

    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return _tf_idf(counts, self.idf)

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the ``k`` nearest voters, weighted by cosine; 0.5 without voters.

        Cosines are taken in doubles and rounded, so they don't depend on the texts of a block; of equal ones the first voters count.
        """
        if not len(self.voters):
            return np.full(len(counts), 0.5)
        cosine = np.round(unit(self.weighted(counts).astype(np.float64) @ self.axes) @ self.voters.T.astype(np.float64), 8)
        k = min(k, len(self.voters))
        order = cosine - np.arange(len(self.voters)) * (1e-9 / len(self.voters))
        near = np.sort(np.argpartition(order, len(self.voters) - k, axis=1)[:, -k:], axis=1)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0.0, 1.0)


def _tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative frequencies, rooted; repetition columns as shares of the words, with more weight."""
    grams = counts[:, :GRAM_WIDTH].astype(np.float32)
    grams = unit(np.sqrt(grams) * idf)
    extra = counts[:, GRAM_WIDTH:].astype(np.float32)
    words = np.maximum(extra[:, :1], 1)
    shares = np.concatenate([np.log1p(extra[:, :1]) / 20, extra[:, 1:4] / words, extra[:, 4:] * 0.1], axis=1)
    return np.concatenate([grams, shares], axis=1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, dimensions: int = DIMENSIONS) -> QualityModel:
    """Frequencies from every document; axes and voters from at most ``most`` labelled rows of the folds that may be learned from."""
    have, n = document_frequencies(docs.select(F.col(text_col).alias("text")), _grams, GRAM_WIDTH)
    idf = inverse_frequency(have, n)

    def vectorise(batches):
        for batch in batches:
            for i, j, counts in counted(batch.column("text"), _counts):
                yield pa.record_batch([batch.column("id")[i:j], batch.column("label")[i:j], pa.array([x.tobytes() for x in _tf_idf(counts, idf)], pa.binary())], names=["id", "label", "vector"])

    sample = sample_rows(docs, labels, label_col, most, id_col, text_col).withColumns({"id": F.col("id").cast("long"), "label": F.col("label").cast("int")})
    rows = sample.mapInArrow(vectorise, "id long, label int, vector binary").toPandas().sort_values("id")
    if not len(rows):
        return QualityModel(idf, np.zeros((GRAM_WIDTH + _EXTRA, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0))
    m = np.stack([np.frombuffer(x, np.float32) for x in rows["vector"]])
    axes = np.linalg.eigh(m.T.astype(np.float64) @ m)[1][:, ::-1][:, :dimensions].astype(np.float32)
    return QualityModel(idf, axes, unit(m @ axes), (rows["label"].to_numpy() > 0).astype(np.float64))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    score (0 to 1) is the cosine-weighted share of label 1 among the nearest labelled documents, from the whole text; predicted
    is 1 from a score of 0.3. A null text is empty; an empty text is scored like any other, by the neighbours of a text without
    words. Of voters at equal cosines those with the smaller ids count. Only the text is read, so equal texts get equal scores, in
    whatever batch they come, and extra columns don't matter. Null ids are kept.
    """

    def run(batches):
        for batch in batches:
            for i, j, counts in counted(batch.column("text"), _counts):
                yield pa.record_batch([batch.column("doc_id")[i:j], batch.column("held_out")[i:j], pa.array(model.scores(counts))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0))


def filter_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = GOOD_FROM) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more; null texts are scored as empty."""

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            good = [s >= least for _, _, counts in counted(batch.column(at), _counts) for s in model.scores(counts)]
            yield batch.filter(pa.array(good, pa.bool_()))

    # Columns travel under numbers, as names may hold anything.
    numbered = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
