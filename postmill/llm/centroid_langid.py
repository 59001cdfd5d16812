"""Language by nearest centroid: TF-IDF n-gram vectors against several clustered centroids per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.grams import count_grams, counted, document_frequencies, inverse_frequency, letters_only, unit
from postmill.llm.labelled import held_out, sample_rows

WIDTH = 2048
#: Centroids of a language, and the labelled documents of each language from which they are clustered.
CENTROIDS, SAMPLE_PER_LANGUAGE = 4, 256
#: Share of a language's own sample that lies beyond its rejection distance.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
_LETTERS = letters_only()


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return count_grams(_LETTERS[data], at, WIDTH)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, unit centroids with their languages' numbers, inverse document frequencies, least cosine of each language."""

    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(counts.astype(np.float32) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid's language and the cosine to it; ties to the smaller number."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        return self.of[best], cosine[np.arange(len(best)), best]


def clustered(vectors: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids by spherical k-means; the first is next to the mean, each further one is the vector farthest from those."""
    picked = [int((vectors @ vectors.mean(0)).argmax())]
    while len(picked) < min(k, len(vectors)):
        picked.append(int((vectors @ vectors[picked].T).max(1).argmin()))
    centroids = vectors[picked]
    for _ in range(rounds):
        near = (vectors @ centroids.T).argmax(1)
        moved = unit(np.stack([vectors[near == c].sum(0) if (near == c).any() else centroids[c] for c in range(len(centroids))]))
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> LanguageModel:
    """Frequencies from every labelled document of the folds that may be learned from, centroids from a bounded sample of each language."""
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    if labels is docs:
        learn = learn.where(F.col(label_col).isNotNull())
    else:
        learn = learn.join(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col)).distinct(), id_col, "left_semi")
    learn = learn.select(F.col(text_col).alias("text"))
    have, n = document_frequencies(learn, _counts, WIDTH)
    idf = inverse_frequency(have, n)

    def vectorise(batches):
        for batch in batches:
            for i, j, counts in counted(batch.column("text"), _counts):
                yield pa.record_batch([batch.column("label")[i:j], pa.array([c.astype(np.float32).tobytes() for c in counts], pa.binary())], names=["label", "counts"])

    sample = sample_rows(docs, labels, label_col, per_language, id_col, text_col, by_label=True)
    rows = sample.mapInArrow(vectorise, "label string, counts binary").toPandas()
    model = LanguageModel([], np.zeros((0, WIDTH), np.float32), np.zeros(0, int), idf, np.zeros(0))
    languages, centroids, of, least = sorted(set(rows["label"])), [], [], []
    for number, language in enumerate(languages):
        m = np.stack([np.frombuffer(x, np.float32) for x in sorted(rows["counts"][rows["label"] == language])])
        v = model.vectors(m)
        v = v[v.any(1)]
        if len(v):
            c = clustered(v, k)
            centroids.append(c)
            of += [number] * len(c)
            least.append(float(np.quantile((v @ c.T).max(1), REJECTED_SHARE)))
        else:
            least.append(1.0)
    return LanguageModel(languages, np.concatenate(centroids) if centroids else model.centroids, np.array(of, int), idf, np.array(least))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs``.

    score is the cosine to the nearest centroid (0 if there is none). A text that is null or has no letter is ``und`` with score 0,
    as is every text if nothing was learned. rejected marks texts beyond the rejection distance of their nearest language; with
    ``reject`` these are ``und`` too. Only the text is read: extra columns neither count nor clash. Equal texts get equal results.
    """
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), dtype=bool)
            for i, j, counts in counted(batch.column("text"), _counts):
                number, cosine = np.full(j - i, len(model.languages)), np.zeros(j - i)
                far = np.ones(j - i, bool)
                seen = letters[i:j] & counts.any(1)
                if len(model.of) and seen.any():
                    number[seen], cosine[seen] = model.nearest(counts[seen])
                    far[seen] = cosine[seen] < model.least[number[seen]]
                    if reject:
                        number[far] = len(model.languages)
                yield pa.record_batch([batch.column("doc_id")[i:j], batch.column("held_out")[i:j], pa.array(names[number], pa.string()), pa.array(np.clip(cosine, 0.0, 1.0)), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
