"""Toxicity by cumulative-link ordinal regression: one weight per word for all grades, ordered thresholds, expected severity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.labelled import held_out, sample_rows
from postmill.llm.text_arrays import bytes_of, pieces, word_bounds, word_hashes

#: Hashed word columns, and the labelled documents of each label that are learned from.
WIDTH, SAMPLE_PER_LABEL = 1 << 18, 4096
ROUNDS, L1, LEAST_DOCS = 300, 1e-3, 3
TOXIC_FROM = 0.5
#: Besides whole words, their first bytes are features, so that inflected and compound forms share a weight.
BEGINNINGS = (3, 4, 5)

#: Letters and apostrophes inside words count; other ASCII characters part them. A-Z are read as a-z.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def word_columns(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hashed column of each distinct word and word beginning of each text; at most 2^20 texts."""
    data = _LETTERS[data]
    starts, ends, first = word_bounds(data, at)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64) << np.uint64(20), np.diff(first))
    keys = [owner | (word_hashes(data, starts, ends) & np.uint64(WIDTH - 1))]
    for k in BEGINNINGS:
        longer = ends - starts > k
        begun = word_hashes(data, starts[longer], starts[longer] + k) + np.uint64(k)
        keys.append(owner[longer] | (begun & np.uint64(WIDTH - 1)))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = logistic(thresholds[k] - w.x), with x the presence of words; ``weights`` of all hashed columns."""

    weights: np.ndarray
    thresholds: np.ndarray

    def exceeds(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text for each k but the last grade."""
        return 1 - _logistic(self.thresholds[None, :] - margin[:, None])


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, rounds: int = ROUNDS, l1: float = L1, least_docs: int = LEAST_DOCS) -> OrdinalModel:
    """Fit by accelerated proximal gradients with an L1 penalty on word weights; words in fewer than ``least_docs`` texts have none.

    Weights are at least 0: a word can add to the severity, but no amount of harmless text takes from it.

    Texts of each grade count so that grade 0 and all others weigh the same. Thresholds are a first one and
    positive steps, which move by a tenth a round at most, as they share their scale with the weights.
    """
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    if n == 0 or top == 0 or (grades > 0).all():
        return OrdinalModel(np.zeros(WIDTH, np.float32), np.full(max(top, 1), 40.0 if not n or top == 0 else -40.0))
    share = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())
    # Only features that lean towards the higher grades by themselves can get a weight; rare ones are left out.
    seen = np.bincount(columns, minlength=WIDTH)
    lean = np.bincount(columns, weights=(share * np.where(grades > 0, 0.5, -0.5))[rows], minlength=WIDTH)
    use = np.flatnonzero((seen >= least_docs) & (lean > l1 / 2))
    short = np.full(WIDTH, -1)
    short[use] = np.arange(len(use))
    keep = short[columns] >= 0
    r, c = rows[keep], short[columns[keep]]
    # A safe step for each feature: the curvature of its texts, each as often as it has features.
    load = np.bincount(r, minlength=n)
    rate = 1 / np.maximum(np.bincount(c, weights=(share * load)[r], minlength=len(use)) / 2, 1e-9)
    w = z = np.zeros(len(use))
    base, steps, t = 0.0, np.zeros(top - 1), 1.0
    for _ in range(rounds):
        thresholds = base + np.append(0.0, np.cumsum(np.exp(steps)))
        eta = np.bincount(r, weights=z[c], minlength=n)
        a = np.where(grades < top, _logistic(np.append(thresholds, 0)[np.minimum(grades, top)] - eta), 1.0)
        b = np.where(grades > 0, _logistic(np.append(0, thresholds)[grades] - eta), 0.0)
        mass = np.maximum(a - b, 1e-9)
        slope = share * (1 - a - b)  # of the loss by eta
        da, db = share * a * (1 - a) / mass, share * b * (1 - b) / mass
        down = -np.bincount(np.minimum(grades, top - 1), weights=np.where(grades < top, da, 0), minlength=top)[:top]
        down += np.bincount(np.maximum(grades - 1, 0), weights=np.where(grades > 0, db, 0), minlength=top)[:top]
        new = z - rate * np.bincount(c, weights=slope[r], minlength=len(use))
        new = np.maximum(new - rate * l1, 0)
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / further * (new - w)
        if ((z - new) * (new - w)).sum() < 0:
            further = 1.0
        w, t = new, further
        base -= np.clip(down.sum(), -0.1, 0.1)
        for k in range(top - 1):
            steps[k] = np.clip(steps[k] - np.clip(down[k + 1 :].sum() * np.exp(steps[k]), -0.1, 0.1), -3, 3)
    full = np.zeros(WIDTH, np.float32)
    full[use] = w
    return OrdinalModel(full, base + np.append(0.0, np.cumsum(np.exp(steps))))


def graded_by_markers(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, grades: int = 3) -> np.ndarray:
    """Grades 0 .. grades - 1 from labels 0 and 1: toxic texts are graded by how many toxic words they have.

    Toxic words are those found in ``LEAST_DOCS`` toxic texts and at least 20 times as often there as in others. A toxic text's
    grade grows at even quantiles of that number.
    """
    bad = np.bincount(columns[toxic[rows] > 0], minlength=WIDTH)
    good = np.bincount(columns[toxic[rows] == 0], minlength=WIDTH)
    n_bad, n_good = max((toxic > 0).sum(), 1), max((toxic == 0).sum(), 1)
    marker = (bad >= LEAST_DOCS) & (bad / n_bad > 20 * (good + 0.1) / n_good)
    count = np.bincount(rows[marker[columns]], minlength=len(toxic))
    cuts = np.quantile(count[toxic > 0], np.arange(1, grades - 1) / (grades - 1)) if (toxic > 0).any() else []
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, count, side="left"), 0)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_PER_LABEL, grades: int = 3) -> OrdinalModel:
    """Learn from at most ``most`` rows of each label, of the folds that may be learned from.

    Labels with several grades are used as they are; where there are only 0 and 1, ``graded_by_markers`` makes ``grades`` of them.
    """

    def columns_of(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            for i, j in pieces(at):
                row, column = word_columns(data[at[i] : at[j]], at[i : j + 1] - at[i])
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                packed = [column[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.record_batch([batch.column("id")[i:j], batch.column("label")[i:j], pa.array(packed, pa.binary())], names=["id", "label", "words"])

    sample = sample_rows(docs, labels, label_col, most, id_col, text_col, by_label=True).withColumns({"id": F.col("id").cast("long"), "label": F.col("label").cast("int")})
    got = sample.mapInArrow(columns_of, "id long, label int, words binary").toPandas().sort_values("id")
    words = [np.frombuffer(x, np.int32) for x in got["words"]]
    rows = np.repeat(np.arange(len(words)), [len(x) for x in words]) if words else np.zeros(0, int)
    columns = np.concatenate(words).astype(np.int64) if words else np.zeros(0, np.int64)
    label = np.maximum(got["label"].to_numpy().astype(int), 0)
    if len(label) and label.max() == 1 and grades > 2:
        label = graded_by_markers(rows, columns, label, grades)
    return fit_ordinal(rows, columns, label)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, severity, grade, p_toxic, toxic for each row of ``docs``.

    severity is the expected grade, grade the likeliest one by the thresholds (the number of k with P(grade > k) >= 0.5), toxic is
    P(grade > 0) >= 0.5. Every distinct word of the whole text counts once. A null text is empty; a text without words gets what the
    thresholds alone say. Only the text is read, so equal texts get equal results and extra columns don't matter.
    """

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            for i, j in pieces(at):
                row, column = word_columns(data[at[i] : at[j]], at[i : j + 1] - at[i])
                p = model.exceeds(np.bincount(row, weights=model.weights[column], minlength=j - i))
                cols = [p.sum(1), (p >= TOXIC_FROM).sum(1).astype(np.int32), p[:, 0], p[:, 0] >= TOXIC_FROM]
                yield pa.record_batch([batch.column("doc_id")[i:j], batch.column("held_out")[i:j], *map(pa.array, cols)], names=["doc_id", "held_out", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, severity double, grade int, p_toxic double, toxic boolean")
