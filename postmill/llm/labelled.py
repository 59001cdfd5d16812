"""Labels of documents: which rows may be learned from, and a bounded, repeatable sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose crc32, as text, is divisible by 5: rows that nothing is learned from. False for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text", by_label: bool = False) -> DataFrame:
    """text and label of at most ``most`` rows (of each label, if ``by_label``) of the folds that may be learned from.

    Rows are taken in the order of their ids' md5, so reruns agree. Only ids and labels are ranked, with what is beyond the limit
    dropped before the shuffle; the ids of the sample, whose number ``most`` bounds, are broadcast to the texts. An id that is
    labelled twice counts with its smaller label, and one that has several texts with the smallest text.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    order = F.md5(F.col("id").cast("string"))
    if by_label:
        ranked = known.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(order, "id")))
        picked = ranked.where(F.col("nth") <= most).drop("nth")
    else:
        picked = known.orderBy(order, "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("text", "label")).alias("row")).select("id", "row.text", "row.label")
