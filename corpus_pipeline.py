"""The training-data pipeline: from ``documents`` to a clean, deduplicated, decontaminated, mixed corpus.

Each stage reads what its predecessor kept, as a written table, and calls one operator of ``postmill.llm``. All stages but the last
return the columns they got, whatever others a table has and whatever their names: helpers take names that are free. The last one returns the
mix's figures with source, lang and text. Stages tell rows apart by id and, where an id has several texts, by the text's hash, so repeated
rows share their fate; rows without id are kept by the near-duplicate stage, and judged by their text in the others. Null texts count
as empty. An empty table passes as an empty table. Ids that a stage drops are broadcast up to DROPPED of them, and joined beyond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import neighbour_quality
from postmill.llm.lsh_forest import near_duplicates
from postmill.llm.mixing import mix_sources
from postmill.llm.queries import table
from postmill.llm.spaced_seeds import find_leaks
from postmill.llm.suffix_dedup import dedup_substrings
from postmill.session import ensure_checkpoint_dir
from postmill.sources.tables import scratch_path

#: Similarity, in percent, from which the near-duplicate stage links documents: that of stages on word shingles.
NEAR = 80
#: Rows of keys that are broadcast at most (24 bytes each).
DROPPED = 1_000_000


def _free(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` does not have."""
    have = {c.lower() for c in docs.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def _version(docs: DataFrame) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` without those whose id and text version (any, if null) ``keys`` (id, version) name, or only them."""
    ensure_checkpoint_dir(docs.sparkSession)
    names = [_free(docs, "dropped_id"), _free(docs, "dropped_version")]
    keys = keys.toDF(*names).checkpoint()
    keys = F.broadcast(keys) if keys.count() <= DROPPED else keys
    same = docs["doc_id"].eqNullSafe(F.col(names[0])) & (F.col(names[1]).isNull() | (F.col(names[1]) == _version(docs)))
    return docs.join(keys, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more), scored by their text alone."""
    model = neighbour_quality.train(docs, table(spark, sf_dir, "labels"))
    return neighbour_quality.filter_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (NEAR); one row, where rows repeat an id and its text."""
    none = F.lit(None).cast("long")
    dropped = near_duplicates(docs, link=NEAR).where(~F.col("kept")).select("doc_id", none).distinct()
    left = _without(docs, dropped)
    # Rows that repeat an id are copies of one document.
    ids = left.where(left["doc_id"].isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", none)
    once = _without(left, ids)
    version = _free(docs, "text_version")
    several = _without(left, ids, "left_semi")
    return once.unionByName(several.withColumn(version, _version(several)).dropDuplicates(["doc_id", version]).drop(version))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that an earlier one has; those that lose their last word go."""
    removed = _free(docs, "n_removed")
    left = dedup_substrings(docs, rewrite=True, removed_col=removed).where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"), row=_version(docs))
    return _without(docs, leaks.select("doc_id", "row").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's size and target, and the words taken (repeats counted)."""
    return mix_sources(docs, carry=("source", "lang", "text")).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: SQL cannot express the stages (classifier, signatures, spaced seeds); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "corpus-pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
