"""One query per operator, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import centroid_langid, neighbour_quality, ordinal_toxicity
from postmill.llm.lsh_forest import near_duplicates, near_duplicates_sql
from postmill.llm.mincut_html import extract_pages
from postmill.llm.mixing import mix_sources, mixing_sql
from postmill.llm.norm_topk import top_inner_products, topk_sql
from postmill.llm.periodic_runs import find_runs
from postmill.llm.phrase_automata import dedup_phrases, phrases_sql
from postmill.llm.pq_links import linked_vectors
from postmill.llm.spaced_seeds import find_leaks
from postmill.llm.suffix_dedup import dedup_substrings, substrings_sql
from postmill.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query("op1_neighbour_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbour_quality.score_quality(docs, neighbour_quality.train(docs, table(spark, sf_dir, "labels")))


@_query("op2_ordinal_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_toxicity.score_toxicity(docs, ordinal_toxicity.train(docs, table(spark, sf_dir, "labels")))


@_query("op3_lsh_forest", near_duplicates_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query("op4_suffix_array_dedup", substrings_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


@_query("op5_spaced_seeds")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@_query("op6_centroid_langid")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return centroid_langid.identify(docs, centroid_langid.train(docs, docs, "lang"), reject=False)


@_query("op7_phrase_automata", phrases_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(table(spark, sf_dir, "documents"))


@_query("op8_mincut_html")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@_query("op9_source_mixing", mixing_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@_query("op10_norm_sorted_topk", topk_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@_query("op11_cholesky_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@_query("op12_pq_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def _with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; in the documents that op13's contract names, the words from one on are the first few of them, repeated."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), repeated)
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@_query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_with_planted_repeats(table(spark, sf_dir, "documents")))
    # Runs come by start and period, so the first of those with the greatest exponent is the wanted one.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
