"""Landing, upsert, expiry, checkpoints and exports of postings tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import squeeze
from postmill.operators.spread import keep_first
from postmill.session import ensure_checkpoint_dir

SUCCESS_STATES = ["auto_merged", "merged_with_review", "no_missing_targets"]

# The known chat channels, keyed by the id their files are named after.
CHAT_CHANNELS = [
    ("-1001746243221", "itcom_kz", "ITcom KZ", "itcom_kz"),
    ("-1001218364404", "zhumysbarit", "Zhumys Bar IT", "zhumysbarit"),
    ("-1001446132226", "workitkz", "Work IT KZ", "workitkz"),
    ("-1001651093004", "halyk_jumys", "Halyk Jumys", "halyk_jumys"),
    ("-1002321256587", "itvacancykz", "IT Vacancy KZ", "itvacancykz"),
    ("-1003217256724", "insferaforyou", "Insfera For You", "insferaforyou"),
    ("-1003882138113", "no_username", "Freedom Broker", "freedom_broker"),
]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint storage."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a file, folder or glob is there, on any Hadoop file system."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return found is not None and len(found) > 0


# ---- scans ---------------------------------------------------------------

def read_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Quoted multi-line CSV with a header and an explicit schema; no inference pass."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(list(paths))
    )


def scan_sources(spark: SparkSession, paths: Mapping[str, Sequence[str]], schemas: Mapping[str, T.StructType | str]) -> dict[str, DataFrame]:
    """One frame per source over all of its files; missing files and empty sources are left out."""
    out = {}
    for source, wanted in paths.items():
        there = [p for p in wanted if path_exists(spark, p)]
        if there:
            out[source] = read_csv(spark, there, schemas[source])
    return out


def channel_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAT_CHANNELS, "channel_id string, channel_name string, channel_title string, channel_handle string")


def tag_channels(df: DataFrame, registry: DataFrame, channel_id: Column) -> DataFrame:
    """Channel name, title and handle of the file a row came from; unknown channels are dropped.

    The registry is a short fixed list, so it is broadcast.
    """
    return df.withColumn("channel_id", channel_id).join(F.broadcast(registry), "channel_id")


def channel_of_file(file_name: Column) -> Column:
    """``<channel id>_<name>.csv`` → channel id."""
    return F.nullif(F.regexp_extract(file_name, "(-?\\d+)_[^/]*$", 1), F.lit(""))


#: The characters of the upper half of windows-1251 and of Latin-1, which is read byte by byte; one byte is not assigned.
_CYRILLIC = bytes(range(128, 256)).decode("windows-1251", "replace").replace("\ufffd", "\x98")
_LATIN = bytes(range(128, 256)).decode("latin-1")


def decode_cyrillic(content: Column) -> Column:
    """windows-1251 bytes → text."""
    return F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _CYRILLIC)


def as_latin(text: Column) -> Column:
    """Text of windows-1251's characters → the text whose Latin-1 bytes are its windows-1251 bytes."""
    return F.translate(text, _CYRILLIC, _LATIN)


def encode_cyrillic(text: Column) -> Column:
    """Text → windows-1251 bytes, for texts of its characters."""
    return F.encode(as_latin(text), "ISO-8859-1")


def decode_text(spark: SparkSession, df: DataFrame, content: str, out: str) -> DataFrame:
    """Bytes → text: UTF-8, UTF-8 with a byte order mark, else windows-1251."""
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    text = F.when(valid, F.decode(content, "UTF-8")).otherwise(decode_cyrillic(F.col(content)))
    return df.withColumn(out, F.regexp_replace(text, "^\\uFEFF", ""))


def scan_any_charset(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV files with a header, each of unknown charset: UTF-8 (with or without a byte order mark) where the whole file is valid, else windows-1251.

    Files are read in byte ranges cut at line ends, so a file is the work of many tasks, whatever its size. One pass settles the charset
    of each file. A quoted value may hold line ends: whether a line begins inside quotes follows from the number of quotes before it, which
    is summed by range first. Lines that are a record are parsed where they are; only those of longer records meet. Columns follow the schema by
    position; empty lines are no records; a quote inside a value is doubled.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = spark.read.option("lineSep", "\n").text(path).select(at.alias("at"), F.col("value").cast("binary").alias("bytes"), F.monotonically_increasing_id().alias("no"))
    valid = raw.groupBy(F.col("at.file").alias("file")).agg(F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8"))
    # A row per file; which way it joins is left to its measured size.
    lines = raw.join(valid, F.col("at.file") == F.col("file")).select(
        "at", "no", F.when(F.col("utf8"), F.col("bytes").cast("string")).otherwise(decode_cyrillic(F.col("bytes"))).alias("line"))
    quotes = F.regexp_count("line", F.lit('"')).cast("long")
    ranges = lines.groupBy("at").agg(F.sum(quotes).alias("n"))
    earlier = Window.partitionBy("at.file").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("at").alias("range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("at").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.join(ranges, F.col("at") == F.col("range")).withColumn("seen", F.col("before") + F.coalesce(F.sum(quotes).over(here), F.lit(0)))
    placed = opened.select("at", "no", "line", (F.col("seen") % 2 == 0).alias("begins"), ((F.col("seen") + quotes) % 2 == 0).alias("ends"))

    # Records are numbered within their file: those that begin in earlier ranges, and in this one up to the line.
    begun = placed.groupBy("at").agg(F.count_if("begins").alias("n"))
    begun = begun.select(F.col("at").alias("range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    so_far = Window.partitionBy("at").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.join(begun, F.col("at") == F.col("range")).withColumn("record", F.col("before") + F.sum(F.col("begins").cast("long")).over(so_far))
    single = numbered.where("begins AND ends").select(F.col("at.file").alias("file"), "record", F.col("line").alias("text"))
    parts = numbered.where("NOT (begins AND ends)").groupBy(F.col("at.file").alias("file"), "record").agg(F.sort_array(F.collect_list(F.struct("at.start", "no", "line"))).alias("p"))
    several = parts.select("file", "record", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))
    records = single.union(several).where("record > 1").select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")
    wanted = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("text", F.lit(wanted), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")


def land(df: DataFrame, source_file: Column, inserted_at: Column) -> DataFrame:
    """Raw rows as they are, with their file and landing time."""
    return df.withColumns({"_source_file": source_file, "inserted_at": inserted_at})


def land_files(df: DataFrame) -> DataFrame:
    return land(df, F.col("_metadata.file_name"), F.current_timestamp())


# ---- upsert and expiry ------------------------------------------------------

def upsert_by_key(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Merge a batch into a table that holds one row per key.

    The last batch row of a key replaces the columns the batch has; columns only
    the table has are kept. Batch rows with a null key are always added.
    """
    keys = list(keys)
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    values = [c for c in batch.columns if c not in keys and c != order]
    latest = keep_first(batch.filter(has_key), keys, [F.desc(order)]).drop(order)
    renamed = latest.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    merged = target.join(renamed, keys, "full_outer")
    columns = list(target.columns) + [c for c in values if c not in target.columns]
    out = []
    for c in columns:
        if c in keys:
            out.append(F.col(c))
        elif c in values and c in target.columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in values:
            out.append(F.col(f"_new_{c}").alias(c))
        else:
            out.append(F.col(c))
    keyless = batch.filter(~has_key).drop(order)
    return merged.select(*out).unionByName(keyless, allowMissingColumns=True)


def expire(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Drop rows older than ``days``; rows without the time stay."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= cutoff))


# ---- checkpoints and audit ---------------------------------------------------

def latest_success(log: DataFrame, row_id: str, status: str, seq: str) -> DataFrame:
    """Last entry per id, but a success is never replaced by a later failure."""
    ok = F.coalesce(F.lower(F.col(status)).isin(SUCCESS_STATES), F.lit(False))
    return keep_first(log.withColumn("is_success", ok), [row_id], [F.desc("is_success"), F.desc(seq)])


def apply_patches(base: DataFrame, patches: DataFrame, row_id: str, patch: str, cols: Sequence[str]) -> DataFrame:
    """Overwrite the columns a patch map names; other columns and rows stay."""
    joined = base.join(patches.select(row_id, F.col(patch).alias("_patch")), row_id, "left")
    new = {}
    for c in cols:
        given = F.coalesce(F.map_contains_key("_patch", F.lit(c)), F.lit(False))
        new[c] = F.when(given, F.col("_patch")[c].cast(base.schema[c].dataType)).otherwise(F.col(c))
    return joined.withColumns(new).drop("_patch")


def completed_ids(log: DataFrame, row_id: str, status: str, seq: str) -> DataFrame:
    return latest_success(log, row_id, status, seq).filter("is_success").select(row_id)


def skip_completed(df: DataFrame, done: DataFrame, row_id: str) -> DataFrame:
    return df.join(done.select(row_id), row_id, "left_anti")


def audit_events(df: DataFrame, row_id: str, stage: str, text: str, result: Sequence[str], at: Column, error: Column | None = None) -> DataFrame:
    """One event row per input row: stage, 280-character preview, result as JSON."""
    return df.select(
        F.col(row_id).alias("row_id"),
        F.lit(stage).alias("stage"),
        (error if error is not None else F.lit(None).cast("string")).alias("error_type"),
        F.substring(F.coalesce(F.col(text), F.lit("")), 1, 280).alias("raw_text_preview"),
        F.to_json(F.struct(*result)).alias("final_result"),
        at.alias("timestamp"),
    )


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def snapshot_once(df: DataFrame, path: str) -> None:
    """Keep the first snapshot for good."""
    df.write.mode("ignore").parquet(path)


# ---- exports -----------------------------------------------------------------

def export_csv(df: DataFrame, path: str, where: Column | str | None = None) -> int:
    """Filtered rows as CSV; the number of rows written comes from the write itself."""
    rows = df if where is None else df.filter(where)
    seen = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    observed = Observation()
    rows.drop("_id").observe(observed, seen).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return observed.get["n"]


def export_unified(df: DataFrame, path: str) -> None:
    """Parquet by source; each file is sorted by category and level, so that filters on them skip files and row groups.

    Rows are dealt by ranges of the same columns, so a source has few files, and a large one several.
    """
    order = ["source", "category", "level"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("source").parquet(path)


def export_all(frames: Mapping[str, DataFrame], path: str) -> None:
    """Every mart and one-row report to its own folder."""
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite")
        if name.endswith("_report"):
            writer.json(f"{path}/{name}")
        else:
            writer.parquet(f"{path}/{name}")


def json_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lists, maps and structs as JSON text; empty ones become null."""
    new = {}
    for c in cols:
        kind = df.schema[c].dataType
        empty = (F.size(c) == 0) if isinstance(kind, (T.ArrayType, T.MapType)) else F.lit(False)
        new[c] = F.when(~empty, F.to_json(c))
    return df.withColumns(new)


# ---- loads for the dashboards --------------------------------------------------

ENRICHED_NAMES = {
    "category": "category_filled", "level": "level_filled", "city": "city_norm", "company": "company_clean",
    "title": "title_final", "work_format": "work_format_norm", "salary_avg": "salary_avg_clean",
    "salary_from": "salary_from_clean", "salary_to": "salary_to_clean",
}


def load_enriched(df: DataFrame, list_cols: Sequence[str]) -> DataFrame:
    """Uncurated table under the curated names: skills combined, untitled rows dropped."""
    from postmill.functions.lists import combine_lists

    out = df.withColumnsRenamed(ENRICHED_NAMES).withColumn("skills_all_clean_list", combine_lists([F.col(c) for c in list_cols]))
    return out.withColumn("currency_clean", F.coalesce("currency", F.lit("KZT"))).filter(squeeze(F.col("title_final")) != "")


def load_main(df: DataFrame, numeric: Sequence[str], boolean: Sequence[str], text: Sequence[str], list_cols: Sequence[str]) -> DataFrame:
    """Curated table with types repaired, skills combined, KZT as the default currency; deduplicated and titled rows only."""
    from postmill.functions.lists import combine_lists
    from postmill.functions.text import to_bool

    typed = df.withColumns(
        {c: F.col(c).try_cast("double") for c in numeric}
        | {c: to_bool(F.col(c)) for c in boolean}
        | {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in text}
    )
    combined = typed.withColumns({
        "skills_all_clean_list": combine_lists([F.col(c) for c in list_cols]),
        "currency_clean": F.coalesce(F.nullif(F.col("currency_clean"), F.lit("")), F.lit("KZT")),
    })
    return combined.filter(F.col("dedup_keep_for_analytics") & (F.col("title_final") != ""))


def join_marts(entity: DataFrame, salary: DataFrame, skills: DataFrame) -> DataFrame:
    """Entity rows with salary columns and the list of skills; absent lists are empty."""
    lists = skills.groupBy(F.col("job_id").alias("id")).agg(F.sort_array(F.collect_list("skill")).alias("skills_all_clean_list"))
    money = salary.select("id", "salary_from_clean", "salary_to_clean", "salary_avg_clean", "currency_clean")
    out = entity.join(money, "id", "left").join(lists, "id", "left")
    return out.withColumns({
        "skills_all_clean_list": F.coalesce("skills_all_clean_list", F.array().cast("array<string>")),
        "currency_clean": F.coalesce("currency_clean", F.lit("KZT")),
    }).filter(F.trim("title_final") != "")
