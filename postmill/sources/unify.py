"""Four raw source schemas → the unified (silver) postings table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import classify as k
from postmill.functions.text import blank_to_null, clean_html, contains_any, lookup, squeeze
from postmill.functions.vocab import CHAT_KEYWORDS
from postmill.operators.spread import flag_repeats

c = F.col
UNKNOWN = F.lit

# Fixed values of the sources.
CITY_NAMES = {"Алматы": "almaty", "Астана": "astana"}
EMPLOYMENT_NAMES = {"Полная занятость": "full_time", "Неполная занятость": "part_time", "Стажировка": "internship"}

SILVER_SOURCE = [
    "source", "source_id", "title", "company", "city", "source_url", "employment", "work_format", "salary_from", "salary_to",
    "salary_avg", "currency", "salary_raw", "salary_gross", "description_raw", "requirements_raw", "responsibilities_raw",
    "skills_raw", "posted_at", "experience_raw",
]


def _known(col: Column) -> Column:
    return F.coalesce(col, F.lit("unknown"))


def _city(col: Column) -> Column:
    return _known(lookup(col, CITY_NAMES))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def unify_board(df: DataFrame, source: str = "hh_kz") -> DataFrame:
    """API board: markup stripped, salary text rebuilt from its numbers, Russian names mapped."""
    lo, hi = c("salary_from").try_cast("double"), c("salary_to").try_cast("double")
    code = k.currency_exact(c("currency"))
    whole = lambda x: F.coalesce(x.cast("long").cast("string"), F.lit(""))
    raw = F.trim(F.concat(
        whole(lo), F.when(hi.isNotNull(), F.concat(F.lit(" - "), whole(hi))).otherwise(F.lit("")), F.lit(" "), code))
    return df.select(
        F.lit(source).alias("source"), c("id").cast("string").alias("source_id"), _known(c("title")).alias("title"),
        _known(c("company")).alias("company"), _city(c("vacancy_city")).alias("city"), c("url").alias("source_url"),
        _known(lookup(c("employment"), EMPLOYMENT_NAMES)).alias("employment"),
        k.work_format_infer(c("schedule"), c("description"), c("requirement"), c("responsibility")).alias("work_format"),
        lo.alias("salary_from"), hi.alias("salary_to"), k.average(lo, hi).alias("salary_avg"), code.alias("currency"),
        F.when(lo.isNotNull() | hi.isNotNull(), raw).alias("salary_raw"), c("salary_gross"),
        clean_html(c("description")).alias("description_raw"), clean_html(c("requirement")).alias("requirements_raw"),
        clean_html(c("responsibility")).alias("responsibilities_raw"), clean_html(c("skills")).alias("skills_raw"),
        c("published_at").try_cast("timestamp").alias("posted_at"), c("experience").alias("experience_raw"),
    )


def unify_career(df: DataFrame, source: str = "kolesa_jobs", prefix: str = "kolesa") -> DataFrame:
    """Career site: three text blocks joined, id from the URL, currency fixed."""
    blocks = [F.when(F.trim(c(x)) != "", c(x)) for x in ("responsibilities", "requirements", "nice_to_have")]
    lo, hi = c("salary_from").try_cast("double"), c("salary_to").try_cast("double")
    return df.select(
        F.lit(source).alias("source"), k.url_id(c("url"), prefix).alias("source_id"), _known(c("title")).alias("title"),
        _known(c("company")).alias("company"), _city(c("location")).alias("city"), c("url").alias("source_url"),
        F.lit("unknown").alias("employment"),
        k.work_format_infer(c("title"), c("responsibilities"), c("requirements"), c("nice_to_have")).alias("work_format"),
        lo.alias("salary_from"), hi.alias("salary_to"), k.average(lo, hi).alias("salary_avg"), F.lit("KZT").alias("currency"),
        c("salary").alias("salary_raw"), _null("boolean").alias("salary_gross"),
        clean_html(blank_to_null(F.concat_ws(" ", *blocks))).alias("description_raw"),
        clean_html(c("requirements")).alias("requirements_raw"), clean_html(c("responsibilities")).alias("responsibilities_raw"),
        clean_html(c("tech_stack")).alias("skills_raw"), _null("timestamp").alias("posted_at"), c("experience").alias("experience_raw"),
    )


def unify_bank(df: DataFrame, source: str = "kaspi_jobs", prefix: str = "kaspi", company: str = "Kaspi.kz") -> DataFrame:
    """Bank board: salary read from its text, company fixed."""
    skills = clean_html(c("Skills_List"))
    return df.withColumn("_s", k.salary_text_simple(c("Salary"))).select(
        F.lit(source).alias("source"), k.url_id(c("URL"), prefix).alias("source_id"), _known(c("Position")).alias("title"),
        F.lit(company).alias("company"), _city(c("City")).alias("city"), c("URL").alias("source_url"), F.lit("unknown").alias("employment"),
        k.work_format_infer(c("Schedule"), c("Full_Description")).alias("work_format"),
        c("_s.from").cast("double").alias("salary_from"), c("_s.to").cast("double").alias("salary_to"), c("_s.avg").alias("salary_avg"),
        c("_s.currency").alias("currency"), c("Salary").alias("salary_raw"), _null("boolean").alias("salary_gross"),
        clean_html(c("Full_Description")).alias("description_raw"), skills.alias("requirements_raw"), skills.alias("responsibilities_raw"),
        skills.alias("skills_raw"), _null("timestamp").alias("posted_at"), c("Experience").alias("experience_raw"),
    )


def unify_chat(df: DataFrame, keywords: Sequence[str] = CHAT_KEYWORDS, min_len: int = 50) -> DataFrame:
    """Chat messages that read like postings; the id joins channel and message."""
    msg = c("message")
    rows = df.filter(msg.isNotNull() & (F.length(msg) > min_len) & contains_any(F.lower(msg), keywords))
    name = F.when(F.trim(F.coalesce(c("channel_title"), F.lit(""))) == "", "Telegram Channel").otherwise(squeeze(c("channel_title")))
    return rows.select(
        name.alias("source"), F.concat_ws("_", c("channel_id").cast("string"), c("message_id").cast("long").cast("string")).alias("source_id"),
        F.lit("unknown").alias("title"), F.lit("unknown").alias("company"), F.lit("unknown").alias("city"),
        F.when(c("channel_handle") != "", F.concat(F.lit("@"), c("channel_handle"))).alias("source_url"),
        F.lit("unknown").alias("employment"), k.work_format_infer(msg).alias("work_format"),
        _null("double").alias("salary_from"), _null("double").alias("salary_to"), _null("double").alias("salary_avg"),
        F.lit("UNKNOWN").alias("currency"), _null("string").alias("salary_raw"), _null("boolean").alias("salary_gross"),
        clean_html(msg).alias("description_raw"), _null("string").alias("requirements_raw"), _null("string").alias("responsibilities_raw"),
        _null("string").alias("skills_raw"), c("date").try_cast("timestamp").alias("posted_at"), _null("string").alias("experience_raw"),
    )


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All sources under one another; a frame without a source column is tagged with its name."""
    out = None
    for name, df in frames.items():
        tagged = df if "source" in df.columns else df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources to union")
    return out


def extract_fields(df: DataFrame) -> DataFrame:
    """Years of experience and english signals."""
    staged = df.withColumns({
        "_e": k.experience(c("experience_raw")), "_g": k.english_signals(c("description_raw"), c("requirements_raw"), c("skills_raw")),
    })
    return staged.withColumns({
        "experience_min": c("_e.min").cast("long"), "experience_max": c("_e.max").cast("long"),
        "english_level": c("_g.level"), "english_mention": c("_g.mention"), "english_required": c("_g.required"),
    }).drop("_e", "_g")


def hash_text(text: Column) -> Column:
    """Letters (Latin and Cyrillic without ё) and digits in lower case, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-zа-я0-9]+", " "))


def fingerprint(title: Column, company: Column, city: Column, text: Column, lead: int | None = None) -> Column:
    """First-pass duplicate hash: title, company, city and the whole text.

    ``lead`` cuts the text to its first characters; the published hash has 400, which joins postings that only begin alike.
    """
    body = text if lead is None else F.substring(text, 1, lead)
    return F.md5(F.concat_ws(" | ", hash_text(title), hash_text(company), hash_text(city), hash_text(body)))


def finalize(df: DataFrame, scraped_at: Column) -> DataFrame:
    """The silver contract: every column with its default, and an id that stays the same over runs."""
    blank, unknown = F.lit(""), F.lit("unknown")
    content = F.concat_ws("|", *[F.coalesce(c(x).cast("string"), blank) for x in ("title", "company", "city", "description_raw")])
    row_id = F.sha2(F.concat_ws("|", c("source"), F.coalesce("source_id", F.sha2(content, 256))), 256)
    return df.select(
        row_id.alias("id"), "source", "source_id", "source_url", "title", c("title").alias("title_normalized"), "company", "city",
        unknown.alias("category"), unknown.alias("level"), "experience_raw", "experience_min", "experience_max", "employment",
        "work_format", c("salary_from").cast("long").alias("salary_from"), c("salary_to").cast("long").alias("salary_to"), "salary_avg",
        "currency", "salary_raw", "salary_gross", c("description_raw").alias("description"), c("description_raw").alias("description_clean"),
        "requirements_raw", blank.alias("requirements_clean"), "responsibilities_raw", blank.alias("responsibilities_clean"), "skills_raw",
        _null("array<string>").alias("hard_skills"), _null("array<string>").alias("soft_skills"), _null("array<string>").alias("tech_stack"),
        "english_mention", "english_required", "english_level", "posted_at", scraped_at.alias("scraped_at"), F.lit(True).alias("is_active"),
        F.lit("rule_based").alias("extraction_method"), F.lit(0.0).alias("llm_confidence"),
        fingerprint(c("title"), c("company"), c("city"), c("description_raw")).alias("duplicate_hash"),
    )


def refresh_duplicates(df: DataFrame, order: str = "id") -> DataFrame:
    """Repeat flag of the first-pass hash."""
    return flag_repeats(df, ["duplicate_hash"], order)
