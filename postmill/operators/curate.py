"""Curation jobs: description, header, title, company, city, skills, category, level, dedup, tiers, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import classify as k
from postmill.functions import titles as t
from postmill.functions import vocab as v
from postmill.functions.lists import parse_json_items
from postmill.functions.text import (
    is_meaningful, is_missing_like, is_missing_list, lookup, normalize_key, squeeze, standardize_missing,
)
from postmill.operators.spread import attach_group, head_per_key, seal
from postmill.session import ensure_checkpoint_dir

c = F.col


def null_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing words → null in every string column, in one projection."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = strings if cols is None else list(cols)
    return df.withColumns({x: standardize_missing(c(x)) for x in chosen})


def with_description(df: DataFrame, text: str = "description") -> DataFrame:
    return seal(df.withColumn("_d", t.clean_description(c(text))), {
        "description_clean_v2": c("_d.text"), "description_clean_changed": c("_d.changed"),
        "description_clean_len": c("_d.length"), "description_clean_removed_chars": c("_d.removed"),
    }).drop("_d")


def parse_header(df: DataFrame, text: str = "description_clean_v2") -> DataFrame:
    """Header pattern, its confidence, and the cleaned title, company and city."""
    staged = df.withColumn("_h", t.header_window(c(text)))
    staged = seal(staged, {"header_parse_pattern": t.header_pattern(c("_h"))})
    fields = t.header_fields(c("_h"), c("header_parse_pattern"))
    raw = staged.withColumns({f"_{n}": col for n, col in fields.items()})
    return seal(raw, {
        "header_extracted_title": t.header_title(c("_title")),
        "header_extracted_company": t.header_company(c("_company")),
        "header_extracted_city": t.header_city(c("_city")),
        "header_parse_confidence": c("_confidence"),
    }).drop("_h", "_title", "_company", "_city", "_confidence")


def normalise_enums(df: DataFrame) -> DataFrame:
    return seal(df, {
        "english_level_norm": k.english_level(c("english_level")),
        "category_norm": k.category(c("category")), "level_norm": k.level(c("level")),
        "employment_norm": k.employment(c("employment")), "work_format_norm": k.work_format(c("work_format")),
        "city_norm": k.city(c("city")),
    }).withColumn("english_level_invalid_flag", c("english_level").isNotNull() & c("english_level_norm").isNull())


def backfill_city(df: DataFrame) -> DataFrame:
    """Header city where the field gave none, with its provenance."""
    head = t.header_city(c("header_extracted_city"))
    return df.withColumn("_hc", head).withColumns({
        "city_source_v2": F.when(c("city_norm").isNotNull(), "existing_city").when(c("_hc").isNotNull(), "header_parse").otherwise("missing"),
        "city_norm": F.coalesce("city_norm", "_hc"),
    }).drop("_hc")


def final_title(df: DataFrame) -> DataFrame:
    """Title from the raw field, the normalised field, the header or the description, in that order."""
    staged = df.withColumns({
        "title_clean": t.clean_title(c("title")), "_tn": t.clean_title(c("title_normalized")),
        "_th": t.header_title(c("header_extracted_title")),
        "_td": t.title_from_description(c("description_clean_v2"), c("header_extracted_title")),
    })
    staged = staged.withColumn("title_source_v2",
        F.when(is_meaningful(c("title_clean"), 3), "raw_title").when(is_meaningful(c("_tn"), 3), "title_normalized")
        .when(t.title_ok(c("_th")), "header_parse").when(is_meaningful(c("_td"), 3), "description_rule").otherwise("missing"))
    source = c("title_source_v2")
    chosen = (
        F.when(source == "raw_title", c("title_clean")).when(source == "title_normalized", c("_tn"))
        .when(source == "header_parse", c("_th")).when(source == "description_rule", c("_td"))
    )
    return seal(staged.withColumn("_pick", chosen), {
        "title_final": t.title_variant(c("_pick")), "title_is_inferred": ~source.isin("raw_title", "missing"),
    }).drop("_tn", "_th", "_td", "_pick")


def final_company(df: DataFrame) -> DataFrame:
    """Cleaned company, else the header's; suspicious texts are dropped."""
    staged = df.withColumns({"_cc": t.clean_company(c("company")), "_ch": t.header_company(c("header_extracted_company"))})
    staged = staged.withColumn("_has", is_meaningful(c("_cc"), 2))
    staged = staged.withColumn("_pick", F.when(c("_has"), c("_cc")).otherwise(c("_ch")))
    staged = staged.withColumn("company_is_suspicious", F.coalesce(t.company_suspicious(c("_pick")), F.lit(False)))
    usable = ~c("company_is_suspicious") & is_meaningful(c("_pick"), 2)
    return seal(staged, {
        "company_clean": F.when(usable, c("_pick")),
        "company_source_v2": F.when(c("company_is_suspicious"), "dropped_suspicious").when(c("_has"), "cleaned_existing")
        .when(is_meaningful(c("_ch"), 2), "header_parse").otherwise("missing"),
    }).drop("_cc", "_ch", "_has", "_pick")


CONTEXT = ["title", "title_normalized", "description_clean_v2", "requirements_clean", "responsibilities_clean"]


def with_context(df: DataFrame, cols: Sequence[str] = CONTEXT, out: str = "_context") -> DataFrame:
    parts = [F.when(is_meaningful(c(x)), squeeze(c(x))) for x in cols if x in df.columns]
    return df.withColumn(out, F.concat_ws(" ", *parts))


def canon_skills(df: DataFrame, context: str = "_context") -> DataFrame:
    """Canonical skill lists; all = hard, tech, soft in that order; count and top family."""
    js = k.programming_context(c(context))
    lists = {f"{x}_clean": k.canonical_skills(c(x), js) for x in ("hard_skills", "soft_skills", "tech_stack")}
    staged = seal(df, lists)
    every = k.canonical_skills(F.concat("hard_skills_clean", "tech_stack_clean", "soft_skills_clean"), js)
    staged = staged.withColumn("skills_all_clean", every)
    return seal(staged, {
        "skills_count": F.size("skills_all_clean").cast("long"), "top_skill_family": k.top_family(c("skills_all_clean")),
    })


def infer_category(df: DataFrame, context: str = "_context") -> DataFrame:
    return seal(df.withColumn("_c", k.infer_category(c("category_norm"), c(context), c("skills_all_clean"))), {
        "category_filled": c("_c.value"), "category_source_v2": c("_c.source"), "category_confidence_v2": c("_c.confidence"),
    }).drop("_c")


def infer_level(df: DataFrame, context: str = "_context") -> DataFrame:
    titles = F.concat_ws(" ", *[F.when(is_meaningful(c(x)), F.lower(squeeze(c(x)))) for x in ("title", "title_normalized", "title_final")])
    return seal(df.withColumn("_l", k.infer_level(c("level_norm"), titles, c(context), c("experience_min"))), {
        "level_filled": c("_l.value"), "level_source_v2": c("_l.source"), "level_confidence_v2": c("_l.confidence"),
    }).drop("_l")


def internship(df: DataFrame, context: str = "_context") -> DataFrame:
    job = F.coalesce(c("employment_norm") == "internship", F.lit(False))
    lvl = F.coalesce(c("level_filled") == "intern", F.lit(False))
    text = F.lower(c(context)).rlike(r"(?iU)\b(?:intern|internship|trainee|стажер|стажёр|стажировка)\b")
    return df.withColumns({
        "internship_flag_v2": F.coalesce(text, F.lit(False)) | job | lvl,
        "internship_consistency_flag": F.when(job & lvl, "consistent").when(job, "employment_without_intern_level")
        .when(lvl, "intern_level_without_internship_employment").otherwise("not_applicable"),
    })


# ---- dedup and quality -------------------------------------------------------------

def text_key(text: Column, lead: int | None = None, digits: int | None = None) -> Column:
    """Hash of the normalised text, 'none' for no text.

    The published key takes the first 500 characters and 12 hex digits (``lead``, ``digits``), which joins distinct texts.
    """
    body = normalize_key(text) if lead is None else F.substring(normalize_key(text), 1, lead)
    key = F.md5(body) if digits is None else F.substring(F.md5(body), 1, digits)
    return F.when(F.coalesce(text, F.lit("")) == "", "none").otherwise(key)


def week_bucket(ts: Column) -> Column:
    """Monday/Sunday of the posting's week, 'NaT' without a date."""
    monday = F.date_trunc("week", ts)
    text = F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday.cast("date"), 6), "yyyy-MM-dd"))
    return F.coalesce(text, F.lit("NaT"))


def dedup_key(title: Column, company: Column, city: Column, category: Column, text: Column, posted_at: Column) -> Column:
    """Same role: title, company, city, category and week; without both names the text stands in."""
    tk, ck = normalize_key(title), normalize_key(company)
    cityk, catk = F.coalesce(city, F.lit("unknown")), F.coalesce(category, F.lit("unknown"))
    week = week_bucket(posted_at)
    both = (tk != "") & (ck != "")
    return F.md5(F.when(both, F.concat_ws("|", tk, ck, cityk, catk, week)).otherwise(
        F.concat_ws("|", tk, cityk, catk, text_key(text), week)))


def completeness(strings: Sequence[str], lists: Sequence[str] = ()) -> Column:
    total = F.lit(0)
    for s in strings:
        total = total + (~F.coalesce(is_missing_like(c(s)), F.lit(True))).cast("int")
    for s in lists:
        total = total + (~is_missing_list(c(s))).cast("int")
    return total


def priority(df: DataFrame, strings: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Keep-best score: source, no review, usable salary, skills, completeness, length, confidence."""
    source = F.coalesce(lookup(c("source"), v.SOURCE_PRIORITY), F.lit(0))
    staged = df.withColumn("completeness_score", completeness(strings, lists))
    score = (
        source * 100
        + (~F.coalesce("llm_review_flag", F.lit(False))).cast("int") * 20
        + F.coalesce("salary_usable_for_analytics", F.lit(False)).cast("int") * 10
        + F.coalesce("skills_count", F.lit(0))
        + c("completeness_score") * 2
        + F.coalesce("description_clean_len", F.lit(0)) / 1000
        + F.coalesce("llm_confidence", F.lit(0.0))
    )
    return staged.withColumn("dedup_priority_score", score.cast("double"))


def keep_best(df: DataFrame, key: str, score: str, order: str, repeat: str | None = None) -> DataFrame:
    """Group size, group id, duplicate flag, and whether a row is kept (alone, or best of its group).

    Keys and scores are kept once in the checkpoint folder; all group work runs on
    those few columns. The best row per key comes from a combined aggregate and is
    matched on the unique order column; only the group size travels by key, with
    hot keys salted. Full rows are joined back on the order column; a row without
    order value belongs to no group and is kept.
    """
    ensure_checkpoint_dir(df.sparkSession)
    slim = df.filter(c(order).isNotNull()).select(order, key, score, (F.lit(False) if repeat is None else F.coalesce(c(repeat), F.lit(False))).alias("_again")).checkpoint()
    best = slim.groupBy(key).agg(F.min_by(order, F.struct(-c(score), c(order))).alias(order)).select(order, F.lit(True).alias("_best"))
    sized = attach_group(slim, [key], [F.count(F.lit(1)).alias("group_size")], order)
    dup = (c("group_size") > 1) | c("_again")
    flags = sized.join(best, order, "left").select(
        order, "group_size",
        F.when(c("group_size") > 1, c(key)).alias("same_role_duplicate_group"),
        dup.alias("is_duplicate_v2"), (~dup | c("_best").isNotNull()).alias("dedup_keep_for_analytics"),
    )
    # Most rows are alone in their group: only the others meet the full rows.
    flags = flags.filter("group_size > 1 OR is_duplicate_v2")
    alone = {"group_size": F.coalesce("group_size", F.lit(1)), "is_duplicate_v2": F.coalesce("is_duplicate_v2", F.lit(False)),
             "dedup_keep_for_analytics": F.coalesce("dedup_keep_for_analytics", F.lit(True))}
    return df.join(flags, order, "left").withColumns(alone)


def quality_tier(df: DataFrame) -> DataFrame:
    """A structured and clean, B kept with core fields, C described, D the rest and all severe rows."""
    keep, dup = c("dedup_keep_for_analytics"), c("is_duplicate_v2")
    flag = lambda x: F.coalesce(c(x), F.lit(False))
    some = lambda x, n: F.coalesce(is_meaningful(c(x), n), F.lit(False))
    severe = (dup & ~keep) | flag("salary_contact_leak_flag") | (flag("company_is_suspicious") & F.coalesce(is_missing_like(c("company_clean")), F.lit(True)))
    core = some("title_final", 3) & some("category_filled", 3) & some("city_norm", 3)
    calm = ~flag("llm_review_flag") & ~flag("salary_is_suspicious") & ~flag("company_is_suspicious")
    described = some("description_clean_v2", 30) & (some("category_filled", 3) | (F.coalesce("skills_count", F.lit(0)) > 0))
    tier = (
        F.when(severe, "D").when(c("source").isin(v.STRUCTURED_SOURCES) & keep & core & calm, "A")
        .when(keep & core & ~flag("company_is_suspicious"), "B").when(described, "C").otherwise("D")
    )
    return df.withColumn("quality_tier", tier)


def usability(df: DataFrame) -> DataFrame:
    keep = F.coalesce("dedup_keep_for_analytics", F.lit(False))
    return df.withColumns({
        "usable_for_salary_analytics": keep & F.coalesce("salary_usable_for_analytics", F.lit(False)),
        "usable_for_employer_analytics": keep & c("company_clean").isNotNull() & ~F.coalesce("company_is_suspicious", F.lit(False)),
        "usable_for_skill_analytics": keep & (F.coalesce("skills_count", F.lit(0)) > 0) & c("description_clean_v2").isNotNull(),
        "usable_for_category_analytics": keep & c("category_filled").isNotNull(),
    })


# ---- marts ---------------------------------------------------------------------------

ENTITY_MART = [
    "id", "source", "title_final", "title_is_inferred", "company_clean", "company_is_suspicious", "category_filled", "level_filled",
    "city_norm", "employment_norm", "work_format_norm", "quality_tier", "dedup_keep_for_analytics", "posted_at",
]


def entity_mart(df: DataFrame) -> DataFrame:
    return df.select(*ENTITY_MART)


def skills_mart(df: DataFrame) -> DataFrame:
    """One row per posting, list and skill."""
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("skill_type"), c(col).alias("items"))
        for col, kind in (("hard_skills_clean", "hard_skill"), ("soft_skills_clean", "soft_skill"), ("tech_stack_clean", "tech_stack"))
    ])
    return df.select(
        c("id").alias("job_id"), c("category_filled").alias("category_norm"), c("level_filled").alias("level_norm"),
        "source", "city_norm", "posted_at", F.inline(kinds),
    ).withColumn("skill", F.explode("items")).drop("items")


# ---- the whole curation --------------------------------------------------------------

def curate(df: DataFrame, order: str = "seq") -> DataFrame:
    """Silver → gold. The rules run in one pass without a shuffle; only the dedup shuffles. ``order`` is a unique row order."""
    from postmill.operators.salary import salary_repair_v3

    lists = {x: parse_json_items(c(x)) for x in ("hard_skills", "soft_skills", "tech_stack")}
    a = parse_header(with_description(null_missing(df)))
    a = backfill_city(normalise_enums(salary_repair_v3(a)))
    a = with_context(final_company(final_title(a.withColumns(lists))))
    a = internship(infer_level(infer_category(canon_skills(a)))).drop("_context")
    a = a.withColumn("dedup_key_v2", dedup_key(
        c("title_final"), c("company_clean"), c("city_norm"), c("category_filled"), c("description_clean_v2"), c("posted_at")))
    strings = ["title_final", "company_clean", "city_norm", "category_filled", "level_filled", "requirements_clean", "responsibilities_clean"]
    # The rules are dear and the dedup reads its input more than once: keep their result.
    ensure_checkpoint_dir(df.sparkSession)
    a = priority(a, strings, ["hard_skills_clean"]).checkpoint()
    a = keep_best(a, "dedup_key_v2", "dedup_priority_score", order, "is_duplicate")
    return usability(quality_tier(a))


# ---- reports -----------------------------------------------------------------------------

def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double")) * 100


def present(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        return ~F.coalesce(is_missing_like(c(col)), F.lit(True))
    if isinstance(kind, T.ArrayType):
        return ~is_missing_list(c(col))
    return c(col).isNotNull()


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, coverage in percent) for several columns in one pass."""
    one = df.agg(*[_share(present(df, x)).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), c(x).alias("coverage_pct")) for x in cols])))


def quality_report(
    before: DataFrame, after: DataFrame, before_cols: Sequence[str], after_cols: Sequence[str],
    skills_before: DataFrame | None = None, skills_after: DataFrame | None = None,
) -> DataFrame:
    """One long report (section, measure, value) from one pass over each side.

    ``skills_before`` and ``skills_after`` hold a ``skill`` per row; their distinct skills are counted.
    """
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long")).cast("double")
    after_aggs = {("coverage_after", x): _share(present(after, x)) for x in after_cols}
    for name in ("usable_for_salary_analytics", "usable_for_skill_analytics", "usable_for_employer_analytics", "usable_for_category_analytics"):
        after_aggs[("usability", name)] = count(c(name))
    for name in ("is_duplicate", "is_duplicate_v2", "dedup_keep_for_analytics"):
        if name in after.columns:
            after_aggs[("dedup", name)] = count(c(name))
    for name in ("salary_is_suspicious", "salary_outlier_flag", "salary_contact_leak_flag", "salary_zero_flag",
                 "salary_usable_for_analytics", "company_is_suspicious", "description_clean_changed"):
        if name in after.columns:
            after_aggs[("cleaning", name)] = count(c(name))
    for tier in v.QUALITY_ORDER:
        after_aggs[("tier", tier)] = count(c("quality_tier") == tier)
    after_aggs[("rows", "after")] = F.count(F.lit(1)).cast("double")
    before_aggs = {("coverage_before", x): _share(present(before, x)) for x in before_cols}
    before_aggs[("rows", "before")] = F.count(F.lit(1)).cast("double")

    def long_form(df: DataFrame, aggs: dict) -> DataFrame:
        one = df.agg(*[col.alias(f"a{i}") for i, col in enumerate(aggs.values())])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(s).alias("section"), F.lit(m).alias("measure"), c(f"a{i}").alias("value"))
            for i, (s, m) in enumerate(aggs)
        ])))

    out = long_form(before, before_aggs).unionByName(long_form(after, after_aggs))
    for name, skills in (("before", skills_before), ("after", skills_after)):
        if skills is not None:
            out = out.unionByName(long_form(skills.select("skill").distinct(), {("unique_hard_skills", name): F.count("skill").cast("double")}))
    return out


def profile_columns(df: DataFrame, json_cols: Sequence[str] = ()) -> DataFrame:
    """Per column: type, missing-like count and share, smallest value, JSON validity; one pass over the rows."""
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, f in enumerate(df.schema):
        text = c(f.name).cast("string")
        json_ok = F.try_parse_json(text).isNotNull() if f.name in json_cols else F.lit(None).cast("boolean")
        aggs += [
            F.sum((~present(df, f.name)).cast("long")).alias(f"m{i}"), F.min(text).alias(f"s{i}"),
            F.count(F.when(json_ok, 1)).alias(f"j{i}"), F.count(F.when(~json_ok & text.isNotNull(), 1)).alias(f"b{i}"),
        ]
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), c(f"m{i}").alias("missing_like"),
            (c(f"m{i}") / c("_n") * 100).alias("missing_pct"), c(f"s{i}").alias("sample"),
            c(f"j{i}").alias("json_valid"), c(f"b{i}").alias("json_invalid"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def column_samples(df: DataFrame, cols: Sequence[str], order: str, n: int = 5) -> DataFrame:
    """First ``n`` values of every column in row order: (column, samples). Partitions send ``n`` rows per column."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in cols])
    rows = df.select(c(order).alias("_o"), F.inline(pairs)).filter(c("value").isNotNull())
    heads = head_per_key(rows, ["column"], [F.asc("_o")], n, "_i")
    listed = heads.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_i", "value"))).alias("_s"))
    return listed.select("column", c("_s.value").alias("samples"))


def column_values(df: DataFrame, cols: Sequence[str], max_distinct: int = 40, n: int = 15) -> DataFrame:
    """Most frequent values of every column with few distinct ones: (column, value, n_rows)."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.coalesce(c(x).cast("string"), F.lit("<NA>")).alias("value")) for x in cols])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    few = counts.groupBy("column").agg(F.sum((c("value") != "<NA>").cast("int")).alias("_d")).filter(c("_d") <= max_distinct)
    ranked = head_per_key(counts, ["column"], [F.desc("n_rows"), F.asc("value")], n, "value_rank")
    return ranked.join(F.broadcast(few.select("column")), "column", "left_semi")


def header_audit(df: DataFrame, order: str) -> dict[str, DataFrame]:
    """Chat rows: match summary, counts and five examples per pattern, most frequent unresolved headers, 50 samples.

    The chat rows are kept in the checkpoint folder, so the rules before the audit run once, whatever reads of it are used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    chat = df.filter(~c("source").isin(v.STRUCTURED_SOURCES)).checkpoint()
    matched = c("header_parse_pattern") != "no_match"
    bad = c("title_final").isNull() | c("company_clean").isNull()
    window = t.header_window(c("description_clean_v2"), 220)
    unresolved = chat.filter(bad).withColumn("header_window", window)
    return {
        "summary": chat.agg(
            F.count(F.lit(1)).alias("chat_rows"), F.count(F.when(matched, 1)).alias("matched_rows"),
            (F.count(F.when(matched, 1)) / F.count(F.lit(1)) * 100).alias("matched_pct"),
            F.count(F.when(bad, 1)).alias("still_bad_rows"),
        ),
        "patterns": chat.filter(matched).groupBy("header_parse_pattern").agg(F.count(F.lit(1)).alias("n_rows")),
        "examples": head_per_key(
            chat.filter(matched).withColumn("header_window", window), ["header_parse_pattern"], [F.asc(order)], 5, "example_no"),
        "unresolved": unresolved.groupBy("header_window").agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), F.asc("header_window")).limit(30),
        "samples": unresolved.orderBy(F.asc(order)).limit(50),
    }
