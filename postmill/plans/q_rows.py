"""Projection, filter, window, sort and set queries."""

from pyspark.sql import functions as F

from postmill.operators import curate, rows
from postmill.operators.analytics import city_bucket
from postmill.operators.listing import write_listing
from postmill.operators.spread import flag_repeats, head_per_key, keep_first, number_rows
from postmill.plans.fixtures import FIXTURES
from postmill.plans.registry import query
from postmill.sources.tables import scratch_path

c = F.col
MISSING = "('', 'unknown', 'none', 'null', 'nan', 'n/a', 'na')"
SQUEEZE = r"trim(regexp_replace({x}, '[\s\x{{a0}}]+', ' ', 'g'))"


def sq(x: str) -> str:
    return SQUEEZE.format(x=x)


# Documents as descriptions; some blank, some missing words, repeats flagged by their text.
FIXTURES["doc_rows"] = """
SELECT doc_id, lang, text,
  CASE WHEN doc_id % 19 = 0 THEN ' Unknown ' WHEN doc_id % 23 = 0 THEN 'N/A' WHEN doc_id % 29 = 0 THEN '[]' WHEN doc_id % 31 = 0 THEN NULL
       ELSE source END AS company,
  CASE WHEN doc_id % 37 = 0 THEN '   ' ELSE text END AS description_clean,
  CASE doc_id % 5 WHEN 0 THEN 'hh_kz' WHEN 1 THEN 'kaspi_jobs' WHEN 2 THEN 'Work IT KZ' WHEN 3 THEN 'Halyk Jumys' ELSE 'kolesa_jobs' END AS source
FROM documents
"""
FIXTURES["doc_flagged"] = """
SELECT doc_rows.*, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM doc_rows
"""
FIXTURES["doc_candidates"] = """
SELECT doc_id, source, text, length(description_clean) AS description_length,
  CASE WHEN source IN ('Work IT KZ', 'Halyk Jumys') THEN 0 WHEN source = 'hh_kz' THEN 1 ELSE 2 END AS source_priority
FROM doc_flagged WHERE NOT is_duplicate AND trim(description_clean) <> '' AND length(description_clean) > 200
"""


def flagged_docs(i):
    return flag_repeats(i.view("doc_rows").withColumn("_k", F.md5("text")), ["_k"], "doc_id").drop("_k")


@query("ensure_columns", """
SELECT id, source, 'D' AS quality_tier, '[]' AS skills_all_clean, CAST(0 AS BIGINT) AS skills_count, false AS usable_for_salary_analytics,
  CAST(NULL AS DOUBLE) AS salary_avg_clean FROM postings""")
def _(i):
    df = i.sql("SELECT id, source FROM postings")
    out = rows.ensure_columns(df, {
        "source": "Unknown", "quality_tier": "D", "skills_all_clean": "[]", "skills_count": 0, "usable_for_salary_analytics": False,
        "salary_avg_clean": None})
    return out.withColumn("skills_count", c("skills_count").cast("long"))


@query("coerce_types", """
SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE salary_avg_clean END AS salary_avg_clean,
  CASE id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS keep_flag, coalesce(company_clean, '') AS company_clean,
  CASE WHEN title_final = '' THEN 'Untitled vacancy' ELSE title_final END AS title_display,
  coalesce(company_clean, 'Company not specified') AS company_display, coalesce(category_filled, 'unresolved') AS category_display,
  coalesce(level_filled, 'unresolved') AS level_display,
  CAST(CASE level_filled WHEN 'intern' THEN 1 WHEN 'junior' THEN 2 WHEN 'middle' THEN 3 WHEN 'senior' THEN 4 END AS BIGINT) AS level_ordinal,
  CAST(CASE quality_tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS BIGINT) AS tier_ordinal
FROM postings""")
def _(i):
    df = i.sql("""SELECT postings.*, CASE WHEN id % 7 = 0 THEN 'not a number' ELSE CAST(salary_avg_clean AS STRING) END AS salary_text,
      CASE id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN 'no' WHEN 3 THEN NULL ELSE '1' END AS keep_flag FROM postings""")
    typed = rows.coerce_types(df, ["salary_text"], ["keep_flag"], ["company_clean", "title_final", "category_filled"])
    shown = rows.display_columns(typed)
    return shown.select(
        "id", c("salary_text").alias("salary_avg_clean"), "keep_flag", "company_clean", "title_display", "company_display", "category_display",
        "level_display", c("level_ordinal").cast("long").alias("level_ordinal"), c("tier_ordinal").cast("long").alias("tier_ordinal"))


@query("missing_like_to_null", rf"""
SELECT doc_id, CASE WHEN lower({sq('company')}) IN {MISSING} THEN NULL ELSE {sq('company')} END AS company,
  md5(CASE WHEN lower({sq('d')}) IN {MISSING} THEN NULL ELSE {sq('d')} END) AS text_md5
FROM (SELECT doc_id, company, replace(replace(replace(description_clean, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS d FROM doc_rows)""")
def _(i):
    out = curate.null_missing(i.sql("SELECT doc_id, company, description_clean FROM doc_rows"))
    return out.select("doc_id", "company", F.md5("description_clean").alias("text_md5"))


@query("is_missing_like", rf"""
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE company IS NULL OR lower({sq('company')}) IN {MISSING} OR {sq('company')} = '[]') AS n_missing
FROM doc_rows GROUP BY 1""")
def _(i):
    from postmill.functions.text import is_missing_like
    gone = F.coalesce(is_missing_like(c("company")), F.lit(True)) | c("company").isNull()
    return i.view("doc_rows").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(gone, 1)).alias("n_missing"))


@query("is_meaningful", rf"""
SELECT doc_id, company IS NOT NULL AND lower({sq('company')}) NOT IN {MISSING} AND length({sq('company')}) >= 5 AS ok
FROM doc_rows""")
def _(i):
    from postmill.functions.text import is_meaningful
    return i.view("doc_rows").select("doc_id", is_meaningful(c("company"), 5).alias("ok"))


@query("facet_filter", """
SELECT id, city_norm, category_filled, quality_tier, salary_avg_clean FROM postings
WHERE city_norm IN ('almaty', 'remote') AND category_filled IN ('data', 'qa', 'design') AND quality_tier IN ('A', 'B')
  AND source IN ('hh_kz', 'Work IT KZ', 'Freedom Broker') AND english_required AND (salary_avg_clean IS NULL OR salary_avg_clean BETWEEN 50000 AND 400000)""")
def _(i):
    df = i.view("postings").withColumn("source_family", rows.source_family(c("source")))
    picked = rows.apply_facets(
        df, {"city": ["almaty", "remote"], "category": ["data", "qa", "design"], "quality_tier": ["A", "B"], "source": ["hh_kz", "telegram"]},
        (50_000, 400_000), "Required")
    return picked.select("id", "city_norm", "category_filled", "quality_tier", "salary_avg_clean")


@query("facet_options", """
WITH o AS (SELECT DISTINCT facet, value FROM (
  SELECT unnest(['city', 'category', 'level', 'work_format', 'quality_tier', 'company']) AS facet,
         unnest([city_norm, category_filled, level_filled, work_format_norm, quality_tier, company_clean]) AS value FROM postings) WHERE value <> '')
SELECT * FROM o WHERE facet <> 'company'
UNION ALL (SELECT * FROM o WHERE facet = 'company' ORDER BY value LIMIT 200)
UNION ALL SELECT 'salary_min', CAST(greatest(CAST(floor(min(salary_avg_clean) / 50000) * 50000 AS BIGINT), 0) AS VARCHAR) FROM postings
UNION ALL SELECT 'salary_max', CAST(CAST((floor(max(salary_avg_clean) / 50000) + 1) * 50000 AS BIGINT) AS VARCHAR) FROM postings""")
def _(i):
    return rows.facet_options(i.view("postings"), ["city", "category", "level", "work_format", "quality_tier", "company"])


@query("job_listing_page", """
WITH f AS (SELECT id, title_final, company_clean, salary_avg_clean FROM postings WHERE dedup_keep_for_analytics AND category_filled = 'data' AND level_filled = 'junior')
SELECT *, (SELECT count(*) FROM f) AS total, CAST(greatest(ceil((SELECT count(*) FROM f) / 12.0), 1) AS BIGINT) AS pages
FROM f ORDER BY id LIMIT 12 OFFSET 24""")
def _(i):
    """The page and the total come from the stored listing's index; only the folder of the page's rows is read."""
    df = i.view("postings").where("dedup_keep_for_analytics").select("id", "title_final", "company_clean", "salary_avg_clean", "category_filled", "level_filled")
    store = write_listing(df, scratch_path(i.spark, "listing"), ["id"], ["category", "level"])
    return store.page({"category": ["data"], "level": ["junior"]}, 3, 12).select("id", "title_final", "company_clean", "salary_avg_clean", "total", "pages")


@query("facet_counts", """
WITH s AS (SELECT * FROM postings WHERE city_norm IN ('almaty', 'remote') AND quality_tier IN ('A', 'B'))
SELECT facet, value, count(*) AS n FROM (
  SELECT unnest(['city', 'category', 'level', 'work_format', 'quality_tier']) AS facet, unnest([city_norm, category_filled, level_filled, work_format_norm, quality_tier]) AS value FROM s)
WHERE value <> '' GROUP BY 1, 2""")
def _(i):
    """Counts of every choice under a selection, from the index alone."""
    store = write_listing(i.view("postings"), scratch_path(i.spark, "listing"), ["id"], ["city", "category", "level", "work_format", "quality_tier"])
    return store.facet_counts({"city": ["almaty", "remote"], "quality_tier": ["A", "B"]})


@query("analytic_slices", """
SELECT 'all' AS slice, count(*) AS n_rows FROM postings UNION ALL SELECT 'base', count(*) FROM base_rows
UNION ALL SELECT 'base_structured', count(*) FROM structured_rows UNION ALL SELECT 'salary', count(*) FROM salary_rows
UNION ALL SELECT 'skills', count(*) FROM skill_usable_rows UNION ALL SELECT 'employer', count(*) FROM employer_rows
UNION ALL SELECT 'category', count(*) FROM category_rows""")
def _(i):
    out = None
    for name, df in rows.slices(i.view("postings")).items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("slice"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("structured_salary_gate", """
SELECT id, ok AS salary_structured_analytics_flag, CASE WHEN ok THEN salary_avg_clean END AS salary_avg_analytics,
  CASE WHEN ok THEN salary_from_clean END AS salary_from_analytics, CASE WHEN ok THEN salary_to_clean END AS salary_to_analytics
FROM (SELECT *, usable_for_salary_analytics AND source IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs') AS ok FROM postings)""")
def _(i):
    return rows.gate_salary(i.view("postings")).select(
        "id", "salary_structured_analytics_flag", "salary_avg_analytics", "salary_from_analytics", "salary_to_analytics")


@query("source_family", """
SELECT source, CASE source WHEN 'hh_kz' THEN 'hh_kz' WHEN 'kaspi_jobs' THEN 'kaspi' WHEN 'kolesa_jobs' THEN 'kolesa' WHEN '' THEN 'other' ELSE 'telegram' END AS family,
  count(*) AS n_rows FROM (SELECT CASE WHEN id % 41 = 0 THEN '' ELSE source END AS source FROM postings) GROUP BY 1, 2""")
def _(i):
    df = i.sql("SELECT CASE WHEN id % 41 = 0 THEN '' ELSE source END AS source FROM postings")
    return df.groupBy("source", rows.source_family(c("source")).alias("family")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("city_bucket", """
SELECT city_norm, CASE WHEN city_norm IN ('almaty', 'astana', 'remote') THEN city_norm ELSE 'other' END AS bucket, count(*) AS n_rows
FROM postings GROUP BY 1, 2""")
def _(i):
    return i.view("postings").groupBy("city_norm", city_bucket(c("city_norm")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


LABEL_SQL = """
SELECT id, CASE WHEN a{z} THEN fa || ' ' || cur WHEN f{z2} AND t{z3} THEN ff || '{dash}' || ft || ' ' || cur
  WHEN f{z2} THEN '{low}' || ff || ' ' || cur WHEN t{z3} THEN '{high}' || ft || ' ' || cur ELSE '{none}' END AS salary_display
FROM (SELECT id, salary_avg_clean IS NOT NULL AS a, salary_from_clean IS NOT NULL AS f, salary_to_clean IS NOT NULL AS t,
  replace(format('{{:,}}', CAST(trunc(salary_avg_clean) AS BIGINT)), ',', ' ') AS fa, replace(format('{{:,}}', CAST(salary_from_clean AS BIGINT)), ',', ' ') AS ff,
  replace(format('{{:,}}', CAST(salary_to_clean AS BIGINT)), ',', ' ') AS ft, CASE WHEN currency_clean = '' THEN 'KZT' ELSE currency_clean END AS cur FROM postings)"""


@query("salary_label", LABEL_SQL.format(z="", z2="", z3="", dash=" - ", low="from ", high="up to ", none="Salary not specified"))
def _(i):
    return rows.salary_label(i.view("postings")).select("id", "salary_display")


@query("enrichment_candidates", "SELECT doc_id, source, description_length, CAST(source_priority AS BIGINT) AS source_priority FROM doc_candidates")
def _(i):
    out = rows.candidates(flagged_docs(i))
    return out.select("doc_id", "source", c("description_length").cast("long").alias("description_length"), c("source_priority").cast("long").alias("source_priority"))


@query("stratified_sample", """
WITH d AS (SELECT doc_id, source, description_length, CASE source_priority WHEN 0 THEN 'chat' WHEN 1 THEN 'api' ELSE 'other' END AS stratum, md5(doc_id || ':42') AS draw FROM doc_candidates),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id) AS nth FROM d)
SELECT doc_id, source, stratum, description_length FROM n
ORDER BY CASE WHEN nth <= CASE stratum WHEN 'chat' THEN 200 WHEN 'api' THEN 70 ELSE 30 END THEN 0 ELSE 1 END, draw, doc_id LIMIT 300""")
def _(i):
    return rows.stratified_sample(rows.candidates(flagged_docs(i)), "doc_id", 300).select("doc_id", "source", "stratum", "description_length")


@query("skip_completed", """
SELECT doc_id, source FROM doc_candidates WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def _(i):
    from postmill.sources.tables import skip_completed
    done = i.sql("SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'purchase'")
    return skip_completed(rows.candidates(flagged_docs(i)), done, "doc_id").select("doc_id", "source")


@query("enrichment_batches", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source_priority, description_length DESC, source, doc_id) - 1 AS n FROM doc_candidates)
SELECT CAST(n // 5 AS BIGINT) AS batch_no, count(*) AS n_rows, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n) AS ids FROM r GROUP BY 1""")
def _(i):
    rows_in = rows.candidates(flagged_docs(i)).select("doc_id", "source", "source_priority", "description_length", "text")
    text = rows.context_text({"SOURCE": c("source"), "DESCRIPTION": c("text"), "SKILLS_RAW": F.lit(None)})
    out = rows.enrichment_batches(rows_in, 5, rows.candidate_order("doc_id"), {"doc_id": c("doc_id"), "context": text})
    ids = F.transform(F.from_json("items", "array<struct<row_no:bigint,doc_id:bigint>>"), lambda x: x["doc_id"].cast("string"))
    return out.select("batch_no", "n_rows", F.array_join(ids, ",").alias("ids"))


@query("token_cost_estimate", """
WITH t AS (SELECT count(*) AS n_rows, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS i FROM doc_candidates)
SELECT n_rows, i AS input_tokens, n_rows * 350 AS output_tokens, round(i / 1e6 * 0.05 + n_rows * 350 / 1e6 * 0.08, 6) AS cost_cheap,
  round(i / 1e6 * 0.59 + n_rows * 350 / 1e6 * 0.79, 6) AS cost_strong,
  round(i / 1e6 * 0.05 + n_rows * 350 / 1e6 * 0.08 + ceil(i * 0.1) / 1e6 * 0.59 + ceil(n_rows * 350 * 0.1) / 1e6 * 0.79, 6) AS cost_hybrid FROM t""")
def _(i):
    prices = i.spark.createDataFrame([("cheap", 0.05, 0.08), ("strong", 0.59, 0.79)], "model string, input_price double, output_price double")
    return rows.token_cost(rows.candidates(flagged_docs(i)), "text", prices, 350, 0.1, "cheap", "strong")


# ---- windows, sorts, sets ------------------------------------------------------------

KEY = r"md5(trim(regexp_replace(lower(text), '[^0-9a-zа-яё]+', ' ', 'g')))"


@query("dup_flag_first", f"SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY {KEY}) AS is_duplicate FROM documents")
def _(i):
    from postmill.functions.text import normalize_key
    keyed = i.table("documents").select("doc_id", F.md5(normalize_key(c("text"))).alias("h"))
    return flag_repeats(keyed, ["h"], "doc_id").select("doc_id", "is_duplicate")


@query("group_size", f"""
SELECT doc_id, n AS group_size, CASE WHEN n > 1 THEN h END AS group_id
FROM (SELECT doc_id, {KEY} AS h, count(*) OVER (PARTITION BY {KEY}) AS n FROM documents)""")
def _(i):
    from postmill.functions.text import normalize_key
    from postmill.operators.spread import attach_group
    keyed = i.table("documents").select("doc_id", F.md5(normalize_key(c("text"))).alias("h"))
    out = attach_group(keyed, ["h"], [F.count(F.lit(1)).alias("group_size")], "doc_id")
    return out.select("doc_id", "group_size", F.when(c("group_size") > 1, c("h")).alias("group_id"))


@query("rank_keep_best", """
WITH k AS (SELECT id, coalesce(company_clean, '') || '|' || coalesce(category_filled, '') AS k, coalesce(salary_avg_clean, 0) AS s FROM postings),
r AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS rn FROM k)
SELECT id, n AS group_size, CASE WHEN n > 1 THEN k END AS same_role_duplicate_group, n > 1 AS is_duplicate_v2, n = 1 OR rn = 1 AS dedup_keep_for_analytics FROM r""")
def _(i):
    keyed = i.sql("""SELECT id, coalesce(company_clean, '') || '|' || coalesce(category_filled, '') AS k, coalesce(salary_avg_clean, 0) AS s
                     FROM postings""")
    return curate.keep_best(keyed, "k", "s", "id").drop("k", "s")


@query("head_per_group", """
SELECT * FROM (SELECT source, id, title_final, row_number() OVER (PARTITION BY source ORDER BY id) AS rank_in_group FROM postings) WHERE rank_in_group <= 5""")
def _(i):
    out = head_per_key(i.view("postings").select("source", "id", "title_final"), ["source"], [F.asc("id")], 5)
    return out.withColumn("rank_in_group", c("rank_in_group").cast("long"))


@query("last_wins", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(i):
    return keep_first(i.table("events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("distinct_by_key", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def _(i):
    out = keep_first(i.table("events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])
    return out.select("user_id", "event_type", "event_id", "value")


@query("sort_multi_nulls_last", """
SELECT id, experience_min, salary_avg_clean, n_skills, row_number() OVER (ORDER BY experience_min DESC NULLS LAST, salary_avg_clean DESC NULLS LAST, n_skills DESC NULLS LAST, id) - 1 AS place
FROM postings LEFT JOIN (SELECT id, count(*) AS n_skills FROM posting_skills GROUP BY 1) USING (id)""")
def _(i):
    """The whole table in order, each row with its place."""
    counts = i.sql("SELECT id, count(*) AS n_skills FROM posting_skills GROUP BY id")
    both = i.sql("SELECT id, experience_min, salary_avg_clean FROM postings").join(counts, "id", "left")
    order = [c(x).desc_nulls_last() for x in ("experience_min", "salary_avg_clean", "n_skills")]
    return number_rows(both, [*order, F.asc("id")], "place")


@query("union_all_sources", """
SELECT source, count(*) AS n_rows, count(salary) AS n_salary, count(body) AS n_body FROM (
  SELECT 'board' AS source, id, salary_avg_clean AS salary, CAST(NULL AS VARCHAR) AS body FROM postings
  UNION ALL SELECT 'docs', doc_id, NULL, text FROM documents UNION ALL SELECT role, conv_id, NULL, text FROM conversations) GROUP BY 1""")
def _(i):
    from postmill.sources.unify import union_sources
    both = union_sources({
        "board": i.sql("SELECT id, salary_avg_clean AS salary FROM postings"),
        "docs": i.sql("SELECT doc_id AS id, text AS body FROM documents"),
        "chat": i.sql("SELECT role AS source, conv_id AS id, text AS body FROM conversations"),
    })
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("salary").alias("n_salary"), F.count("body").alias("n_body"))
