"""Dedup, tiers, marts, profiles of columns and reports."""

from pyspark.sql import functions as F

from postmill.functions import vocab as v
from postmill.operators import curate
from postmill.plans.fixtures import FIXTURES
from postmill.plans.q_text import NORM
from postmill.plans.registry import query

c = F.col

FIXTURES["gold_in"] = """
SELECT id, source, title_final, company_clean, city_norm, category_filled, level_filled, posted_at, salary_avg_clean, english_required,
  id % 3 = 0 AS title_is_inferred, CASE WHEN id % 4 = 0 THEN 'full_time' END AS employment_norm, work_format_norm,
  CASE WHEN id % 8 = 0 THEN NULL ELSE 'Long enough description text for ' || source || ' ' || (id % 50) END AS description_clean_v2,
  CASE WHEN id % 8 = 0 THEN 0 ELSE 40 + id % 50 END AS description_clean_len, CASE WHEN id % 2 = 0 THEN 'reqs' END AS requirements_clean,
  CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 'resp' END AS responsibilities_clean, id % 6 = 0 AS llm_review_flag, id % 3 <> 0 AS salary_usable_for_analytics,
  (id % 9) * 1.0 AS skills_count, CAST((id % 16) AS DOUBLE) / 16 AS llm_confidence, id % 13 = 0 AS is_duplicate, id % 17 = 0 AS company_is_suspicious,
  id % 19 = 0 AS salary_contact_leak_flag, id % 7 = 0 AS salary_is_suspicious
FROM postings
"""
T = NORM.format(x="coalesce(title_final, '')")
C = NORM.format(x="coalesce(company_clean, '')")
D = NORM.format(x="description_clean_v2")
WEEK = "strftime(date_trunc('week', posted_at), '%Y-%m-%d') || '/' || strftime(date_trunc('week', posted_at) + INTERVAL 6 DAY, '%Y-%m-%d')"
KEYED = f"""
k AS (SELECT *, md5(CASE WHEN {T} <> '' AND {C} <> '' THEN {T} || '|' || {C} || '|' || coalesce(city_norm, 'unknown') || '|' || coalesce(category_filled, 'unknown') || '|' || {WEEK}
  ELSE {T} || '|' || coalesce(city_norm, 'unknown') || '|' || coalesce(category_filled, 'unknown') || '|'
    || CASE WHEN description_clean_v2 IS NULL THEN 'none' ELSE md5({D}) END || '|' || {WEEK} END) AS dedup_key_v2,
  (title_final <> '')::INT + (company_clean IS NOT NULL)::INT + (city_norm IS NOT NULL)::INT + (category_filled IS NOT NULL)::INT + (level_filled IS NOT NULL)::INT
    + (requirements_clean IS NOT NULL)::INT + (responsibilities_clean <> 'unknown')::INT AS completeness_score FROM gold_in),
s AS (SELECT *, CAST(CASE source WHEN 'hh_kz' THEN 400 WHEN 'kaspi_jobs' THEN 300 WHEN 'kolesa_jobs' THEN 300 WHEN 'Freedom Broker' THEN 200 ELSE 100 END + CASE WHEN llm_review_flag THEN 0 ELSE 20 END
  + CASE WHEN salary_usable_for_analytics THEN 10 ELSE 0 END + skills_count::INT + completeness_score * 2 AS DOUBLE) + description_clean_len / 1000.0::DOUBLE + llm_confidence AS score FROM k),
g AS (SELECT *, count(*) OVER (PARTITION BY dedup_key_v2) AS n, row_number() OVER (PARTITION BY dedup_key_v2 ORDER BY score DESC, id) AS rn FROM s),
d AS (SELECT *, n > 1 OR is_duplicate AS is_duplicate_v2, NOT (n > 1 OR is_duplicate) OR rn = 1 AS dedup_keep_for_analytics FROM g),
t AS (SELECT *, title_final <> '' AND category_filled IS NOT NULL AND city_norm IS NOT NULL AS core,
  (is_duplicate_v2 AND NOT dedup_keep_for_analytics) OR salary_contact_leak_flag OR (company_is_suspicious AND company_clean IS NULL) AS severe FROM d),
q AS (SELECT *, CASE WHEN severe THEN 'D' WHEN source IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs') AND dedup_keep_for_analytics AND core AND NOT llm_review_flag AND NOT salary_is_suspicious
    AND NOT company_is_suspicious AND length(category_filled) >= 3 THEN 'A' WHEN dedup_keep_for_analytics AND core AND NOT company_is_suspicious AND length(category_filled) >= 3 THEN 'B'
  WHEN description_clean_v2 IS NOT NULL AND (length(category_filled) >= 3 OR skills_count > 0) THEN 'C' ELSE 'D' END AS quality_tier FROM t)"""
STRINGS = ["title_final", "company_clean", "city_norm", "category_filled", "level_filled", "requirements_clean", "responsibilities_clean"]


def deduped(i):
    df = i.dealt("gold_in", "id").withColumns({
        "skills_count": c("skills_count").cast("long"), "dedup_key_v2": curate.dedup_key(
            c("title_final"), c("company_clean"), c("city_norm"), c("category_filled"), c("description_clean_v2"), c("posted_at"))})
    return curate.keep_best(curate.priority(df, STRINGS), "dedup_key_v2", "dedup_priority_score", "id", "is_duplicate")


def tiered(i):
    return curate.usability(curate.quality_tier(deduped(i)))


@query("dedup_second_pass", f"WITH {KEYED.strip()} SELECT id, dedup_key_v2, n AS group_size, is_duplicate_v2, dedup_keep_for_analytics FROM d")
def _(i):
    return deduped(i).select("id", "dedup_key_v2", "group_size", "is_duplicate_v2", "dedup_keep_for_analytics")


@query("completeness_score", f"WITH {KEYED.strip()} SELECT id, CAST(completeness_score AS BIGINT) AS completeness_score, round(score, 6) AS dedup_priority_score FROM s")
def _(i):
    df = curate.priority(i.dealt("gold_in", "id"), STRINGS)
    return df.select("id", c("completeness_score").cast("long").alias("completeness_score"), F.round("dedup_priority_score", 6).alias("dedup_priority_score"))


@query("quality_tier", f"WITH {KEYED.strip()} SELECT id, quality_tier FROM q")
def _(i):
    return tiered(i).select("id", "quality_tier")


USABLE = """dedup_keep_for_analytics AND salary_usable_for_analytics AS usable_for_salary_analytics,
  dedup_keep_for_analytics AND company_clean IS NOT NULL AND NOT company_is_suspicious AS usable_for_employer_analytics,
  dedup_keep_for_analytics AND skills_count > 0 AND description_clean_v2 IS NOT NULL AS usable_for_skill_analytics,
  dedup_keep_for_analytics AND category_filled IS NOT NULL AS usable_for_category_analytics"""


@query("usability_flags", f"WITH {KEYED.strip()} SELECT id, {USABLE} FROM q")
def _(i):
    return tiered(i).select("id", "usable_for_salary_analytics", "usable_for_employer_analytics", "usable_for_skill_analytics", "usable_for_category_analytics")


@query("entity_mart", f"""
WITH {KEYED.strip()} SELECT id, source, title_final, title_is_inferred, company_clean, company_is_suspicious, category_filled, level_filled, city_norm, employment_norm, work_format_norm,
  quality_tier, dedup_keep_for_analytics, posted_at FROM q""")
def _(i):
    return curate.entity_mart(tiered(i))


@query("skills_mart", """
SELECT p.id AS job_id, skill, skill_type, category_filled AS category_norm, level_filled AS level_norm, source, city_norm, posted_at FROM skill_rows s JOIN postings p ON s.id = p.id""")
def _(i):
    kind = lambda name: F.sort_array(F.collect_set(F.when(c("skill_type") == name, c("skill"))))
    lists = i.view("skill_rows").groupBy("id").agg(
        kind("hard_skill").alias("hard_skills_clean"), kind("soft_skill").alias("soft_skills_clean"), kind("tech_stack").alias("tech_stack_clean"))
    df = i.sql("SELECT id, category_filled, level_filled, source, city_norm, posted_at FROM postings").join(lists, "id")
    return curate.skills_mart(df)


REPORT_COLS = ["title_final", "company_clean", "category_filled", "level_filled", "responsibilities_clean"]


def coverage_sql(table: str, section: str) -> str:
    gone = "'', 'unknown', 'none', 'null', 'nan', 'n/a', 'na', '[]'"
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{x}' AS measure, avg(CASE WHEN {x} IS NOT NULL AND lower(trim({x})) NOT IN ({gone}) THEN 1.0 ELSE 0.0 END) * 100 AS value FROM {table}" for x in REPORT_COLS)


def count_sql(section: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}', '{x}', CAST(count(*) FILTER (WHERE {x}) AS DOUBLE) FROM u" for x in names)


# Skills as written: a third of the mentions in capitals, a fifth with blanks around.
FIXTURES["raw_hard"] = """
SELECT CASE WHEN id % 5 = 0 THEN ' ' ELSE '' END || CASE WHEN id % 3 = 0 THEN upper(skill) ELSE skill END AS skill FROM skill_rows WHERE skill_type = 'hard_skill'
"""


@query("quality_report", f"""
WITH {KEYED.strip()}, u AS (SELECT *, {USABLE} FROM q)
{coverage_sql('gold_in', 'coverage_before')} UNION ALL {coverage_sql('u', 'coverage_after')}
UNION ALL {count_sql('usability', ['usable_for_salary_analytics', 'usable_for_skill_analytics', 'usable_for_employer_analytics', 'usable_for_category_analytics'])}
UNION ALL {count_sql('dedup', ['is_duplicate', 'is_duplicate_v2', 'dedup_keep_for_analytics'])}
UNION ALL {count_sql('cleaning', ['salary_is_suspicious', 'salary_contact_leak_flag', 'salary_usable_for_analytics', 'company_is_suspicious'])}
UNION ALL SELECT 'tier', x, CAST(count(*) FILTER (WHERE quality_tier = x) AS DOUBLE) FROM u, (VALUES ('A'), ('B'), ('C'), ('D')) z(x) GROUP BY x
UNION ALL SELECT 'unique_hard_skills', 'before', CAST(count(DISTINCT skill) AS DOUBLE) FROM raw_hard UNION ALL SELECT 'unique_hard_skills', 'after', CAST(count(DISTINCT lower(trim(skill))) AS DOUBLE) FROM raw_hard
UNION ALL SELECT 'rows', 'after', CAST(count(*) AS DOUBLE) FROM u UNION ALL SELECT 'rows', 'before', CAST(count(*) AS DOUBLE) FROM gold_in""")
def _(i):
    raw = i.view("raw_hard")
    clean = raw.select(F.lower(F.trim("skill")).alias("skill"))
    return curate.quality_report(i.dealt("gold_in", "id"), tiered(i), REPORT_COLS, REPORT_COLS, raw, clean)


@query("profile_columns", """
WITH p AS (SELECT event_type, nullif(props, '{"k": 69}') AS props, CASE WHEN event_id % 9 = 0 THEN '{bad' ELSE props END AS raw, value FROM events)
SELECT 'event_type' AS "column", 'string' AS dtype, CAST(0 AS BIGINT) AS missing_like, 0.0::DOUBLE AS missing_pct, min(event_type) AS sample, CAST(0 AS BIGINT) AS json_valid, CAST(0 AS BIGINT) AS json_invalid FROM p
UNION ALL SELECT 'props', 'string', count(*) FILTER (WHERE props IS NULL), count(*) FILTER (WHERE props IS NULL)::DOUBLE / count(*) * 100, min(props), count(props), 0 FROM p
UNION ALL SELECT 'raw', 'string', 0, 0.0, min(raw), count(*) FILTER (WHERE raw <> '{bad'), count(*) FILTER (WHERE raw = '{bad') FROM p""")
def _(i):
    df = i.sql("""SELECT event_type, nullif(props, '{"k": 69}') AS props, CASE WHEN event_id % 9 = 0 THEN '{bad' ELSE props END AS raw FROM events""")
    return curate.profile_columns(df, ["props", "raw"])


@query("profile_column_values", """
WITH l AS (SELECT unnest(['source', 'level_filled', 'quality_tier', 'company_clean']) AS "column", unnest([source, level_filled, quality_tier, company_clean]) AS value FROM postings),
k AS (SELECT "column", coalesce(value, '<NA>') AS value, count(*) AS n_rows FROM l GROUP BY 1, 2),
f AS (SELECT "column" FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE value <> '<NA>') <= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n_rows DESC, value) AS value_rank FROM k)
SELECT r."column", value, n_rows, value_rank FROM r JOIN f USING ("column") WHERE value_rank <= 15""")
def _(i):
    out = curate.column_values(i.view("postings"), ["source", "level_filled", "quality_tier", "company_clean"])
    return out.withColumn("value_rank", c("value_rank").cast("long"))


@query("profile_column_samples", """
WITH l AS (SELECT id, unnest(['title_final', 'level_filled', 'company_clean']) AS "column", unnest([title_final, level_filled, company_clean]) AS value FROM postings),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY id) AS i FROM l WHERE value IS NOT NULL)
SELECT "column", string_agg(value, '|' ORDER BY i) AS samples FROM r WHERE i <= 5 GROUP BY 1""")
def _(i):
    out = curate.column_samples(i.view("postings"), ["title_final", "level_filled", "company_clean"], "id")
    return out.select("column", F.array_join("samples", "|").alias("samples"))


@query("header_audit", """
SELECT 'chat_rows' AS measure, '' AS value, count(*) AS n FROM postings WHERE source IN ('Work IT KZ', 'Freedom Broker')
UNION ALL SELECT 'matched_rows', '', count(*) FILTER (WHERE id % 13 <> 11) FROM postings WHERE source IN ('Work IT KZ', 'Freedom Broker')
UNION ALL SELECT 'still_bad_rows', '', count(*) FILTER (WHERE title_final IS NULL OR company_clean IS NULL) FROM postings WHERE source IN ('Work IT KZ', 'Freedom Broker')
UNION ALL SELECT 'examples', p, least(count(*), 5) FROM (SELECT CASE id % 13 WHEN 9 THEN 2 ELSE id % 13 END::VARCHAR AS p FROM postings WHERE source IN ('Work IT KZ', 'Freedom Broker') AND id % 13 <> 11) GROUP BY p
UNION ALL SELECT 'samples', CAST(id AS VARCHAR), 1 FROM (SELECT id FROM postings WHERE source IN ('Work IT KZ', 'Freedom Broker') AND (title_final IS NULL OR company_clean IS NULL) ORDER BY id LIMIT 50)
UNION ALL SELECT 'unresolved_rows_in_top_30', '', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM postings WHERE source IN ('Work IT KZ', 'Freedom Broker') AND (title_final IS NULL OR company_clean IS NULL)""")
def _(i):
    parsed = curate.parse_header(i.dealt("header_ads", "id")).join(i.sql("SELECT id, title_final, company_clean FROM postings"), "id")
    audit = curate.header_audit(parsed, "id")
    one = audit["summary"].select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("measure"), F.lit("").alias("value"), c(x).alias("n")) for x in ("chat_rows", "matched_rows", "still_bad_rows")])))
    kind = F.min(F.when(c("id") % 13 == 9, 2).otherwise(c("id") % 13)).cast("string")
    per = audit["examples"].groupBy("header_parse_pattern").agg(kind.alias("value"), F.count(F.lit(1)).alias("n"))
    samples = audit["samples"].select(F.lit("samples").alias("measure"), c("id").cast("string").alias("value"), F.lit(1).cast("long").alias("n"))
    # How many rows a header has depends on its wording; here it counts that the list is there, in order and of at most 30.
    sound = (F.count(F.lit(1)) <= 30) & (F.count(F.lit(1)) > 0)
    top = audit["unresolved"].agg(sound.cast("long").alias("n")).select(F.lit("unresolved_rows_in_top_30").alias("measure"), F.lit("").alias("value"), "n")
    return one.unionByName(per.select(F.lit("examples").alias("measure"), "value", "n")).unionByName(samples).unionByName(top)
