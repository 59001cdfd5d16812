"""Aggregation queries over the postings slices."""

from pyspark.sql import functions as F

from postmill.functions.vocab import WORK_FORMAT_ORDER
from postmill.operators import analytics as a
from postmill.plans.registry import query

CATS = ["data", "software_engineering", "qa", "analytics", "design"]
COVERAGE = "(SELECT count(*) FROM salary_rows) * 100.0 / (SELECT count(*) FROM structured_rows)"


def steady(df, *cols):
    """Interpolated values to six decimals: engines differ in the last bit."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def pct(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST({part} AS DOUBLE) / {total} * 100 ELSE 0.0 END"


COVER = pct("(SELECT count(*) FROM salary_rows)", "(SELECT count(*) FROM structured_rows)")


@query("agg_market_kpis", f"""
SELECT count(*) AS n_rows, count(DISTINCT nullif(company_clean, '')) AS n_companies,
  coalesce(avg(CASE WHEN work_format_norm IS NOT NULL THEN CASE WHEN work_format_norm = 'remote' THEN 1.0 ELSE 0.0 END END) * 100, 0.0) AS remote_pct,
  (SELECT quantile_cont(salary_avg_clean, 0.5) FROM salary_rows) AS median_salary,
  {COVER} AS salary_coverage_pct,
  (SELECT count(DISTINCT skill) FROM skill_rows WHERE skill_type = 'hard_skill' AND id IN (SELECT id FROM base_rows)) AS n_hard_skills
FROM base_rows""")
def _(i):
    hard = i.sql("SELECT id, skill FROM skill_rows WHERE skill_type = 'hard_skill'")
    return a.market_kpis(i.view("base_rows"), i.view("structured_rows"), i.view("salary_rows"), hard)


@query("agg_freshness", f"""
SELECT max(posted_at) AS latest, (SELECT count(*) FROM base_rows) AS n_base, {COVER} AS salary_coverage_pct FROM postings""")
def _(i):
    return a.freshness(i.view("postings"), i.view("structured_rows"), i.view("salary_rows"), i.view("base_rows"), "posted_at")


MAP_SQL = """
WITH c AS (SELECT category_filled, coalesce(nullif(level_filled, ''), 'level_unresolved') AS level_group, count(id) AS n_rows
  FROM category_rows WHERE category_filled <> '' GROUP BY 1, 2),
m AS (SELECT category_filled, coalesce(nullif(level_filled, ''), 'level_unresolved') AS level_group,
  quantile_cont(salary_avg_clean, 0.5) AS median_salary FROM salary_rows WHERE category_filled <> '' GROUP BY 1, 2)
SELECT c.category_filled, c.level_group, n_rows, median_salary FROM c LEFT JOIN m USING (category_filled, level_group)"""


@query("agg_category_level_map", MAP_SQL)
def _(i):
    return a.market_map(i.view("category_rows"), i.view("salary_rows"))


@query("join_counts_with_medians", MAP_SQL.replace("category_rows", "base_rows"))
def _(i):
    return a.market_map(i.view("base_rows"), i.view("salary_rows"))


CITY_SQL = "CASE WHEN lower(trim(city_norm)) IN ('almaty', 'astana') THEN lower(trim(city_norm)) ELSE 'other' END"


@query("agg_city_distribution", f"SELECT {CITY_SQL} AS city_group, count(*) AS n_rows FROM base_rows GROUP BY 1")
def _(i):
    return a.count_by(i.view("base_rows"), {"city_group": a.city_group(F.col("city_norm"))})


@query("agg_category_format_top15", """
WITH c AS (SELECT category_filled, work_format_norm, count(*) AS n_rows FROM category_rows WHERE category_filled <> '' GROUP BY 1, 2),
t AS (SELECT category_filled FROM c GROUP BY 1 ORDER BY sum(n_rows) DESC, 1 LIMIT 3)
SELECT * FROM c WHERE category_filled IN (SELECT category_filled FROM t)""")
def _(i):
    return a.category_format(i.view("category_rows"), 3)


@query("agg_level_city", f"SELECT level_filled, {CITY_SQL} AS city_group, count(*) AS n_rows FROM base_rows GROUP BY 1, 2")
def _(i):
    return a.count_by(i.view("base_rows"), {"level_filled": F.col("level_filled"), "city_group": a.city_group(F.col("city_norm"))})


@query("agg_pivot_share", """
SELECT category_filled,
  count(*) FILTER (WHERE work_format_norm = 'office') * 100.0 / count(*) AS pct_office,
  count(*) FILTER (WHERE work_format_norm = 'hybrid') * 100.0 / count(*) AS pct_hybrid,
  count(*) FILTER (WHERE work_format_norm = 'remote') * 100.0 / count(*) AS pct_remote
FROM category_rows WHERE category_filled <> '' AND work_format_norm IS NOT NULL GROUP BY 1""".replace(" * 100.0 / count(*)", "::DOUBLE / count(*) * 100"))
def _(i):
    return a.share_pivot(i.view("category_rows"), "category_filled", "work_format_norm", WORK_FORMAT_ORDER)


@query("agg_salary_vs_experience", """
SELECT id, experience_min, salary_avg_clean, category_filled, title_final, company_clean, city_norm, work_format_norm
FROM salary_rows WHERE salary_avg_clean IS NOT NULL AND experience_min IS NOT NULL""")
def _(i):
    return a.salary_points(i.view("salary_rows"))


PREMIUM_CTE = """p AS (SELECT category_filled,
  quantile_cont(salary_avg_clean, 0.5) FILTER (WHERE english_required) AS median_yes,
  quantile_cont(salary_avg_clean, 0.5) FILTER (WHERE NOT english_required) AS median_no
  FROM salary_rows WHERE category_filled IS NOT NULL GROUP BY 1),
q AS (SELECT *, (median_yes - median_no) / median_no * 100 AS premium_pct FROM p WHERE median_yes IS NOT NULL AND median_no > 0)"""


@query("agg_insights", f"""
WITH d AS (SELECT category_filled AS c, count(*) AS n FROM base_rows WHERE category_filled <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
b AS (SELECT category_filled AS c, quantile_cont(salary_avg_clean, 0.5) AS m FROM salary_rows WHERE category_filled <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
{PREMIUM_CTE},
k AS (SELECT category_filled AS c, premium_pct AS v FROM q ORDER BY premium_pct DESC, 1 LIMIT 1)
SELECT d.c AS top_category, d.n AS top_category_rows, b.c AS best_paid_category, b.m AS best_paid_median,
  k.c AS premium_category, k.v AS premium_pct FROM d, b, k""")
def _(i):
    return a.insights(i.view("base_rows"), i.view("salary_rows"))


@query("agg_salary_kpis", f"""
SELECT count(*) AS n_rows, count(DISTINCT nullif(currency_clean, '')) AS n_currencies,
  quantile_cont(salary_avg_clean, 0.5) AS median_salary, {COVER} AS salary_coverage_pct FROM salary_rows""")
def _(i):
    return a.salary_kpis(i.view("structured_rows"), i.view("salary_rows"))


@query("agg_salary_iqr", """
WITH s AS (SELECT category_filled, count(salary_avg_clean) AS n_values, round(quantile_cont(salary_avg_clean, 0.25), 6) AS q25,
  quantile_cont(salary_avg_clean, 0.5) AS median, round(quantile_cont(salary_avg_clean, 0.75), 6) AS q75
  FROM salary_rows WHERE category_filled <> '' GROUP BY 1)
SELECT *, median - (SELECT quantile_cont(salary_avg_clean, 0.5) FROM salary_rows) AS diff_vs_market,
  round(q75 - median, 6) AS error_plus, round(median - q25, 6) AS error_minus FROM s""")
def _(i):
    return steady(a.salary_iqr(i.view("salary_rows"), "category_filled"), "q25", "q75", "error_plus", "error_minus")


@query("agg_salary_box", """
SELECT coalesce(level_filled, '') AS level_filled, coalesce(city_norm, '') AS city_norm, count(salary_avg_clean) AS n_values,
  min(salary_avg_clean) AS v_min, round(quantile_cont(salary_avg_clean, 0.25), 6) AS q25, quantile_cont(salary_avg_clean, 0.5) AS median,
  round(quantile_cont(salary_avg_clean, 0.75), 6) AS q75, max(salary_avg_clean) AS v_max
FROM salary_rows WHERE category_filled = 'data' GROUP BY 1, 2""")
def _(i):
    rows = i.view("salary_rows").filter("category_filled = 'data'")
    return steady(a.five_numbers(rows, ["level_filled", "city_norm"], "salary_avg_clean"), "q25", "q75")


@query("agg_salary_heatmap", "SELECT level_filled, " + ", ".join(
    f"coalesce(quantile_cont(salary_avg_clean, 0.5) FILTER (WHERE category_filled = '{c}'), 0.0) AS m_{c}" for c in CATS
) + " FROM salary_rows WHERE level_filled <> '' AND category_filled <> '' GROUP BY 1")
def _(i):
    return a.median_pivot(i.view("salary_rows"), "level_filled", "category_filled", CATS, "salary_avg_clean")


@query("agg_premium_flag", f"WITH {PREMIUM_CTE} SELECT * FROM q")
def _(i):
    return a.premium(i.view("salary_rows"), "category_filled", F.col("english_required"), "salary_avg_clean")


REMOTE_SQL = """
WITH p AS (SELECT category_filled,
  quantile_cont(salary_avg_clean, 0.5) FILTER (WHERE work_format_norm = 'remote') AS median_yes,
  quantile_cont(salary_avg_clean, 0.5) FILTER (WHERE work_format_norm = 'office') AS median_no
  FROM salary_rows WHERE category_filled IS NOT NULL GROUP BY 1)
SELECT *, (median_yes - median_no) / median_no * 100 AS premium_pct FROM p WHERE median_yes IS NOT NULL AND median_no > 0"""


@query("agg_premium_remote", REMOTE_SQL)
def _(i):
    rows = i.view("salary_rows").filter("work_format_norm IN ('remote', 'office')")
    return a.premium(rows, "category_filled", F.col("work_format_norm") == "remote", "salary_avg_clean")


@query("join_aligned_groups", REMOTE_SQL.replace("category_filled", "city_norm"))
def _(i):
    rows = i.view("salary_rows").filter("work_format_norm IN ('remote', 'office')")
    return a.premium(rows, "city_norm", F.col("work_format_norm") == "remote", "salary_avg_clean")


@query("agg_salary_benchmark", f"""
SELECT category_filled, level_filled, count(salary_avg_clean) AS n_values, round(quantile_cont(salary_avg_clean, 0.25), 6) AS q25,
  quantile_cont(salary_avg_clean, 0.5) AS median, round(quantile_cont(salary_avg_clean, 0.75), 6) AS q75, {COVER} AS salary_coverage_pct
FROM salary_rows WHERE category_filled IS NOT NULL AND level_filled IS NOT NULL GROUP BY 1, 2""")
def _(i):
    return steady(a.benchmark(i.view("structured_rows"), i.view("salary_rows")), "q25", "q75")


@query("agg_role_salary", """
SELECT count(salary_avg_clean) AS n_values, quantile_cont(salary_avg_clean, 0.5) AS median_salary FROM salary_rows
WHERE category_filled = 'data' AND level_filled = 'senior' AND city_norm = 'almaty'""")
def _(i):
    return a.role_median(i.view("salary_rows"), "data", "senior", "almaty")


@query("agg_market_salary", """
SELECT category_filled, CAST(trunc(quantile_cont(salary_avg_clean, 0.5)) AS BIGINT) AS market_avg, count(*) AS n_rows
FROM postings WHERE usable_for_salary_analytics AND salary_avg_clean > 0 AND category_filled IS NOT NULL GROUP BY 1""")
def _(i):
    return a.market_salary(i.view("postings"))


FAMILY_SQL = """CASE WHEN regexp_matches(lower(skill), 'python|java|go|scala|c#|php|sql|javascript|typescript') THEN 'language'
  WHEN regexp_matches(lower(skill), 'react|vue|angular|django|flask|spring|fastapi|laravel') THEN 'framework'
  WHEN regexp_matches(lower(skill), 'docker|kubernetes|aws|azure|gcp|terraform|airflow|jenkins') THEN 'cloud_devops'
  WHEN regexp_matches(lower(skill), 'power bi|tableau|looker|superset|excel|etl|dbt') THEN 'analytics_bi' ELSE 'other' END"""


@query("agg_skill_stats", f"""
SELECT skill, CAST(count(*) AS BIGINT) AS demand, count(DISTINCT id) AS n_postings,
  quantile_cont(CASE WHEN source IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs') AND usable_for_salary_analytics THEN salary_avg_clean END, 0.5) AS median_salary,
  {FAMILY_SQL} AS skill_family
FROM posting_skills JOIN skill_usable_rows USING (id) GROUP BY skill HAVING count(*) >= 10""")
def _(i):
    rows = i.sql("""SELECT id, CASE WHEN source IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs') AND usable_for_salary_analytics
                    THEN salary_avg_clean END AS salary_avg_analytics FROM skill_usable_rows""")
    return a.skill_stats(rows, i.view("posting_skills"), "salary_avg_analytics", 10)


DEMAND = "SELECT skill, count(*) AS n_rows FROM posting_skills JOIN skill_usable_rows USING (id) GROUP BY 1"


@query("agg_skill_top30", f"{DEMAND} ORDER BY 2 DESC, 1 LIMIT 30")
def _(i):
    return a.top_values(i.sql("SELECT skill FROM posting_skills JOIN skill_usable_rows ON posting_skills.id = skill_usable_rows.id"), "skill", 30)


@query("rank_global_top20", f"""
WITH d AS ({DEMAND}), r AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, skill) AS rn FROM d)
SELECT skill, n_rows, CASE WHEN rn <= 20 THEN skill ELSE '' END AS label FROM r""")
def _(i):
    rows = i.sql("SELECT skill FROM posting_skills JOIN skill_usable_rows ON posting_skills.id = skill_usable_rows.id")
    return a.label_top(a.count_by(rows, {"skill": F.col("skill")}), "skill", "n_rows", 20)


@query("agg_skill_cooccurrence", """
WITH t AS (SELECT skill FROM posting_skills GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15),
s AS (SELECT DISTINCT id, skill FROM posting_skills WHERE skill IN (SELECT skill FROM t))
SELECT l.skill AS l, r.skill AS r, count(*) AS n_postings FROM s AS l JOIN s AS r ON l.id = r.id GROUP BY 1, 2""")
def _(i):
    return a.cooccurrence(i.view("posting_skills"), 15)


@query("agg_skill_levels", """
SELECT level_filled, count(DISTINCT id) AS n_postings FROM skill_usable_rows
WHERE level_filled IS NOT NULL AND id IN (SELECT id FROM posting_skills WHERE skill = 'red gear') GROUP BY 1""")
def _(i):
    return a.skill_levels(i.view("skill_usable_rows"), i.view("posting_skills"), "red gear")


@query("agg_soft_skill_cloud", """
SELECT skill, count(*) AS n_rows FROM skill_rows JOIN skill_usable_rows USING (id) WHERE skill_type = 'soft_skill' GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 24""")
def _(i):
    rows = i.sql("""SELECT skill FROM skill_rows JOIN skill_usable_rows ON skill_rows.id = skill_usable_rows.id
                    WHERE skill_type = 'soft_skill'""")
    return a.top_values(rows, "skill", 24)


@query("agg_stack_by_level", """
WITH c AS (SELECT skill, level_filled, count(DISTINCT id) AS n_postings FROM skill_rows JOIN skill_usable_rows USING (id)
  WHERE skill_type = 'tech_stack' AND category_filled = 'data' AND level_filled IS NOT NULL GROUP BY 1, 2),
t AS (SELECT skill FROM c GROUP BY 1 ORDER BY sum(n_postings) DESC, 1 LIMIT 12)
SELECT * FROM c WHERE skill IN (SELECT skill FROM t)""")
def _(i):
    stack = i.sql("SELECT id, skill FROM skill_rows WHERE skill_type = 'tech_stack'")
    return a.stack_levels(i.view("skill_usable_rows"), stack, "data", 12)


@query("agg_skill_vocabulary", "SELECT skill, count(*) AS n_mentions FROM skill_rows GROUP BY 1")
def _(i):
    return a.vocabulary(i.view("skill_rows"))


@query("agg_role_top_skills", """
SELECT skill, count(*) AS n_mentions FROM posting_skills JOIN skill_usable_rows USING (id)
WHERE category_filled = 'qa' AND level_filled = 'junior' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(i):
    return a.role_skills(i.view("skill_usable_rows"), i.view("posting_skills"), "qa", "junior", 20)


@query("agg_missing_skill_stats", """
WITH m AS (SELECT DISTINCT skill FROM posting_skills WHERE skill LIKE 'new %' OR skill LIKE '% ring'),
r AS (SELECT s.skill, s.id, p.salary_avg_clean FROM posting_skills s JOIN skill_usable_rows p ON s.id = p.id
  WHERE category_filled = 'data' AND level_filled = 'senior')
SELECT m.skill, count(DISTINCT r.id) AS demand, quantile_cont(r.salary_avg_clean, 0.5) AS median_salary
FROM m LEFT JOIN r ON m.skill = r.skill GROUP BY 1""")
def _(i):
    missing = i.sql("SELECT DISTINCT skill FROM posting_skills WHERE skill LIKE 'new %' OR skill LIKE '% ring'")
    return a.gap_stats(i.view("skill_usable_rows"), i.view("posting_skills"), missing, "data", "senior", "salary_avg_clean")


@query("agg_company_summary", """
WITH t AS (SELECT company_clean, count(id) AS n_postings FROM employer_rows WHERE company_clean <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
sc AS (SELECT id, count(*) AS skills_count FROM posting_skills GROUP BY 1),
m AS (SELECT e.*, coalesce(skills_count, 0) AS k FROM employer_rows e JOIN t USING (company_clean) LEFT JOIN sc USING (id)),
f AS (SELECT company_clean, title_final, min(id) AS f FROM m WHERE title_final <> '' GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY company_clean ORDER BY f) AS rn FROM f),
o AS (SELECT company_clean, string_agg(title_final, ', ' ORDER BY f) AS open_roles FROM g WHERE rn <= 4 GROUP BY 1),
a AS (SELECT company_clean, count(*) AS n_postings, CAST(sum(k) AS DOUBLE) / count(*) AS avg_skills,
  quantile_cont(salary_avg_clean, 0.5) AS median_salary FROM m GROUP BY 1)
SELECT a.company_clean, n_postings, avg_skills, median_salary, open_roles FROM a LEFT JOIN o USING (company_clean)""")
def _(i):
    counts = i.sql("SELECT id, count(*) AS skills_count FROM posting_skills GROUP BY id")
    return a.company_summary(i.view("employer_rows"), counts, "salary_avg_clean", 20)


@query("agg_company_kpis", f"""
WITH c AS (SELECT company_clean, count(*) AS n FROM employer_rows WHERE company_clean <> '' GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS n_companies, (SELECT count(*) FROM c WHERE n >= 2) AS n_hiring,
  {pct("(SELECT count(salary_avg_clean) FROM employer_rows)", "(SELECT count(*) FROM base_rows)")} AS salary_coverage_pct,
  {pct("(SELECT count(*) FROM employer_rows WHERE work_format_norm = 'remote')", "(SELECT count(*) FROM employer_rows)")} AS remote_share_all_rows_pct""")
def _(i):
    return a.company_kpis(i.view("base_rows"), i.view("employer_rows"), "salary_avg_clean")


TOP12 = "(SELECT company_clean FROM employer_rows WHERE company_clean <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12)"


@query("agg_company_category_pivot", "SELECT company_clean, " + ", ".join(
    f"count(*) FILTER (WHERE category_filled = '{c}') AS n_{c}" for c in CATS
) + f" FROM employer_rows WHERE category_filled IS NOT NULL AND company_clean IN {TOP12} GROUP BY 1")
def _(i):
    return a.company_pivot(i.view("employer_rows"), "category_filled", CATS, 12)


@query("agg_company_format_mix", f"""
SELECT company_clean, work_format_norm, count(*) AS n_rows FROM employer_rows
WHERE work_format_norm IS NOT NULL AND company_clean IN {TOP12} GROUP BY 1, 2""")
def _(i):
    return a.company_mix(i.view("employer_rows"), "work_format_norm", 12)


@query("agg_coverage", f"""
SELECT source, count(*) AS n_total, count(salary_avg_clean) AS n_part, {pct("count(salary_avg_clean)", "count(*)")} AS coverage_pct
FROM postings GROUP BY 1""")
def _(i):
    counts = i.view("postings").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_total"), F.count("salary_avg_clean").alias("n_part")
    )
    return counts.withColumn("coverage_pct", a.percent(F.col("n_part"), F.col("n_total")))


@query("safe_ratio", f"""
SELECT level_filled, {pct("count(*) FILTER (WHERE quality_tier = 'A')", "count(*) FILTER (WHERE quality_tier = 'D')")} AS ratio_pct
FROM postings GROUP BY 1""")
def _(i):
    tiers = i.view("postings").groupBy("level_filled").agg(
        F.count(F.when(F.col("quality_tier") == "A", 1)).alias("a"), F.count(F.when(F.col("quality_tier") == "D", 1)).alias("d")
    )
    return tiers.select("level_filled", a.percent(F.col("a"), F.col("d")).alias("ratio_pct"))


@query("join_topn_semi", """
SELECT id, company_clean, salary_avg_clean FROM base_rows WHERE company_clean IN (
  SELECT company_clean FROM base_rows WHERE company_clean IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12)""")
def _(i):
    rows = i.view("base_rows").filter("company_clean IS NOT NULL")
    return a.restrict_top(rows, "company_clean", 12).select("id", "company_clean", "salary_avg_clean")


@query("topk_values", "SELECT title_final, count(*) AS n_rows FROM postings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(i):
    return a.top_values(i.view("postings"), "title_final", 10)


@query("duplicate_overview", """
WITH k AS (SELECT doc_id, lang, source, md5(trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-zа-яё]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM documents),
f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY 1)
SELECT lang, source, count(*) AS n_rows, count(*) FILTER (WHERE doc_id <> first_doc) AS n_duplicates,
  CAST(count(*) FILTER (WHERE doc_id = first_doc) AS DOUBLE) / count(*) * 100 AS kept_pct
FROM k JOIN f USING (h) GROUP BY 1, 2""")
def _(i):
    """Flagship: normalise, fingerprint, flag repeats, then rows, repeats and share kept per language and source."""
    from postmill.functions.text import normalize_key
    from postmill.operators.spread import flag_repeats

    keyed = i.table("documents").select("doc_id", "lang", "source", F.md5(normalize_key(F.col("text"))).alias("h"))
    flagged = flag_repeats(keyed, ["h"], "doc_id")
    return flagged.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("is_duplicate"), 1)).alias("n_duplicates"),
        a.percent(F.count(F.when(~F.col("is_duplicate"), 1)), F.count(F.lit(1))).alias("kept_pct"),
    )
