"""Salary queries: every rule branch on texts derived from the postings, expected values stated as SQL."""

from pyspark.sql import functions as F

from postmill.functions import classify as k
from postmill.functions import money as m
from postmill.operators import salary as s
from postmill.plans.fixtures import FIXTURES
from postmill.plans.registry import query
from postmill.session import ensure_checkpoint_dir

c = F.col

# a and b are whole thousands that differ by posting; v is the rule branch a posting exercises.
FIXTURES["salary_base"] = """
SELECT id, source, company_clean, category_filled, level_filled, city_norm, title_final, posted_at, dedup_keep_for_analytics,
  100 + id % 400 AS a, 150 + id % 400 AS b, id % 18 AS v, salary_from_clean, salary_to_clean FROM postings
"""
FIXTURES["salary_ads"] = """
SELECT salary_base.*, CASE v
  WHEN 0 THEN a || ' 000 - ' || b || ' 000 тг' WHEN 1 THEN 'от ' || a || ' 000 тенге' WHEN 2 THEN 'до ' || a || ' 000 KZT'
  WHEN 3 THEN a || 'k - ' || b || 'k USD' WHEN 4 THEN '1 млн ' || a || ' тыс тенге' WHEN 5 THEN a || '-' || b || ' тыс тг'
  WHEN 6 THEN '$' || a || '0 per month' WHEN 7 THEN 'Контакты: +7 701 123 45 67' WHEN 8 THEN '1,' || a || '.50 EUR'
  WHEN 9 THEN '50 per hour, 300 per day USD' WHEN 10 THEN a || ' 000 тг, bonus 20 000, kpi 5 000' WHEN 11 THEN 'junior ' || a || ' 000 или senior ' || b || ' 000 тг'
  WHEN 12 THEN a || ' 000; ' || b || ' 000; 900 000 тг' WHEN 13 THEN '' WHEN 14 THEN NULL WHEN 15 THEN '20 млн тг' WHEN 16 THEN 'договорная' ELSE a || ' 000 ₽ в год' END AS salary_raw,
  CASE WHEN v = 14 THEN 'Ищем человека в команду. Зарплата: ' || a || ' 000 - ' || b || ' 000 тг на руки. Звоните' END AS description_clean_v2,
  CAST(NULL AS VARCHAR(10)) AS description,
  CASE WHEN v = 13 THEN 'KZT' END AS currency, CASE WHEN v = 13 THEN salary_from_clean WHEN v = 0 THEN a * 1000.0 WHEN v = 1 THEN 1.0 WHEN v = 16 THEN 0.0 END AS salary_from,
  CASE WHEN v = 13 THEN salary_to_clean WHEN v = 16 THEN 0.0 END AS salary_to
FROM salary_base
"""


def by_branch(values: dict[int, str], other: str = "NULL") -> str:
    return "CASE v " + " ".join(f"WHEN {k} THEN {x}" for k, x in values.items()) + f" ELSE {other} END"


SIMPLE_FROM = {0: "a * 1000", 1: "a * 1000", 3: "a", 4: "1", 5: "a", 6: "a * 10", 7: "77011234567", 8: "50", 9: "50", 10: "20000",
               11: "a * 1000", 12: "a * 1000", 15: "20", 17: "a * 1000"}
SIMPLE_TO = {0: "b * 1000", 2: "a * 1000", 3: "b", 4: "a", 5: "b", 8: "a", 9: "300", 10: "greatest(a * 1000, 20000)", 11: "b * 1000", 12: "b * 1000"}


@query("salary_text_simple", f"""
WITH x AS (SELECT id, v, a, b, CAST({by_branch(SIMPLE_FROM)} AS BIGINT) AS lo, CAST({by_branch(SIMPLE_TO)} AS BIGINT) AS hi,
  {by_branch({2: "'UNKNOWN'", 3: "'USD'", 6: "'USD'", 7: "'UNKNOWN'", 8: "'EUR'", 9: "'USD'", 13: "'UNKNOWN'", 14: "'UNKNOWN'", 16: "'UNKNOWN'", 17: "'UNKNOWN'"}, "'KZT'")} AS currency
  FROM salary_ads)
SELECT id, lo AS salary_from, hi AS salary_to, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE coalesce(lo, hi) END::DOUBLE AS salary_avg, currency FROM x""")
def _(i):
    out = i.dealt("salary_ads", "id").withColumn("s", k.salary_text_simple(c("salary_raw")))
    return out.select("id", c("s.from").alias("salary_from"), c("s.to").alias("salary_to"), c("s.avg").alias("salary_avg"), c("s.currency").alias("currency"))


@query("salary_average", """
SELECT id, CASE WHEN salary_from_clean IS NOT NULL AND salary_to_clean IS NOT NULL THEN (salary_from_clean + salary_to_clean) / 2
  ELSE coalesce(salary_from_clean, salary_to_clean) END AS salary_avg FROM postings""")
def _(i):
    return i.view("postings").select("id", k.average(c("salary_from_clean"), c("salary_to_clean")).alias("salary_avg"))


V1_FROM = {1: "a * 1000.0", 3: "a * 1000.0", 5: "least(a, b * 1000.0)", 6: "a * 10.0", 13: "salary_from_clean",
           17: "a * 1000.0"}
V1_TO = {3: "b * 1000.0", 5: "b * 1000.0", 13: "salary_to_clean"}
V1_QUALITY = {0: "'contact_leak'", 1: "'mixed_parsed_lower_bound'", 2: "'outlier_removed'", 3: "'parsed_range'", 5: "'parsed_range'", 6: "'parsed_single'",
              7: "'contact_leak'", 13: "CASE WHEN salary_from_clean IS NULL AND salary_to_clean IS NULL THEN 'missing' ELSE 'existing_numeric' END",
              14: "'contact_leak'", 15: "'outlier_removed'", 16: "'zero_only'", 17: "'parsed_single'"}


@query("salary_clean_v1", f"""
WITH x AS (SELECT id, v, {by_branch(V1_FROM)}::DOUBLE AS f, {by_branch(V1_TO)}::DOUBLE AS t, {by_branch(V1_QUALITY, "'missing'")} AS salary_parse_quality,
  {by_branch({3: "'USD'", 6: "'USD'", 7: "NULL", 8: "'EUR'", 9: "'USD'", 16: "NULL", 17: "NULL"}, "'KZT'")} AS currency_clean FROM salary_ads)
SELECT id, f AS salary_from_clean, t AS salary_to_clean, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN (f + t) / 2 ELSE coalesce(f, t) END AS salary_avg_clean,
  salary_parse_quality, currency_clean, v IN (0, 2, 7, 14, 15, 16) AS salary_is_suspicious, v IN (2, 15) AS salary_outlier_flag, v IN (0, 7, 14) AS salary_contact_leak_flag,
  v = 16 AS salary_zero_flag, v NOT IN (0, 2, 7, 14, 15) AND currency_clean IS NOT NULL AND (f IS NOT NULL OR t IS NOT NULL) AS salary_usable_for_analytics,
  {by_branch({0: "'contact_leak_detected'", 2: "'parsed_to_outlier_removed'", 7: "'contact_leak_detected'", 14: "'contact_leak_detected'", 15: "'parsed_from_outlier_removed'",
              16: "'zero_value'"}, "''")} AS fix_flags,
  CASE WHEN v = 13 THEN 'missing' WHEN v = 14 THEN 'description_keyword' ELSE 'salary_raw' END AS salary_parse_source FROM x""")
def _(i):
    out = s.salary_clean_v1(i.dealt("salary_ads", "id"))
    return out.select(
        "id", "salary_from_clean", "salary_to_clean", "salary_avg_clean", "salary_parse_quality", "currency_clean", "salary_is_suspicious", "salary_outlier_flag",
        "salary_contact_leak_flag", "salary_zero_flag", "salary_usable_for_analytics", F.array_join("salary_fix_flags", ",").alias("fix_flags"), "salary_parse_source")


TOKENS = {0: "a * 1000 || ',' || b * 1000", 1: "'' || a * 1000", 2: "'' || a * 1000", 3: "a * 1000 || ',' || b * 1000", 4: "'' || (1000000 + a * 1000)",
          5: "a * 1000 || ',' || b * 1000", 6: "'' || a * 10", 7: "''", 8: "(1000 + a) || '.5'", 9: "'50,300'", 10: "a * 1000 || ',20000,5000'",
          11: "a * 1000 || ',' || b * 1000", 12: "a * 1000 || ',' || b * 1000 || ',900000'", 13: "''", 15: "'20000000'", 16: "''", 17: "'' || a * 1000"}


@query("salary_amount_tokens", f"SELECT id, {by_branch(TOKENS)} AS amounts FROM salary_ads")
def _(i):
    values = F.transform(m.amount_tokens(c("salary_raw")), lambda t: F.regexp_replace(F.format_string("%.1f", t["value"]), "\\.0$", ""))
    return i.dealt("salary_ads", "id").select("id", F.when(c("salary_raw").isNotNull(), F.array_join(values, ",")).alias("amounts"))


@query("salary_candidate_text", r"""
SELECT doc_id, CASE WHEN v = 0 THEN 'pay ' || doc_id || ' USD net, remote' WHEN v = 1 THEN 'Зарплата ' || doc_id || ' тенге на руки'
    WHEN v = 2 THEN 'words here 500' || doc_id || ' usd bonus' ELSE '' END AS salary_text,
  CASE WHEN v = 0 THEN 'salary_raw' WHEN v = 1 THEN 'description_clean_v2_salary_keyword' WHEN v = 2 THEN 'description_currency_pattern' ELSE 'missing' END AS source
FROM (SELECT doc_id, doc_id % 4 AS v FROM documents)""")
def _(i):
    df = i.sql("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '  pay ' || doc_id || ' USD net,  remote. More text requirements: many' END AS salary_raw,
      CASE doc_id % 4 WHEN 1 THEN 'Some long opening words about us and the team. Зарплата ' || doc_id || ' тенге на руки. Next sentence 5.'
           WHEN 3 THEN 'The salary is discussed with every person at the interview, no figures.' END AS d1,
      CASE WHEN doc_id % 4 = 2 THEN 'words here 500' || doc_id || ' usd bonus' END AS d2 FROM documents""")
    out = df.withColumn("t", s.candidate_text_v3(c("salary_raw"), {"description_clean_v2": c("d1"), "description": c("d2")}))
    return out.select("doc_id", c("t.text").alias("salary_text"), c("t.source").alias("source"))


@query("salary_periods", f"""
SELECT id, {by_branch({6: "'month'", 9: "'hour,day'", 14: "NULL", 17: "'year'"}, "''")} AS periods FROM salary_ads""")
def _(i):
    return i.dealt("salary_ads", "id").select("id", F.when(c("salary_raw").isNotNull(), F.array_join(m.periods(c("salary_raw")), ",")).alias("periods"))


REVIEW = {7: "'contact_or_noise'", 9: "'mixed_salary_periods'", 10: "'base_salary_plus_bonus_mix'", 11: "'multi_variant_compensation'", 12: "'too_many_amounts'"}


@query("salary_review_class", f"SELECT id, {by_branch(REVIEW)} AS review_class, v IN (7, 9, 10, 11, 12) AS needs_review FROM salary_ads")
def _(i):
    df = i.dealt("salary_ads", "id").withColumns({"n": F.size(m.amount_tokens(c("salary_raw"))), "p": m.periods(c("salary_raw"))})
    out = df.withColumn("review_class", m.review_class(c("salary_raw"), c("n"), c("p")))
    return out.select("id", "review_class", c("review_class").isNotNull().alias("needs_review"))


V3_FROM = {0: "a * 1000", 3: "a * 1000", 4: "1000000 + a * 1000", 5: "a * 1000", 6: "a * 10", 8: "1000.5 + a", 14: "a * 1000", 17: "a * 1000",
           13: "salary_from_clean"}
V3_TO = {0: "b * 1000", 2: "a * 1000", 3: "b * 1000", 5: "b * 1000", 14: "b * 1000", 13: "salary_to_clean"}
V3_CTE = f"""
e AS (SELECT *, {by_branch(V3_FROM)}::DOUBLE AS f, {by_branch(V3_TO)}::DOUBLE AS t,
  {by_branch({3: "'USD'", 6: "'USD'", 7: "NULL", 8: "'EUR'", 9: "'USD'", 16: "NULL", 17: "'RUB'"}, "'KZT'")} AS cur, v IN (1, 7, 9, 10, 11, 12) AS review,
  {by_branch({**REVIEW, 1: "'source_conflict_major'"})} AS review_category, {by_branch({6: "'month'", 17: "'year'"})} AS period FROM salary_ads),
r AS (SELECT *, CASE WHEN review THEN 'manual_review_complex_v2' WHEN f IS NULL AND t IS NULL THEN 'missing' WHEN v = 13 THEN 'existing_numeric_v2'
    WHEN v = 2 THEN 'parsed_upper_bound_v2' WHEN v IN (4, 6, 8, 17) THEN 'parsed_single_v2' ELSE 'parsed_range_v2' END AS quality,
  NOT review AND v <> 17 AND cur IS NOT NULL AND (f IS NOT NULL OR t IS NOT NULL) AS usable FROM e)"""


@query("salary_repair_v3", f"""
WITH {V3_CTE.strip()}
SELECT id, f AS salary_from_clean, t AS salary_to_clean, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN (f + t) / 2 ELSE coalesce(f, t) END AS salary_avg_clean,
  cur AS currency_clean, quality AS salary_parse_quality, review OR v = 16 AS salary_is_suspicious, v = 7 AS salary_contact_leak_flag, v = 16 AS salary_zero_flag,
  usable AS salary_usable_for_analytics, CASE WHEN v = 1 THEN 'source_conflict_manual_review' WHEN review THEN 'manual_review_required' WHEN v = 16 THEN 'zero_value_removed' ELSE '' END AS fix_flags,
  CASE WHEN v = 13 THEN 'missing' WHEN v = 14 THEN 'description_clean_v2_salary_keyword' ELSE 'salary_raw' END AS salary_parse_source, period AS salary_period,
  CASE WHEN review THEN 'manual_review_queue' WHEN v = 13 AND (f IS NOT NULL OR t IS NOT NULL) THEN 'existing_numeric_fallback'
    WHEN f IS NULL AND t IS NULL THEN 'missing' ELSE 'text_parsed' END AS salary_source_basis_v2,
  v = 1 AS salary_source_conflict_flag, review AS salary_manual_review_flag, review_category AS salary_manual_review_category FROM r""")
def _(i):
    out = s.salary_repair_v3(i.dealt("salary_ads", "id"))
    return out.select(
        "id", "salary_from_clean", "salary_to_clean", "salary_avg_clean", "currency_clean", "salary_parse_quality", "salary_is_suspicious",
        "salary_contact_leak_flag", "salary_zero_flag", "salary_usable_for_analytics", F.array_join("salary_fix_flags", ",").alias("fix_flags"),
        "salary_parse_source", "salary_period", "salary_source_basis_v2", "salary_source_conflict_flag", "salary_manual_review_flag",
        "salary_manual_review_category")


def repaired(i):
    out = s.salary_repair_v3(i.dealt("salary_ads", "id"))
    return out.withColumn("usable_for_salary_analytics", c("salary_usable_for_analytics") & c("dedup_keep_for_analytics"))


@query("salary_marts", f"""
WITH {V3_CTE.strip()}
SELECT 'salary' AS mart, id, f AS salary_from_clean, quality AS salary_parse_quality, CAST(NULL AS VARCHAR) AS review_category FROM r WHERE usable AND dedup_keep_for_analytics
UNION ALL SELECT 'review', id, NULL, quality, review_category FROM r WHERE review""")
def _(i):
    # The repair runs once; each mart reads its rows.
    ensure_checkpoint_dir(i.spark)
    marts = ["id", "salary_from_clean", "salary_parse_quality", "salary_manual_review_category", "salary_manual_review_flag", "usable_for_salary_analytics"]
    df = repaired(i).select(*marts).checkpoint()
    null = F.lit(None)
    return s.salary_mart(df).select(
        F.lit("salary").alias("mart"), "id", "salary_from_clean", "salary_parse_quality", null.cast("string").alias("review_category")
    ).unionByName(s.review_mart(df.withColumn("salary_avg", null.cast("double"))).select(
        F.lit("review").alias("mart"), "id", null.cast("double").alias("salary_from_clean"), "salary_parse_quality",
        c("salary_manual_review_category").alias("review_category")))


@query("salary_repair_summary", f"""
WITH {V3_CTE.strip()}
SELECT 'rows' AS measure, '' AS value, count(*) AS n FROM r UNION ALL SELECT 'usable', '', count(*) FROM r WHERE usable AND dedup_keep_for_analytics
UNION ALL SELECT 'manual_review', '', count(*) FROM r WHERE review UNION ALL SELECT 'source_conflict', '', count(*) FROM r WHERE v = 1
UNION ALL SELECT 'period', coalesce(period, 'unknown'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'parse_quality', quality, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'review_category', coalesce(review_category, 'none'), count(*) FROM r GROUP BY 2""")
def _(i):
    return s.repair_summary(repaired(i))


@query("currency_normalize", """
SELECT id, CASE id % 12 WHEN 0 THEN 'KZT' WHEN 1 THEN 'KZT' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN 'RUB' WHEN 5 THEN 'KGS' WHEN 6 THEN NULL WHEN 7 THEN 'KZT'
    WHEN 8 THEN 'USD' WHEN 9 THEN NULL WHEN 10 THEN 'GBP' ELSE 'RUB' END AS with_fallback,
  CASE id % 12 WHEN 0 THEN 'KZT' WHEN 1 THEN '₸' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN 'RUB' WHEN 5 THEN 'KGS' WHEN 6 THEN 'UNKNOWN' WHEN 7 THEN 'UNKNOWN'
    WHEN 8 THEN 'UNKNOWN' WHEN 9 THEN 'BTC' WHEN 10 THEN '£' ELSE '₽' END AS exact_map FROM postings""")
def _(i):
    df = i.sql("""SELECT id, CASE id % 12 WHEN 0 THEN ' kzt ' WHEN 1 THEN '₸' WHEN 2 THEN '$' WHEN 3 THEN '€' WHEN 4 THEN 'rur' WHEN 5 THEN 'KGS' WHEN 6 THEN NULL WHEN 7 THEN ' '
      WHEN 8 THEN NULL WHEN 9 THEN 'btc' WHEN 10 THEN '£' ELSE '₽' END AS cur, CASE id % 12 WHEN 7 THEN '100 тенге' WHEN 8 THEN '5 usd' END AS txt FROM postings""")
    from postmill.functions.vocab import CURRENCY_WORDS_V3
    return df.select("id", k.currency(c("cur"), c("txt"), CURRENCY_WORDS_V3).alias("with_fallback"), k.currency_exact(c("cur")).alias("exact_map"))
