"""Views over the test tables, in SQL that Spark and DuckDB both run.

They give the base tables the roles of postings, skills, candidates, chat rows
and so on. Every view covers whole tables; nothing is cut or sampled.
"""

base_tables = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES: dict[str, str] = {}

# Postings with the curated columns; nulls and blanks appear in every facet.
FIXTURES["postings"] = """
SELECT o_orderkey AS id,
  CASE r_name WHEN 'ASIA' THEN 'hh_kz' WHEN 'EUROPE' THEN 'kaspi_jobs' WHEN 'AMERICA' THEN 'kolesa_jobs'
              WHEN 'AFRICA' THEN 'Work IT KZ' ELSE 'Freedom Broker' END AS source,
  CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'Data Engineer'
       WHEN o_orderkey % 3 = 1 THEN 'Backend Developer ' || substr(c_mktsegment, 1, 4)
       ELSE 'Analyst ' || substr(o_orderpriority, 3) END AS title_final,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE c_name END AS company_clean,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN n_nationkey % 4 = 0 THEN 'almaty' WHEN n_nationkey % 4 = 1 THEN 'astana'
       WHEN n_nationkey % 4 = 2 THEN 'remote' ELSE 'shymkent' END AS city_norm,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'data' WHEN 'BUILDING' THEN 'software_engineering' WHEN 'FURNITURE' THEN 'qa'
       WHEN 'HOUSEHOLD' THEN 'analytics' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'design' END END AS category_filled,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'middle' WHEN '3-MEDIUM' THEN 'junior'
       WHEN '5-LOW' THEN 'intern' END AS level_filled,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'office' WHEN o_orderstatus = 'F' THEN 'remote'
       ELSE 'hybrid' END AS work_format_norm,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS salary_avg_clean,
  CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice * 0.8) END AS salary_from_clean,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice * 1.2) END AS salary_to_clean,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'KZT' END AS currency_clean,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 8 END AS experience_min,
  (o_custkey % 2 = 0) AS english_required,
  CASE WHEN o_orderkey % 10 < 3 THEN 'A' WHEN o_orderkey % 10 < 6 THEN 'B' WHEN o_orderkey % 10 < 8 THEN 'C' ELSE 'D' END AS quality_tier,
  (o_orderkey % 11 <> 0) AS dedup_keep_for_analytics,
  (o_orderkey % 11 <> 0 AND o_orderkey % 6 <> 0) AS usable_for_salary_analytics,
  (o_orderkey % 11 <> 0 AND o_orderkey % 12 <> 0) AS usable_for_skill_analytics,
  (o_orderkey % 11 <> 0 AND o_orderkey % 29 <> 0) AS usable_for_employer_analytics,
  (o_orderkey % 11 <> 0 AND NOT (c_mktsegment = 'MACHINERY' AND o_orderkey % 2 = 1)) AS usable_for_category_analytics,
  o_orderdate AS posted_at
FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

FIXTURES["posting_skills"] = """
SELECT DISTINCT l_orderkey AS id, p_name AS skill FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# One row per posting, skill and list kind: hard = widgets and gears, soft = rods, the rest is the tech stack.
FIXTURES["skill_rows"] = """
SELECT id, skill,
  CASE WHEN skill LIKE '%widget' OR skill LIKE '%gear' OR skill LIKE '%gizmo' THEN 'hard_skill'
       WHEN skill LIKE '%rod' THEN 'soft_skill' ELSE 'tech_stack' END AS skill_type
FROM posting_skills
"""

FIXTURES["base_rows"] = "SELECT * FROM postings WHERE dedup_keep_for_analytics"
FIXTURES["structured_rows"] = """
SELECT * FROM base_rows WHERE source IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs')
"""
FIXTURES["salary_rows"] = """
SELECT * FROM postings WHERE usable_for_salary_analytics AND source IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs')
"""
FIXTURES["skill_usable_rows"] = "SELECT * FROM postings WHERE usable_for_skill_analytics"
FIXTURES["employer_rows"] = "SELECT * FROM postings WHERE usable_for_employer_analytics"
FIXTURES["category_rows"] = "SELECT * FROM postings WHERE usable_for_category_analytics"

# One candidate per customer; the skills are those of the customer's own orders.
FIXTURES["candidate_skills"] = """
SELECT DISTINCT o_custkey AS cand_id, skill FROM posting_skills JOIN orders ON posting_skills.id = o_orderkey
"""
