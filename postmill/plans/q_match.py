"""Vocabulary, matching, gap and résumé queries."""

from pyspark.sql import functions as F

from postmill.operators import matching as m
from postmill.plans.fixtures import FIXTURES
from postmill.plans.registry import query

c = F.col

# Words of the documents as a vocabulary: every word of the part names, and two-word names found in document text.
FIXTURES["doc_vocab"] = """
SELECT skill, count(*) AS n_mentions FROM (
  SELECT substr(p_name, 1, strpos(p_name, ' ') - 1) AS skill FROM part UNION ALL SELECT p_name FROM part
  UNION ALL SELECT 'the' FROM part UNION ALL SELECT 'for the' FROM part UNION ALL SELECT 'elle un' FROM part UNION ALL SELECT 'Für' FROM part
  UNION ALL SELECT 'of the' FROM part UNION ALL SELECT 'an' FROM part UNION ALL SELECT 'nicht' FROM part) GROUP BY skill
"""

# Two spellings of the functions Spark and DuckDB name differently are avoided: strpos exists only in DuckDB.
FIXTURES["doc_vocab"] = FIXTURES["doc_vocab"].replace("strpos(p_name, ' ')", "position(' ' IN p_name)")

W = r"[\p{L}\p{N}_]"


@query("match_vocab_text", rf"""
WITH k AS (SELECT lower(trim(skill)) AS key, skill FROM doc_vocab WHERE length(skill) > 2 OR lower(skill) IN ('ai','bi','ci','ml','nlp','qa','ui','ux','go','c#','c++','1c','hr')),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
h AS (SELECT doc_id, skill, key FROM w JOIN k ON word = regexp_extract(key, '[\p{{L}}\p{{N}}_]+') JOIN documents USING (doc_id) WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(key) || '($|[^\p{{L}}\p{{N}}_])')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, key) AS hit_no FROM h)
SELECT doc_id, skill, hit_no FROM r""")
def _(i):
    out = m.find_skills(i.dealt("documents", "doc_id"), "doc_id", "text", i.view("doc_vocab"))
    return out.withColumn("hit_no", c("hit_no").cast("long"))


@query("resume_summary", rf"""
WITH k AS (SELECT lower(trim(skill)) AS key, skill FROM doc_vocab WHERE length(skill) > 2),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
h AS (SELECT doc_id, string_agg(skill, '|' ORDER BY length(key) DESC, key) AS s FROM w JOIN k ON word = regexp_extract(key, '[\p{{L}}\p{{N}}_]+') JOIN documents USING (doc_id)
  WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(key) || '($|[^\p{{L}}\p{{N}}_])') GROUP BY 1),
d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, coalesce(s, '') AS skills, try_cast(nullif(regexp_extract(t, '(?i)(\d+)\+?\s*(?:years|year|лет|года|год)', 1), '') AS BIGINT) AS years_experience,
  CASE WHEN regexp_matches(lower(t), 'lead|head|руковод') THEN 'lead' WHEN regexp_matches(lower(t), 'senior|старш|sr\.') THEN 'senior'
    WHEN regexp_matches(lower(t), 'middle|mid-level|mid ') THEN 'middle' WHEN regexp_matches(lower(t), 'intern|стаж|trainee') THEN 'intern' ELSE 'junior' END AS current_level,
  upper(nullif(regexp_extract(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(a1|a2|b1|b2|c1|c2)(?:$|[^\p{{L}}\p{{N}}_])', 1), '')) AS english_level, md5(substr(t, 1, 400)) AS preview_md5
FROM d LEFT JOIN h USING (doc_id)""")
def _(i):
    out = m.resume_summary(i.sql("SELECT doc_id, text FROM documents"), "doc_id", "text", i.view("doc_vocab"))
    return out.select("doc_id", F.array_join("skills", "|").alias("skills"), "years_experience", "current_level", "english_level", F.md5("preview").alias("preview_md5"))


MATCH_SQL = """
WITH ov AS (SELECT cand_id, id, count(*) AS o FROM {cs} c JOIN posting_skills USING (skill) {pj} GROUP BY 1, 2),
cn AS (SELECT cand_id, count(*) AS n FROM candidate_skills GROUP BY 1), pn AS (SELECT id, count(*) AS n FROM posting_skills GROUP BY 1),
base AS (SELECT p.id, salary_avg_clean, coalesce(pn.n, 0) AS skills_count, {part} AS part FROM {rows} p LEFT JOIN pn USING (id) WHERE {part} IS NOT NULL),
cand AS ({cands}),
best0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY salary_avg_clean DESC NULLS LAST, skills_count DESC, id) AS rn FROM base) WHERE rn <= {n2}),
s AS (SELECT cand.cand_id, cand.part, base.id, o * 1.0::DOUBLE / (cn.n + base.skills_count - o) AS score, salary_avg_clean, skills_count
  FROM cand JOIN ov USING (cand_id) JOIN base ON ov.id = base.id AND base.part = cand.part JOIN cn ON cn.cand_id = cand.cand_id
  UNION ALL SELECT cand.cand_id, cand.part, b.id, 0.0::DOUBLE, b.salary_avg_clean, b.skills_count FROM cand JOIN best0 b USING (part)
  WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.cand_id = cand.cand_id AND ov.id = b.id)),
r AS (SELECT *, row_number() OVER (PARTITION BY cand_id, part ORDER BY score DESC, salary_avg_clean DESC NULLS LAST, skills_count DESC, id) AS match_no FROM s)
SELECT r.cand_id, r.part, r.id, score, salary_avg_clean, skills_count, match_no,
  (SELECT coalesce(string_agg(skill, '|' ORDER BY skill), '') FROM posting_skills ps WHERE ps.id = r.id AND skill IN (SELECT skill FROM candidate_skills x WHERE x.cand_id = r.cand_id)) AS matched,
  (SELECT count(*) FROM posting_skills ps WHERE ps.id = r.id AND skill NOT IN (SELECT skill FROM candidate_skills x WHERE x.cand_id = r.cand_id)) AS n_missing
FROM r WHERE match_no <= {n}"""


def shown(df):
    return df.select("cand_id", "part", "id", "score", "salary_avg_clean", "skills_count", "match_no",
                     F.array_join("matched_skills", "|").alias("matched"), F.size("missing_skills").cast("long").alias("n_missing"))


@query("match_candidates", MATCH_SQL.format(
    cs="candidate_skills", pj="", part="''", rows="base_rows", cands="SELECT DISTINCT o_custkey AS cand_id, '' AS part FROM orders", n=5, n2=10))
def _(i):
    cands = i.sql("SELECT DISTINCT o_custkey AS cand_id FROM orders")
    return shown(m.match(cands, i.view("candidate_skills"), i.view("base_rows"), i.view("posting_skills"), 5))


@query("topk_by_role", MATCH_SQL.format(
    cs="candidate_skills", pj="", part="category_filled", rows="base_rows", n=5, n2=10,
    cands="SELECT DISTINCT o_custkey AS cand_id, role AS part FROM orders, (VALUES ('data'), ('qa')) t(role) WHERE o_orderstatus <> 'O' OR role = 'data'"))
def _(i):
    cands = i.sql("SELECT DISTINCT o_custkey AS cand_id, explode(CASE WHEN o_orderstatus <> 'O' THEN array('data', 'qa') ELSE array('data') END) AS role FROM orders")
    return shown(m.match(cands, i.view("candidate_skills"), i.view("base_rows"), i.view("posting_skills"), 5, "role", "category_filled"))


@query("match_filtered", MATCH_SQL.format(
    cs="candidate_skills", pj="", part="''", n=5, n2=10, cands="SELECT DISTINCT o_custkey AS cand_id, '' AS part FROM orders",
    rows="(SELECT * FROM base_rows WHERE level_filled = 'middle' AND city_norm = 'almaty' AND work_format_norm = 'hybrid' AND (salary_avg_clean IS NULL OR salary_avg_clean >= 200000))"))
def _(i):
    cands = i.sql("SELECT DISTINCT o_custkey AS cand_id FROM orders")
    wanted = m.narrow_postings(i.view("base_rows"), level="middle", city="almaty", work_format="hybrid", salary_min=200_000)
    return shown(m.match(cands, i.view("candidate_skills"), wanted, i.view("posting_skills"), 5))


# Each customer's skills against the 20 most wanted skills of the category its account falls in.
FIXTURES["role_targets"] = """
SELECT category_filled, skill FROM (SELECT category_filled, skill, row_number() OVER (PARTITION BY category_filled ORDER BY count(*) DESC, skill) AS rn
  FROM posting_skills JOIN skill_usable_rows ON posting_skills.id = skill_usable_rows.id WHERE category_filled IS NOT NULL GROUP BY category_filled, skill) WHERE rn <= 20
"""
FIXTURES["customer_roles"] = """
SELECT c_custkey AS cand_id, CASE c_custkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'qa' WHEN 2 THEN 'design' ELSE 'analytics' END AS role FROM customer
"""


def gaps(i):
    have = i.view("candidate_skills").groupBy("cand_id").agg(F.sort_array(F.collect_set(F.upper("skill"))).alias("have"))
    want = i.view("role_targets").groupBy("category_filled").agg(F.sort_array(F.collect_set("skill")).alias("want"))
    df = i.view("customer_roles").join(have, "cand_id", "left").join(want.withColumnRenamed("category_filled", "role"), "role", "left")
    return m.skill_gap(df.withColumn("have", F.coalesce("have", F.array().cast("array<string>"))), "have", "want")


GAP_SQL = """
WITH g AS (SELECT r.cand_id, t.skill, EXISTS (SELECT 1 FROM candidate_skills x WHERE x.cand_id = r.cand_id AND x.skill = t.skill) AS has
  FROM customer_roles r JOIN role_targets t ON r.role = t.category_filled),
m AS (SELECT cand_id, coalesce(string_agg(CASE WHEN has THEN skill END, '|' ORDER BY skill), '') AS matched,
  coalesce(string_agg(CASE WHEN NOT has THEN skill END, '|' ORDER BY skill), '') AS missing, CAST(count(*) FILTER (WHERE has) AS DOUBLE) / count(*) * 100 AS gap_score FROM g GROUP BY 1),
e AS (SELECT r.cand_id, string_agg(upper(x.skill), '|' ORDER BY x.skill) AS extra FROM customer_roles r JOIN candidate_skills x USING (cand_id)
  WHERE x.skill NOT IN (SELECT skill FROM role_targets t WHERE t.category_filled = r.role) GROUP BY 1)"""


@query("skill_gap_sets", GAP_SQL + " SELECT m.*, coalesce(extra, '') AS extra FROM m LEFT JOIN e USING (cand_id)")
def _(i):
    return gaps(i).select("cand_id", *[F.array_join(x, "|").alias(x) for x in ("matched", "missing", "extra")], "gap_score")


@query("resume_notes", GAP_SQL + """,
n AS (SELECT cand_id, CASE WHEN missing <> '' THEN 'Add explicit evidence for these market-critical skills: ' || array_to_string(string_split(missing, '|')[1:8], ', ') || '.' END AS a,
  CASE WHEN matched <> '' THEN 'Prominently surface matched skills near the top of the resume: ' || array_to_string(string_split(matched, '|')[1:8], ', ') || '.' END AS b,
  CASE WHEN gap_score < 50 THEN 'The current profile sits below the median market-fit threshold for this target. Strengthen both core tools and delivery outcomes.' END AS c FROM m)
SELECT cand_id, concat_ws('#', a, b, c, 'Convert generic responsibility bullets into quantified impact statements with tools, scale, and business results.') AS notes FROM n""")
def _(i):
    return m.resume_notes(gaps(i), "missing", "matched", "gap_score").select("cand_id", F.array_join("notes", "#").alias("notes"))


@query("salary_position", """
WITH k AS (SELECT category_filled, quantile_cont(salary_avg_clean, 0.5) AS market FROM salary_rows WHERE category_filled IS NOT NULL GROUP BY 1)
SELECT p.id, CASE WHEN salary_from_clean IS NULL OR market IS NULL OR salary_from_clean = 0 THEN 'unknown' WHEN salary_from_clean < market * 0.9 THEN 'below'
  WHEN salary_from_clean > market * 1.1 THEN 'above' ELSE 'at' END AS status FROM postings p LEFT JOIN k ON p.category_filled = k.category_filled""")
def _(i):
    from postmill.operators.spread import exact_median
    market = exact_median(i.view("salary_rows").filter("category_filled IS NOT NULL"), ["category_filled"], "salary_avg_clean", "market")
    both = i.sql("SELECT id, category_filled, salary_from_clean FROM postings").join(market.select("category_filled", "market"), "category_filled", "left")
    return both.select("id", m.salary_position(c("salary_from_clean"), c("market")).alias("status"))


@query("fallback_token_skills", r"""
SELECT doc_id, len(f) AS n_items, md5(array_to_string(f, '|')) AS items_md5 FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;/\n]'), lambda x: trim(regexp_replace(x, '[\s\x{a0}]+', ' ', 'g'))), lambda x: x <> '') AS f FROM documents)""")
def _(i):
    out = i.table("documents").select("doc_id", m.token_skills(c("text")).alias("f"))
    return out.select("doc_id", F.size("f").cast("long").alias("n_items"), F.md5(F.array_join("f", "|")).alias("items_md5"))
