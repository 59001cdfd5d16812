"""Rule extraction, external extraction records, reconciliation and merge, on posts derived from the postings."""

from pyspark.sql import functions as F

from postmill.operators import extraction as e
from postmill.plans.fixtures import FIXTURES
from postmill.plans.registry import ORACLES, query
from postmill.session import ensure_checkpoint_dir

c = F.col
NL = "' || chr(10) || '"

# One chat post per posting (six kinds) and the record an external extractor gave for it.
FIXTURES["chat_ads"] = f"""
SELECT id, source, v, n, CASE v
  WHEN 0 THEN 'Компания: Acme ' || n || '{NL}Город: Алматы{NL}Формат: удаленный/гибрид{NL}Занятость: полная{NL}Зарплата: до ' || n || ' 000 тг{NL}Опыт: от 2 лет'
  WHEN 1 THEN 'Ищем Backend Developer, remote, full time, ' || (n % 9 + 1) || '+ years of Python, salary ' || n || '0 USD. English B2'
  WHEN 2 THEN 'Город: Астана{NL}Company: Beta ' || n WHEN 3 THEN 'Salary: 700000 - ' || n || '000 тг' WHEN 4 THEN 'Занятость: стажировка{NL}Опыт: 1-3 года'
  ELSE 'Обычный текст без полей' END AS text,
  '{{"id":"' || id || '","company":' || CASE v WHEN 2 THEN '"beta ' || n || '"' WHEN 1 THEN '"  "' ELSE 'null' END || ',"city":' || CASE v WHEN 2 THEN '"almaty"' WHEN 1 THEN '"Remote"' ELSE 'null' END
  || ',"employment":"' || CASE v WHEN 1 THEN 'Full Time' WHEN 4 THEN 'internship' ELSE 'unknown' END || '","work_format":"' || CASE v WHEN 1 THEN 'remote' WHEN 5 THEN 'moon' ELSE 'unknown' END
  || '","salary_from":' || CASE v WHEN 1 THEN '"' || (n * 10) || '"' WHEN 3 THEN '900000' ELSE 'null' END || ',"salary_to":' || CASE v WHEN 3 THEN '' || (n * 1000) ELSE 'null' END
  || ',"currency":"' || CASE v WHEN 1 THEN 'usd' WHEN 3 THEN 'KZT' ELSE 'BYN' END || '","salary_raw":' || CASE v WHEN 1 THEN '"not specified"' ELSE 'null' END
  || ',"experience_min":' || CASE v WHEN 1 THEN '5' ELSE 'null' END || ',"experience_max":' || CASE v WHEN 1 THEN '3' ELSE 'null' END
  || ',"category":"' || CASE v WHEN 0 THEN 'Back-end Developer' WHEN 1 THEN 'backend' WHEN 2 THEN 'R&D' WHEN 3 THEN '' WHEN 4 THEN 'Data Scientist' ELSE 'poetry' END
  || '","title_normalized":' || CASE v WHEN 5 THEN 'null' ELSE '"Dev  ' || v || '"' END || ',"level":"' || CASE v WHEN 4 THEN 'Senior' WHEN 5 THEN 'boss' ELSE 'lead' END
  || '","hard_skills":' || CASE v WHEN 1 THEN '["k8s","K8S","js","unknown"]' ELSE '[]' END || ',"english_mention":' || CASE v WHEN 1 THEN 'true' WHEN 5 THEN 'false' ELSE 'null' END
  || ',"english_required":' || CASE v WHEN 5 THEN 'true' ELSE 'null' END || ',"english_level":"' || CASE v WHEN 1 THEN 'Upper-Intermediate' WHEN 5 THEN 'C2' ELSE '' END
  || '","requirements_clean":' || CASE v WHEN 1 THEN '"Strong Python and SQL needed here"' ELSE 'null' END || ',"salary_period":"' || CASE v WHEN 0 THEN 'месяц' WHEN 1 THEN 'yearly' ELSE '' END
  || '","llm_confidence":' || CASE v WHEN 0 THEN '0.5' WHEN 1 THEN '7' WHEN 2 THEN '-1' ELSE '"x"' END || '}}' || CASE WHEN v = 5 AND n % 2 = 0 THEN ' broken' ELSE '' END AS record
FROM (SELECT id, source, id % 6 AS v, 100 + id % 400 AS n FROM postings)
"""


def m(values: dict[int, str], other: str = "NULL") -> str:
    return "CASE v " + " ".join(f"WHEN {k} THEN {x}" for k, x in values.items()) + f" ELSE {other} END"


PREFILL_EXPECTED = {
    "company": m({0: "'Acme ' || n", 2: "'Beta ' || n"}), "city": m({0: "'almaty'", 2: "'astana'"}),
    "employment": m({0: "'full_time'", 1: "'full_time'", 4: "'internship'"}), "work_format": m({0: "'hybrid'", 1: "'remote'"}),
    "salary_raw": m({0: "'до ' || n || ' 000 тг'", 1: "'salary ' || n || '0 USD. English B2'", 3: "'700000 - ' || n || '000 тг'"}),
    "salary_from": m({1: "'' || (n * 10)", 3: "'' || least(700000, n * 1000)"}), "salary_to": m({0: "'' || n || '000'", 3: "'' || greatest(700000, n * 1000)"}),
    "currency": m({0: "'KZT'", 1: "'USD'", 3: "'KZT'"}), "experience_min": m({0: "'2.0'", 4: "'1.0'"}),
    "experience_max": m({4: "'3.0'"}),
}
HIGH = {"company": "0, 2", "city": "0, 2", "employment": "0, 4", "work_format": "0", "salary_raw": "0, 3", "salary_from": "3", "salary_to": "0, 3", "currency": "0, 3", "experience_min": "0", "experience_max": ""}


@query("prefill_extract", "SELECT id, " + ", ".join(f"{x} AS {f}" for f, x in PREFILL_EXPECTED.items()) + ", " + ", ".join(
    f"CASE WHEN {x} IS NULL THEN 'missing' WHEN v IN ({HIGH[f] or '-1'}) THEN 'high_confidence' ELSE 'medium_confidence' END AS {f}_conf" for f, x in PREFILL_EXPECTED.items()
    if f not in ("experience_max", "experience_min")) + " FROM chat_ads")
def _(i):
    out = e.prefill(i.dealt("chat_ads", "id"), "text")
    return out.select("id", *[c("prefill")[f]["value"].alias(f) for f in PREFILL_EXPECTED],
                      *[c("prefill")[f]["confidence"].alias(f"{f}_conf") for f in PREFILL_EXPECTED if not f.startswith("experience")])


CHECKED = {
    "title_normalized": m({5: "NULL"}, "'Dev ' || v"), "company": m({2: "'beta ' || n"}), "city": m({1: "'Remote'", 2: "'almaty'"}),
    "category": m({0: "'software_engineering'", 1: "'software_engineering'", 2: "'other'", 3: "'unknown'", 4: "'data'"}, "'other'"),
    "level": m({4: "'senior'", 5: "'unknown'"}, "'lead'"), "employment": m({1: "'full_time'", 4: "'internship'"}, "'unknown'"), "work_format": m({1: "'remote'"}, "'unknown'"),
    "salary_from": m({1: "n * 10", 3: "least(900000, n * 1000)"}), "salary_to": m({3: "greatest(900000, n * 1000)"}), "currency": m({1: "'USD'", 3: "'KZT'"}, "'unknown'"),
    "experience_min": m({1: "3.0::DOUBLE"}), "experience_max": m({1: "5.0::DOUBLE"}), "english_level": m({1: "'b2'", 5: "'c2'"}, "'unknown'"),
    "salary_period": m({0: "'month'", 1: "'year'"}, "'unknown'"), "llm_confidence": m({0: "0.5::DOUBLE", 1: "1.0::DOUBLE"}, "0.0::DOUBLE"), "salary_raw": "CAST(NULL AS VARCHAR)",
}
WHOLE = "NOT (v = 5 AND n % 2 = 0)"


@query("extraction_validate", "SELECT id, " + ", ".join(f"{x} AS {f}" for f, x in CHECKED.items()) + f""", {m({1: "'k8s|js'"}, "''")} AS hard_skills, true AS extraction_ok
FROM chat_ads WHERE {WHOLE} UNION ALL SELECT id, {', '.join('NULL' for _ in CHECKED)}, NULL, false FROM chat_ads WHERE NOT ({WHOLE})""")
def _(i):
    out = e.validate_extraction(i.dealt("chat_ads", "id"), "record")
    ok = c("extraction_ok")
    return out.select("id", *[F.when(ok, c(f"extraction.{f}")).alias(f) for f in CHECKED],
                      F.when(ok, F.array_join("extraction.hard_skills", "|")).alias("hard_skills"), "extraction_ok")


def checked(i):
    """Records the strict schema accepts."""
    return e.validate_extraction(i.dealt("chat_ads", "id"), "record").filter("extraction_ok")


@query("extraction_sanitize", f"""
SELECT id, {m({1: "'remote'", 2: "'almaty'"})} AS city, {m({1: "'Kubernetes|JavaScript'"}, "''")} AS hard_skills,
  {m({1: "n || '0 USD'", 3: "'700000 - ' || n || '000 тг'"})} AS salary_raw FROM chat_ads WHERE {WHOLE}""")
def _(i):
    out = e.sanitize(checked(i), "text")
    return out.select("id", c("extraction.city").alias("city"), F.array_join("extraction.hard_skills", "|").alias("hard_skills"), c("extraction.salary_raw").alias("salary_raw"))


def sanitized(i):
    return e.sanitize(checked(i), "text")


def reconciled(clean):
    return e.reconcile(e.prefill(clean, "text"))


@query("reconcile_fields", f"""
SELECT id, {m({0: "'Acme ' || n", 2: "'beta ' || n"}).replace("'beta '", "'Beta '")} AS company, {m({0: "'almaty'", 1: "'remote'", 2: "'astana'"})} AS city, {m({0: "'rule_label'", 2: "'rule_label'"}, "'missing'")} AS company_source,
  {m({0: "'normalized_label'", 1: "'llm_semantic'", 2: "'normalized_label'"}, "'missing'")} AS city_source, {m({1: "'parser_confirmed_by_llm'", 0: "'normalized_label'", 4: "'normalized_label'"}, "'missing'")} AS employment_source,
  {m({1: "'high_confidence'", 0: "'high_confidence'", 4: "'high_confidence'"}, "'missing'")} AS employment_conf, {m({2: "'city'", 1: "'salary_raw'"}, "''")} AS conflicts
FROM chat_ads WHERE {WHOLE} AND v <> 3
UNION ALL SELECT id, NULL, NULL, 'missing', 'missing', 'missing', 'missing', CASE WHEN n * 1000 = 700000 THEN 'salary_to' WHEN n * 1000 < 700000 THEN 'salary_to' ELSE 'salary_from,salary_to' END FROM chat_ads WHERE v = 3""")
def _(i):
    out = reconciled(sanitized(i))
    return out.select("id", c("final_values")["company"].alias("company"), c("final_values")["city"].alias("city"), c("final_sources")["company"].alias("company_source"),
                      c("final_sources")["city"].alias("city_source"), c("final_sources")["employment"].alias("employment_source"),
                      c("final_confidence")["employment"].alias("employment_conf"), F.array_join("conflict_flags", ",").alias("conflicts"))


@query("validate_record", f"""
SELECT id, {m({0: "'almaty'", 1: "'remote'", 2: "'astana'"})} AS city, {m({0: "'full_time'", 1: "'full_time'", 4: "'internship'"}, "'unknown'")} AS employment, {m({5: "NULL", 1: "'b2'"}, "'unknown'")} AS english_level,
  {m({5: "false"})} AS english_required, {m({4: "'internship_level_review'", 5: "'english_level_reset_without_mention,english_required_reset_without_mention'"}, "''")} AS fixes,
  {m({4: "'internship_level_consistency'", 2: "'city'", 1: "'salary_raw'", 3: "'salary_to'"}, "''")} AS review_flags FROM chat_ads WHERE {WHOLE}""")
def _(i):
    out = e.validate_record(e.final_record(reconciled(sanitized(i))))
    return out.select("id", "city", "employment", "english_level", "english_required", F.array_join("validation_fixes", ",").alias("fixes"), F.array_join("review_flags", ",").alias("review_flags"))


@query("extraction_confidence", f"""
WITH s AS (SELECT id, v, source NOT IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs') AS chat FROM chat_ads WHERE {WHOLE})
SELECT id, round({m({0: "0.06 + 0.14 + 0.07 + 0.08 + 0.5 * 0.03", 1: "0.15 + 0.14 + 0.07 + 0.08 + 0.04 + CASE WHEN chat THEN 0.03 ELSE 0 END + 0.05 + 0.05 + 0.10 + 0.10 + 0.04 + 0.04 + 0.04 + 0.03",
  2: "0.10 + 0.14 + 0.07 + 0.08 + 0.06 + 0.04 + CASE WHEN chat THEN 0.07 ELSE 0 END", 3: "0.06 + 0.07 + 0.08 + 0.04 - 0.12", 4: "0.08 + 0.14 + 0.07 + 0.08 + 0.05", 5: "0.04 + 0.14 + 0.04 - 0.12"})}, 4)::DOUBLE AS extraction_confidence,
  CAST({m({0: "3", 1: "11", 2: "5", 3: "3", 4: "4", 5: "2"})} AS BIGINT) AS signal_count, CAST({m({0: "2", 1: "4", 2: "3", 3: "1", 4: "2", 5: "1"})} AS BIGINT) AS major_signal_count FROM s""")
def _(i):
    out = e.confidence(e.sanitize(checked(i), "text"))
    return out.select("id", "extraction_confidence", "signal_count", "major_signal_count")


def merged(i, clean):
    base = e.confidence(clean).join(i.sql(
        """SELECT id, CASE WHEN id % 4 = 0 THEN 'unknown' ELSE company_clean END AS company, city_norm AS city, CASE WHEN id % 2 = 0 THEN category_filled END AS category,
           CAST(NULL AS STRING) AS title_normalized, CAST(salary_from_clean AS BIGINT) AS salary_from, CAST(NULL AS BIGINT) AS salary_to, CAST(NULL AS ARRAY<STRING>) AS hard_skills,
           '' AS extraction_method, 0.2 AS llm_confidence FROM postings"""), "id")
    return e.merge_if_missing(base)


FIXTURES["merge_base"] = """
SELECT chat_ads.*, CASE WHEN id % 4 = 0 THEN 'unknown' ELSE company_clean END AS b_company, city_norm AS b_city, CASE WHEN id % 2 = 0 THEN category_filled END AS b_category,
  CAST(salary_from_clean AS BIGINT) AS b_from FROM chat_ads JOIN (SELECT id AS pid, company_clean, city_norm, category_filled, salary_from_clean FROM postings) b ON chat_ads.id = b.pid
"""


@query("merge_if_missing", f"""
WITH f AS (SELECT *, v = 2 AND (b_company IS NULL OR b_company = 'unknown') AS m_company, v IN (1, 2) AND b_city IS NULL AS m_city, v <> 3 AND b_category IS NULL AS m_category,
    v <> 5 AS m_title, v IN (1, 3) AND b_from IS NULL AS m_from, v = 3 AS m_to, v = 1 AS m_hard FROM merge_base WHERE {WHOLE})
SELECT id, CASE WHEN m_company THEN 'beta ' || n ELSE b_company END AS company, CASE WHEN m_city THEN {m({1: "'remote'", 2: "'almaty'"})} ELSE b_city END AS city,
  CASE WHEN m_from THEN {m({1: "n * 10", 3: "least(900000, n * 1000)"})} ELSE b_from END AS salary_from, concat_ws(',', CASE WHEN m_category THEN 'category' END, CASE WHEN m_city THEN 'city' END,
    CASE WHEN m_company THEN 'company' END, CASE WHEN m_hard THEN 'hard_skills' END, CASE WHEN m_from THEN 'salary_from' END, CASE WHEN m_to THEN 'salary_to' END, CASE WHEN m_title THEN 'title_normalized' END) AS merged_fields,
  CASE WHEN NOT (m_category OR m_city OR m_company OR m_hard OR m_from OR m_to OR m_title) THEN 'no_missing_targets' WHEN v = 1 THEN 'auto_merged' ELSE 'merged_with_review' END AS llm_merge_status
FROM f""")
def _(i):
    return merged(i, sanitized(i)).select("id", "company", "city", "salary_from", F.array_join("merged_fields", ",").alias("merged_fields"), "llm_merge_status")


@query("join_patch", """
SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND l.quality IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS lang, coalesce(l.toxic, NULL) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.doc_id % 3 <> 0 OR l.quality IS NOT NULL UNION ALL SELECT d.doc_id, 'unknown', NULL FROM documents d WHERE d.doc_id % 3 = 0 AND d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(i):
    base = i.sql("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END AS lang, CAST(NULL AS INT) AS toxic FROM documents")
    ext = i.sql("SELECT doc_id, 'q' || quality AS lang, toxic FROM labels")
    return e.fill_from(base, ext, "doc_id", ["lang", "toxic"])


@query("row_diff_patch", """
SELECT d.doc_id, CASE WHEN quality <> 1 THEN 'q0' END AS source, CASE WHEN toxic = 1 THEN '{"v":1}' END AS flag FROM documents d JOIN labels l USING (doc_id) WHERE quality <> 1 OR toxic = 1""")
def _(i):
    before = i.sql("SELECT doc_id, source, 0 AS flag FROM documents")
    after = i.sql("SELECT documents.doc_id, CASE WHEN quality <> 1 THEN 'q0' ELSE source END AS source, coalesce(toxic, 0) AS flag FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
    return e.row_diff(before, after, "doc_id", ["source", "flag"]).select("doc_id", c("patch")["source"].alias("source"), c("patch")["flag"].alias("flag"))


CHAT = "source NOT IN ('hh_kz', 'kaspi_jobs', 'kolesa_jobs')"
COVERED = "round(100.0 * count(*) FILTER (WHERE coalesce(trim(lower({x})), '') NOT IN ('', 'unknown', 'nan', 'none', 'null', '[]')) / count(*), 2)"
PARSED = [f for f in PREFILL_EXPECTED if not f.startswith("experience")]


@query("enrichment_report", f"""
WITH r AS (SELECT id, company, city, conflicts FROM ({ORACLES['reconcile_fields']})),
mm AS (SELECT id, company, city, llm_merge_status AS status FROM ({ORACLES['merge_if_missing']})),
a AS (SELECT mm.*, ads.source, r.company AS r_company, r.city AS r_city, r.conflicts FROM mm JOIN r USING (id) JOIN chat_ads ads USING (id)),
p AS (SELECT {', '.join(f"{PREFILL_EXPECTED[f]} AS {f}" for f in PARSED)} FROM chat_ads WHERE {WHOLE} AND {CHAT})
""" + " UNION ALL ".join([
    *[f"SELECT 'coverage_before' AS section, '{x}' AS measure, {COVERED.format(x=y)}::DOUBLE AS value FROM postings" for x, y in (("company", "company_clean"), ("city", "city_norm"))],
    *[f"SELECT 'coverage_after', '{x}', {COVERED.format(x=x)}::DOUBLE FROM a" for x in ("company", "city")],
    "SELECT 'status', status, count(*)::DOUBLE FROM a GROUP BY 2",
    "SELECT 'processed_per_source', source, count(*)::DOUBLE FROM a GROUP BY 2",
    "SELECT 'merged_per_source', source, count(*)::DOUBLE FROM a WHERE status <> 'no_missing_targets' GROUP BY 2",
    "SELECT 'conflicts', f, count(*)::DOUBLE FROM (SELECT unnest(string_split(conflicts, ',')) AS f FROM a WHERE conflicts <> '') GROUP BY 2",
    "SELECT 'failure', 'share', 0.0::DOUBLE", "SELECT 'failure', 'alarm', 0.0::DOUBLE",
    *[f"SELECT 'parser_hits', '{f}', round(100.0 * count({f}) / count(*), 6)::DOUBLE FROM p" for f in PARSED],
    *[f"SELECT 'final_hits', '{x}', round(100.0 * count(r_{x}) FILTER (WHERE r_{x} <> 'unknown') / count(*), 6)::DOUBLE FROM a" for x in ("company", "city")],
]))
def _(i):
    before = i.sql("SELECT id, company_clean AS company, city_norm AS city FROM postings")
    # Every rule chain runs once: both branches read the checked records, and the report reads their rows several times.
    ensure_checkpoint_dir(i.spark)
    clean = sanitized(i).select("id", "source", "text", "extraction").checkpoint()
    after = merged(i, clean).join(reconciled(clean).select("id", "conflict_flags", "prefill", "final_values"), "id")
    after = after.select("id", "company", "city", "source", "llm_merge_status", "conflict_flags", "prefill", "final_values").checkpoint()
    chat = ~c("source").isin("hh_kz", "kaspi_jobs", "kolesa_jobs")
    filled = lambda x: x.isNotNull() & (x != "unknown")
    out = e.enrichment_report(before, after, ["company", "city"], hits={
        "parser_hits": (chat, {f: c("prefill")[f]["confidence"] != "missing" for f in PARSED}),
        "final_hits": (F.lit(True), {x: filled(c("final_values")[x]) for x in ("company", "city")})})
    return out.select("section", "measure", F.when(c("section").startswith("coverage"), F.round("value", 2)).otherwise(F.round("value", 6)).alias("value"))
