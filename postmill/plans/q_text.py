"""Text column jobs: on documents and pages as they are, and on posting texts derived from the tables."""

from pyspark.sql import functions as F

from postmill.functions import classify as k
from postmill.functions import text as x
from postmill.functions import titles as t
from postmill.functions.lists import parse_list
from postmill.operators import curate
from postmill.plans.fixtures import FIXTURES
from postmill.plans.q_rows import sq
from postmill.plans.q_sources import links_sql
from postmill.plans.registry import query
from postmill.sources import unify

c = F.col
NORM = r"trim(regexp_replace(lower({x}), '[^0-9a-zа-яё]+', ' ', 'g'))"
HASH = r"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-zа-я0-9]+', ' ', 'g'))"


def case(expr: str, values: dict[int, str], other: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {q(y)}" for i, y in values.items()) + f" ELSE {q(other)} END"


def q(value: str | None) -> str:
    """SQL literal; NULL and expressions in braces stay as they are."""
    if value is None or value == "NULL":
        return "NULL"
    return value[1:-1] if value.startswith("{") else "'" + value.replace("'", "''") + "'"


def branches(expr: str, rows: list[tuple[str, str]]) -> tuple[str, str]:
    """(input CASE, expected CASE) of a list of (text, expected value) pairs."""
    n = f"({expr}) % {len(rows)}"
    return case(n, dict(enumerate(r[0] for r in rows))), case(n, dict(enumerate(r[1] for r in rows)))


CLEAN_HTML = r"nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', ''''), '&nbsp;', ' '), '[\s\x{{a0}}]+', ' ', 'g')), '')".replace('\\"', '"')


@query("text_clean_html", f"SELECT page_id, length({CLEAN_HTML.format(x='html')}) AS n, md5({CLEAN_HTML.format(x='html')}) AS h FROM pages")
def _(i):
    return i.table("pages").withColumn("t", x.clean_html(c("html"))).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


@query("text_normalize_key", f"SELECT doc_id, md5({NORM.format(x='text')}) AS h FROM documents")
def _(i):
    return i.table("documents").select("doc_id", F.md5(x.normalize_key(c("text"))).alias("h"))


@query("text_hash_fingerprint", f"""
SELECT doc_id, md5(concat_ws(' | ', {HASH.format(x="'Title ' || lang")}, {HASH.format(x='source')}, 'almaty', {HASH.format(x='text')})) AS duplicate_hash FROM documents""")
def _(i):
    return i.table("documents").select("doc_id", unify.fingerprint(
        F.concat(F.lit("Title "), c("lang")), c("source"), F.lit("Almaty!"), c("text")).alias("duplicate_hash"))


@query("text_md5_key", f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'none' ELSE md5({NORM.format(x='text')}) END AS text_key FROM documents")
def _(i):
    return i.table("documents").select("doc_id", curate.text_key(c("text")).alias("text_key"))


U = r"[\p{L}\p{N}_]"
NU = r"[^\p{L}\p{N}_]"
CLEAN_STEPS = [
    (r"<[^>]+>", " "), (r"(?i)https?://\S+|www\.\S+|t\.me/\S+|telegram\.me/\S+", " "),
    (r"[\p{L}\p{N}_.+%-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}", " "), (rf"(^|{NU})@{U}{{3,}}", r"\1 "), (rf"(^|{NU})#[\p{{L}}\p{{N}}_-]+", r"\1 "),
]


@query("text_clean_description")
def _(i):
    """Checked on fixed texts in the tests: the look-behind rules have no equal in the checking dialect."""
    out = i.dealt("documents", "doc_id").withColumn("d", t.clean_description(c("text")))
    return out.select("doc_id", F.md5("d.text").alias("h"), "d.changed", "d.length", "d.removed")


@query("url_to_id", r"""
SELECT page_id, CASE WHEN v = 0 THEN CAST(page_id * 7 AS VARCHAR) WHEN v = 1 THEN 'dev-' || page_id || 'x' ELSE 'kolesa_' || substr(md5(lower(url)), 1, 12) END AS url_id
FROM (SELECT page_id, url, page_id % 3 AS v FROM pages)""")
def _(i):
    df = i.sql("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://x.example/vacancy/dev-' || (page_id * 7) || '/?a=1' WHEN 1 THEN 'https://x.example/vacancy/dev-' || page_id || 'x?b=2'
      ELSE url END AS url FROM pages""")
    # Page addresses hold no dash followed by digits, so the third kind always takes the hash.
    return df.select("page_id", k.url_id(F.regexp_replace(c("url"), "^$", " "), "kolesa").alias("url_id"))


@query("list_parse_dedupe", """
SELECT id, 'sql|Python ' || (id % 9) || '|' || title_final || '|x-y' AS items FROM postings WHERE title_final <> ''
UNION ALL SELECT id, 'sql|Python ' || (id % 9) || '|x-y' FROM postings WHERE title_final = ''""")
def _(i):
    df = i.sql("SELECT id, ' sql - ; Python ' || (id % 9) || '|SQL,' || title_final || '/' || lower(title_final) || ';; - x-y -' AS raw FROM postings")
    return df.select("id", F.array_join(x.split_list(c("raw")), "|").alias("items"))


LISTS = [
    ('["SQL", "sql", " Py ", ""]', "SQL|Py"), ("['A b', \"C\", 'a B']", "A b|C"), ("x, Y , x,,z", "x|Y|z"), ("", ""), ("NaN", ""), ('"one"', "one"), ("[]", ""), ("NULL", "{CAST(NULL AS VARCHAR)}"),
]
LIST_IN, LIST_OUT = branches("id", LISTS)


@query("list_parse_json_lenient", f"SELECT id, coalesce({LIST_OUT}, '') AS items FROM postings")
def _(i):
    return i.sql(f"SELECT id, {LIST_IN} AS raw FROM postings").select("id", F.array_join(parse_list(c("raw")), "|").alias("items"))


CITIES = [("г. Алматы, центр", "almaty"), ("ALMATY", "almaty"), ("Нур-Султан", "astana"), ("Astana city", "astana"), ("Удаленно", "remote"), ("Шымкент", "other"),
          ("unknown", "NULL"), ("", "NULL"), ("NULL", "NULL"), ("Remote / KZ", "remote")]
CITY_IN, CITY_OUT = branches("id", CITIES)


@query("city_normalize", f"SELECT id, {CITY_OUT} AS city FROM postings")
def _(i):
    return i.sql(f"SELECT id, {CITY_IN} AS raw FROM postings").select("id", k.city(c("raw")).alias("city"))


@query("work_format_infer", """
SELECT doc_id, CASE WHEN regexp_matches(l, 'гибрид|hybrid') THEN 'hybrid' WHEN regexp_matches(l, 'удален|remote|дистанцион|home office|work from home') THEN 'remote'
  WHEN regexp_matches(l, 'офис|office|onsite|on-site|на месте') THEN 'office' ELSE 'unknown' END AS work_format
FROM (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' Work From  Home' WHEN 1 THEN ' ОФИС и гибрид' WHEN 2 THEN ' on-site' ELSE '' END) AS l FROM documents)""".replace("From  Home", "From Home"))
def _(i):
    df = i.sql("SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'Work From  Home' WHEN 1 THEN 'ОФИС и гибрид' WHEN 2 THEN 'on-site' END AS extra FROM documents")
    return df.select("doc_id", k.work_format_infer(c("text"), c("extra")).alias("work_format"))


EMPLOY = [("Full Time", "full_time"), ("part-time", "part_time"), ("Freelance", "contract"), ("intern", "internship"), ("temporary", "temporary"), ("зп", "NULL"), ("unknown", "NULL"), ("NULL", "NULL")]
EMPLOY_TEXT = [("Полная занятость", "full_time"), ("part time ok", "part_time"), ("a Contractor", "contract"), ("Стажировка", "internship"), ("временная", "temporary"), ("pet project", "contract"), ("x", "NULL")]
EM_IN, EM_OUT = branches("id", EMPLOY)
ET_IN, ET_OUT = branches("id", EMPLOY_TEXT)


@query("employment_normalize", f"SELECT id, {EM_OUT} AS field_value, {ET_OUT} AS text_value FROM postings")
def _(i):
    df = i.sql(f"SELECT id, {EM_IN} AS a, {ET_IN} AS b FROM postings")
    return df.select("id", k.employment(c("a")).alias("field_value"), k.employment_text(c("b")).alias("text_value"))


CATEGORY = [("Backend", "software_engineering"), ("data analyst", "analytics"), ("ML-Engineer", "data"), ("QA", "qa"), ("Product Manager", "product"), ("zzz", "NULL"), ("n/a", "NULL"), ("NULL", "NULL")]
LEVEL = [("Mid", "middle"), ("Middle+", "middle"), ("middle plus", "NULL"), ("SR", "senior"), ("head", "manager"), ("Lead", "lead"), ("none", "NULL")]
ENGLISH = [("B2", "b2"), ("c1 ", "c1"), ("not required", "not_required"), ("Fluent", "NULL"), ("NULL", "NULL")]
CA_IN, CA_OUT = branches("id", CATEGORY)
LE_IN, LE_OUT = branches("id", LEVEL)
EN_IN, EN_OUT = branches("id", ENGLISH)


@query("category_normalize", f"SELECT id, {CA_OUT} AS value FROM postings")
def _(i):
    return i.sql(f"SELECT id, {CA_IN} AS raw FROM postings").select("id", k.category(c("raw")).alias("value"))


@query("level_normalize", f"SELECT id, {LE_OUT} AS value FROM postings")
def _(i):
    return i.sql(f"SELECT id, {LE_IN} AS raw FROM postings").select("id", k.level(c("raw")).alias("value"))


@query("english_normalize", f"SELECT id, {EN_OUT} AS value FROM postings")
def _(i):
    return i.sql(f"SELECT id, {EN_IN} AS raw FROM postings").select("id", k.english_level(c("raw")).alias("value"))


EXPERIENCE = [
    ("Нет опыта", "0/0"), ("{'более ' || (id % 9) || ' лет'}", "{(id % 9) || '/-'}"), ("{'от ' || (id % 5) || ' до 7 лет'}", "{(id % 5) || '/7'}"), ("{(id % 6) || '–3 года'}", "{least(id % 6, 3) || '/' || greatest(id % 6, 3)}"),
    ("{'до ' || (id % 8) || ' лет'}", "{'0/' || (id % 8)}"), ("{'Опыт ' || (id % 4) || ' years'}", "{(id % 4) || '/' || (id % 4)}"), ("{'2-' || (3 + id % 4)}", "{'2/' || (3 + id % 4)}"), ("60 лет", "-/-"), ("x", "-/-"),
    ("от 4 лет", "4/-"), ("more than 2 years", "2/-"), ("NULL", "-/-"),
]
EX_IN, EX_OUT = branches("id", EXPERIENCE)


@query("experience_extract", f"SELECT id, {EX_OUT} AS years FROM postings")
def _(i):
    df = i.sql(f"SELECT id, {EX_IN} AS raw FROM postings").withColumn("e", k.experience(c("raw")))
    shown = lambda y: F.coalesce(y.cast("string"), F.lit("-"))
    return df.select("id", F.concat(shown(c("e.min")), F.lit("/"), shown(c("e.max"))).alias("years"))


@query("english_extract", """
SELECT doc_id, m AS mention, m AND regexp_matches(l, 'required|требуется|must have|обязательно') AS required,
  CASE WHEN contains(l, 'c2') THEN 'C2' WHEN contains(l, 'c1') THEN 'C1' WHEN contains(l, 'b2') THEN 'B2' WHEN contains(l, 'b1') THEN 'B1' WHEN contains(l, 'a2') THEN 'A2' WHEN contains(l, 'a1') THEN 'A1' END AS level
FROM (SELECT doc_id, l, regexp_matches(l, 'english|англий') AS m FROM (SELECT doc_id, lower(text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'English B2 required' WHEN 1 THEN 'Английский C1, b1' WHEN 2 THEN 'required' ELSE '' END) AS l FROM documents))""")
def _(i):
    df = i.sql("SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'English B2 required' WHEN 1 THEN 'Английский C1, b1' WHEN 2 THEN 'required' END AS extra FROM documents")
    return df.withColumn("e", k.english_signals(c("text"), c("extra"))).select("doc_id", "e.mention", "e.required", "e.level")


SKILLS = [
    ("postgres|Git|GIT|k8s|Excel", "PostgreSQL|Git|Kubernetes|Excel"), ("js|React.js|reactjs", "JavaScript|React"), ("ci cd|SQL|sql|Aws|AWS", "CI/CD|SQL|Aws"), ("airflow|unknown|ETL|etl x", "Apache Airflow|ETL|etl x"), ("", ""),
]
SK_IN, SK_OUT = branches("id", SKILLS)


@query("skill_canonicalize", f"SELECT id, CASE WHEN id % 5 = 1 AND id % 2 = 0 THEN 'JS|React' ELSE {SK_OUT} END AS skills FROM postings")
def _(i):
    df = i.sql(f"SELECT id, {SK_IN} AS raw, CASE WHEN id % 2 = 0 THEN 'cook' ELSE 'Frontend Developer' END AS ctx FROM postings")
    return df.select("id", F.array_join(k.canonical_skills(F.split("raw", "\\|"), k.programming_context(c("ctx"))), "|").alias("skills"))


FAMILIES = [("Python|SQL|React", "data_and_backend"), ("React|Python", "frontend_and_web"), ("zzz|Figma|yyy", "other"), ("Docker|Linux|Figma|Figma", "devops_and_cloud"), ("", "NULL")]
FA_IN, FA_OUT = branches("id", FAMILIES)


@query("skill_family_top", f"SELECT id, {FA_OUT} AS family FROM postings")
def _(i):
    items = F.filter(F.split("raw", "\\|"), lambda y: y != "")
    return i.sql(f"SELECT id, {FA_IN} AS raw FROM postings").select("id", k.top_family(items).alias("family"))


@query("explode_skills", "SELECT id, skill FROM posting_skills")
def _(i):
    lists = i.view("posting_skills").groupBy("id").agg(F.collect_set(F.concat(F.lit(" "), c("skill"))).alias("s"))
    padded = lists.withColumn("s", F.concat("s", F.array(F.lit("  "))))
    return padded.select("id", F.explode("s").alias("skill")).withColumn("skill", F.trim("skill")).filter("skill <> ''")


@query("join_lookup_maps", """
SELECT source, CASE source WHEN 'hh_kz' THEN 4 WHEN 'kaspi_jobs' THEN 3 WHEN 'kolesa_jobs' THEN 3 WHEN 'Freedom Broker' THEN 2 ELSE 1 END::BIGINT AS priority,
  count(*) AS n_rows FROM postings GROUP BY 1, 2""")
def _(i):
    from postmill.functions.vocab import SOURCE_PRIORITY
    p = F.coalesce(x.lookup(c("source"), SOURCE_PRIORITY), F.lit(0)).cast("long")
    return i.view("postings").groupBy("source", p.alias("priority")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---- headers, titles, companies ---------------------------------------------------------------

N = "(id % 90)"
HEADERS = [  # text, pattern, confidence, title, company, city
    ("{'Data Engineer ' || %s || ' (Алматы) ТОО \"Ромашка\" ищет специалиста'}" % N, "title_city_company_is_hiring", "0.95", "{'Data Engineer ' || %s}" % N, 'ТОО "Ромашка"', "almaty"),
    ("{'Должность: QA ' || %s || ' Компания: Acme Город: Астана Формат: офис'}" % N, "labeled_title_company_city", "0.97", "{'QA ' || %s}" % N, "Acme", "astana"),
    ("{'Команда Beta ' || %s || ' в поисках Java Developer'}" % N, "company_searching_for_title", "0.9", "Java Developer", "{'Beta ' || %s}" % N, "NULL"),
    ("{'Аналитик ' || %s || ' Компания: Gamma Локация: Шымкент'}" % N, "title_company_location", "0.94", "{'Аналитик ' || %s}" % N, "Gamma", "other"),
    ("{'Дизайнер ' || %s || ' | Алматы'}" % N, "title_pipe_city", "0.84", "{'Дизайнер ' || %s}" % N, "NULL", "almaty"),
    ("{'Delta ' || %s || ' требуется: Бухгалтер'}" % N, "company_requires_title", "0.88", "Бухгалтер", "{'Delta ' || %s}" % N, "NULL"),
    ("{'Python разработчик ' || %s || ' формат удаленный'}" % N, "title_before_header_labels", "0.82", "{'Python разработчик ' || %s}" % N, "NULL", "NULL"),
    ("{'Требуется кассир ' || %s || '!'}" % N, "required_title_only", "0.83", "{'кассир ' || %s}" % N, "NULL", "NULL"),
    ("{'We are looking for Go developer ' || %s || '. ТОО Омега'}" % N, "looking_for_title", "0.8", "{'Go developer ' || %s}" % N, "ТОО Омега", "NULL"),
    ("{'Компания Сигма ' || %s || ' ищет человека'}" % N, "company_searching_for_title", "0.9", "человека", "{'Сигма ' || %s}" % N, "NULL"),
    ("{'Сигма ' || %s || ' ищет людей'}" % N, "company_hiring_only", "0.8", "NULL", "{'Сигма ' || %s}" % N, "NULL"),
    ("{'Просто текст без полезных слов ' || %s}" % N, "no_match", "0.0", "NULL", "NULL", "NULL"),
    ("{'Тестировщик ' || %s || ', Zeta'}" % N, "title_comma_company", "0.86", "{'Тестировщик ' || %s}" % N, "Zeta", "NULL"),
]
HD = f"(id % {len(HEADERS)})"
HD_COLS = [case(HD, dict(enumerate(h[j] for h in HEADERS))) for j in range(6)]
FIXTURES["header_ads"] = f"SELECT id, source, {HD_COLS[0]} || CASE WHEN id % 2 = 0 THEN chr(10) || 'Требования: опыт от 3 лет' ELSE '' END AS description_clean_v2 FROM postings"
EXPECT_HEADER = f"{HD_COLS[1]} AS header_parse_pattern, {HD_COLS[2]}::DOUBLE AS header_parse_confidence, {HD_COLS[3]} AS header_extracted_title, {HD_COLS[4]} AS header_extracted_company, {HD_COLS[5]} AS header_extracted_city"


@query("header_parse", f"SELECT id, {EXPECT_HEADER} FROM postings")
def _(i):
    return curate.parse_header(i.dealt("header_ads", "id")).select(
        "id", "header_parse_pattern", "header_parse_confidence", "header_extracted_title", "header_extracted_company", "header_extracted_city")


TITLES = [  # title, title_normalized, header title, description, final, source
    ("Вакансия: Senior Python developer", "NULL", "NULL", "NULL", "Senior Python developer", "raw_title"),
    ("backend", "NULL", "NULL", "NULL", "Backend Developer", "raw_title"),
    ("unknown", "Business Analyst", "NULL", "NULL", "Business Analyst", "title_normalized"),
    ("NULL", "n/a", "{'Кассир ' || (id % 50)}", "NULL", "{'Кассир ' || (id % 50)}", "header_parse"),
    ("NULL", "NULL", "NULL", "{'Привет всем, ищем Повара ' || (id % 40) || '. Звоните скорее сюда'}", "{'Повара ' || (id % 40) || '. Звоните скорее сюда'}", "description_rule"),
    ("NULL", "NULL", "NULL", "Data analyst в нашем отделе. Остальное потом", "Data Analyst", "description_rule"),
    ("NULL", "NULL", "вакансия", "тут нет ничего похожего на название роли", "NULL", "missing"),
    ("{'Tester ' || (id % 30)}", "NULL", "NULL", "NULL", "QA Engineer", "raw_title"),
]
TI = f"(id % {len(TITLES)})"
TI_COLS = [case(TI, dict(enumerate(h[j] for h in TITLES))) for j in range(6)]


@query("title_finalize", f"SELECT id, {TI_COLS[4]} AS title_final, {TI_COLS[5]} AS title_source_v2, {TI_COLS[5]} NOT IN ('raw_title', 'missing') AS title_is_inferred FROM postings")
def _(i):
    df = i.sql(f"""SELECT id, {TI_COLS[0]} AS title, {TI_COLS[1]} AS title_normalized, {TI_COLS[2]} AS header_extracted_title, {TI_COLS[3]} AS description_clean_v2 FROM postings""")
    return curate.final_title(df).select("id", "title_final", "title_source_v2", "title_is_inferred")


COMPANIES = [  # company, header company, clean, source
    ("kaspi", "NULL", "Kaspi.kz", "cleaned_existing"), ("{'Компания: Acme ' || (id % 70)}", "NULL", "{'Acme ' || (id % 70)}", "cleaned_existing"),
    ("NULL", "{'Beta ' || (id % 60) || ' ищет людей'}", "{'Beta ' || (id % 60)}", "header_parse"), ("Пишите в telegram сюда", "Other", "NULL", "dropped_suspicious"),
    ("Звоните! Срочно! Офис +7 701 123 45 67", "NULL", "NULL", "dropped_suspicious"), ("n/a", "NULL", "NULL", "missing"), ("- Tele2/Altel -", "NULL", "Tele2/Altel", "cleaned_existing"),
]
CO = f"(id % {len(COMPANIES)})"
CO_COLS = [case(CO, dict(enumerate(h[j] for h in COMPANIES))) for j in range(4)]


@query("company_finalize", f"SELECT id, {CO_COLS[2]} AS company_clean, {CO_COLS[3]} AS company_source_v2, {CO_COLS[3]} = 'dropped_suspicious' AS company_is_suspicious FROM postings")
def _(i):
    df = i.sql(f"SELECT id, {CO_COLS[0]} AS company, {CO_COLS[1]} AS header_extracted_company FROM postings")
    return curate.final_company(df).select("id", "company_clean", "company_source_v2", "company_is_suspicious")


@query("city_backfill", f"""
SELECT id, coalesce({CITY_OUT}, {HD_COLS[5]}) AS city_norm,
  CASE WHEN {CITY_OUT} IS NOT NULL THEN 'existing_city' WHEN {HD_COLS[5]} IS NOT NULL THEN 'header_parse' ELSE 'missing' END AS city_source_v2 FROM postings""")
def _(i):
    df = i.sql(f"SELECT id, {CITY_IN} AS raw, {HD_COLS[5]} AS header_extracted_city FROM postings").withColumn("city_norm", k.city(c("raw")))
    return curate.backfill_city(df).select("id", "city_norm", "city_source_v2")


CAT_TEXTS = [  # context, skills, existing, value, source, confidence
    ("Senior data engineer, ETL", "Python|SQL", "NULL", "data", "rule_based_high", "0.9"), ("QA engineer and tester", "Figma", "NULL", "qa", "rule_based_medium", "0.78"),
    ("backend developer with docker", "Docker|React", "NULL", "devops", "rule_based_high", "0.9"), ("nothing at all", "Figma", "NULL", "NULL", "unresolved", "0.0"), ("anything", "SQL", "hr", "hr", "existing_valid", "1.0"),
    ("kubernetes clusters", "Linux", "NULL", "devops", "rule_based_high", "0.9"), ("sales and marketing", "", "NULL", "NULL", "unresolved", "0.0"),
]
CT = f"(id % {len(CAT_TEXTS)})"
CT_COLS = [case(CT, dict(enumerate(h[j] for h in CAT_TEXTS))) for j in range(6)]


@query("category_infer", f"SELECT id, {CT_COLS[3]} AS category_filled, {CT_COLS[4]} AS category_source_v2, {CT_COLS[5]}::DOUBLE AS category_confidence_v2 FROM postings")
def _(i):
    df = i.sql(f"SELECT id, {CT_COLS[0]} || ' ' || source AS _context, {CT_COLS[1]} AS s, {CT_COLS[2]} AS category_norm FROM postings")
    out = curate.infer_category(df.withColumn("skills_all_clean", F.filter(F.split("s", "\\|"), lambda y: y != "")))
    return out.select("id", "category_filled", "category_source_v2", "category_confidence_v2")


LEVELS = [  # title, text, years, existing, value, source, confidence
    ("Стажёр", "x", "9", "NULL", "intern", "title_rule_high", "0.95"), ("Team Lead", "x", "NULL", "NULL", "lead", "title_rule_high", "0.95"), ("Sr. analyst", "x", "NULL", "NULL", "senior", "title_rule_high", "0.95"),
    ("Head of QA", "x", "NULL", "NULL", "manager", "title_rule_high", "0.92"), ("Analyst", "mid-level person", "NULL", "NULL", "middle", "text_rule_medium", "0.8"),
    ("Analyst", "0-1 year", "NULL", "NULL", "junior", "text_rule_medium", "0.8"), ("Analyst", "нужно более 5 лет", "NULL", "NULL", "senior", "text_rule_medium", "0.82"), ("Analyst", "x", "1", "NULL", "junior", "experience_rule_medium", "0.72"),
    ("Analyst", "x", "3", "NULL", "middle", "experience_rule_medium", "0.72"), ("Analyst", "x", "8", "NULL", "senior", "experience_rule_medium", "0.74"), ("Analyst", "x", "NULL", "NULL", "NULL", "unresolved", "0.0"),
    ("Intern", "x", "1", "lead", "lead", "existing_valid", "1.0"),
]
LV = f"(id % {len(LEVELS)})"
LV_COLS = [case(LV, dict(enumerate(h[j] for h in LEVELS))) for j in range(7)]


@query("level_infer", f"SELECT id, {LV_COLS[4]} AS level_filled, {LV_COLS[5]} AS level_source_v2, {LV_COLS[6]}::DOUBLE AS level_confidence_v2 FROM postings")
def _(i):
    df = i.sql(f"""SELECT id, {LV_COLS[0]} AS title, NULL AS title_normalized, NULL AS title_final, {LV_COLS[1]} AS _context, CAST({LV_COLS[2]} AS DOUBLE) AS experience_min,
      {LV_COLS[3]} AS level_norm FROM postings""")
    return curate.infer_level(df).select("id", "level_filled", "level_source_v2", "level_confidence_v2")


@query("internship_flags", """
SELECT id, e = 'internship' OR l = 'intern' OR id % 7 = 0 AS flag, CASE WHEN e = 'internship' AND l = 'intern' THEN 'consistent' WHEN e = 'internship' THEN 'employment_without_intern_level'
  WHEN l = 'intern' THEN 'intern_level_without_internship_employment' ELSE 'not_applicable' END AS consistency
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'internship' ELSE 'full_time' END AS e, coalesce(level_filled, '') AS l FROM postings)""")
def _(i):
    df = i.sql("""SELECT id, CASE WHEN id % 3 = 0 THEN 'internship' ELSE 'full_time' END AS employment_norm, level_filled,
      CASE WHEN id % 7 = 0 THEN 'Есть Стажировка тут' ELSE 'internal audits' END AS _context FROM postings""")
    return curate.internship(df).select("id", c("internship_flag_v2").alias("flag"), c("internship_consistency_flag").alias("consistency"))


# ---- unify -----------------------------------------------------------------------------------

@query("unify_board_api", """
SELECT CAST(id AS VARCHAR) AS source_id, CASE WHEN title_final = '' THEN 'unknown' ELSE title_final END AS title, coalesce(company_clean, 'unknown') AS company,
  CASE id % 3 WHEN 0 THEN 'almaty' WHEN 1 THEN 'astana' ELSE 'unknown' END AS city, CASE id % 3 WHEN 0 THEN 'full_time' WHEN 1 THEN 'internship' ELSE 'unknown' END AS employment,
  CASE id % 4 WHEN 0 THEN 'remote' ELSE 'unknown' END AS work_format, salary_from_clean AS salary_from, salary_to_clean AS salary_to,
  CASE WHEN salary_from_clean IS NOT NULL AND salary_to_clean IS NOT NULL THEN (salary_from_clean + salary_to_clean) / 2 ELSE coalesce(salary_from_clean, salary_to_clean) END AS salary_avg,
  CASE WHEN currency_clean = '' THEN 'UNKNOWN' ELSE currency_clean END AS currency,
  CASE WHEN salary_from_clean IS NOT NULL OR salary_to_clean IS NOT NULL THEN trim(coalesce(CAST(CAST(salary_from_clean AS BIGINT) AS VARCHAR), '') || coalesce(' - ' || CAST(salary_to_clean AS BIGINT), '')
    || ' ' || CASE WHEN currency_clean = '' THEN 'UNKNOWN' ELSE currency_clean END) END AS salary_raw, 'Text & more ' || source AS description_raw FROM postings""")
def _(i):
    df = i.sql("""SELECT id, nullif(title_final, '') AS title, company_clean AS company, CASE id % 3 WHEN 0 THEN 'Алматы' WHEN 1 THEN 'Астана' ELSE 'Актау' END AS vacancy_city, 'u' AS url,
      CASE id % 3 WHEN 0 THEN 'Полная занятость' WHEN 1 THEN 'Стажировка' ELSE 'x' END AS employment, CASE id % 4 WHEN 0 THEN 'Удаленная работа' END AS schedule,
      '<p>Text &amp;  more</p> ' || source AS description, NULL AS requirement, NULL AS responsibility, NULL AS skills, CAST(salary_from_clean AS STRING) AS salary_from,
      CAST(salary_to_clean AS STRING) AS salary_to, lower(currency_clean) AS currency, true AS salary_gross, '2024-01-01' AS published_at, NULL AS experience FROM postings""")
    return unify.unify_board(df).select("source_id", "title", "company", "city", "employment", "work_format", "salary_from", "salary_to", "salary_avg", "currency", "salary_raw", "description_raw")


@query("unify_career_site", r"""
SELECT CAST(page_id * 7 AS VARCHAR) AS source_id, 'Build x' || CASE WHEN page_id % 2 = 0 THEN ' SQL' ELSE '' END AS description_raw, CASE page_id % 3 WHEN 0 THEN 'almaty' ELSE 'unknown' END AS city,
  'hybrid' AS work_format, 'KZT' AS currency, CAST(page_id * 100 AS DOUBLE) AS salary_avg FROM pages""")
def _(i):
    df = i.sql("""SELECT 'Dev' AS title, 'https://x.example/vacancy/dev-' || (page_id * 7) AS url, NULL AS company, CASE page_id % 3 WHEN 0 THEN 'Алматы' ELSE '' END AS location, 'Build <b>x</b>' AS responsibilities,
      CASE WHEN page_id % 2 = 0 THEN 'SQL' ELSE '  ' END AS requirements, 'Гибрид' AS nice_to_have_x, NULL AS nice_to_have, page_id * 100 AS salary_from, NULL AS salary_to, 's' AS salary, 't' AS tech_stack, '1 год' AS experience FROM pages""")
    out = unify.unify_career(df.withColumn("title", F.lit("Гибрид dev")))
    return out.select("source_id", "description_raw", "city", "work_format", "currency", "salary_avg")


@query("unify_bank_board", f"""
SELECT page_id, 'Kaspi.kz' AS company, CASE WHEN page_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(page_id * 1000 AS DOUBLE) END AS salary_from,
  CASE WHEN page_id % 5 = 0 THEN 'UNKNOWN' ELSE 'KZT' END AS currency, array_to_string(list_append({links_sql('body', 2)}, 'Docker'), ' | ') AS skills_raw FROM board_pages""")
def _(i):
    from postmill.sources.records import page_records
    p = page_records(i.dealt("board_pages", "page_id").select("page_id", "html"))
    raw = p.select(c("page_id"), c("position").alias("Position"), c("salary").alias("Salary"), c("city").alias("City"), c("schedule").alias("Schedule"), c("experience").alias("Experience"),
                   c("skills_list").alias("Skills_List"), c("full_description").alias("Full_Description"), F.concat(F.lit("https://x.example/vacancy/a-"), c("page_id")).alias("URL"))
    out = unify.unify_bank(raw)
    return out.select(c("source_id").cast("long").alias("page_id"), "company", "salary_from", "currency", "skills_raw")


@query("unify_chat", r"""
SELECT 'ITcom KZ' AS source, conv_id || '_' || turn AS source_id, '@itcom_kz' AS source_url, md5(nullif(trim(regexp_replace(replace(replace(replace(regexp_replace(message, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[\s\x{a0}]+', ' ', 'g')), '')) AS text_md5
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' нужен человек' WHEN 1 THEN text || ' Developer' ELSE text END AS message FROM conversations)
WHERE length(message) > 50 AND regexp_matches(lower(message), 'вакансия|требуется|нужен|опыт|зарплата|job|developer|engineer')""")
def _(i):
    df = i.sql("""SELECT conv_id AS channel_id, turn AS message_id, '2024-01-01' AS date, ' ITcom   KZ ' AS channel_title, 'itcom_kz' AS channel_handle,
      CASE turn % 3 WHEN 0 THEN text || ' нужен человек' WHEN 1 THEN text || ' Developer' ELSE text END AS message FROM conversations""")
    return unify.unify_chat(df).select("source", "source_id", "source_url", F.md5("description_raw").alias("text_md5"))


@query("finalize_unified", r"""
SELECT sha256('docs|' || doc_id) AS id, 'unknown' AS category, CAST(doc_id % 7 AS BIGINT) AS experience_min, 'rule_based' AS extraction_method, 0.0::DOUBLE AS llm_confidence,
  h AS duplicate_hash, doc_id <> min(doc_id) OVER (PARTITION BY h) AS is_duplicate FROM (SELECT doc_id, md5(concat_ws(' | ', lang, 'unknown', 'unknown',
  trim(regexp_replace(lower(text), '[^a-zа-я0-9]+', ' ', 'g')))) AS h FROM documents)""")
def _(i):
    base = i.sql("SELECT doc_id, 'docs' AS source, CAST(doc_id AS STRING) AS source_id, lang AS title, text AS description_raw, 'более ' || (doc_id % 7) || ' лет' AS experience_raw FROM documents")
    fixed = {x: F.lit(None).cast("string") for x in ("source_url", "salary_raw", "requirements_raw", "responsibilities_raw", "skills_raw")}
    fixed |= {x: F.lit("unknown") for x in ("company", "city", "employment", "work_format", "currency")}
    fixed |= {x: F.lit(None).cast("double") for x in ("salary_from", "salary_to", "salary_avg")}
    fixed |= {"salary_gross": F.lit(None).cast("boolean"), "posted_at": F.lit(None).cast("timestamp")}
    silver = unify.finalize(unify.extract_fields(base.withColumns(fixed)), F.current_timestamp())
    order = F.lpad("source_id", 12, "0")
    flagged = unify.refresh_duplicates(silver.withColumn("_o", order), "_o")
    return flagged.select("id", "category", "experience_min", "extraction_method", "llm_confidence", "duplicate_hash", "is_duplicate")
