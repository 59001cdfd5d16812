"""Rule branches on fixed rows; expected values are derived by hand."""

import json

import pytest
from pyspark.sql import functions as F

from postmill.functions import classify as k
from postmill.functions import money, titles
from postmill.functions.text import split_list, standardize_missing
from postmill.operators import curate, extraction, matching, rows, salary
from postmill.sources import tables

c = F.col


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(c("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,lo,hi", [
    ("Нет опыта", 0, 0), ("более 6 лет", 6, None), ("от 1 года до 3 лет", 1, 3), ("3-1 года", 1, 3), ("до 2 лет", 0, 2),
    ("4 года", 4, 4), ("от 5 лет", 5, None), ("2 – 4", 2, 4), ("70 лет", None, None), ("60-70", None, None), ("", None, None), (None, None, None),
])
def test_experience(spark, text, lo, hi):
    got = one(spark, text, k.experience)
    assert (got["min"], got["max"]) == (lo, hi)


@pytest.mark.parametrize("text,want", [
    ("1 200 000 тг", [1200000]), ("1.200.000,50", [1200000.5]), ("1,5 млн", [1500000]), ("2.5k", [2500]), ("300-500 тыс", [300000, 500000]),
    ("1 млн 200 тыс", [1200000]), ("+7 701 123 45 67", []), ("0", []), ("100 and 2k", [100000, 2000]), ("5 до 7 млн", [5000000, 7000000]),
    ("500 - 1 млн", [500000, 1000000]), ("no digits", []),
])
def test_amount_tokens(spark, text, want):
    got = one(spark, text, lambda x: F.transform(money.amount_tokens(x), lambda t: t["value"]))
    assert got == want


def test_review_needs_contact_word_or_plus(spark):
    signal = lambda t: one(spark, t, money.contact_signal)
    assert signal("tel 8 701 123 45 67") and signal("+7 701 123 45 67") and signal("a@b.kz")
    assert not signal("300000 - 500000")


def test_first_salary_reader_takes_ranges_for_phones(spark):
    df = spark.createDataFrame([("300000 - 500000 KZT", None, None, "KZT", 300000.0, 500000.0)],
                               "salary_raw string, description_clean_v2 string, description string, currency string, salary_from double, salary_to double")
    old, new = salary.salary_clean_v1(df).first(), salary.salary_repair_v3(df).first()
    assert old["salary_parse_quality"] == "contact_leak" and old["salary_from_clean"] is None
    assert (new["salary_from_clean"], new["salary_to_clean"], new["salary_usable_for_analytics"]) == (300000.0, 500000.0, True)


def test_filter_on_repaired_salary_plans_quickly(spark):
    df = spark.createDataFrame([("100 000 тг", None, None, "KZT", None, None)],
                               "salary_raw string, description_clean_v2 string, description string, currency string, salary_from double, salary_to double")
    kept = salary.salary_repair_v3(df).filter("salary_usable_for_analytics AND salary_from_clean > 5 AND NOT salary_is_suspicious")
    assert kept.count() == 1


TEXTS = [
    # A contact clause runs over the line end; what is left is too short, so the squeezed original stands.
    ("Hi <b>team</b>\nПишите в telegram @hr_team\nWe build data &amp; tools", "Hi <b>team</b> Пишите в telegram @hr_team We build data & tools"),
    ("Hi <b>team</b>\nContact: +7 701 123 45 67\nWe build data &amp; tools for the market", "Hi team We build data & tools for the market"),
    ("Build services, see https://x.kz/a now; write code daily", "Build services, see now; write code daily"),
    ("Long enough sentence about work 😀 • item one", "Long enough sentence about work item one"),
    ("#tagged", "#tagged"), ("#tag", None), ("unknown", None), (None, None),
]


@pytest.mark.parametrize("text,want", TEXTS)
def test_clean_description(spark, text, want):
    got = one(spark, text, titles.clean_description)
    assert got["text"] == want
    assert got["length"] == len(want or "")


def test_missing_and_lists(spark):
    assert one(spark, " N/A ", standardize_missing) is None
    assert one(spark, "a  &lt;b&gt;", standardize_missing) == "a <b>"
    assert one(spark, "SQL; sql | Py -\n go", split_list) == ["SQL", "Py", "go"]


def test_level_rules_before_years(spark):
    df = spark.createDataFrame([("Ведущий", "нужен junior", 6.0), ("Analyst", "", 6.0)], "t string, x string, e double")
    got = [r[0]["value"] for r in df.select(k.infer_level(F.lit(None).cast("string"), c("t"), c("x"), c("e"))).collect()]
    assert got == ["junior", "senior"]


def record(**given):
    base = dict.fromkeys(["company", "city", "salary_raw", "salary_from", "salary_to", "experience_min", "experience_max", "title_normalized",
                          "requirements_clean", "responsibilities_clean", "english_required"])
    base |= {"employment": "unknown", "work_format": "unknown", "currency": "unknown", "category": "unknown", "level": "unknown",
             "hard_skills": [], "soft_skills": [], "tech_stack": [], "english_mention": False, "english_level": "unknown"}
    return json.dumps(base | given, ensure_ascii=False)


CASES = {
    "labelled_fields": (
        "Компания: Internet Company PS\nГород: Алматы\nФормат: удаленный/гибрид\nЗанятость: полная\nЗарплата: до 1 000 000 тг\nОпыт: от 2 лет",
        record(category="software_engineering", level="senior"),
        {"company": "Internet Company PS", "city": "almaty", "employment": "full_time", "work_format": "hybrid", "salary_to": 1000000,
         "currency": "KZT", "experience_min": 2.0}),
    "free_text_only": (
        "Ищем Backend Developer, remote, full time, 3+ years of Python and Django, salary 4000 USD.",
        record(city="remote", employment="full_time", work_format="remote", salary_raw="4000 USD", salary_from=4000, currency="USD",
               experience_min=3, title_normalized="Backend Developer"),
        {"title_normalized": "Backend Developer", "employment": "full_time", "work_format": "remote", "currency": "USD"}),
    "parser_extractor_conflict_city": ("Город: Алматы\nКомпания: Test Company", record(company="Test Company", city="astana"), {"city": "almaty"}),
    "salary_swap_fix": ("Зарплата: 700000 - 300000 тг", record(salary_raw="700000 - 300000 тг", salary_from=700000, salary_to=300000, currency="KZT"),
                        {"salary_from": 300000, "salary_to": 700000}),
    "english_reset_without_mention": ("Ищем QA Engineer. Manual testing, SQL.", record(english_required=True, english_level="c2"),
                                      {"english_required": False, "english_level": None}),
    "mixed_ru_en": ("Company: Bee Lab\nГород: Astana\nWork format: remote\nEmployment: full-time",
                    record(company="Bee Lab", city="astana", english_mention=True, english_level="b2"),
                    {"company": "Bee Lab", "city": "astana", "work_format": "remote"}),
    "unknown_city": ("Город: Караганда", record(), {"city": "other"}),
    "internship_review": ("Занятость: стажировка", record(employment="internship", level="senior"), {"employment": "internship"}),
    "short_description": ("Python vacancy", record(hard_skills=["Python", "Python"]), {"hard_skills": ["Python"]}),
}


def test_extraction_cases(spark):
    df = spark.createDataFrame([(n, t, r) for n, (t, r, _) in CASES.items()], "name string, text string, record string")
    checked = extraction.sanitize(extraction.validate_extraction(df, "record"), "text")
    done = extraction.validate_record(extraction.final_record(extraction.reconcile(extraction.prefill(checked, "text"))))
    got = {r["name"]: r for r in done.collect()}
    for name, (_, _, want) in CASES.items():
        assert {f: got[name][f] for f in want} == want, name
    assert "internship_level_consistency" in got["internship_review"]["review_flags"]
    assert got["parser_extractor_conflict_city"]["conflict_flags"] == ["city"]


def test_rules_are_projections(spark):
    """Rules on single values are no lambdas, which Spark evaluates expression by expression; lists and salary texts have the few there are."""
    df = spark.createDataFrame([(t, r) for t, r, _ in CASES.values()], "text string, record string")
    checked = extraction.sanitize(extraction.validate_extraction(df, "record"), "text")
    done = extraction.validate_record(extraction.final_record(extraction.reconcile(extraction.prefill(checked, "text"))))
    done = done.select("city", "employment", "english_level", "english_required", "validation_fixes", "review_flags")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        plan = done._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("lambdafunction(") < 100


def test_same_sides_that_say_nothing_do_not_differ(spark):
    """A label that both sides give as a missing word is the rule's value, and no conflict; no list at all stays no list."""
    rows = [("Company: unknown", record(company="none", hard_skills=None)), ("Company: Beta", record(company=" BETA ", hard_skills=[]))]
    df = spark.createDataFrame(rows, "text string, record string")
    checked = extraction.sanitize(extraction.validate_extraction(df, "record"), "text")
    got = extraction.reconcile(extraction.prefill(checked, "text")).select("*", F.col("final_values")["company"].alias("v"), F.col("final_sources")["company"].alias("s")).collect()
    assert [(r["v"], r["s"], r["conflict_flags"]) for r in got] == [("unknown", "rule_label", []), ("Beta", "rule_label", [])]
    assert [r["extraction"]["hard_skills"] for r in got] == [[], []]


def test_enrichment_report(spark):
    before = spark.createDataFrame([("a", None), ("b", "unknown")], "id string, city string")
    after = spark.createDataFrame([("a", "almaty", "auto_merged", "s", ["city"]), ("b", None, "failed", "s", [])],
                                  "id string, city string, llm_merge_status string, source string, conflict_flags array<string>")
    got = {(r["section"], r["measure"]): r["value"] for r in extraction.enrichment_report(before, after, ["city"]).collect()}
    assert got[("coverage_before", "city")] == 0 and got[("coverage_after", "city")] == 50
    assert got[("failure", "share")] == 0.5 and got[("failure", "alarm")] == 1 and got[("conflicts", "city")] == 1


def test_match_against_brute_force(spark):
    import random
    rng = random.Random(3)
    skills = [f"s{i}" for i in range(12)]
    posts = {i: rng.sample(skills, rng.randint(0, 5)) for i in range(120)} | {i: ["s0", "s1"] for i in range(120, 160)}
    cands = {i: rng.sample(skills, rng.randint(0, 6)) for i in range(15)}
    pay = {i: (None if i % 7 == 0 else float(i % 10)) for i in posts}
    p = spark.createDataFrame([(i, pay[i]) for i in posts], "id long, salary_avg_clean double")
    ps = spark.createDataFrame([(i, s) for i, xs in posts.items() for s in xs], "id long, skill string")
    cd = spark.createDataFrame([(i,) for i in cands], "cand_id long")
    cs = spark.createDataFrame([(i, s.upper()) for i, xs in cands.items() for s in xs], "cand_id long, skill string")
    got = {}
    for r in matching.match(cd, cs, p, ps, 5).collect():
        got.setdefault(r["cand_id"], []).append((r["match_no"], r["id"], r["score"]))
    for i, mine in cands.items():
        score = lambda j: len(set(mine) & set(posts[j])) / len(set(mine) | set(posts[j])) if mine and posts[j] else 0.0
        want = sorted(posts, key=lambda j: (-score(j), -(pay[j] if pay[j] is not None else -1), -len(posts[j]), j))[:5]
        assert [x[1] for x in sorted(got[i])] == want
        assert [x[2] for x in sorted(got[i])] == pytest.approx([score(j) for j in want])


def test_sample_targets():
    assert rows.scaled_targets({"a": 200, "b": 70, "c": 30}, 300) == {"a": 200, "b": 70, "c": 30}
    assert rows.scaled_targets({"a": 200, "b": 70, "c": 30}, 100) == {"a": 67, "b": 23, "c": 10}


def test_charset_scan(spark, tmp_path):
    text = 'id,name\n1,"Вакансия, ""один"""\n2,два\n'
    for name, data in (("a", text.encode()), ("b", b"\xef\xbb\xbf" + text.encode()), ("c", text.encode("cp1251"))):
        (tmp_path / f"{name}.csv").write_bytes(data)
    for name in "abc":
        got = tables.scan_any_charset(spark, str(tmp_path / f"{name}.csv"), "id long, name string").orderBy("id").collect()
        assert [tuple(r) for r in got] == [(1, 'Вакансия, "один"'), (2, "два")]


def test_curate_whole(spark):
    cols = ["seq", "id", "source", "title", "title_normalized", "company", "city", "category", "level", "employment", "work_format", "english_level",
            "experience_min", "salary_raw", "salary_from", "salary_to", "currency", "description", "requirements_clean", "responsibilities_clean",
            "hard_skills", "soft_skills", "tech_stack", "posted_at", "is_duplicate", "llm_review_flag", "llm_confidence"]
    long = "We need a person to build and run data services for the whole market"
    base = [1, "a", "hh_kz", "Data Engineer", None, "Acme", "Алматы", "data", "senior", "full time", "remote", "b2", 3.0, "100 000 - 200 000 тг", None, None, "KZT",
            long, None, None, '["SQL", "sql", "postgres"]', None, None, "2024-01-02", False, False, 0.5]
    other = [2, "b", "Work IT KZ", *base[3:]]
    chat = [3, "c", "Work IT KZ", None, None, None, None, None, None, None, None, None, None, None, None, None, None,
            "Тестировщик QA, Zeta\nТребования: selenium и postman", None, None, None, None, None, None, False, False, 0.0]
    kinds = ["int", *["string"] * 11, "double", "string", "double", "double", *["string"] * 8, "boolean", "boolean", "double"]
    df = spark.createDataFrame([base, other, chat], ", ".join(f"{n} {t}" for n, t in zip(cols, kinds))).withColumn("posted_at", c("posted_at").try_cast("timestamp"))
    got = {r["id"]: r for r in curate.curate(df).collect()}
    assert got["a"]["quality_tier"] == "A" and got["b"]["quality_tier"] == "D"
    assert got["a"]["dedup_keep_for_analytics"] and not got["b"]["dedup_keep_for_analytics"]
    assert got["a"]["skills_all_clean"] == ["SQL", "PostgreSQL"] and got["a"]["salary_avg_clean"] == 150000.0
    assert got["c"]["header_parse_pattern"] == "title_comma_company" and got["c"]["company_clean"] == "Zeta"
    assert got["c"]["category_filled"] == "qa"


def test_all_missing_skills_are_kept(spark):
    posts = spark.createDataFrame([(1, 100.0)], "id long, salary_avg_clean double")
    skills = spark.createDataFrame([(1, f"s{n:02}") for n in range(14)], "id long, skill string")
    mine = spark.createDataFrame([(7, "s03")], "cand_id long, skill string")
    got = matching.match(spark.createDataFrame([(7,)], "cand_id long"), mine, posts, skills, 3).select("*", matching.shown_skills(F.col("missing_skills")).alias("shown")).first()
    assert len(got["missing_skills"]) == 13 and len(got["shown"]) == 8


def test_skills_of_any_spelling_are_matched(spark):
    posts = spark.createDataFrame([(1, 100.0), (2, 50.0)], "id long, salary_avg_clean double")
    skills = spark.createDataFrame([(1, "SQL"), (1, "sql"), (1, "Go"), (2, "go"), (2, "rust")], "id long, skill string")
    mine = spark.createDataFrame([(7, "Sql"), (7, "GO")], "cand_id long, skill string")
    got = {r["id"]: r for r in matching.match(spark.createDataFrame([(7,)], "cand_id long"), mine, posts, skills, 3).collect()}
    assert got[1]["matched_skills"] == ["Go", "SQL", "sql"] and got[1]["missing_skills"] == [] and got[1]["score"] == 1.0
    assert got[2]["matched_skills"] == ["go"] and got[2]["missing_skills"] == ["rust"]


def test_report_shares_and_alarm(spark):
    schema = "id string, city string, llm_merge_status string, source string, conflict_flags array<string>, hit boolean"
    after = spark.createDataFrame([("a", "x", "failed", "s", [], True), ("b", "x", "failed", "t", [], None), ("c", "x", "auto_merged", "t", [], True)], schema)
    hits = {"h": (F.col("source") == "t", {"f": F.coalesce(F.col("hit"), F.lit(False))}), "none": (F.col("source") == "z", {"f": F.lit(True)})}
    got = {(r["section"], r["measure"]): r["value"] for r in extraction.enrichment_report(after, after, ["city"], hits=hits).collect()}
    assert got["h", "f"] == 50 and got["none", "f"] == 0 and got["failure", "alarm"] == 1
    assert got["failed_per_source", "s"] == got["failed_per_source", "t"] == got["merged_per_source", "t"] == 1 and ("merged_per_source", "s") not in got
    empty = {(r["section"], r["measure"]): r["value"] for r in extraction.enrichment_report(after, after.limit(0), ["city"]).collect()}
    assert empty["failure", "alarm"] == 1
