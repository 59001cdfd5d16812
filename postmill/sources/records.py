"""Fetched pages, API items and profiles → flat records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import squeeze
from postmill.operators.spread import keep_first, seal
from postmill.sources import tagtree

# Class names of the bank board's page, and words of a schedule.
BOARD = "vacancy-single__head__content"
BOARD_RULES = {
    "title": ("h1", f"{BOARD}__title"),
    "salary": ("div", f"{BOARD}__salary__label"),
    "city": ("div", f"{BOARD}__salary__cities"),
    "labels": ("div", f"{BOARD}__filter-items__label"),
    "body": ("div", "vacancy-single__body__desc"),
}
SCHEDULE_WORDS = "график|удал|офис|гибк|полный|частич"


def strip_tags(html: Column, gap: str = " ") -> Column:
    return F.regexp_replace(html, "<[^>]+>", gap)


def clean(html: Column) -> Column:
    return squeeze(strip_tags(html))


def with_tree(pages: DataFrame, html: str) -> DataFrame:
    """Pages with their tag tree in ``_page``, worked out once."""
    return seal(pages, {"_page": tagtree.tree(F.col(html))})


def _found(page: Column, rule: tuple[str, str | None], default: str) -> Column:
    """Text of the first element of a rule; the default where there is none."""
    return F.coalesce(squeeze_or_null(tagtree.text_of(page, tagtree.first(tagtree.select(page, *rule)))), F.lit(default))


def squeeze_or_null(text: Column) -> Column:
    return F.when(text.isNotNull(), squeeze(text))


def _items(page: Column, body: Column, strip: bool) -> Column:
    """List items and paragraphs of an element, in the order of the page, with their texts."""
    inside = tagtree.within(page, body, ["li", "p"])
    text = lambda e: tagtree.text_of(page, e, "", True) if strip else squeeze(tagtree.text_of(page, e))
    return F.transform(inside, lambda e: F.struct(e["name"].alias("tag"), text(e).alias("txt")))


def _bullets(items: Column, bullets: str, strip: str, ok) -> Column:
    """Texts of list items, and of paragraphs that start with a bullet."""
    marked = F.filter(items, lambda x: (x["tag"] == "li") | x["txt"].rlike(f"^[{bullets}]"))
    texts = F.transform(marked, lambda x: tagtree.squeeze_ends(F.regexp_replace(x["txt"], f"^[{strip}]+", "")))
    return F.coalesce(F.array_join(F.filter(texts, ok), " | "), F.lit(""))


Rules = Mapping[str, tuple[str, str | None]]


def _board(pages: DataFrame, html: str, rules: Rules, strip: bool) -> tuple[DataFrame, Column]:
    page, body = F.col("_page"), F.col("_body")
    found = seal(with_tree(pages, html), {"_body": tagtree.first(tagtree.select(page, *rules["body"]))})
    labels = F.transform(tagtree.select(page, *rules["labels"]), lambda e: tagtree.text_of(page, e, "", True) if strip else F.lower(squeeze(tagtree.text_of(page, e))))
    full = squeeze(tagtree.text_of(page, body, " "))
    return seal(found, {"_labels": labels, "_items": _items(page, body, strip), "_full": F.coalesce(full, F.lit(""))}), page


def page_records(pages: DataFrame, html: str = "html", rules: Rules = BOARD_RULES) -> DataFrame:
    """Vacancy pages of a board: head fields, first label = schedule, second = experience, bullets = skills.

    ``rules`` name the tag and class (any, if None) of each field. A field whose element is missing has a default, an empty element an
    empty text. A page that is null or no markup has defaults only. Nested and unclosed tags are read as the tag tree has them.
    """
    out, page = _board(pages, html, rules, True)
    return out.withColumns({
        "position": _found(page, rules["title"], "N/A"),
        "salary": _found(page, rules["salary"], "Не указана"),
        "city": _found(page, rules["city"], "N/A"),
        "schedule": F.coalesce(F.get("_labels", F.lit(0)), F.lit("N/A")),
        "experience": F.coalesce(F.get("_labels", F.lit(1)), F.lit("N/A")),
        "skills_list": _bullets(F.col("_items"), "•\\-", "•\\- ", lambda x: F.length(x) > 2),
        "full_description": F.col("_full"),
    }).drop("_labels", "_body", "_items", "_full", "_page", html)


def page_records_v1(pages: DataFrame, html: str = "html", rules: Rules = BOARD_RULES) -> DataFrame:
    """Older reading: the last label with a digit and a year word is the experience, another with a schedule word the schedule."""
    out, page = _board(pages, html, rules, False)

    def is_experience(x: Column) -> Column:
        return x.rlike("\\d") & x.rlike("год|лет")

    exp = F.filter("_labels", is_experience)
    plan = F.filter("_labels", lambda x: ~is_experience(x) & x.rlike(SCHEDULE_WORDS))
    return out.withColumns({
        "title": _found(page, rules["title"], "N/A"),
        "salary_raw": _found(page, rules["salary"], "Не указана"),
        "city": _found(page, rules["city"], "N/A"),
        "experience": F.coalesce(F.try_element_at(exp, F.lit(-1)), F.lit("")),
        "schedule": F.coalesce(F.try_element_at(plan, F.lit(-1)), F.lit("")),
        "skills": _bullets(F.col("_items"), "•\\-—", "•\\-— ", lambda x: (x != "") & (F.length(x) < 120)),
        "full_description": F.col("_full"),
    }).drop("_labels", "_body", "_items", "_full", "_page", html)


# Headings of the career site's lists, and of the text about the company.
CAREER_HEADINGS = {
    "tech_stack": "Стек", "responsibilities": "Тебе предстоит", "requirements": "Мы ждем", "nice_to_have": "Будет преимуществом",
}
ABOUT = "О компании"


def _heading(page: Column, words: str) -> Column:
    """The innermost element around the first text that holds the words."""
    return tagtree.around(page, tagtree.first_text_with(page, words))


def list_after(page: Column, heading: str) -> Column:
    """Items of the first list after the element of a heading text, joined by `` | ``."""
    items = F.transform(tagtree.children(page, tagtree.following(page, _heading(page, heading), "ul"), "li"), lambda e: squeeze(tagtree.text_of(page, e)))
    return F.coalesce(F.array_join(F.filter(items, lambda x: x != ""), " | "), F.lit(""))


def career_records(pages: DataFrame, html: str = "html", headings: dict[str, str] | None = None, about: str = ABOUT, currency: str = "₸") -> DataFrame:
    """Career-site pages: title, salary line, first city and experience tags, lists after their headings; '' for what a page lacks."""
    page = F.col("_page")
    tags = F.transform(tagtree.select(page, "li"), lambda e: squeeze(tagtree.text_of(page, e)))
    numbers = F.transform(
        F.regexp_extract_all("salary", F.lit("\\d[\\d ]*"), F.lit(0)), lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("long")
    )
    text = lambda e: squeeze(tagtree.text_of(page, e))
    tagged = lambda words: F.coalesce(F.get(F.filter("_tags", lambda x: x.rlike(words)), F.lit(0)), F.lit(""))
    out = seal(with_tree(pages, html), {"_tags": tags})
    return (
        seal(out, {
            "title": text(tagtree.first(tagtree.select(page, "h1"))),
            "salary": text(_heading(page, currency)),
            "location": tagged("Алматы|Астана|Remote"),
            "experience": tagged("Опыт|лет"),
            "company": text(tagtree.following(page, _heading(page, about), "div")),
        } | {name: list_after(page, words) for name, words in (headings or CAREER_HEADINGS).items()})
        .withColumn("_n", numbers)
        .withColumns({"salary_from": F.get("_n", F.lit(0)), "salary_to": F.get("_n", F.lit(1))})
        .drop("_n", "_tags", "_page", html)
    )


NAMED = "struct<id:string,name:string>"
SALARY = "struct<`from`:double,`to`:double,currency:string,gross:boolean>"
API_ITEM = (
    f"id string, name string, area {NAMED}, employer {NAMED}, experience {NAMED}, employment {NAMED}, schedule {NAMED}, "
    f"salary {SALARY}, snippet struct<requirement:string,responsibility:string>, alternate_url string, published_at string"
)
API_DETAIL = (
    f"area {NAMED}, description string, key_skills array<struct<name:string>>, salary {SALARY}, schedule {NAMED}, "
    f"employment {NAMED}, experience {NAMED}, working_time_modes array<struct<name:string>>, working_hours array<struct<name:string>>, "
    f"type {NAMED}, internship boolean"
)


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flatten_api(df: DataFrame, json_col: str, search_city: str) -> DataFrame:
    """List items of the API → one flat row each, detail columns still blank."""
    parsed = df.withColumn("_j", F.from_json(json_col, API_ITEM))
    j = F.col("_j")
    return parsed.select(
        j["id"].alias("id"), j["name"].alias("title"), F.col(search_city).alias("search_city"),
        _or_blank(j["area"]["name"]).alias("vacancy_city"),
        _or_blank(j["employer"]["name"]).alias("company"), _or_blank(j["employer"]["id"]).alias("company_id"),
        _or_blank(j["experience"]["name"]).alias("experience"), _or_blank(j["employment"]["name"]).alias("employment"),
        _or_blank(j["schedule"]["name"]).alias("schedule"),
        j["salary"]["from"].alias("salary_from"), j["salary"]["to"].alias("salary_to"),
        j["salary"]["currency"].alias("currency"), j["salary"]["gross"].alias("salary_gross"),
        clean(j["snippet"]["requirement"]).alias("requirement"), clean(j["snippet"]["responsibility"]).alias("responsibility"),
        F.lit("").alias("skills"), F.lit("").alias("description"), F.lit("").alias("work_format"),
        F.lit("").alias("working_hours"), F.lit("").alias("vacancy_type"), F.lit(None).cast("boolean").alias("internship"),
        j["alternate_url"].alias("url"), j["published_at"].alias("published_at"),
    )


def _names(items: Column) -> Column:
    names = F.transform(items, lambda x: x["name"])
    return F.coalesce(F.array_join(F.filter(names, lambda x: x.isNotNull() & (x != "")), ", "), F.lit(""))


def overlay_detail(rows: DataFrame, details: DataFrame, row_id: str, json_col: str, allowed_areas: Sequence[int]) -> DataFrame:
    """Detail JSON over the flat row; rows of an area outside the allowed set go, unreadable areas stay."""
    parsed = details.select(F.col(row_id), F.from_json(json_col, API_DETAIL).alias("_d"))
    both = rows.join(parsed, row_id, "left")
    d = F.col("_d")
    area = d["area"]["id"].try_cast("int")
    has = d.isNotNull()
    money = d["salary"]
    has_money = (
        money["from"].isNotNull() | money["to"].isNotNull() | money["currency"].isNotNull() | money["gross"].isNotNull()
    )

    def over(new: Column, old: str) -> Column:
        return F.coalesce(new, F.col(old))

    return (
        both.filter(area.isNull() | area.isin(list(allowed_areas)))
        .withColumns({
            "vacancy_city": over(d["area"]["name"], "vacancy_city"),
            "description": F.when(has, clean(d["description"])).otherwise(F.col("description")),
            "skills": F.when(has, _names(d["key_skills"])).otherwise(F.col("skills")),
            "salary_from": F.when(has_money, money["from"]).otherwise(F.col("salary_from")),
            "salary_to": F.when(has_money, money["to"]).otherwise(F.col("salary_to")),
            "currency": F.when(has_money, money["currency"]).otherwise(F.col("currency")),
            "salary_gross": F.when(has_money, money["gross"]).otherwise(F.col("salary_gross")),
            "schedule": over(d["schedule"]["name"], "schedule"),
            "employment": over(d["employment"]["name"], "employment"),
            "experience": over(d["experience"]["name"], "experience"),
            "work_format": F.when(has, _names(d["working_time_modes"])).otherwise(F.col("work_format")),
            "working_hours": F.when(has, _names(d["working_hours"])).otherwise(F.col("working_hours")),
            "vacancy_type": F.when(has, _or_blank(d["type"]["name"])).otherwise(F.col("vacancy_type")),
            "internship": over(d["internship"], "internship"),
        })
        .drop("_d")
    )


def crawl_dedup(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """First crawled row per key in crawl order."""
    return keep_first(df, keys, [F.asc(seq)])


DATED = "struct<text:string>"
PROFILE = (
    "id string, objectUrn string, firstName string, lastName string, name string, linkedinUrl string, url string, headline string, "
    f"location struct<parsed:{DATED},linkedinText:string>, "
    f"experience array<struct<position:string,title:string,companyName:string,startDate:{DATED},endDate:{DATED}>>, "
    f"education array<struct<schoolName:string,school:string,degree:string,period:string,startDate:{DATED},endDate:{DATED}>>, "
    f"profileTopEducation array<struct<schoolName:string,school:string,degree:string,period:string,startDate:{DATED},endDate:{DATED}>>, "
    + ", ".join(
        f"{n} array<struct<name:string,title:string,authority:string,issuingOrganizationName:string,issuingOrganization:struct<name:string>,"
        f"issuer:string,startDate:{DATED},issueDate:string,issuedAt:string,url:string,credentialUrl:string,link:string>>"
        for n in ("certifications", "licensesAndCertifications", "licenses")
    )
    + ", skills array<string>"
)


def _first(*cols: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def profile_records(df: DataFrame, json_col: str) -> DataFrame:
    """Profile JSON with its alternative keys → one normal row with arrays of structs."""
    parsed = df.withColumn("_p", F.from_json(json_col, PROFILE))
    p = F.col("_p")
    na = F.lit("N/A")
    education = F.coalesce(p["education"], p["profileTopEducation"])
    certs = F.coalesce(p["certifications"], p["licensesAndCertifications"], p["licenses"])
    full = F.trim(F.concat_ws(" ", _first(p["firstName"]), _first(p["lastName"])))
    skill = lambda s: F.coalesce(F.get_json_object(s, "$.name"), F.get_json_object(s, "$.title"), s)
    return parsed.select(
        *[c for c in df.columns if c != json_col],
        _first(p["id"], p["objectUrn"]).alias("profile_id"),
        _first(full, p["name"]).alias("full_name"),
        _first(p["linkedinUrl"], p["url"]).alias("profile_url"),
        p["headline"].alias("headline"),
        F.coalesce(_first(p["location"]["parsed"]["text"], p["location"]["linkedinText"]), F.lit("Unknown")).alias("location"),
        F.coalesce(F.transform(p["experience"], lambda e: F.struct(
            _first(e["position"], e["title"]).alias("title"), e["companyName"].alias("company"),
            F.coalesce(_first(e["startDate"]["text"]), na).alias("start"),
            F.coalesce(_first(e["endDate"]["text"]), F.lit("Present")).alias("end"),
        )), F.expr("array()").cast("array<struct<title:string,company:string,start:string,end:string>>")).alias("experience"),
        F.coalesce(F.transform(education, lambda e: F.struct(
            _first(e["schoolName"], e["school"]).alias("school"), e["degree"].alias("degree"),
            F.coalesce(
                _first(e["period"]),
                F.when(e["startDate"].isNotNull(), F.concat(e["startDate"]["text"], F.lit(" - "), _or_blank(e["endDate"]["text"]))),
                na,
            ).alias("period"),
        )), F.expr("array()").cast("array<struct<school:string,degree:string,period:string>>")).alias("education"),
        F.coalesce(F.transform(certs, lambda c: F.struct(
            F.coalesce(_first(c["name"], c["title"]), F.lit("Unknown Certificate")).alias("name"),
            F.coalesce(_first(
                c["authority"], c["issuingOrganizationName"], c["issuingOrganization"]["name"], c["issuer"]), na).alias("authority"),
            F.coalesce(_first(c["startDate"]["text"], c["issueDate"], c["issuedAt"]), na).alias("issued"),
            _first(c["url"], c["credentialUrl"], c["link"]).alias("url"),
        )), F.expr("array()").cast("array<struct<name:string,authority:string,issued:string,url:string>>")).alias("certifications"),
        F.coalesce(F.transform(p["skills"], skill), F.array().cast("array<string>")).alias("skills"),
    )
