"""Rule extraction from chat posts, checks of external extraction records, and their merge with provenance.

The external extractor itself is outside; its results come in as JSON rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import vocab as v
from postmill.functions.classify import average, first_hit
from postmill.functions.text import contains_any, distinct_ignore_case, let, lookup, squeeze
from postmill.operators.spread import seal

c = F.col
PREFILL_FIELDS = [
    "company", "city", "employment", "work_format", "salary_raw", "salary_from", "salary_to", "currency", "experience_min", "experience_max",
]
EXTRACTOR_FIRST = [
    "title_normalized", "category", "level", "requirements_clean", "responsibilities_clean", "hard_skills", "soft_skills", "tech_stack",
]
LIST_FIELDS = ["hard_skills", "soft_skills", "tech_stack"]
MISSING = v.MISSING_WORDS_PREFILL


# Rules run as compiled projections: what is named several times is a column of its own before it, since ``let`` and generators are
# evaluated expression by expression, row by row.

def sealed(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """``seal`` of columns that are worked out in a projection; the generator only passes them on."""
    keep = [name for name in df.columns if name not in cols]
    return df.select(*keep, F.struct(*[col.alias(name) for name, col in cols.items()]).alias("_row")).select(*keep, F.inline(F.array("_row")))


def _chain(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column | None = None) -> Column:
    """``first_hit`` of a text that is a column."""
    out = F.lit(None).cast("string") if default is None else default
    for value, words in reversed(rules):
        out = F.when(contains_any(text, words), F.lit(value)).otherwise(out)
    return out


def _some(items: Column, use: Callable[[Column], Column]) -> Column:
    """``use(items)``, or no items where there are none."""
    return F.when(F.size(items) > 0, use(items)).otherwise(F.array().cast("array<string>"))


# ---- prefill ---------------------------------------------------------------------------------

def _found(value: Column, source: str, confidence: str) -> Column:
    """struct<value, source, confidence> for a value that is there, else null; ``value`` is a column."""
    return F.when(value.isNotNull(), F.struct(value.cast("string").alias("value"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def _label(text: Column, field: str) -> Column:
    """Value of a ``label: value`` line."""
    return F.nullif(squeeze(F.regexp_extract(text, rf"(?imU)^(?:{v.PREFILL_LABELS[field]})\s*[:\-]\s*(.+)$", 1)), F.lit(""))


def _city(low: Column) -> Column:
    """City of a lower-case text that is a column."""
    return _chain(low, v.CITY_WORDS, F.when(F.length(low) >= 2, F.lit("other")))


def label_city(text: Column) -> Column:
    return let(F.lower(squeeze(text)), _city)


def prefill_currency(text: Column) -> Column:
    return first_hit(F.upper(squeeze(text)), v.PREFILL_CURRENCY_WORDS)


def prefill_salary(text: Column) -> Column:
    """struct<raw, lo, hi, currency> of a salary text; upper-bound words are tried before lower-bound words."""
    def read(t: Column) -> Column:
        found = F.filter(F.transform(
            F.regexp_extract_all(t, F.lit("(\\d[\\d ]+)"), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("long")),
            lambda x: x.isNotNull())
        upper = contains_any(F.lower(t), ["до", "to"])

        def bounds(ns: Column) -> Column:
            n, a, b = F.size(ns), F.get(ns, F.lit(0)), F.get(ns, F.lit(1))
            return F.struct(
                F.nullif(t, F.lit("")).alias("raw"),
                F.when(n >= 2, F.least(a, b)).when((n == 1) & ~upper, a).alias("lo"),
                F.when(n >= 2, F.greatest(a, b)).when((n == 1) & upper, a).alias("hi"),
                prefill_currency(t).alias("currency"),
            )

        return let(found, bounds)

    return let(squeeze(text), read)


NUMBER = r"(\d+(?:[.,]\d+)?)"


def prefill_experience(text: Column) -> Column:
    """struct<lo, hi> of years, from the first rule that matches."""
    def num(t: Column, pattern: str, i: int) -> Column:
        return F.translate(F.regexp_extract(t, pattern, i), ",", ".").try_cast("double")

    def pair(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def read(t: Column) -> Column:
        none = F.lit(None).cast("double")
        from_to = rf"(?:от|from)\s*{NUMBER}\s*(?:г|лет|years?)?.{{0,12}}?(?:до|to)\s*{NUMBER}"
        ranged = rf"{NUMBER}\s*[-–—]\s*{NUMBER}\s*(?:г|лет|years?)"
        at_least, at_most, one = rf"(?:от|from|more than|более)\s*{NUMBER}", rf"(?:до|up to)\s*{NUMBER}", rf"{NUMBER}\s*(?:\+)?\s*(?:г|лет|years?)"
        both = lambda p: pair(F.least(num(t, p, 1), num(t, p, 2)), F.greatest(num(t, p, 1), num(t, p, 2)))
        return (
            F.when(contains_any(t, ["нет опыта", "no experience"]), pair(F.lit(0.0), F.lit(0.0)))
            .when(t.rlike(from_to), both(from_to)).when(t.rlike(ranged), both(ranged))
            .when(t.rlike(at_least), pair(num(t, at_least, 1), none)).when(t.rlike(at_most), pair(F.lit(0.0), num(t, at_most, 1)))
            .when(t.rlike(one), pair(num(t, one, 1), num(t, one, 1))).otherwise(pair(none, none))
        )

    return let(F.lower(squeeze(text)), read)


SALARY_CLAUSE = r"(?iu)(?:зарплата|salary)[^\n]{0,80}"
SALARY_AMOUNT = r"(?iU)(?:от|до)?\s*\d[\d\s]*(?:\s*[-–—]\s*\d[\d\s]*)?\s*(?:₸|тг|тенге|usd|\$|eur|€|rub|rur|руб)\b"
# Fixed value: a clause on years of experience.
EXPERIENCE_CLAUSE = (
    r"(?iu)(?:опыт(?: работы)?|experience).{0,20}?(\d+(?:[.,]\d+)?(?:\s*[-–—]\s*\d+(?:[.,]\d+)?)?)\s*(?:\+)?\s*(?:г|лет|years?)"
)


def prefill(df: DataFrame, text: str, out: str = "prefill") -> DataFrame:
    """Map of field → struct<value, source, confidence>: label lines first, then rules inside the text."""
    t, low = c("_t"), c("_low")
    labels = {"_lc": "city", "_lm": "employment", "_lf": "work_format"}
    staged = df.withColumn("_t", F.coalesce(c(text), F.lit(""))).withColumns({
        "_ls": prefill_salary(_label(t, "salary_raw")), "_le": prefill_experience(_label(t, "experience")),
        "_clause": F.coalesce(F.nullif(F.regexp_extract(t, SALARY_CLAUSE, 0), F.lit("")), F.regexp_extract(t, SALARY_AMOUNT, 0)),
        "_ee": prefill_experience(F.regexp_extract(t, EXPERIENCE_CLAUSE, 0)), "_low": F.lower(squeeze(t)), "_co": _label(t, "company"),
        "_place": F.when(t.rlike(r"(?iU)(?:#алматы|\bалматы\b|\balmaty\b)"), "almaty").when(
            t.rlike(r"(?iU)(?:#астана|\bастана\b|\bastana\b|\bnur-sultan\b)"), "astana"),
        **{name: F.lower(squeeze(_label(t, field))) for name, field in labels.items()},
    }).withColumns({
        "_ms": prefill_salary(F.nullif(c("_clause"), F.lit(""))), "_lc": _city(c("_lc")), "_lm": _chain(c("_lm"), v.EMPLOYMENT_WORDS),
        "_lf": _chain(c("_lf"), v.PREFILL_WORK_FORMAT_WORDS), "_im": _chain(low, v.EMPLOYMENT_WORDS),
        "_if": F.when(contains_any(low, ["удаленный/гибрид", "удалённый/гибрид", "remote/hybrid"]), "hybrid").otherwise(_chain(low, v.PREFILL_WORK_FORMAT_WORDS)),
    })
    has_label = c("_ls.raw").isNotNull()
    small = (F.greatest(c("_ms.lo"), c("_ms.hi")) < 1000) & c("_ms.currency").isNull()
    no_label_exp = c("_le.lo").isNull() & c("_le.hi").isNull()

    def two(label: Column, label_source: str, inside: Column) -> Column:
        return F.coalesce(_found(label, label_source, "high_confidence"), _found(inside, "regex_in_text", "medium_confidence"))

    def money(field: str) -> Column:
        return two(c(f"_ls.{field}"), "rule_label", F.when(~has_label & ~F.coalesce(small, F.lit(False)), c(f"_ms.{field}")))

    def years(field: str) -> Column:
        return two(c(f"_le.{field}"), "rule_label", F.when(no_label_exp, c(f"_ee.{field}")))

    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit("missing").alias("source"), F.lit("missing").alias("confidence"))
    fields = {
        "company": _found(c("_co"), "rule_label", "high_confidence"),
        "city": two(c("_lc"), "normalized_label", c("_place")),
        "employment": two(c("_lm"), "normalized_label", c("_im")),
        "work_format": two(c("_lf"), "normalized_label", c("_if")),
        "salary_raw": money("raw"), "salary_from": money("lo"), "salary_to": money("hi"), "currency": money("currency"),
        "experience_min": years("lo"), "experience_max": years("hi"),
    }
    pairs = [x for name, col in fields.items() for x in (F.lit(name), F.coalesce(col, missing))]
    return sealed(staged, {out: F.create_map(*pairs)}).drop("_t", "_low", "_co", "_place", "_ls", "_le", "_clause", "_ee", "_lc", "_lm", "_lf", "_ms", "_im", "_if")


def prefill_hints(col: Column) -> Column:
    """Map without the missing fields."""
    return F.map_filter(col, lambda k, x: (x["confidence"] != "missing") & x["value"].isNotNull())


# ---- extraction records ------------------------------------------------------------------------

EXTRACTION = (
    "id string, title_normalized string, company string, city string, category string, level string, employment string, work_format string, "
    "experience_min string, experience_max string, english_mention boolean, english_required boolean, english_level string, "
    "requirements_clean string, responsibilities_clean string, hard_skills array<string>, soft_skills array<string>, tech_stack array<string>, "
    "salary_raw string, salary_from string, salary_to string, currency string, salary_period string, salary_gross boolean, llm_confidence string"
)
NOT_SAID = ["unknown", "null", "none", "n/a", "not specified"]


def _said(text: Column) -> Column:
    return let(squeeze(text), _meant)


def _meant(t: Column) -> Column:
    """A squeezed text, unless it says that nothing is known."""
    return F.when((t != "") & ~F.lower(t).isin(NOT_SAID), t)


def _one_of(key: Column, allowed: Sequence[str]) -> Column:
    return F.when(key.isin(list(allowed)), key).otherwise(F.lit("unknown"))


def _enum_key(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    key = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(key, dict(aliases)), key) if aliases else key


def _category_key(text: Column) -> Column:
    spaced = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit(" and ")), "[/.\\-]", " ")
    return F.replace(squeeze(spaced), F.lit(" "), F.lit("_"))


def _category_of(key: Column) -> Column:
    return F.when(key == "", "unknown").when(key.isin([*v.CATEGORIES, "unknown"]), key).otherwise(
        F.coalesce(lookup(key, v.EXTRACTION_CATEGORY_ALIASES), _chain(key, v.EXTRACTION_CATEGORY_WORDS, F.lit("other"))))


def extraction_category(text: Column) -> Column:
    """Category by name, alias, or the first word list that hits; 'other' for the rest, 'unknown' for nothing."""
    return let(_category_key(text), _category_of)


def validate_extraction(df: DataFrame, json_col: str, out: str = "extraction") -> DataFrame:
    """JSON → checked record: enums, aliases, distinct lists, non-negative and ordered ranges, confidence in 0..1.

    ``extraction_ok`` is false for rows the strict schema rejects: broken JSON, or a negative number.
    """
    x, k = c("_x"), c("_k")
    texts = ("title_normalized", "company", "city", "requirements_clean", "responsibilities_clean", "salary_raw")
    aliases = {"english_level": v.EXTRACTION_ENGLISH_ALIASES, "salary_period": v.EXTRACTION_PERIOD_ALIASES}
    parsed = df.withColumn("_x", F.from_json(json_col, EXTRACTION)).withColumn("_k", F.struct(
        *[squeeze(x[n]).alias(n) for n in texts], _category_key(x["category"]).alias("category"), F.upper(F.trim(x["currency"])).alias("currency"),
        *[_enum_key(x[n], aliases.get(n)).alias(n) for n in ("level", "employment", "work_format", "english_level", "salary_period")],
        *[x[n].try_cast("double").alias(n) for n in ("experience_min", "experience_max")],
        *[x[n].try_cast("double").try_cast("long").alias(n) for n in ("salary_from", "salary_to")]))
    items = lambda col: _some(col, lambda xs: distinct_ignore_case(F.filter(F.transform(xs, _said), lambda i: i.isNotNull())))
    low = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).otherwise(a)
    high = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)).otherwise(b)
    e_lo, e_hi, s_lo, s_hi = (k[n] for n in ("experience_min", "experience_max", "salary_from", "salary_to"))
    negative = F.coalesce(F.least(e_lo, e_hi, s_lo.cast("double"), s_hi.cast("double")) < 0, F.lit(False))
    confidence = F.least(F.greatest(F.coalesce(x["llm_confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    record = F.struct(
        x["id"].alias("id"),
        *[_meant(k[n]).alias(n) for n in texts[:3]],
        _category_of(k["category"]).alias("category"), _one_of(k["level"], v.LEVELS).alias("level"),
        _one_of(k["employment"], v.EMPLOYMENTS).alias("employment"), _one_of(k["work_format"], v.WORK_FORMATS).alias("work_format"),
        low(e_lo, e_hi).alias("experience_min"), high(e_lo, e_hi).alias("experience_max"),
        x["english_mention"].alias("english_mention"), x["english_required"].alias("english_required"),
        _one_of(k["english_level"], v.ENGLISH_LEVELS).alias("english_level"),
        *[_meant(k[n]).alias(n) for n in texts[3:5]],
        *[items(x[n]).alias(n) for n in LIST_FIELDS],
        _meant(k["salary_raw"]).alias("salary_raw"), low(s_lo, s_hi).alias("salary_from"), high(s_lo, s_hi).alias("salary_to"),
        F.when(k["currency"].isin(v.EXTRACTION_CURRENCIES), k["currency"]).otherwise(F.lit("unknown")).alias("currency"),
        _one_of(k["salary_period"], ["hour", "week", "month", "year"]).alias("salary_period"),
        x["salary_gross"].alias("salary_gross"), confidence.alias("llm_confidence"),
    )
    ok = F.coalesce(F.try_parse_json(json_col).isNotNull(), F.lit(False)) & ~negative
    return sealed(parsed, {out: record, "extraction_ok": ok}).drop("_x", "_k")


# Fixed value: amounts of money in running text.
MONEY_IN_TEXT = (
    r"(?iU)\b\d[\d\s,.–—-]*(?:-\s*\d[\d\s,.–—-]*)?\s*(?:₸|тг|тенге|usd|eur|kzt|rub|rur|руб|\$|€|₽)\b"
    r"(?:\s*(?:per|/|в|в\s+месяц|в\s+год|месяц|год|hour|week|month|year))?"
)


def _canon(items: Column, programming: Column) -> Column:
    def name(s: Column) -> Column:
        low = F.lower(s)
        return F.coalesce(lookup(low, v.EXTRACTION_SKILL_ALIASES), F.when((low == "js") & programming, F.lit("JavaScript")), s)

    return F.when(items.isNotNull(), _some(items, lambda xs: distinct_ignore_case(F.filter(F.transform(xs, lambda s: name(squeeze(s))), lambda s: s != ""))))


def sanitize(df: DataFrame, text: str, extraction: str = "extraction") -> DataFrame:
    """City and skills in canonical form; a lost salary text is taken back from the description."""
    e = c(extraction)
    programming = contains_any(F.lower(F.coalesce(c(text), F.lit(""))), v.EXTRACTION_JS_WORDS)
    texts = F.transform(F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(MONEY_IN_TEXT), F.lit(0)), lambda m: F.btrim(m, F.lit(" .,-;:")))
    staged = df.withColumns({"_js": programming, "_money": texts, "_place": F.lower(squeeze(e["city"]))})
    has_raw = (F.length(squeeze(e["salary_raw"])) >= 2) & e["salary_raw"].isNotNull()
    has_any = e["salary_from"].isNotNull() | e["salary_to"].isNotNull() | (e["currency"] != "unknown")

    def fits(m: Column) -> Column:
        digits = F.regexp_replace(m, "\\D+", "")
        near = lambda x: F.coalesce(F.contains(digits, x.cast("string")), F.lit(False))
        named = (e["currency"] == "unknown") | F.contains(F.lower(m), F.lower(e["currency"]))
        return named & (near(e["salary_from"]) | near(e["salary_to"]))

    from_text = F.when(F.size("_money") == 1, F.get("_money", F.lit(0))).otherwise(
        F.coalesce(F.get(F.filter("_money", fits), F.lit(0)), F.get("_money", F.lit(0))))
    city = F.when(F.coalesce(e["city"], F.lit("")) != "", _chain(c("_place"), v.CITY_WORDS, F.lit("other")))
    changed = {
        "city": city, "salary_raw": F.when(~has_raw & has_any, F.coalesce(from_text, e["salary_raw"])).otherwise(e["salary_raw"]),
        **{n: _canon(e[n], c("_js")) for n in LIST_FIELDS},
    }
    out = e
    for name, col in changed.items():
        out = out.withField(name, col)
    return sealed(staged, {extraction: out}).drop("_js", "_money", "_place")


# ---- reconcile --------------------------------------------------------------------------------------

def _missing(value: Column) -> Column:
    return F.coalesce(F.lower(squeeze(value)).isin(MISSING), F.lit(True)) | value.isNull()


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(squeeze(a)) == F.lower(squeeze(b)), F.lit(False)) | F.coalesce(
        a.try_cast("double") == b.try_cast("double"), F.lit(False))


def _as_text(e: Column, field: str) -> Column:
    if field in LIST_FIELDS:
        return F.when(F.size(e[field]) > 0, F.to_json(e[field]))
    return e[field].cast("string")


def reconcile(df: DataFrame, prefill_col: str = "prefill", extraction: str = "extraction") -> DataFrame:
    """Field by field choice between rules and extraction: final_values, final_sources, final_confidence, conflict_flags.

    Rule fields win where a label gave them, and where both differ (then flagged);
    agreement of a weaker rule with the extraction raises the confidence.
    """
    e, no = c(extraction), F.lit(False)
    others = [*EXTRACTOR_FIRST, "english_mention", "english_level"]
    fields = PREFILL_FIELDS + others
    p, ext, no_ext, same, final = (lambda f, kind=kind: c(f"_{kind}_{f}") for kind in ("p", "ext", "no", "same", "final"))

    def pick(value: Column, source: Column, confidence: Column, differs: Column) -> Column:
        return F.struct(value.alias("value"), source.alias("source"), confidence.alias("confidence"), differs.alias("differs"))

    def external(f: str) -> Column:
        return F.when(no_ext(f), pick(ext(f), F.lit("missing"), F.lit("missing"), no)).otherwise(pick(ext(f), F.lit("llm_semantic"), F.lit("medium_confidence"), no))

    def choose(f: str) -> Column:
        level = F.coalesce(p(f)["confidence"], F.lit("missing"))
        return F.when((level == "medium_confidence") & ~no_ext(f) & F.coalesce(same(f), no), pick(ext(f), F.lit("parser_confirmed_by_llm"), F.lit("high_confidence"), no)).when(
            level != "missing", pick(p(f)["value"], p(f)["source"], level, ~no_ext(f) & F.coalesce(~same(f), no))).otherwise(external(f))

    # Both sides of each field, then whether the extraction says something, and whether both say the same where the rules do.
    sides = df.withColumns({f"_ext_{f}": _as_text(e, f) for f in fields} | {f"_p_{f}": c(prefill_col)[f] for f in PREFILL_FIELDS})
    compared = sides.withColumns(
        {f"_no_{f}": _missing(ext(f)) for f in fields}
        | {f"_same_{f}": F.when(F.coalesce(p(f)["confidence"], F.lit("missing")) != "missing", _same(p(f)["value"], ext(f))) for f in PREFILL_FIELDS})
    chosen = sealed(compared, {f"_final_{f}": choose(f) for f in PREFILL_FIELDS} | {f"_final_{f}": external(f) for f in others})
    flags = F.array_compact(F.array(*[F.when(final(f)["differs"], F.lit(f)) for f in sorted(PREFILL_FIELDS)]))
    part = lambda name: F.create_map(*[x for f in fields for x in (F.lit(f), final(f)[name])])
    staged = chosen.withColumn("conflict_flags", flags).withColumns({
        "final_values": part("value"), "final_sources": part("source"), "final_confidence": part("confidence"), "review_flags": c("conflict_flags"),
    })
    return staged.drop(*[x for x in staged.columns if x.startswith(("_ext_", "_p_", "_no_", "_same_", "_final_"))])


def final_record(df: DataFrame, extraction: str = "extraction") -> DataFrame:
    """Chosen values as typed columns, next to the lists and flags of the extraction."""
    e, m = c(extraction), c("final_values")
    kinds = {"salary_from": "long", "salary_to": "long", "experience_min": "double", "experience_max": "double", "english_mention": "boolean"}
    plain = [f for f in PREFILL_FIELDS + EXTRACTOR_FIRST + ["english_mention", "english_level"] if f not in LIST_FIELDS]
    return df.withColumns(
        {f: m[f].try_cast(kinds.get(f, "string")) for f in plain} | {f: e[f] for f in LIST_FIELDS} | {"english_required": e["english_required"]})


# ---- record checks ------------------------------------------------------------------------------------

def validate_record(df: DataFrame) -> DataFrame:
    """Repairs of a reconciled record; every repair is named in validation_fixes."""
    fixes: list[tuple[Column, str]] = []

    def fix(cond: Column, name: str) -> Column:
        cond = F.coalesce(cond, F.lit(False))
        fixes.append((cond, name))
        return cond

    # Both currencies, the city and the lists, each read once.
    empty = F.array().cast("array<string>")
    df = df.withColumns({
        "_cur": F.upper(squeeze(c("currency"))), "_raw": F.upper(squeeze(c("salary_raw"))), "_place": F.lower(squeeze(c("city"))),
        **{f"_{n}": _some(c(n), lambda xs: distinct_ignore_case(F.filter(F.transform(xs, squeeze), lambda x: x != ""))) for n in LIST_FIELDS},
    }).withColumns({"_cur": _chain(c("_cur"), v.PREFILL_CURRENCY_WORDS), "_raw": _chain(c("_raw"), v.PREFILL_CURRENCY_WORDS), "_place": _city(c("_place"))})
    new: dict[str, Column] = {}
    for lo, hi, word in (("salary_from", "salary_to", "salary"), ("experience_min", "experience_max", "experience")):
        a = F.when(~fix(c(lo) < 0, f"{lo}_negative_to_null"), c(lo))
        b = F.when(~fix(c(hi) < 0, f"{hi}_negative_to_null"), c(hi))
        swap = fix(a > b, f"{word}_range_swapped")
        new[lo], new[hi] = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    cur, from_raw = c("_cur"), c("_raw")
    fix(cur.isNull() & from_raw.isNotNull(), "currency_normalized_from_salary_raw")
    new["currency"] = F.coalesce(cur, from_raw)
    silent = c("english_mention") == F.lit(False)
    lost_level = fix(silent & c("english_level").isNotNull() & (c("english_level") != "unknown"), "english_level_reset_without_mention")
    lost_req = fix(silent & (c("english_required") == F.lit(True)), "english_required_reset_without_mention")
    odd = fix(~lost_level & ~c("english_level").isin([*v.ENGLISH_LEVELS, "unknown"]), "english_level_out_of_enum")
    new["english_level"] = F.when(~lost_level & ~odd, c("english_level"))
    new["english_required"] = F.when(lost_req, F.lit(False)).otherwise(c("english_required"))
    for field, allowed in (("employment", v.EMPLOYMENTS), ("work_format", v.WORK_FORMATS)):
        bad = fix(~c(field).isin([*allowed, "unknown"]), f"{field}_out_of_enum")
        new[field] = F.when(bad, F.lit("unknown")).otherwise(c(field))
    city = c("_place")
    moved = fix(city.isNotNull() & (city != c("city")), "city_normalized")
    new["city"] = F.when(moved, city).otherwise(c("city"))
    for field in LIST_FIELDS:
        items = new[field] = c(f"_{field}")
        fix(c(field).isNotNull() & (items != c(field)), f"{field}_deduplicated")
    odd_level = fix((c("employment") == "internship") & ~c("level").isin("intern", "junior", "unknown"), "internship_level_review")
    flags = F.coalesce(c("review_flags"), empty)
    new["review_flags"] = F.array_sort(F.when(odd_level, F.array_union(flags, F.array(F.lit("internship_level_consistency")))).otherwise(flags))
    new["validation_fixes"] = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(n)) for cond, n in fixes]))))
    return sealed(df, new).drop("_cur", "_raw", "_place", *[f"_{n}" for n in LIST_FIELDS])


# ---- confidence and merge --------------------------------------------------------------------------------

# Weight of each signal of an extraction record, with the extra weight for chat sources.
SIGNAL_WEIGHTS = {
    "category": 0.14, "level": 0.07, "title_normalized": 0.08, "company": 0.06, "city": 0.04, "employment": 0.05, "work_format": 0.05,
    "requirements_clean": 0.10, "responsibilities_clean": 0.10, "hard_skills": 0.10, "tech_stack": 0.06, "soft_skills": 0.03, "english": 0.04,
    "experience": 0.04, "salary": 0.04,
}
CHAT_EXTRA = {"company": 0.04, "city": 0.03}
RAW_WEIGHT = 0.03
LOW_CONFIDENCE, REVIEW_CONFIDENCE = 0.65, 0.85


def signals(e: Column) -> dict[str, Column]:
    def text(name: str, n: int = 3) -> Column:
        return F.coalesce(let(squeeze(e[name]), lambda t: (F.length(t) >= n) & ~F.lower(t).isin("unknown", "none", "null", "n/a")), F.lit(False))

    known = lambda name: F.coalesce(e[name] != "unknown", F.lit(False))
    some = lambda name: F.coalesce(F.size(e[name]) > 0, F.lit(False))
    return {
        "title_normalized": text("title_normalized"), "company": text("company"),
        "city": F.coalesce(e["city"].isin("almaty", "astana", "remote"), F.lit(False)),
        "category": known("category"), "level": known("level"), "employment": known("employment"), "work_format": known("work_format"),
        "requirements_clean": text("requirements_clean", 20), "responsibilities_clean": text("responsibilities_clean", 20),
        "hard_skills": some("hard_skills"), "soft_skills": some("soft_skills"), "tech_stack": some("tech_stack"),
        "english": F.coalesce(e["english_mention"], F.lit(False)) | e["english_required"].isNotNull() | known("english_level"),
        "experience": e["experience_min"].isNotNull() | e["experience_max"].isNotNull(),
        "salary": text("salary_raw", 2) | e["salary_from"].isNotNull() | e["salary_to"].isNotNull() | known("currency"),
    }


def confidence(df: DataFrame, source: str = "source", extraction: str = "extraction") -> DataFrame:
    """extraction_confidence (0..1, four decimals), the number of signals and of major signals."""
    e = c(extraction)
    named = signals(e)
    staged = df.withColumn("_s", F.struct(*[x.cast("int").alias(n) for n, x in named.items()]))
    s = c("_s")
    chat = (~c(source).isin(v.STRUCTURED_SOURCES)).cast("int")
    count, score = F.lit(0), F.lit(0.0)
    for n in named:
        count = count + s[n]
        score = score + s[n] * SIGNAL_WEIGHTS[n]
    for n, w in CHAT_EXTRA.items():
        score = score + s[n] * chat * w
    major = s["title_normalized"] + s["company"] + s["category"] + s["requirements_clean"] + s["responsibilities_clean"] + F.greatest(s["hard_skills"], s["tech_stack"])
    base = F.least(F.lit(0.15), count * 0.02) + score
    judged = F.when(major == 0, F.lit(0.0)).when(major == 1, base - 0.12).otherwise(base)
    total = judged + F.least(F.greatest(e["llm_confidence"], F.lit(0.0)), F.lit(1.0)) * RAW_WEIGHT
    return seal(staged, {
        "extraction_confidence": F.bround(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4),
        "signal_count": count.cast("long"), "major_signal_count": major.cast("long"),
    }).drop("_s")


# Text fields that a merge may fill.
MERGE_TEXT = [
    "title_normalized", "company", "city", "category", "level", "employment", "work_format", "english_level", "requirements_clean",
    "responsibilities_clean", "salary_raw", "currency", "salary_period",
]
MERGE_NUMBERS = ["experience_min", "experience_max", "salary_from", "salary_to"]


def merge_if_missing(df: DataFrame, extraction: str = "extraction", low: float = LOW_CONFIDENCE, review: float = REVIEW_CONFIDENCE) -> DataFrame:
    """Fill only what the base row lacks; status, review flag, method and the list of filled fields tell what happened.

    Base columns carry the field names; ``extraction_confidence`` comes from ``confidence``.
    """
    e = c(extraction)

    def gone(x: Column) -> Column:
        return F.coalesce(F.lower(F.trim(x)).isin(v.MISSING_WORDS_EXTRACTION), F.lit(True))

    incoming, lacking, new = {}, {}, {}
    for f in df.columns:
        if f in MERGE_TEXT:
            incoming[f], lacking[f] = ~gone(e[f]), gone(c(f))
        elif f in LIST_FIELDS:
            incoming[f], lacking[f] = F.coalesce(F.size(e[f]) > 0, F.lit(False)), c(f).isNull() | (F.size(f) == 0)
        elif f in MERGE_NUMBERS or f in ("english_required", "salary_gross"):
            incoming[f], lacking[f] = e[f].isNotNull(), c(f).isNull()
        elif f == "english_mention":
            incoming[f], lacking[f] = F.coalesce(e[f], F.lit(False)), ~F.coalesce(c(f), F.lit(False))
    any_incoming = F.lit(False)
    for x in incoming.values():
        any_incoming = any_incoming | x
    skipped = (c("extraction_confidence") < low) & ~any_incoming
    filled = {f: ~skipped & incoming[f] & lacking[f] for f in incoming}
    for f, cond in filled.items():
        new[f] = F.when(cond, e[f].cast(df.schema[f].dataType)).otherwise(c(f))
    new["merged_fields"] = F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(f)) for f, cond in filled.items()])))
    merged = seal(df.withColumn("_skipped", skipped), new)
    changed = F.size("merged_fields") > 0
    flag = ~c("_skipped") & (c("extraction_confidence") < review)
    out = {
        "llm_review_flag": flag,
        "llm_merge_status": F.when(c("_skipped"), "skipped_low_confidence").when(~changed, "no_missing_targets")
        .when(flag, "merged_with_review").otherwise("auto_merged"),
    }
    if "extraction_method" in df.columns:
        method = F.lower(F.trim(F.coalesce("extraction_method", F.lit(""))))
        out["extraction_method"] = F.when(changed, F.when(method.isin("", "nan", "none"), "llm").otherwise("mixed")).otherwise(c("extraction_method"))
    if "llm_confidence" in df.columns:
        out["llm_confidence"] = F.greatest("extraction_confidence", F.coalesce("llm_confidence", F.lit(0.0)))
    if {"salary_from", "salary_to"} <= set(df.columns):
        out["salary_avg"] = average(c("salary_from"), c("salary_to"))
    return merged.withColumns(out).drop("_skipped")


def fill_from(base: DataFrame, ext: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Columns of another table where the base is missing, by id."""
    renamed = ext.select(row_id, *[c(x).alias(f"_n_{x}") for x in cols])
    joined = base.join(renamed, row_id, "left")
    new = {}
    for x in cols:
        text = c(x).cast("string")
        gone = F.coalesce(F.lower(F.trim(text)).isin(v.MISSING_WORDS_EXTRACTION), F.lit(True))
        new[x] = F.when(gone, F.coalesce(c(f"_n_{x}"), c(x))).otherwise(c(x))
    return joined.withColumns(new).drop(*[f"_n_{x}" for x in cols])


def row_diff(before: DataFrame, after: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """(id, patch): new values of the columns that changed, for rows with any change."""
    text = lambda d, x, p: c(f"{p}{x}") if d.schema[x].dataType.simpleString() == "string" else F.to_json(F.struct(c(f"{p}{x}").alias("v")))
    old = before.select(row_id, *[c(x).alias(f"_o_{x}") for x in cols])
    new = after.select(row_id, *[c(x).alias(f"_n_{x}") for x in cols])
    both = old.join(new, row_id)
    pairs = [y for x in cols for y in (F.lit(x), F.struct(
        text(before, x, "_o_").alias("o"), text(after, x, "_n_").alias("n")))]
    changed = F.map_filter(F.create_map(*pairs), lambda k, x: ~x["o"].eqNullSafe(x["n"]))
    patched = both.select(row_id, F.transform_values(changed, lambda k, x: x["n"]).alias("patch"))
    return patched.filter(F.size("patch") > 0)


# ---- report ----------------------------------------------------------------------------------------------

def enrichment_report(
    before: DataFrame, after: DataFrame, tracked: Sequence[str], failure_alarm: float = 0.30,
    hits: Mapping[str, tuple[Column, Mapping[str, Column]]] | None = None,
) -> DataFrame:
    """(section, measure, value): coverage before and after, statuses, per-source counts, hit shares, conflicts, failure alarm.

    ``hits`` names, for each further section, the rows that count (of ``after``) and a condition per field; the value is the percentage
    of the counted rows that meet it, 0 without any. The alarm is 1 if more than ``failure_alarm`` of the rows failed, or if there are
    none. Apart from coverage, all of it comes from one pass with combined sums.
    """
    from postmill.operators.curate import coverage

    row = lambda section, measure, value: F.struct(F.lit(section).alias("section"), measure.alias("measure"), value.cast("double").alias("value"))
    out = coverage(before, tracked).select(F.lit("coverage_before").alias("section"), c("column").alias("measure"), c("coverage_pct").alias("value"))
    out = out.unionByName(coverage(after, tracked).select(
        F.lit("coverage_after").alias("section"), c("column").alias("measure"), c("coverage_pct").alias("value")))
    status = c("llm_merge_status")
    conflicts = F.transform("conflict_flags", lambda f: row("conflicts", f, F.lit(1)))
    of = lambda section, cond: F.when(cond, F.array(row(section, c("source"), F.lit(1)))).otherwise(F.array().cast("array<struct<section:string,measure:string,value:double>>"))
    facts = F.concat(
        F.array(row("status", status, F.lit(1)), row("processed_per_source", c("source"), F.lit(1))),
        of("merged_per_source", F.coalesce(status.isin("auto_merged", "merged_with_review"), F.lit(False))),
        of("failed_per_source", F.coalesce(status == "failed", F.lit(False))), conflicts)
    counted = after.select(F.inline(facts)).groupBy("section", "measure").agg(F.sum("value").alias("value"))
    sums = {("failure", "share"): F.coalesce(F.avg((status == "failed").cast("double")), F.lit(1.0))}
    for section, (counts, fields) in (hits or {}).items():
        n = F.count_if(counts)
        for field, met in fields.items():
            sums[section, field] = F.coalesce(F.try_divide(F.count_if(counts & met) * F.lit(100.0), n.cast("double")), F.lit(0.0))
    one = after.agg(*[col.alias(f"_{k}") for k, col in enumerate(sums.values())])
    shares = F.array(*[row(section, F.lit(measure), c(f"_{k}")) for k, (section, measure) in enumerate(sums)], row("failure", F.lit("alarm"), (c("_0") > failure_alarm).cast("int")))
    return out.unionByName(counted).unionByName(one.select(F.inline(shares)))
