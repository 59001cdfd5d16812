"""Column builders that map free text to closed value sets, and read numbers of years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import vocab as v
from postmill.functions.text import (
    blank_to_null, contains_any, distinct_ignore_case, is_meaningful, let, lookup, normalize_key, squeeze,
)


def first_hit(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column | None = None) -> Column:
    """Value of the first rule one of whose words occurs in the text."""
    def chain(t: Column) -> Column:
        out = F.lit(None).cast("string") if default is None else default
        for value, words in reversed(rules):
            out = F.when(contains_any(t, words), F.lit(value)).otherwise(out)
        return out

    return let(text, chain)


def _enum_key(text: Column) -> Column:
    return let(F.replace(normalize_key(text), F.lit(" "), F.lit("_")), lambda key: F.when(~key.isin(v.MISSING_WORDS), key))


def _enum(text: Column, aliases: dict[str, str], allowed: Sequence[str]) -> Column:
    named = let(_enum_key(text), lambda key: F.coalesce(lookup(key, aliases), key))
    return let(named, lambda value: F.when(value.isin(list(allowed)), value))


def category(text: Column) -> Column:
    return _enum(text, v.CATEGORY_ALIASES, v.CATEGORIES)


def level(text: Column) -> Column:
    return _enum(text, v.LEVEL_ALIASES, v.LEVELS)


def employment(text: Column) -> Column:
    return _enum(text, v.EMPLOYMENT_ALIASES, v.EMPLOYMENTS)


def english_level(text: Column) -> Column:
    return let(_enum_key(text), lambda key: F.when(key.isin(v.ENGLISH_LEVELS), key))


def employment_text(text: Column) -> Column:
    """Ordered containment rules over free text."""
    return first_hit(F.lower(squeeze(text)), v.EMPLOYMENT_WORDS)


def work_format(text: Column) -> Column:
    """Value of a work-format field."""
    return first_hit(_enum_key(text), v.WORK_FORMAT_KEY_WORDS)


def work_format_infer(*texts: Column) -> Column:
    """Format over several free texts: hybrid before remote before office."""
    joined = F.lower(squeeze(F.concat_ws(" ", *texts)))
    return first_hit(joined, v.WORK_FORMAT_WORDS, F.lit("unknown"))


def city(text: Column) -> Column:
    return let(
        F.lower(squeeze(text)),
        lambda t: F.when(~t.isin(v.MISSING_WORDS), first_hit(t, v.CITY_WORDS, F.lit("other"))),
    )


def currency(text: Column, fallback: Column | None = None, rules=None) -> Column:
    """Currency named in the value or the fallback text, by fixed precedence."""
    parts = [squeeze(text)] if fallback is None else [squeeze(text), squeeze(fallback)]
    joined = F.upper(F.concat_ws(" ", *parts))
    return first_hit(joined, rules or v.CURRENCY_WORDS_V1)


def currency_exact(text: Column) -> Column:
    """Whole-value map of a structured source: blank → UNKNOWN, other values as they are."""
    code = F.upper(F.trim(text))
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(
        F.coalesce(lookup(code, v.CURRENCY_ALIASES), code)
    )


YEARS = "(?:года|лет|years?)"


def _pair(text: Column, pattern: str) -> tuple[Column, Column]:
    a = F.regexp_extract(text, pattern, 1).try_cast("int")
    b = F.regexp_extract(text, pattern, 2).try_cast("int")
    return a, b


def _bounds(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("min"), hi.cast("int").alias("max"))


def experience(text: Column) -> Column:
    """Years asked for, as struct<min, max>; the first rule that matches decides."""
    return let(F.lower(squeeze(text)), _years_asked)


def _years_asked(t: Column) -> Column:
    none = F.lit(None).cast("int")
    no_exp = contains_any(t, ["нет опыта", "no experience"])
    more = F.regexp_extract(t, f"(?:более|more than|from)\\s*(\\d+)\\s*{YEARS}", 1).try_cast("int")
    f_lo, f_hi = _pair(t, f"от\\s*(\\d+)\\s*(?:года|лет)?\\s*до\\s*(\\d+)\\s*{YEARS}")
    r_lo, r_hi = _pair(t, f"(\\d+)\\s*(?:[-–—]|до)\\s*(\\d+)\\s*{YEARS}")
    upto = F.regexp_extract(t, f"(?<!от\\s)до\\s*(\\d+)\\s*{YEARS}", 1).try_cast("int")
    one = F.regexp_extract(t, f"(\\d+)\\s*{YEARS}", 1).try_cast("int")
    b_lo, b_hi = _pair(t, "(\\d+)\\s*[-–—]\\s*(\\d+)")

    def ranged(lo: Column, hi: Column) -> tuple[Column, Column]:
        return (lo <= 50) & (hi <= 50), _bounds(F.least(lo, hi), F.greatest(lo, hi))

    f_ok, f_val = ranged(f_lo, f_hi)
    r_ok, r_val = ranged(r_lo, r_hi)
    b_ok, b_val = ranged(b_lo, b_hi)
    single = (
        F.when(contains_any(t, ["от", "from"]), _bounds(one, none))
        .when(contains_any(t, ["до", "up to"]), _bounds(F.lit(0), one))
        .otherwise(_bounds(one, one))
    )
    return (
        F.when(F.length(t) < 2, _bounds(none, none))
        .when(no_exp, _bounds(F.lit(0), F.lit(0)))
        .when(more.isNotNull(), _bounds(more, none))
        .when(f_ok, f_val)
        .when(r_ok, r_val)
        .when(upto.isNotNull(), _bounds(F.lit(0), upto))
        .when(one <= 50, single)
        .when(b_ok, b_val)
        .otherwise(_bounds(none, none))
    )


def english_signals(*texts: Column) -> Column:
    """struct<mention, required, level> over several texts; the highest level token wins."""
    def read(t: Column) -> Column:
        mention = contains_any(t, v.ENGLISH_WORDS)
        required = mention & contains_any(t, v.ENGLISH_REQUIRED_WORDS)
        lvl = first_hit(t, [(x.upper(), [x]) for x in ("c2", "c1", "b2", "b1", "a2", "a1")])
        return F.struct(mention.alias("mention"), required.alias("required"), lvl.alias("level"))

    return let(F.lower(squeeze(F.concat_ws(" ", *texts))), read)


def average(lo: Column, hi: Column) -> Column:
    """Mean of both bounds, else the one that is there."""
    lo, hi = lo.cast("double"), hi.cast("double")
    return F.coalesce((lo + hi) / 2, lo, hi)


def salary_text_simple(text: Column) -> Column:
    """First salary parser: struct<from, to, avg, currency>. Word tests hit inside words, as published."""
    return let(F.lower(squeeze(text)), _simple_salary)


def _simple_salary(t: Column) -> Column:
    absent = t.isin("", "не указана", "not specified", "n/a")
    found = F.transform(
        F.regexp_extract_all(t, F.lit("(\\d[\\d ]+)"), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("long")
    )
    upper_word = contains_any(t, ["до", "to"]) & ~contains_any(t, ["от", "from"])

    def bounds(numbers: Column) -> Column:
        n, a, b = F.size(numbers), F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        upper_only = (n == 1) & upper_word
        return F.struct(
            F.when(~absent & (n >= 2), F.least(a, b)).when(~absent & (n == 1) & ~upper_only, a).alias("lo"),
            F.when(~absent & (n >= 2), F.greatest(a, b)).when(~absent & upper_only, a).alias("hi"),
        )

    code = F.when(absent, F.lit("UNKNOWN")).otherwise(first_hit(t, v.CURRENCY_WORDS_SIMPLE, F.lit("UNKNOWN")))
    return let(let(F.filter(found, lambda x: x.isNotNull()), bounds), lambda s: F.struct(
        s["lo"].alias("from"), s["hi"].alias("to"), average(s["lo"], s["hi"]).alias("avg"), code.alias("currency")))


def url_id(url: Column, prefix: str) -> Column:
    """Trailing number of the URL, else the slug after /vacancy/, else prefix and a hash."""
    u = F.trim(url)
    digits = blank_to_null(F.regexp_extract(u, "-(\\d+)(?:[/?#]|$)", 1))
    slug = blank_to_null(F.regexp_extract(u, "/vacancy/([^/?#]+)", 1))
    hashed = F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(F.lower(u)), 1, 12))
    return F.when(F.coalesce(u, F.lit("")) != "", F.coalesce(digits, slug, hashed))


def canonical_skill(skill: Column, programming: Column) -> Column:
    """Canonical spelling; ``js`` needs a programming context; short upper-case words stay."""
    def name(raw: Column) -> Column:
        low = F.lower(raw)
        upper_short = (F.length(raw) <= 4) & (F.upper(raw) == raw) & (low != raw)
        return F.when(~low.isin(v.MISSING_WORDS), F.coalesce(
            lookup(low, v.SKILL_ALIASES),
            F.when(low == "js", F.when(programming, F.lit("JavaScript")).otherwise(F.lit("JS"))),
            F.when(upper_short, raw),
            lookup(low, v.SKILL_TITLES),
            raw,
        ))

    return let(squeeze(skill), name)


def canonical_skills(items: Column, programming: Column) -> Column:
    """Canonical names of a list, distinct ignoring case; the context flag is worked out once."""
    return let(programming, lambda js: distinct_ignore_case(
        F.filter(F.transform(items, lambda x: canonical_skill(x, js)), lambda x: x.isNotNull())))


def programming_context(context: Column) -> Column:
    return contains_any(F.lower(context), v.JS_CONTEXT_WORDS)


def top_family(skills: Column) -> Column:
    """Most common family of a list; ties go to the family seen first."""
    def most_common(fam: Column) -> Column:
        counted = F.transform(F.array_distinct(fam), lambda f: F.struct(
            F.size(F.filter(fam, lambda g: g == f)).alias("n"), (-F.array_position(fam, f)).alias("p"), f.alias("f")))
        return F.array_max(counted)["f"]

    return let(F.transform(skills, lambda s: F.coalesce(lookup(s, v.SKILL_FAMILIES), F.lit("other"))), most_common)


def infer_category(existing: Column, text: Column, skills: Column) -> Column:
    """struct<value, source, confidence>: additive keyword scores, best at least 4 and 2 ahead."""
    scored = let(F.lower(text), lambda low: let(F.transform(skills, lambda s: F.lower(s)), lambda ss: _category_scores(low, ss)))

    def result(value: Column, source: Column, conf: Column) -> Column:
        return F.struct(value.alias("value"), source.alias("source"), conf.alias("confidence"))

    def decide(ranked: Column) -> Column:
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        high = best["s"] >= 6
        return F.when((best["s"] >= 4) & (best["s"] - second["s"] >= 2), result(
            best["c"],
            F.when(high, F.lit("rule_based_high")).otherwise(F.lit("rule_based_medium")),
            F.when(high, F.lit(0.9)).otherwise(F.lit(0.78)),
        )).otherwise(result(F.lit(None).cast("string"), F.lit("unresolved"), F.lit(0.0)))

    return F.when(is_meaningful(existing), result(existing, F.lit("existing_valid"), F.lit(1.0))).otherwise(let(scored, decide))


def _category_scores(low: Column, low_skills: Column) -> Column:
    """Categories by score, then by rule order: array<struct<s, o, c>>."""
    points: dict[str, Column] = {}
    order = [c for c, _, _ in v.CATEGORY_TEXT_RULES]
    for cat, weight, words in v.CATEGORY_TEXT_RULES:
        points[cat] = F.when(contains_any(low, words), F.lit(weight)).otherwise(F.lit(0))
    for cat, weight, words in v.CATEGORY_SKILL_RULES:
        hit = F.arrays_overlap(low_skills, F.array(*[F.lit(w) for w in words]))
        points[cat] = points[cat] + F.when(hit, F.lit(weight)).otherwise(F.lit(0))
    return F.sort_array(
        F.array(*[F.struct(points[c].alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(order)]), asc=False
    )


INTERN = r"(?iU)\b(intern|internship|trainee)\b|стаж[её]р|стажировка"
JUNIOR = r"(?iU)\b(junior|jr)\b|начинающ"
MIDDLE = r"(?iU)\b(middle|mid-level)\b"
SENIOR = r"(?iU)\b(senior|sr)\b"


def infer_level(existing: Column, title: Column, text: Column, experience_min: Column) -> Column:
    """struct<value, source, confidence>: existing, then title, text and experience rules in order."""
    low = lambda y: F.lower(F.coalesce(y, F.lit("")))
    return let(low(title), lambda t: let(low(text), lambda x: _level(existing, t, x, experience_min.cast("double"))))


def _level(existing: Column, t: Column, x: Column, e: Column) -> Column:
    rules = [
        (is_meaningful(existing), existing, "existing_valid", 1.0),
        (t.rlike(INTERN), "intern", "title_rule_high", 0.95),
        (contains_any(t, ["lead", "tech lead", "team lead", "руководитель группы"]), "lead", "title_rule_high", 0.95),
        (t.rlike(SENIOR), "senior", "title_rule_high", 0.95),
        (t.rlike(JUNIOR), "junior", "title_rule_high", 0.95),
        (t.rlike(MIDDLE), "middle", "title_rule_high", 0.95),
        (contains_any(t, ["head of", "director", "chief", "начальник", "руководитель", "engineering manager"]),
         "manager", "title_rule_high", 0.92),
        (x.rlike(INTERN), "intern", "text_rule_medium", 0.82),
        (x.rlike(JUNIOR) | contains_any(x, ["0-1 year", "0–1", "0-1"]), "junior", "text_rule_medium", 0.8),
        (x.rlike(MIDDLE) | contains_any(x, ["2-4 years", "2–4"]), "middle", "text_rule_medium", 0.8),
        (x.rlike(SENIOR) | contains_any(x, ["5+ years", "5 years", "более 5 лет"]), "senior", "text_rule_medium", 0.82),
        ((e > 0) & (e <= 1), "junior", "experience_rule_medium", 0.72),
        (e.between(2, 4), "middle", "experience_rule_medium", 0.72),
        (e >= 5, "senior", "experience_rule_medium", 0.74),
    ]
    out = F.struct(F.lit(None).cast("string").alias("value"), F.lit("unresolved").alias("source"), F.lit(0.0).alias("confidence"))
    for cond, value, source, conf in reversed(rules):
        val = value if isinstance(value, Column) else F.lit(value)
        hit = F.struct(val.alias("value"), F.lit(source).alias("source"), F.lit(conf).alias("confidence"))
        out = F.when(cond, hit).otherwise(out)
    return out
