"""Column builders for titles, companies, message headers and description text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import vocab as v
from postmill.functions.classify import city
from postmill.functions.money import PHONE_LOOSE
from postmill.functions.text import SPACES, blank_to_null, contains_any, is_meaningful, let, lookup, normalize_key, squeeze, unescape

DASHES = " -–—"


def words(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def starts_with_any(text: Column, starts: list[str]) -> Column:
    hit = F.lit(False)
    for s in starts:
        hit = hit | text.startswith(s)
    return hit


# ---- titles --------------------------------------------------------------------

def clean_title(text: Column) -> Column:
    t = F.regexp_replace(squeeze(text), r"(?iu)^(vacancy|вакансия|позиция|role)\s*[:\-]\s*", "")
    t = F.btrim(F.regexp_replace(t, "[|]{2,}", " "), F.lit(DASHES))
    return F.when(is_meaningful(text, 2), blank_to_null(t))


def title_variant(title: Column) -> Column:
    """Collapse to a standard title unless the text carries stack or seniority detail."""
    def variant(t: Column) -> Column:
        out = t
        for name, pattern in reversed(v.TITLE_VARIANTS):
            out = F.when(t.rlike("(?iU)" + pattern), F.lit(name)).otherwise(out)
        keep = let(F.lower(t), lambda low: contains_any(low, v.TITLE_KEEP_WORDS))
        return F.when(is_meaningful(t, 2), F.when(keep, t).otherwise(out))

    return let(title, variant)


def title_ok(text: Column) -> Column:
    def ok(low: Column) -> Column:
        bad = (
            low.isin(v.TITLE_BAD_WORDS)
            | ((words(low) == 1) & low.isin(v.TITLE_BAD_ALONE))
            | contains_any(low, v.TITLE_BAD_PARTS)
            | starts_with_any(low, v.TITLE_BAD_STARTS)
        )
        return (F.length(low) >= 3) & ~low.isin(v.MISSING_WORDS) & ~bad

    return let(F.lower(squeeze(text)), ok)


def header_title(text: Column) -> Column:
    def tail_cut(cleaned: Column) -> Column:
        t = F.trim(F.regexp_replace(squeeze(cleaned), r"(?iU)\s+(?:АО|ТОО|ИП|JSC|LLP)\b.*$", ""))
        t = F.btrim(F.regexp_replace(t, r"(?iU)\b(казахстан|г\.)\b.*$", ""), F.lit(DASHES + ","))
        return let(t, lambda x: F.when(title_ok(cleaned) & title_ok(x), x))

    return let(clean_title(text), tail_cut)


# ---- companies -------------------------------------------------------------------

def clean_company(text: Column) -> Column:
    t = F.btrim(F.regexp_replace(squeeze(text), r"(?iu)^(компания|company)\s*[:\-]\s*", ""), F.lit(DASHES))
    named = let(t, lambda x: F.coalesce(lookup(normalize_key(x), v.COMPANY_ALIASES), x))
    return F.when(is_meaningful(text, 2), named)


def header_company(text: Column) -> Column:
    t = F.trim(F.regexp_replace(squeeze(clean_company(text)), r"(?iU)\s+(ищет|в команду|на позицию|требуется)\b.*$", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)\s+https?://\S+$", ""))
    return let(t, lambda x: F.when(is_meaningful(x, 2) & (words(x) <= 12), x))


def company_suspicious(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    odd = (
        (F.length(t) > 120)
        | (F.regexp_count(t, F.lit("[.!?]")) >= 2)
        | (F.regexp_count(t, F.lit("[,:;!?()]")) >= 8)
        | t.rlike(rf"(?iU)\b{v.CONTACT_WORDS}\b")
        | t.rlike(PHONE_LOOSE)
        | (words(squeeze(t)) > 20)
    )
    return is_meaningful(text, 2) & odd


# ---- description -------------------------------------------------------------------

# Patterns of contacts and signs that are taken out of descriptions.
URL = r"(?iu)https?://\S+|www\.\S+|t\.me/\S+|telegram\.me/\S+"
EMAIL_ADDRESS = r"(?U)\b[\w.\-+%]+@[\w.\-]+\.[A-Za-z]{2,}\b"
HANDLE = r"(?U)(?<!\w)@\w{3,}"
HASHTAG = r"(?U)(?<!\w)#[\w\-_А-Яа-яЁё]+"
EMOJI = "[\\x{1F300}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}]"


def clean_description(text: Column) -> Column:
    """struct<text, changed, length, removed>: markup, contacts, emojis and promo phrases removed.

    A result under 20 characters falls back to the squeezed original.
    """
    return let(text, lambda x: let(unescape(x), lambda original: _clean_description(x, original)))


def _blank_out(pattern: str, sign: str, text: Column) -> Column:
    return F.when(F.contains(text, F.lit(sign)), F.regexp_replace(text, pattern, " ")).otherwise(text)


def _clean_description(text: Column, original: Column) -> Column:
    t = F.translate(original, "\r", "\n")
    # The cheap substring test spares most texts the pattern.
    for pattern, sign in (("<[^>]+>", "<"), (URL, "."), (EMAIL_ADDRESS, "@"), (HANDLE, "@"), (HASHTAG, "#")):
        t = let(t, partial(_blank_out, pattern, sign))
    lines = F.filter(F.transform(F.split(t, "\n+"), lambda x: squeeze(x)), lambda x: x != "")
    contact = rf"(?iU)\b{v.CONTACT_WORDS}\b"
    kept_lines = F.filter(lines, lambda x: ~(x.rlike(contact) & (
        x.rlike(r"\+?\d[\d\-\s()]{7,}\d") | x.rlike(EMAIL_ADDRESS) | x.rlike(HANDLE) | x.rlike(r"(?i)https?://\S+|www\.\S+"))))
    no_lines = t
    t = let(kept_lines, lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(no_lines))
    t = F.regexp_replace(t, rf"(?iU)\b{v.CONTACT_CLAUSE_WORDS}\b[:\s\-]{{0,5}}[^\n.;]{{0,180}}", " ")
    t = F.regexp_replace(t, PHONE_LOOSE, " ")
    t = F.regexp_replace(t, EMOJI, " ")
    t = F.regexp_replace(t, "(?iU)" + "|".join(v.PROMO_PHRASES), " ")
    t = F.regexp_replace(t, "[•▪◾◆▶➤✔✅]+|[|]{2,}", " ")
    t = F.regexp_replace(t, "(?U)\\s*([,:;])\\s*", "$1 ")
    t = F.btrim(F.regexp_replace(t, SPACES, " "), F.lit(" -–—\n\t"))

    def result(plain: Column, final: Column) -> Column:
        return F.struct(
            blank_to_null(final).alias("text"), (final != plain).alias("changed"), F.length(final).cast("long").alias("length"),
            F.greatest(F.length(original) - F.length(final), F.lit(0)).cast("long").alias("removed"),
        )

    nothing = F.struct(
        F.lit(None).cast("string").alias("text"), F.lit(False).alias("changed"),
        F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("removed"),
    )
    cleaned = let(squeeze(original), lambda plain: let(
        let(t, lambda x: F.when(is_meaningful(x, 20), x).otherwise(plain)), lambda final: result(plain, final)))
    return F.when(is_meaningful(text, 5), cleaned).otherwise(nothing)


# ---- headers -------------------------------------------------------------------------

# Words that begin a section of a message.
SECTIONS = [
    r"\bтребования\s*[:\-]",
    r"\bобязанности\s*[:\-]",
    r"\bусловия\s*[:\-]",
    r"\brequirements\s*[:\-]",
    r"\bresponsibilities\s*[:\-]",
    r"\babout the role\b",
]
SECTION_WORDS = "(?iU)" + "|".join(SECTIONS)


def header_window(text: Column, max_len: int = 900) -> Column:
    """First four lines up to the first section word, squeezed, at most ``max_len`` characters (published: 900)."""
    head = let(F.translate(text, "\r", "\n"), lambda t: let(
        F.regexp_instr(t, F.lit(SECTION_WORDS)), lambda at: F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)))
    lines = F.slice(F.split(head, "\n"), 1, 4)
    one = F.array_join(F.filter(F.transform(lines, lambda x: squeeze(x)), lambda x: x != ""), " ")
    return F.when(is_meaningful(text, 10), F.substring(one, 1, max_len)).otherwise(F.lit(""))


_T = r"[A-Za-zА-Яа-я0-9+/#().,\- ]"
_C = r'[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё0-9&"«»()./\-+ ]'
_CITY = "Алматы|Астана|Нур-Султан|Nur-Sultan"

# Header patterns in match order: name, confidence, pattern, group numbers of title, company and city.
HEADER_PATTERNS = [
    ("title_city_company_is_hiring", 0.95,
     r'(?iU)^(.+?)\s*\(\s*([^)]+)\s*\)\s*((?:АО|ТОО|ИП|JSC|LLP)\s*["«][^"»]+["»]|[^.]{3,120}?)\s+ищет\b', 1, 3, 2),
    ("title_company_city_salary", 0.9,
     rf"(?iU)^({_T}{{4,120}}?)\s+({_C}{{2,80}}?)\s+({_CITY})\b.*?(?:\bЗП\b|\bзарплата\b|\bsalary\b)", 1, 2, 3),
    ("labeled_title_company_city", 0.97,
     r"(?isU)(?:должность|вакансия)\s*:\s*(.+?)\s+(?:компания)\s*:\s*(.+?)\s+(?:город|локация|location)\s*:\s*(.+?)"
     r"(?:\s+(?:формат|занятость|оплата|зарплата)\s*:|$)", 1, 2, 3),
    ("company_hiring_for_position", 0.88,
     rf"(?isU)(?:компания\s+)?([^.]{{2,120}}?)\s+ищет\b.+?\b(?:на\s+позицию|позиция|вакансия)\s*[:\-]?\s*({_T}{{4,120}})", 2, 1, 0),
    ("company_searching_for_title", 0.9,
     rf"(?isU)(?:команда|company|компания)\s+([^.]{{2,120}}?)\s+(?:в\s+поисках|ищет)\s+({_T}{{4,120}})", 2, 1, 0),
    ("vacancy_company_location", 0.97,
     r"(?isU)(?:вакансия)\s*:\s*(.+?)\s+(?:компания)\s*:\s*(.+?)\s+(?:локация|город|location)\s*:\s*(.+?)"
     r"(?:\s+(?:формат|занятость|зарплата)\s*:|$)", 1, 2, 3),
    ("title_company_location", 0.94,
     r"(?isU)^(.+?)\s+(?:компания)\s*:\s*(.+?)\s+(?:локация|город|location)\s*:\s*(.+?)"
     r"(?:\s+(?:формат|занятость|зарплата|резюме)\b|$)", 1, 2, 3),
    ("title_comma_company", 0.86,
     rf"(?iU)^([^,|]{{4,120}})\s*,\s*({_C}{{1,80}})"
     r"(?:\s*(?:\||г\.|алматы|астана|нур-султан|location|локация|зарплата|зп|основные)\b|$)", 1, 2, 0),
    ("title_pipe_city", 0.84, rf"(?iU)^([^|]{{4,120}})\|\s*({_CITY})\b", 1, 0, 2),
    ("company_hiring_title_inline", 0.84,
     r"(?isU)(?:компания\s+)?([^.]{2,120}?)\s+ищет\b.{0,80}?\b"
     r"((?:backend|frontend|fullstack|java|python|golang|go|qa|devops|data|system|business|product|mobile|android|ios|ml)"
     r"[^.!?]{0,80}?(?:разработчик|developer|engineer|аналитик|designer|manager))\b", 2, 1, 0),
    ("company_requires_title", 0.88,
     rf"(?isU)(?:компания\s+)?([^.]{{2,120}}?)\s+(?:требуется|требуются|нужен|нужна)\s*[:\-]?\s*({_T}{{4,120}})", 2, 1, 0),
    ("title_before_header_labels", 0.82,
     rf"(?isU)^({_T}{{4,120}}?)\s+(?:формат|резюме|локация|город|location|зарплатная\s+вилка|зп)\b", 1, 0, 0),
    ("required_title_only", 0.83,
     rf"(?isU)^(?:требуется|нужен|нужна|ищем)\s+({_T}{{4,120}}?)(?:\s+(?:в|на)\s+(?:команду|позицию)\b|[.!?]|$)", 1, 0, 0),
    ("looking_for_title", 0.8,
     rf"(?isU)(?:мы\s+ищем|ищем|we are looking for)\s+({_T}{{4,120}}?)(?:\s+в\s+нашу\s+команду|\!|\.|$)", 1, -1, 0),
    ("company_hiring_only", 0.8, r"(?isU)(?:компания\s+)?([^.]{2,120}?)\s+ищет\b", 0, 1, 0),
]
# Fixed value: a company by its legal form.
LEGAL_FORM = r'(?isU)(?:т[оo]{2}|ао|ип)\s*["«]?[A-Za-zА-Яа-яЁё0-9&"«»()./\-+ ]{2,90}'


def header_pattern(header: Column) -> Column:
    """Name of the first header pattern that matches, or no_match."""
    out = F.lit("no_match")
    for name, _, pattern, *_ in reversed(HEADER_PATTERNS):
        out = F.when(header.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(header == "", F.lit("no_match")).otherwise(out)


def header_fields(header: Column, name: Column) -> dict[str, Column]:
    """Cleaned title, company and city, and the confidence, for a header whose pattern is known."""
    title = company = place = F.lit(None).cast("string")
    confidence = F.lit(0.0)
    for pattern_name, conf, pattern, t, c, p in reversed(HEADER_PATTERNS):
        mine = name == pattern_name
        if t:
            title = F.when(mine, F.regexp_extract(header, pattern, t)).otherwise(title)
        if c > 0:
            company = F.when(mine, F.regexp_extract(header, pattern, c)).otherwise(company)
        if c < 0:
            company = F.when(mine, F.regexp_extract(header, LEGAL_FORM, 0)).otherwise(company)
        if p:
            place = F.when(mine, F.regexp_extract(header, pattern, p)).otherwise(place)
        confidence = F.when(mine, F.lit(conf)).otherwise(confidence)
    return {"title": title, "company": company, "city": place, "confidence": confidence}


def header_city(text: Column) -> Column:
    return city(text)


# Titles named in the running text.
TITLE_IN_TEXT = [
    rf"(?iu)(?:ищем|нужен|нужна|требуется|vacancy|position|role)\s+({_T}{{4,80}})",
    rf"(?iU)\b({_T}{{4,80}})\s+(?:в команду|to join the team)\b",
]


def title_from_description(text: Column, parsed_title: Column) -> Column:
    """Title named in a description: header, then two phrases, then a short first sentence with a role word."""
    valid = lambda t: let(clean_title(t), lambda x: F.when(title_ok(x), x))
    options = [F.when(title_ok(parsed_title), parsed_title)]
    options += [valid(F.regexp_extract(text, pattern, 1)) for pattern in TITLE_IN_TEXT]
    options.append(let(F.get(F.split(text, "[.!?\\n]", 2), F.lit(0)), lambda s: F.when(
        (words(squeeze(s)) <= 10) & contains_any(F.lower(s), v.TITLE_SENTENCE_WORDS), valid(s))))
    return F.when(is_meaningful(text, 20), F.coalesce(*options))
