"""Column builders for amounts of money in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import let, squeeze
from postmill.functions.vocab import SALARY_OUTLIER

# Patterns of the salary readers.
MILLION_WORDS = ["млн", "миллион", "миллиона", "миллионов", "million", "mln", "m"]
THOUSAND_WORDS = ["k", "к", "тыс", "тысяч", "thousand"]
AMOUNT_V1 = r"(?iu)(?<!\d)(\d{1,3}(?:[ \xA0]?\d{3})+|\d+(?:[.,]\d+)?)\s*(млн|миллион(?:а|ов)?|million|тыс|тысяч|thousand|k|к|m)?"
AMOUNT_V3 = (
    r"(?iu)([€$£₸]?\s*\d[\d\s\xA0.,]{0,18}\d|\d)"
    r"(?:\s*(млн\.?|миллион(?:а|ов)?|million|mln|тыс\.?|тысяч|thousand|k(?![a-z])|к(?![а-яa-z])|m(?![a-z])))?"
)
RANGE_SEPARATOR = r"(?iU)[-–—]|\bto\b|\bдо\b"
LOWER_BOUND = r"(?iU)\b(from|от|starting from|upwards of)\b"
UPPER_BOUND = r"(?iU)\b(to|до|up to|не более)\b"
PERIODS = [
    ("hour", r"(?iu)(per hour|/ ?hour|в ?час|/ ?час|hourly|в час)"),
    ("day", r"(?iu)(per day|/ ?day|p/day|в день|за день|daily)"),
    ("year", r"(?iu)(per year|per annum|/ ?year|год(?:овых|овая|овой)?|в год|annual|annum)"),
    ("month", r"(?iU)(per month|/ ?month|/ ?mo\b|/ ?мес|в месяц|monthly|month)"),
]
SALARY_BOUNDARY = (
    r"(?iU)\b(company|requirements|responsibilities|about|english|location|format|experience|skills|contacts?|"
    r"компания|требован|обязанност|формат|город|опыт|навык|контакт|резюме|почта|email|e-mail)\b|https?://|www\.|@\w+"
)
SALARY_KEYWORD = r"(?iU)\b(зарплата|salary|оклад|salary range|salary fork|salary estimate)\b"
SALARY_CONTEXT = (
    r"(?iU)\b(зарплата|salary|оклад|salary range|salary fork|salary estimate|зп|на руки|gross|net|тенге|usd|eur|gbp|руб|₸|\$|€|£)\b"
)
CURRENCY_WINDOW = (
    r"(?iu)(?:[$€£₸]|usd|eur|gbp|kzt|тг|тенге|руб)[^\n]{0,80}\d|\d[^\n]{0,80}(?:[$€£₸]|usd|eur|gbp|kzt|тг|тенге|руб)"
)
CONTACT_WORD = r"(?iU)\b(контакт[ыа]?|contact|contacts|whatsapp|telegram|tg|phone|tel|direct|email|e-mail|send cv|resume|резюме)\b"
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?\d[\d\-\s()]{8,}\d)(?!\d)"
PHONE_LOOSE = r"\+?\d[\d\-\s()]{8,}\d"
BONUS_WORD = r"(?iU)\b(bonus|allowance|equity|stock|kpi|gross \+|net \+|преми|бонус)\b"
VARIANT_WORD = r"(?iU)\b(junior|middle|senior|lead|intern|part-time|full-time|contract|day|hour|year|annum)\b"
VARIANT_JOIN = r"(?iU)(?:\bor\b|или|/)"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "\\D", "")


def phone_digits(digits: Column) -> Column:
    return F.length(digits).isin(10, 11) & F.substring(digits, 1, 1).isin("7", "8")


def phone_like(value: Column) -> Column:
    """A number whose whole part looks like a phone number."""
    return F.coalesce(phone_digits(digits_of(F.floor(value.cast("double")).cast("decimal(38,0)").cast("string"))), F.lit(False))


def unit_factor(unit: Column) -> Column:
    word = F.rtrim(F.lower(F.trim(unit)), F.lit("."))
    return F.when(word.isin(MILLION_WORDS), 1_000_000).when(word.isin(THOUSAND_WORDS), 1_000).otherwise(1)


def amounts_v1(text: Column) -> Column:
    """Amounts of a text in order, units applied, phone-like numbers left out."""
    raw = F.regexp_extract_all(text, F.lit(AMOUNT_V1), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(AMOUNT_V1), F.lit(2))
    pairs = F.arrays_zip(raw.alias("num"), units.alias("unit"))
    kept = F.filter(pairs, lambda p: ~(phone_digits(digits_of(p["num"])) & (F.trim(p["unit"]) == "")))
    values = F.transform(
        kept,
        lambda p: F.translate(F.regexp_replace(p["num"], "[ \\u00A0]", ""), ",", ".").try_cast("double") * unit_factor(p["unit"]),
    )
    return F.filter(values, lambda x: x.isNotNull())


def locale_number(text: Column) -> Column:
    """Number with blanks, commas or dots as thousands or decimal signs."""
    return let(F.regexp_replace(text, "[€$£₸\\s\\u00A0]", ""), _locale_number)


def _locale_number(compact: Column) -> Column:
    no_comma, no_dot = F.replace(compact, F.lit(","), F.lit("")), F.replace(compact, F.lit("."), F.lit(""))
    bare = F.regexp_replace(compact, "[.,]", "")
    has_comma, has_dot = F.contains(compact, F.lit(",")), F.contains(compact, F.lit("."))
    dot_decimal = compact.rlike("^\\d{1,3}(?:,\\d{3})+(?:\\.\\d{1,2})?$")
    comma_decimal = compact.rlike("^\\d{1,3}(?:\\.\\d{3})+(?:,\\d{1,2})?$")
    plain = (
        F.when(has_comma & has_dot, F.when(dot_decimal, no_comma).when(
            comma_decimal, F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(bare))
        .when(has_comma, F.when(compact.rlike("^\\d+,\\d{1,2}$"), F.replace(compact, F.lit(","), F.lit("."))).otherwise(bare))
        .when(has_dot, F.when(compact.rlike("^\\d+\\.\\d{1,2}$"), compact).otherwise(bare))
        .otherwise(compact)
    )
    return plain.try_cast("double")


TOKEN = "array<struct<value:double,factor:int,explicit:boolean,gap:string>>"


def amount_tokens(text: Column) -> Column:
    """Amounts with their unit factor, in order: array<struct<value, factor, explicit, gap>>.

    ``gap`` is the text since the previous amount. Units pass to a unit-less
    neighbour across a range sign, and ``1 mln 200 k`` becomes one amount.
    """
    whole = F.regexp_extract_all(text, F.lit(AMOUNT_V3), F.lit(0))
    nums = F.regexp_extract_all(text, F.lit(AMOUNT_V3), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(AMOUNT_V3), F.lit(2))
    gaps = F.slice(F.split(text, AMOUNT_V3, -1), F.lit(1), F.size(whole))
    parts = F.arrays_zip(whole.alias("raw"), nums.alias("num"), units.alias("unit"), gaps.alias("gap"))
    read = F.transform(parts, lambda p: F.struct(
        (locale_number(p["num"]) * unit_factor(p["unit"])).alias("value"),
        unit_factor(p["unit"]).alias("factor"), p["num"].alias("num"), p["raw"].alias("raw"), p["gap"].alias("gap"),
    ))

    def keep(acc: Column, p: Column) -> Column:
        """Left-out amounts become part of the gap before the next one."""
        gap = F.concat(acc["pending"], p["gap"])
        phone = phone_digits(digits_of(p["num"])) & (p["factor"] == 1)
        ok = p["value"].isNotNull() & (p["value"] > 0) & ~phone
        token = F.struct(p["value"].alias("value"), p["factor"].alias("factor"), (p["factor"] > 1).alias("explicit"), gap.alias("gap"))
        return F.struct(
            F.when(ok, F.concat(acc["out"], F.array(token))).otherwise(acc["out"]).cast(TOKEN).alias("out"),
            F.when(ok, F.lit("")).otherwise(F.concat(gap, p["raw"])).alias("pending"),
        )

    start = F.struct(F.array().cast(TOKEN).alias("out"), F.lit("").alias("pending"))
    kept = F.aggregate(read, start, keep, lambda acc: acc["out"])
    return let(let(kept, _spread_units), _merge_units)


def _joins(gap: Column) -> Column:
    return let(F.lower(squeeze(gap)), lambda g: g.rlike(RANGE_SEPARATOR) | g.isin("", "and", "&", ",", "/"))


def _spread_units(tokens: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
        left = F.when(before["explicit"] & _joins(t["gap"]), before["factor"])
        right = F.when(after["explicit"] & _joins(after["gap"]), after["factor"])
        factor = F.greatest(left, right)
        factor = F.when((factor == 1_000_000) & (t["value"] >= 100), 1_000).otherwise(factor)
        takes = ~t["explicit"] & (t["value"] < 10_000) & factor.isNotNull()
        return F.struct(
            F.when(takes, t["value"] * factor).otherwise(t["value"]).alias("value"),
            F.when(takes, factor).otherwise(t["factor"]).cast("int").alias("factor"),
            t["explicit"].alias("explicit"), t["gap"].alias("gap"),
        )

    return F.transform(tokens, one)


def _merge_units(tokens: Column) -> Column:
    def merges(a: Column, b: Column) -> Column:
        g = F.lower(squeeze(b["gap"]))
        return F.coalesce(
            a["explicit"] & b["explicit"] & (a["factor"] == 1_000_000) & (b["factor"] == 1_000)
            & ~g.rlike(RANGE_SEPARATOR) & g.rlike("^[\\s,./+()a-zа-я-]*$"), F.lit(False))

    def one(t: Column, i: Column) -> Column:
        nxt = F.get(tokens, i + 1)
        absorbed = (i > 0) & merges(F.get(tokens, i - 1), t)
        return F.struct(
            F.when(merges(t, nxt), t["value"] + nxt["value"]).otherwise(t["value"]).alias("value"),
            t["factor"].alias("factor"), t["explicit"].alias("explicit"), t["gap"].alias("gap"), absorbed.alias("absorbed"),
        )

    return F.filter(F.transform(tokens, one), lambda t: ~t["absorbed"])


def periods(text: Column) -> Column:
    """Pay periods named in a text, in the order hour, day, year, month."""
    return let(F.lower(squeeze(text)), lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in PERIODS])))


def contact_signal(text: Column) -> Column:
    """E-mail, or a phone number next to a contact word or with a plus."""
    def signal(t: Column) -> Column:
        phone = F.regexp_extract(t, PHONE, 0)
        return t.rlike(EMAIL) | ((phone != "") & (t.rlike(CONTACT_WORD) | F.contains(phone, F.lit("+"))))

    return let(squeeze(text), signal)


def review_class(text: Column, n_tokens: Column, found: Column) -> Column:
    """Why a salary text needs a person, or null."""
    return let(F.lower(squeeze(text)), lambda t: (
        F.when(contact_signal(t), F.lit("contact_or_noise"))
        .when(F.size(found) > 1, F.lit("mixed_salary_periods"))
        .when((n_tokens >= 3) & t.rlike(BONUS_WORD), F.lit("base_salary_plus_bonus_mix"))
        .when((n_tokens >= 2) & t.rlike(VARIANT_WORD) & t.rlike(VARIANT_JOIN), F.lit("multi_variant_compensation"))
        .when(n_tokens > 2, F.lit("too_many_amounts"))
    ))


EDGE = " ,;:-"


def _cut(text: Column, pattern: str, after: int) -> Column:
    """Text before the first match when that lies beyond ``after`` characters."""
    def at(t: Column, start: Column) -> Column:
        return F.when(start > after, F.btrim(F.substring(t, F.lit(1), start), F.lit(EDGE))).otherwise(t)

    return let(text, lambda t: let(F.regexp_instr(t, F.lit(pattern)) - 1, lambda start: at(t, start)))


def trim_clause(text: Column, max_len: int = 220) -> Column:
    """Salary clause: up to the sentence end or the next section word, at most ``max_len``."""
    one = _cut(squeeze(text), "[.!?](?:\\s|$)", 10)
    two = _cut(one, SALARY_BOUNDARY, 12)
    return F.btrim(F.substring(two, 1, max_len), F.lit(EDGE))


def usable_amount(value: Column) -> Column:
    return F.when((value > 0) & (value <= SALARY_OUTLIER), value)
