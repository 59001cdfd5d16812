"""Salary cleaning jobs: v1 (text or numbers) and v3 (repair with review queue)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import money as m
from postmill.functions.classify import average, currency
from postmill.functions.text import is_meaningful, squeeze
from postmill.functions.vocab import CURRENCIES_V1, CURRENCIES_V3, CURRENCY_WORDS_V3, SALARY_OUTLIER
from postmill.operators.spread import seal

FLAGS = "array<string>"


def _flags(*pairs: tuple[Column, str]) -> Column:
    """Names of the true conditions, sorted and distinct."""
    named = F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs])
    return F.sort_array(F.array_distinct(F.array_compact(named)))


# ---- v1 ---------------------------------------------------------------------

KEYWORD_CLAUSE = r"(?isu)(зарплата|salary|оклад)[^.\n]{0,120}"
CURRENCY_CLAUSE = (
    r"(?isu)(?:от|до)?\s*\d[\d\s,.]*(?:[-–—]\s*\d[\d\s,.]*)?\s*(?:₸|тг|тенге|usd|\$|eur|€|rub|rur|руб|млн|k|к)"
)


def candidate_text_v1(raw: Column, *descriptions: Column) -> Column:
    """struct<text, source>: the raw field, else a keyword clause, else a currency clause."""
    options = [F.when(is_meaningful(raw), F.struct(raw.alias("text"), F.lit("salary_raw").alias("source")))]
    for d in descriptions:
        long_enough = is_meaningful(d, 20)
        for pattern, source in ((KEYWORD_CLAUSE, "description_keyword"), (CURRENCY_CLAUSE, "description_currency_pattern")):
            hit = F.regexp_extract(d, pattern, 0)
            options.append(F.when(long_enough & (hit != ""), F.struct(hit.alias("text"), F.lit(source).alias("source"))))
    return F.coalesce(*options, F.struct(F.lit("").alias("text"), F.lit("missing").alias("source")))


def _numeric(value: Column) -> dict[str, Column]:
    """An existing number, and why it was dropped."""
    x = value.try_cast("double")
    zero, phone = x == 0, m.phone_like(x)
    outlier = ~phone & (x > SALARY_OUTLIER)
    return {"value": F.when(~zero & ~phone & ~outlier, x), "zero": zero, "phone": phone, "outlier": outlier}


def salary_clean_v1(df: DataFrame) -> DataFrame:
    """Twelve cleaned salary columns from ``salary_raw``, descriptions, ``currency``, ``salary_from`` and ``salary_to``."""
    c = F.col
    a = df.withColumn("_cand", candidate_text_v1(c("salary_raw"), c("description_clean_v2"), c("description")))
    a = a.withColumns({
        "_t": F.lower(squeeze(c("_cand.text"))),
        "_cur": currency(c("currency"), c("_cand.text")),
        "_leak": m.phone_like(c("salary_from").try_cast("double")) | m.phone_like(c("salary_to").try_cast("double"))
        | c("_cand.text").rlike(m.PHONE_LOOSE),
    }).withColumn("_am", m.amounts_v1(c("_t")))
    n, first, second = F.size("_am"), F.get("_am", F.lit(0)), F.get("_am", F.lit(1))
    lower, upper = c("_t").rlike(r"(?iU)\b(от|from)\b"), c("_t").rlike(r"(?iU)\b(до|to)\b")
    is_range = (n >= 2) & ((lower & upper) | c("_t").rlike("[-–—]"))
    a = a.withColumns({
        "_pf": F.when(is_range, F.least(first, second)).when((n == 1) & (lower | ~upper), first),
        "_pt": F.when(is_range, F.greatest(first, second)).when((n == 1) & ~lower & upper, first),
        "_q": F.when((c("_t") == "") | (n == 0), "missing").when(is_range, "parsed_range")
        .when(n > 1, "ambiguous").when(lower, "parsed_lower_bound").when(upper, "parsed_upper_bound").otherwise("parsed_single"),
    })
    lo, hi = _numeric(c("salary_from")), _numeric(c("salary_to"))
    big_f, big_t = c("_pf") > SALARY_OUTLIER, c("_pt") > SALARY_OUTLIER
    zero_f, zero_t = c("_pf") == 0, c("_pt") == 0
    true = lambda x: F.coalesce(x, F.lit(False))
    a = a.withColumns({
        "_ef": lo["value"], "_et": hi["value"],
        "_pf2": F.when(~true(big_f | zero_f), c("_pf")), "_pt2": F.when(~true(big_t | zero_t), c("_pt")),
        "_q2": F.when(true(big_f) | true(big_t), "outlier_removed").otherwise(c("_q")),
        "_outlier": true(lo["outlier"]) | true(hi["outlier"]) | true(big_f) | true(big_t),
        "_zero": true(lo["zero"]) | true(hi["zero"]) | true(zero_f) | true(zero_t),
        "_fx": _flags(
            (lo["zero"], "zero_value"), (hi["zero"], "zero_value"), (lo["phone"], "phone_like_numeric"),
            (hi["phone"], "phone_like_numeric"), (lo["outlier"], "outlier_numeric"), (hi["outlier"], "outlier_numeric"),
            (big_f, "parsed_from_outlier_removed"), (big_t, "parsed_to_outlier_removed"),
            (zero_f, "parsed_from_zero_removed"), (zero_t, "parsed_to_zero_removed"),
        ),
    })
    parsed = c("_pf2").isNotNull() | c("_pt2").isNotNull()
    existing = c("_ef").isNotNull() | c("_et").isNotNull()
    a = a.withColumns({"_f0": F.coalesce("_pf2", "_ef"), "_t0": F.coalesce("_pt2", "_et")})
    swap = true(c("_f0") > c("_t0"))
    none_left = c("_f0").isNull() & c("_t0").isNull()
    quality = (
        F.when(c("_leak"), "contact_leak")
        .when(none_left & c("_outlier"), "outlier_removed").when(none_left & c("_zero"), "zero_only").when(none_left, "missing")
        .when(~parsed & existing, "existing_numeric")
        .when(parsed & existing, F.concat(F.lit("mixed_"), c("_q2")))
        .otherwise(c("_q2"))
    )
    final_from = F.when(~c("_leak"), F.when(swap, c("_t0")).otherwise(c("_f0")))
    final_to = F.when(~c("_leak"), F.when(swap, c("_f0")).otherwise(c("_t0")))
    valid_currency = true(c("_cur").isin(CURRENCIES_V1))
    a = seal(a, {
        "salary_from_clean": final_from, "salary_to_clean": final_to, "salary_avg_clean": average(final_from, final_to),
        "currency_clean": F.when(valid_currency, c("_cur")),
        "salary_parse_quality": quality,
        "salary_is_suspicious": c("_leak") | c("_outlier") | c("_zero"),
        "salary_outlier_flag": c("_outlier"), "salary_contact_leak_flag": c("_leak"), "salary_zero_flag": c("_zero"),
        "salary_usable_for_analytics": ~c("_leak") & ~c("_outlier") & valid_currency & ~none_left,
        "salary_fix_flags": F.sort_array(F.array_union("_fx", _flags(
            (c("_leak"), "contact_leak_detected"), (~c("_leak") & swap, "salary_range_swapped_v2")))),
        "salary_parse_source": c("_cand.source"),
    })
    return a.drop("_cand", "_t", "_cur", "_leak", "_am", "_pf", "_pt", "_q", "_ef", "_et", "_pf2", "_pt2", "_q2", "_outlier", "_zero", "_fx", "_f0", "_t0")


# ---- v3 ---------------------------------------------------------------------

def candidate_text_v3(raw: Column, descriptions: dict[str, Column]) -> Column:
    """struct<text, source>: trimmed raw field, else per description a keyword window or a currency window."""
    options = [F.when(is_meaningful(raw), F.struct(m.trim_clause(raw).alias("text"), F.lit("salary_raw").alias("source")))]
    for name, col in descriptions.items():
        text = squeeze(col)
        long_enough = is_meaningful(col, 20)
        key_at = F.regexp_instr(text, F.lit(m.SALARY_KEYWORD))
        by_key = m.trim_clause(F.substring(text, key_at, F.lit(220)))
        options.append(F.when(
            long_enough & (key_at > 0) & by_key.rlike("\\d") & by_key.rlike(m.SALARY_CONTEXT),
            F.struct(by_key.alias("text"), F.lit(f"{name}_salary_keyword").alias("source"))))
        at = F.regexp_instr(text, F.lit(m.CURRENCY_WINDOW))
        size = F.length(F.regexp_extract(text, m.CURRENCY_WINDOW, 0))
        start = F.greatest(at - 40, F.lit(1))
        window = m.trim_clause(F.substring(text, start, at + size + 80 - start))
        options.append(F.when(
            long_enough & (at > 0) & window.rlike(m.SALARY_CONTEXT),
            F.struct(window.alias("text"), F.lit(f"{name}_currency_pattern").alias("source"))))
    return F.coalesce(*options, F.struct(F.lit("").alias("text"), F.lit("missing").alias("source")))


def parse_candidate(df: DataFrame, text: str) -> DataFrame:
    """Salary text → ``_p_*`` columns: bounds, quality, period, confidence, review class, candidate bounds."""
    c = F.col
    a = df.withColumn("_txt", squeeze(c(text))).withColumns({"_tok": m.amount_tokens(c("_txt")), "_per": m.periods(c("_txt"))})
    n = F.size("_tok")
    a = a.withColumn("_p_review", F.when(c("_txt") != "", m.review_class(c("_txt"), n, c("_per"))))
    first, second = F.get("_tok", F.lit(0))["value"], F.get("_tok", F.lit(1))["value"]
    low = F.lower("_txt")
    quality = (
        F.when(n >= 2, "parsed_range_v2").when(n == 0, "missing").when(low.rlike(m.LOWER_BOUND), "parsed_lower_bound_v2")
        .when(low.rlike(m.UPPER_BOUND), "parsed_upper_bound_v2").otherwise("parsed_single_v2")
    )
    a = a.withColumn("_q", quality)
    is_range = c("_q") == "parsed_range_v2"
    cand_from = F.when(is_range, F.least(first, second)).when(c("_q").isin("parsed_lower_bound_v2", "parsed_single_v2"), first)
    cand_to = F.when(is_range, F.greatest(first, second)).when(c("_q") == "parsed_upper_bound_v2", first)
    a = a.withColumns({"_p_cand_from": m.usable_amount(cand_from), "_p_cand_to": m.usable_amount(cand_to)})
    review = c("_p_review").isNotNull()
    return a.withColumns({
        "_p_from": F.when(~review, c("_p_cand_from")), "_p_to": F.when(~review, c("_p_cand_to")),
        "_p_quality": F.when(review, "manual_review_complex_v2").otherwise(c("_q")),
        # Without amounts the first period in fixed order stands; with amounts only a single one does.
        "_p_period": F.when((n == 0) | (F.size("_per") == 1), F.get("_per", F.lit(0))),
        "_p_confidence": F.when(review, "low").when(n == 0, "none").when(is_range, "high").otherwise("medium"),
    }).drop("_txt", "_tok", "_per", "_q")


def _mean(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b)


def salary_repair_v3(df: DataFrame) -> DataFrame:
    """Nineteen repaired salary columns; unclear rows go to a review queue instead of the analytics."""
    c = F.col
    true = lambda x: F.coalesce(x, F.lit(False))
    a = df.withColumn("_cand", candidate_text_v3(
        c("salary_raw"), {"description_clean_v2": c("description_clean_v2"), "description": c("description")}))
    a = a.withColumns({"_ctext": c("_cand.text"), "_src": c("_cand.source")})
    prior = c("currency_clean") if "currency_clean" in df.columns else F.lit(None).cast("string")
    a = a.withColumn("_cur", F.coalesce(
        currency(prior, c("_ctext"), CURRENCY_WORDS_V3), currency(c("currency"), c("_ctext"), CURRENCY_WORDS_V3)))
    a = parse_candidate(a, "_ctext")
    lo, hi = _numeric(c("salary_from")), _numeric(c("salary_to"))
    valid = true(c("_cur").isin(CURRENCIES_V3))
    found = c("_p_from").isNotNull() | c("_p_to").isNotNull()
    ignored = (c("_src") != "salary_raw") & found & ~valid
    lone = ~ignored & c("_src").endswith("currency_pattern") & (c("_p_quality") == "parsed_single_v2") & found
    a = a.withColumns({
        "_ef": lo["value"], "_et": hi["value"],
        "_zero": true(lo["zero"]) | true(hi["zero"]), "_out": true(lo["outlier"]) | true(hi["outlier"]),
        "_phone": true(lo["phone"]) | true(hi["phone"]), "_ignored": ignored, "_lone": lone,
    })
    dropped = c("_ignored") | c("_lone")
    a = a.withColumns({
        "_from": F.when(~dropped, c("_p_from")), "_to": F.when(~dropped, c("_p_to")),
        "_quality": F.when(c("_ignored"), "missing").when(c("_lone"), "manual_review_complex_v2").otherwise(c("_p_quality")),
        "_class": F.when(c("_lone"), "single_value_description_currency_pattern").when(~c("_ignored"), c("_p_review")),
        "_conf": F.when(c("_ignored"), "none").when(c("_lone"), "low").otherwise(c("_p_confidence")),
    })
    ours, theirs = _mean(c("_from"), c("_to")), _mean(c("_ef"), c("_et"))
    a = a.withColumn("_conflict", true((ours > 0) & (theirs > 0) & (F.greatest(ours, theirs) / F.least(ours, theirs) >= 20)))
    parsed = c("_from").isNotNull() | c("_to").isNotNull()
    kept = c("_ef").isNotNull() | c("_et").isNotNull()
    clash = parsed & c("_conflict") & (c("_conf") != "high")
    a = a.withColumns({
        "_review": c("_class").isNotNull() | clash,
        "_queued": c("_class").isNotNull(),
        "_clash": c("_class").isNull() & clash,
        "_f0": F.when(parsed, c("_from")).otherwise(c("_ef")), "_t0": F.when(parsed, c("_to")).otherwise(c("_et")),
        "_basis": F.when(parsed, "text_parsed").when(kept, "existing_numeric_fallback").otherwise("missing"),
        "_q1": F.when(parsed, c("_quality")).when(kept, "existing_numeric_v2").otherwise(c("_quality")),
    })
    swap = true(c("_f0") > c("_t0"))
    a = a.withColumns({
        "_f1": m.usable_amount(F.when(swap, c("_t0")).otherwise(c("_f0"))),
        "_t1": m.usable_amount(F.when(swap, c("_f0")).otherwise(c("_t0"))),
        "_swap": swap & ~c("_queued"),
    })
    lost_from, lost_to = c("_f1").isNull() & c("_from").isNotNull(), c("_t1").isNull() & c("_to").isNotNull()
    outlier = c("_out") | (~c("_queued") & (lost_from | lost_to))
    empty = c("_f1").isNull() & c("_t1").isNull()
    zero = F.when(c("_review"), c("_zero")).otherwise(c("_zero") & empty)
    suspicious = c("_review") | outlier | zero
    return seal(a, {
        "salary_from_clean": F.when(~c("_review"), c("_f1")), "salary_to_clean": F.when(~c("_review"), c("_t1")),
        "salary_avg_clean": F.when(~c("_review"), average(c("_f1"), c("_t1"))),
        "currency_clean": F.when(valid, c("_cur")),
        "salary_parse_quality": F.when(c("_queued"), c("_quality")).when(c("_clash"), "manual_review_complex_v2")
        .when(empty, "missing").otherwise(c("_q1")),
        "salary_is_suspicious": suspicious,
        "salary_outlier_flag": outlier,
        "salary_contact_leak_flag": true(c("_class") == "contact_or_noise"),
        "salary_zero_flag": zero,
        "salary_usable_for_analytics": ~suspicious & ~c("_conflict") & valid & ~empty
        & (c("_p_period").isNull() | (c("_p_period") == "month")),
        "salary_fix_flags": _flags(
            (c("_zero"), "zero_value_removed"), (c("_phone"), "phone_like_numeric_removed"), (c("_out"), "outlier_numeric_removed"),
            (c("_ignored"), "description_parse_without_currency_ignored"),
            (c("_lone"), "single_value_description_currency_pattern_sent_to_review"),
            (c("_queued"), "manual_review_required"), (c("_clash"), "source_conflict_manual_review"),
            (c("_swap"), "range_swapped_v2"),
            (~c("_queued") & lost_from, "salary_from_outlier_removed_v2"), (~c("_queued") & lost_to, "salary_to_outlier_removed_v2"),
        ),
        "salary_parse_source": c("_src"),
        "salary_period": c("_p_period"),
        "salary_source_basis_v2": F.when(c("_review"), "manual_review_queue").otherwise(c("_basis")),
        "salary_source_conflict_flag": c("_conflict"),
        "salary_manual_review_flag": c("_review"),
        "salary_manual_review_category": F.when(c("_queued"), c("_class")).when(c("_clash"), "source_conflict_major"),
        "salary_from_candidate_v2": c("_p_cand_from"), "salary_to_candidate_v2": c("_p_cand_to"),
    }).drop(
        "_cand", "_ctext", "_src", "_cur", "_ef", "_et", "_zero", "_out", "_phone", "_ignored", "_lone", "_from", "_to", "_quality",
        "_class", "_conf", "_conflict", "_review", "_queued", "_clash", "_f0", "_t0", "_basis", "_q1", "_f1", "_t1", "_swap",
        "_p_review", "_p_cand_from", "_p_cand_to", "_p_from", "_p_to", "_p_quality", "_p_period", "_p_confidence")


SALARY_MART = [
    "id", "source", "title_final", "company_clean", "city_norm", "category_filled", "level_filled", "salary_from_clean",
    "salary_to_clean", "salary_avg_clean", "currency_clean", "salary_period", "salary_parse_quality", "salary_source_basis_v2",
    "salary_source_conflict_flag", "salary_manual_review_flag", "salary_manual_review_category", "salary_fix_flags", "posted_at",
]
REVIEW_MART = [
    "id", "source", "source_url", "title_final", "company_clean", "city_norm", "category_filled", "level_filled", "salary_raw",
    "salary_from", "salary_to", "salary_avg", "currency", "salary_from_candidate_v2", "salary_to_candidate_v2", "currency_clean",
    "salary_period", "salary_parse_quality", "salary_parse_source", "salary_source_basis_v2", "salary_source_conflict_flag",
    "salary_manual_review_category", "salary_fix_flags", "description_clean_v2",
]


def salary_mart(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("usable_for_salary_analytics", F.lit(False))).select(*[x for x in SALARY_MART if x in df.columns])


def review_mart(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("salary_manual_review_flag", F.lit(False))).select(*[x for x in REVIEW_MART if x in df.columns])


def repair_summary(df: DataFrame) -> DataFrame:
    """Counts in long form (measure, value, n): totals and three distributions in one pass."""
    def total(name: str, cond: Column) -> Column:
        return F.struct(F.lit(name).alias("measure"), F.lit("").alias("value"), cond.cast("long").alias("n"))

    def value(name: str, col: str, default: str) -> Column:
        return F.struct(F.lit(name).alias("measure"), F.coalesce(F.col(col), F.lit(default)).alias("value"), F.lit(1).cast("long").alias("n"))

    facts = F.array(
        total("rows", F.lit(1)),
        total("usable", F.coalesce("usable_for_salary_analytics", F.lit(False))),
        total("manual_review", F.coalesce("salary_manual_review_flag", F.lit(False))),
        total("source_conflict", F.coalesce("salary_source_conflict_flag", F.lit(False))),
        value("period", "salary_period", "unknown"),
        value("parse_quality", "salary_parse_quality", "unknown"),
        value("review_category", "salary_manual_review_category", "none"),
    )
    return df.select(F.inline(facts)).groupBy("measure", "value").agg(F.sum("n").alias("n"))
