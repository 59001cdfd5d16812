"""Row-level jobs for dashboards: defaults, types, facets, paging, slices, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import vocab as v
from postmill.functions.lists import parse_list
from postmill.functions.text import lookup, to_bool
from postmill.operators.analytics import city_bucket
from postmill.operators.spread import head_per_key, number_rows

c = F.col


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the columns that are absent, with their defaults."""
    absent = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns({n: F.lit(x) if x is not None else F.lit(None).cast("double") for n, x in absent.items()}) if absent else df


def coerce_types(df: DataFrame, numeric: Sequence[str], boolean: Sequence[str], text: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {x: c(x).try_cast("double") for x in numeric}
        | {x: to_bool(c(x)) for x in boolean}
        | {x: F.trim(F.coalesce(c(x).cast("string"), F.lit(""))) for x in text}
    )


def ordinal(col: Column, order: Sequence[str]) -> Column:
    """1-based place in a fixed order, null for other values."""
    return lookup(col, {x: i + 1 for i, x in enumerate(order)})


def display_columns(df: DataFrame) -> DataFrame:
    """Text shown instead of blanks, and sort ordinals of the ordered facets."""
    shown = lambda col, alt: F.coalesce(F.nullif(c(col), F.lit("")), F.lit(alt))
    level = F.when(c("level_filled").isin(v.LEVEL_ORDER), c("level_filled"))
    return df.withColumns({
        "title_display": shown("title_final", "Untitled vacancy"),
        "company_display": shown("company_clean", "Company not specified"),
        "category_display": shown("category_filled", "unresolved"),
        "level_display": F.coalesce(level, F.lit("unresolved")),
        "level_ordinal": ordinal(c("level_filled"), v.LEVEL_ORDER),
        "format_ordinal": ordinal(c("work_format_norm"), v.WORK_FORMAT_ORDER),
        "tier_ordinal": ordinal(c("quality_tier"), v.QUALITY_ORDER),
        "city_ordinal": ordinal(city_bucket(c("city_norm")), v.CITY_ORDER),
    })


def source_family(source: Column) -> Column:
    """Known source → its family; other names → chat channel; blank → other."""
    s = F.trim(F.coalesce(source, F.lit("")))
    return F.coalesce(lookup(s, v.SOURCE_FAMILY), F.when(s != "", F.lit("telegram")), F.lit("other"))


def with_skill_lists(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{x}_list": parse_list(c(x)) for x in cols})


def gate_salary(df: DataFrame, sources: Sequence[str] = v.STRUCTURED_SOURCES) -> DataFrame:
    """Salary for analytics: structured sources and usable rows only, else null."""
    ok = c("usable_for_salary_analytics") & c("source").isin(list(sources))
    return df.withColumns({f"{x}_analytics": F.when(ok, c(f"{x}_clean")) for x in ("salary_avg", "salary_from", "salary_to")}).withColumn(
        "salary_structured_analytics_flag", F.coalesce(ok, F.lit(False)))


def slices(df: DataFrame) -> dict[str, DataFrame]:
    """The named analytic slices of a typed frame."""
    structured = c("source").isin(v.STRUCTURED_SOURCES)
    return {
        "all": df,
        "base": df.filter("dedup_keep_for_analytics"),
        "base_structured": df.filter(c("dedup_keep_for_analytics") & structured),
        "salary": df.filter(c("usable_for_salary_analytics") & structured),
        "skills": df.filter("usable_for_skill_analytics"),
        "employer": df.filter("usable_for_employer_analytics"),
        "category": df.filter("usable_for_category_analytics"),
    }


FACET_COLUMNS = {
    "city": "city_norm", "category": "category_filled", "level": "level_filled", "work_format": "work_format_norm",
    "source": "source_family", "quality_tier": "quality_tier", "company": "company_clean",
}


def apply_facets(df: DataFrame, facets: Mapping[str, Sequence[str]], salary_range: tuple[float, float] | None = None, english: str = "Any") -> DataFrame:
    """Conjunctive multi-select; rows without a salary pass any salary range."""
    for name, values in facets.items():
        if values:
            df = df.filter(c(FACET_COLUMNS[name]).isin(list(values)))
    if english != "Any":
        df = df.filter(c("english_required") == F.lit(english == "Required"))
    if salary_range:
        df = df.filter(c("salary_avg_clean").isNull() | c("salary_avg_clean").between(*salary_range))
    return df


def facet_options(df: DataFrame, facets: Sequence[str], company_cap: int = 200, step: int = 50_000) -> DataFrame:
    """(facet, value): sorted distinct choices, the first 200 companies, and the salary slider's ends."""
    pairs = F.array(*[F.struct(F.lit(x).alias("facet"), F.trim(c(FACET_COLUMNS[x])).alias("value")) for x in facets])
    options = df.select(F.inline(pairs)).filter(c("value").isNotNull() & ~c("value").isin("", "nan")).distinct()
    companies = options.filter(c("facet") == "company").orderBy("value").limit(company_cap)
    ends = df.agg(F.min("salary_avg_clean").alias("lo"), F.max("salary_avg_clean").alias("hi")).filter(c("lo").isNotNull()).select(F.inline(F.array(
        F.struct(F.lit("salary_min").alias("facet"), F.greatest(F.floor(c("lo") / step) * step, F.lit(0)).cast("string").alias("value")),
        F.struct(F.lit("salary_max").alias("facet"), ((F.floor(c("hi") / step) + 1) * step).cast("string").alias("value")),
    )))
    return options.filter(c("facet") != "company").unionByName(companies).unionByName(ends)


def list_jobs(df: DataFrame, page: int, limit: int, order: str, category: str | None = None, level: str | None = None, work_format: str | None = None) -> DataFrame:
    """One page of postings in ``order``, with the total and the page count on every row."""
    for col, value in (("category_filled", category), ("level_filled", level), ("work_format_norm", work_format)):
        if value:
            df = df.filter(c(col) == value)
    df = df.filter("dedup_keep_for_analytics")
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(F.asc(order)).offset((page - 1) * limit).limit(limit)
    return rows.withColumn("total", total).withColumn("pages", F.greatest(F.ceil(c("total") / limit), F.lit(1)))


def _thousands(x: Column) -> Column:
    return F.replace(F.format_number(x.cast("long"), 0), F.lit(","), F.lit(" "))


def salary_label(df: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Shown salary: average, else range, else one bound. The second variant treats 0 as absent and speaks Russian."""
    have = lambda x: c(x).isNotNull() & ((c(x) != 0) if zero_is_missing else F.lit(True))
    dash, low, high, none = (" – ", "от ", "до ", "Salary not listed") if zero_is_missing else (" - ", "from ", "up to ", "Salary not specified")
    cur = F.concat(F.lit(" "), F.coalesce(F.nullif(c("currency_clean"), F.lit("")), F.lit("KZT")))
    a, f, t = _thousands(c("salary_avg_clean")), _thousands(c("salary_from_clean")), _thousands(c("salary_to_clean"))
    label = (
        F.when(have("salary_avg_clean"), F.concat(a, cur))
        .when(have("salary_from_clean") & have("salary_to_clean"), F.concat(f, F.lit(dash), t, cur))
        .when(have("salary_from_clean"), F.concat(F.lit(low), f, cur))
        .when(have("salary_to_clean"), F.concat(F.lit(high), t, cur))
        .otherwise(F.lit(none))
    )
    return df.withColumn("salary_display", label)


# ---- rows for the external text model ---------------------------------------------------

def candidates(df: DataFrame, text: str = "description_clean", min_len: int = 200) -> DataFrame:
    """Rows worth extracting, with their order columns; the sort itself belongs to the consumer."""
    length = F.length(F.coalesce(c(text), F.lit("")))
    rank = F.when(~c("source").isin(v.STRUCTURED_SOURCES), 0).when(c("source") == "hh_kz", 1).otherwise(2)
    return df.filter(~c("is_duplicate") & (F.trim(c(text)) != "") & (length > min_len)).withColumns(
        {"description_length": length, "source_priority": rank})


def candidate_order(row_id: str) -> list[Column]:
    return [F.asc("source_priority"), F.desc("description_length"), F.asc("source"), F.asc(row_id)]


STRATA_TARGETS = {"chat": 200, "api": 70, "other": 30}


def scaled_targets(desired: Mapping[str, int], size: int) -> dict[str, int]:
    """Targets that fit ``size``: floors plus the largest remainders."""
    total = sum(desired.values())
    if total <= size:
        return dict(desired)
    exact = {s: n * size / total for s, n in desired.items()}
    out = {s: int(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (exact[s] - out[s], s), reverse=True)
    for s in [s for s in by_rest if out[s] < desired[s]][: size - sum(out.values())]:
        out[s] += 1
    return out


def stratified_sample(df: DataFrame, row_id: str, size: int = 300, targets: Mapping[str, int] = STRATA_TARGETS, seed: int = 42) -> DataFrame:
    """Seeded sample over three strata, topped up from the rest to ``size``.

    Rows are drawn by the MD5 of id and seed, so the draw is repeatable anywhere. Each
    partition sends at most ``size`` rows per stratum. Only targets that exceed ``size``
    together need the strata's counts, three numbers, while the plan is made.
    """
    kind = F.when(c("source_priority") == 0, "chat").when(c("source_priority") == 1, "api").otherwise("other")
    drawn = df.withColumns({"stratum": kind, "draw": F.md5(F.concat_ws(":", c(row_id).cast("string"), F.lit(str(seed))))})
    quotas = dict(targets)
    if sum(quotas.values()) > size:
        one = drawn.agg(*[F.count(F.when(c("stratum") == s, 1)).alias(s) for s in targets]).first()
        quotas = scaled_targets({s: min(n, one[s]) for s, n in targets.items()}, size)
    heads = head_per_key(drawn, ["stratum"], [F.asc("draw"), F.asc(row_id)], size, "draw_no")
    # All the sample can need lies in these heads: the quota rows, and the next ``size`` of each stratum.
    ranked = heads.withColumn("is_quota", c("draw_no") <= lookup(c("stratum"), quotas))
    ordered = ranked.orderBy(F.desc("is_quota"), F.asc("draw"), F.asc(row_id)).limit(size)
    return ordered.drop("draw", "draw_no", "is_quota")


def enrichment_batches(df: DataFrame, n: int, order: Sequence[Column], item: Mapping[str, Column]) -> DataFrame:
    """Rows in order → batches of ``n``: (batch_no, n_rows, items as JSON)."""
    numbered = number_rows(df, order, "row_no").withColumn("batch_no", F.floor(c("row_no") / n))
    items = F.sort_array(F.collect_list(F.struct(c("row_no"), *[x.alias(k) for k, x in item.items()])))
    return numbered.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rows"), F.to_json(items).alias("items"))


def context_text(parts: Mapping[str, Column]) -> Column:
    """``LABEL: value`` lines, N/A for absent values."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(x.cast("string"), F.lit("N/A"))) for label, x in parts.items()]
    return F.concat_ws("\n", *lines)


def token_cost(df: DataFrame, text: str, prices: DataFrame, out_per_row: int, retry: float, cheap: str, strong: str) -> DataFrame:
    """Input and output tokens (four characters each) and the cost per run mode."""
    tokens = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.ceil(F.length(F.coalesce(c(text), F.lit(""))) / 4)).alias("input_tokens"),
    ).withColumn("output_tokens", c("n_rows") * out_per_row)

    def cost(model: str, share: float | None = None) -> Column:
        row = prices.filter(c("model") == model)
        i = F.ceil(c("input_tokens") * share) if share else c("input_tokens")
        o = F.ceil(c("output_tokens") * share) if share else c("output_tokens")
        return i / 1e6 * row.select("input_price").scalar() + o / 1e6 * row.select("output_price").scalar()

    return tokens.withColumns({
        "cost_cheap": F.round(cost(cheap), 6), "cost_strong": F.round(cost(strong), 6),
        "cost_hybrid": F.round(cost(cheap) + cost(strong, retry), 6),
    })
