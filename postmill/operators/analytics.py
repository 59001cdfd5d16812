"""Market, salary, skill and employer questions over curated postings.

Inputs are the named slices (base, structured, salary, ...) and long skill rows
(id, skill). Ratios are left unrounded; rounding is for display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.vocab import CITY_ORDER, SKILL_FAMILY_WORDS
from postmill.operators.spread import exact_median, exact_quantiles, head_per_key

UNRESOLVED = "level_unresolved"


def present(name: str) -> Column:
    """Column is neither null nor blank."""
    return F.col(name).isNotNull() & (F.col(name) != "")


def known(name: str) -> Column:
    """Value, or null where it is blank."""
    return F.nullif(F.col(name), F.lit(""))


def percent(part: Column, total: Column) -> Column:
    """Share in percent, 0 where the total is not positive."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def city_bucket(city: Column) -> Column:
    text = F.lower(F.trim(city))
    return F.when(text.isin("almaty", "astana", "remote"), text).otherwise(F.lit("other"))


def city_group(city: Column) -> Column:
    """Bucket with remote folded into other."""
    bucket = city_bucket(city)
    return F.when(bucket == "remote", F.lit("other")).otherwise(bucket)


def skill_family(skill: Column) -> Column:
    text = F.lower(skill)
    out = F.lit("other")
    for family, words in reversed(SKILL_FAMILY_WORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        out = F.when(hit, F.lit(family)).otherwise(out)
    return out


def row_count(df: DataFrame) -> Column:
    """Number of rows of another frame as a one-value subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def market_kpis(base: DataFrame, structured: DataFrame, salary: DataFrame, hard_skills: DataFrame) -> DataFrame:
    median = exact_median(salary, [], "salary_avg_clean", "median_salary").select("median_salary").scalar()
    remote = (F.col("work_format_norm") == "remote").cast("double")
    return base.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(known("company_clean")).alias("n_companies"),
        F.coalesce(F.avg(remote) * 100, F.lit(0.0)).alias("remote_pct"),
    ).select(
        "n_rows", "n_companies", "remote_pct",
        median.alias("median_salary"),
        percent(row_count(salary), row_count(structured)).alias("salary_coverage_pct"),
        hard_skills.join(base.select("id"), "id", "left_semi").agg(F.count_distinct("skill")).scalar().alias("n_hard_skills"),
    )


def freshness(everything: DataFrame, structured: DataFrame, salary: DataFrame, base: DataFrame, ts: str) -> DataFrame:
    return everything.agg(F.max(ts).alias("latest")).select(
        "latest",
        row_count(base).alias("n_base"),
        percent(row_count(salary), row_count(structured)).alias("salary_coverage_pct"),
    )


def market_map(category: DataFrame, salary: DataFrame) -> DataFrame:
    """Demand per (category, level) with the median salary where there is one."""
    keys = ["category_filled", "level_group"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.filter(present("category_filled")).withColumn(
            "level_group", F.coalesce(known("level_filled"), F.lit(UNRESOLVED))
        )

    counts = keyed(category).groupBy(*keys).agg(F.count("id").alias("n_rows"))
    medians = exact_median(keyed(salary), keys, "salary_avg_clean", "median_salary").drop("n_values")
    return counts.join(medians, keys, "left")


def count_by(df: DataFrame, keys: dict[str, Column], out: str = "n_rows") -> DataFrame:
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias(out))


def largest_keys(counts: DataFrame, key: str, n: int, measure: str) -> DataFrame:
    """The ``n`` keys with the largest total; ties by key. At most ``n`` rows."""
    totals = counts.groupBy(key).agg(F.sum(measure).alias("_total"))
    return totals.orderBy(F.desc("_total"), F.asc(key)).limit(n).select(key)


def restrict_top(df: DataFrame, key: str, n: int, measure: Column | None = None) -> DataFrame:
    """Rows whose key is among the ``n`` largest (by row count unless a measure is given)."""
    m = F.count(F.lit(1)) if measure is None else F.sum(measure)
    top = df.groupBy(key).agg(m.alias("_m")).orderBy(F.desc("_m"), F.asc(key)).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def category_format(category: DataFrame, n: int = 15) -> DataFrame:
    counts = count_by(
        category.filter(present("category_filled")),
        {"category_filled": F.col("category_filled"), "work_format_norm": F.col("work_format_norm")},
    )
    return counts.join(F.broadcast(largest_keys(counts, "category_filled", n, "n_rows")), "category_filled", "left_semi")


def share_pivot(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised percentages over the given column values (others do not count)."""
    counts = [F.count(F.when(F.col(col) == v, 1)).alias(f"n_{v}") for v in values]
    total = F.lit(0)
    for v in values:
        total = total + F.col(f"n_{v}")
    wide = df.filter(present(row) & F.col(col).isNotNull()).groupBy(row).agg(*counts)
    return wide.select(row, *[percent(F.col(f"n_{v}"), total).alias(f"pct_{v}") for v in values])


def salary_points(salary: DataFrame) -> DataFrame:
    return salary.filter(F.col("salary_avg_clean").isNotNull() & F.col("experience_min").isNotNull()).select(
        "id", "experience_min", "salary_avg_clean", "category_filled", "title_final", "company_clean", "city_norm", "work_format_norm"
    )


def premium(df: DataFrame, key: str, flag: Column, value: str) -> DataFrame:
    """Median of flagged against unflagged rows per key, in percent of the latter."""
    rows = df.filter(flag.isNotNull() & F.col(key).isNotNull()).withColumn("_flag", flag)
    medians = exact_median(rows, [key, "_flag"], value, "m")
    wide = medians.groupBy(key).agg(
        F.max(F.when(F.col("_flag"), F.col("m"))).alias("median_yes"),
        F.max(F.when(~F.col("_flag"), F.col("m"))).alias("median_no"),
    )
    return wide.filter(F.col("median_yes").isNotNull() & (F.col("median_no") > 0)).withColumn(
        "premium_pct", (F.col("median_yes") - F.col("median_no")) / F.col("median_no") * 100
    )


def insights(base: DataFrame, salary: DataFrame) -> DataFrame:
    """Most wanted category, best paid category, and the largest english premium."""
    demand = count_by(base.filter(present("category_filled")), {"category_filled": F.col("category_filled")})
    top = demand.orderBy(F.desc("n_rows"), F.asc("category_filled")).limit(1)
    paid = exact_median(salary.filter(present("category_filled")), ["category_filled"], "salary_avg_clean", "m")
    best = paid.orderBy(F.desc("m"), F.asc("category_filled")).limit(1)
    prem = premium(salary, "category_filled", F.col("english_required"), "salary_avg_clean")
    peak = prem.orderBy(F.desc("premium_pct"), F.asc("category_filled")).limit(1)
    return top.select(
        F.col("category_filled").alias("top_category"),
        F.col("n_rows").alias("top_category_rows"),
        best.select("category_filled").scalar().alias("best_paid_category"),
        best.select("m").scalar().alias("best_paid_median"),
        peak.select("category_filled").scalar().alias("premium_category"),
        peak.select("premium_pct").scalar().alias("premium_pct"),
    )


def salary_kpis(structured: DataFrame, salary: DataFrame) -> DataFrame:
    median = exact_median(salary, [], "salary_avg_clean", "m").select("m").scalar()
    return salary.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(known("currency_clean")).alias("n_currencies")
    ).select(
        "n_rows", "n_currencies",
        median.alias("median_salary"),
        percent(F.col("n_rows"), row_count(structured)).alias("salary_coverage_pct"),
    )


def salary_iqr(salary: DataFrame, key: str) -> DataFrame:
    """Quartiles per key, their distances, and the difference to the market median."""
    stats = exact_quantiles(
        salary.filter(present(key)), [key], "salary_avg_clean", {"q25": 0.25, "median": 0.5, "q75": 0.75}, "n_values"
    )
    market = exact_median(salary, [], "salary_avg_clean", "m").select("m").scalar()
    return stats.select(
        key, "n_values", "q25", "median", "q75",
        (F.col("median") - market).alias("diff_vs_market"),
        (F.col("q75") - F.col("median")).alias("error_plus"),
        (F.col("median") - F.col("q25")).alias("error_minus"),
    )


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group; null keys form the group ''."""
    filled = df.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})
    return exact_quantiles(filled, keys, value, {"v_min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "v_max": 1.0}, "n_values")


def median_pivot(df: DataFrame, row: str, col: str, values: Sequence[str], value: str) -> DataFrame:
    """Medians as a grid, 0 where a cell is empty."""
    medians = exact_median(df.filter(present(row) & present(col)), [row, col], value, "m")
    cells = [F.coalesce(F.max(F.when(F.col(col) == v, F.col("m"))), F.lit(0.0)).alias(f"m_{v}") for v in values]
    return medians.groupBy(row).agg(*cells)


def benchmark(structured: DataFrame, salary: DataFrame) -> DataFrame:
    """Observed (category, level) groups with quartiles and the overall coverage."""
    keys = ["category_filled", "level_filled"]
    stats = exact_quantiles(
        salary.filter(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()), keys, "salary_avg_clean",
        {"q25": 0.25, "median": 0.5, "q75": 0.75}, "n_values",
    )
    return stats.withColumn("salary_coverage_pct", percent(row_count(salary), row_count(structured)))


def role_median(df: DataFrame, category: str, level: str, city: str) -> DataFrame:
    rows = df.filter((F.col("category_filled") == category) & (F.col("level_filled") == level) & (F.col("city_norm") == city))
    return exact_median(rows, [], "salary_avg_clean", "median_salary")


def market_salary(df: DataFrame) -> DataFrame:
    """Whole-number median and count of usable positive salaries for every category."""
    rows = df.filter(F.col("usable_for_salary_analytics") & (F.col("salary_avg_clean") > 0) & F.col("category_filled").isNotNull())
    out = exact_median(rows, ["category_filled"], "salary_avg_clean", "m", "n_rows")
    return out.select("category_filled", F.col("m").cast("long").alias("market_avg"), "n_rows")


def skill_stats(postings: DataFrame, skills: DataFrame, salary_col: str, min_demand: int = 1) -> DataFrame:
    """Mentions, distinct postings, median salary and family per skill."""
    rows = skills.join(postings.select("id", salary_col), "id")
    per_posting = rows.groupBy("skill", "id").agg(F.count(F.lit(1)).alias("_m"))
    demand = per_posting.groupBy("skill").agg(F.sum("_m").alias("demand"), F.count(F.lit(1)).alias("n_postings"))
    medians = exact_median(rows, ["skill"], salary_col, "median_salary").drop("n_values")
    return (
        demand.filter(F.col("demand") >= min_demand)
        .join(medians, "skill", "left")
        .withColumn("skill_family", skill_family(F.col("skill")))
    )


def top_values(df: DataFrame, col: str, n: int, out: str = "n_rows") -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy(F.desc(out), F.asc(col)).limit(n)


def label_top(df: DataFrame, key: str, measure: str, n: int = 20, out: str = "label") -> DataFrame:
    """Label the ``n`` largest rows with their key, all others with ''."""
    top = df.orderBy(F.desc(measure), F.asc(key)).limit(n).select(key, F.col(key).alias("_label"))
    return df.join(F.broadcast(top), key, "left").withColumn(out, F.coalesce("_label", F.lit(""))).drop("_label")


def cooccurrence(skills: DataFrame, n: int = 15) -> DataFrame:
    """Postings holding both skills, for the ``n`` most wanted; the diagonal is the support.

    A posting's wanted skills are first gathered into one set of at most ``n``
    entries, so pairs are made inside a bounded array, never by a self join.
    """
    top = top_values(skills, "skill", n).select("skill")
    sets = skills.join(F.broadcast(top), "skill", "left_semi").groupBy("id").agg(F.collect_set("skill").alias("s"))
    left = sets.select("s", F.explode("s").alias("l"))
    return left.select("l", F.explode("s").alias("r")).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n_postings"))


def skill_levels(postings: DataFrame, skills: DataFrame, skill: str) -> DataFrame:
    ids = skills.filter(F.col("skill") == skill).select("id").distinct()
    return postings.filter(F.col("level_filled").isNotNull()).join(ids, "id", "left_semi").groupBy("level_filled").agg(
        F.count_distinct("id").alias("n_postings")
    )


def stack_levels(postings: DataFrame, stack: DataFrame, category: str, n: int = 12) -> DataFrame:
    """Distinct postings per (skill, level) of a category, for its ``n`` largest skills."""
    rows = postings.filter((F.col("category_filled") == category) & F.col("level_filled").isNotNull()).select("id", "level_filled")
    counts = stack.distinct().join(rows, "id").groupBy("skill", "level_filled").agg(F.count_distinct("id").alias("n_postings"))
    return counts.join(F.broadcast(largest_keys(counts, "skill", n, "n_postings")), "skill", "left_semi")


def vocabulary(skill_rows: DataFrame) -> DataFrame:
    return skill_rows.groupBy("skill").agg(F.count(F.lit(1)).alias("n_mentions"))


def role_skills(postings: DataFrame, skills: DataFrame, category: str, level: str, n: int = 20) -> DataFrame:
    ids = postings.filter((F.col("category_filled") == category) & (F.col("level_filled") == level)).select("id")
    return top_values(skills.join(ids, "id", "left_semi"), "skill", n, "n_mentions")


def gap_stats(postings: DataFrame, skills: DataFrame, missing: DataFrame, category: str, level: str, salary_col: str) -> DataFrame:
    """Demand and median salary inside a role for each missing skill."""
    role = postings.filter((F.col("category_filled") == category) & (F.col("level_filled") == level)).select("id", salary_col)
    rows = skills.join(missing, "skill", "left_semi").distinct().join(role, "id")
    demand = rows.groupBy("skill").agg(F.count_distinct("id").alias("demand"))
    medians = exact_median(rows, ["skill"], salary_col, "median_salary").drop("n_values")
    return missing.join(demand, "skill", "left").join(medians, "skill", "left").select(
        "skill", F.coalesce("demand", F.lit(0)).alias("demand"), "median_salary"
    )


def company_summary(employer: DataFrame, skill_counts: DataFrame, salary_col: str, n: int = 20) -> DataFrame:
    """Largest employers: postings, median salary, mean skills and first four distinct titles."""
    rows = employer.filter(present("company_clean"))
    top = rows.groupBy("company_clean").agg(F.count("id").alias("n_postings")).orderBy(
        F.desc("n_postings"), F.asc("company_clean")
    ).limit(n)
    mine = rows.join(F.broadcast(top), "company_clean")
    means = mine.join(skill_counts, "id", "left").groupBy("company_clean").agg(
        F.max("n_postings").alias("n_postings"),
        (F.sum(F.coalesce("skills_count", F.lit(0))) / F.count(F.lit(1))).alias("avg_skills"),
    )
    titles = (
        mine.filter(present("title_final"))
        .groupBy("company_clean", "title_final").agg(F.min("id").alias("first_id"))
    )
    titles = (
        head_per_key(titles, ["company_clean"], [F.asc("first_id")], 4)
        .groupBy("company_clean").agg(F.sort_array(F.collect_list(F.struct("first_id", "title_final"))).alias("t"))
        .select("company_clean", F.array_join(F.col("t.title_final"), ", ").alias("open_roles"))
    )
    medians = exact_median(mine, ["company_clean"], salary_col, "median_salary").drop("n_values")
    return means.join(medians, "company_clean", "left").join(titles, "company_clean", "left")


def company_kpis(base: DataFrame, employer: DataFrame, salary_col: str) -> DataFrame:
    """Employers, those with two postings or more, coverage, remote share of all rows."""
    per_company = employer.groupBy("company_clean").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(salary_col).alias("with_salary"),
        F.count(F.when(F.col("work_format_norm") == "remote", 1)).alias("remote"),
    )
    named = present("company_clean")
    return per_company.agg(
        F.count(F.when(named, 1)).alias("n_companies"),
        F.count(F.when(named & (F.col("n") >= 2), 1)).alias("n_hiring"),
        F.sum("with_salary").alias("_salary"),
        F.sum("remote").alias("_remote"),
        F.sum("n").alias("_n"),
    ).select(
        "n_companies", "n_hiring",
        percent(F.col("_salary"), row_count(base)).alias("salary_coverage_pct"),
        percent(F.col("_remote"), F.col("_n")).alias("remote_share_all_rows_pct"),
    )


def company_mix(employer: DataFrame, col: str, n: int = 12) -> DataFrame:
    """Counts per (employer, value) for the ``n`` largest employers."""
    rows = employer.filter(present("company_clean") & F.col(col).isNotNull())
    top = employer.filter(present("company_clean")).groupBy("company_clean").agg(F.count(F.lit(1)).alias("_n"))
    top = top.orderBy(F.desc("_n"), F.asc("company_clean")).limit(n).select("company_clean")
    return count_by(
        rows.join(F.broadcast(top), "company_clean", "left_semi"),
        {"company_clean": F.col("company_clean"), col: F.col(col)},
    )


def company_pivot(employer: DataFrame, col: str, values: Sequence[str], n: int = 12) -> DataFrame:
    mix = company_mix(employer, col, n)
    return mix.groupBy("company_clean").agg(
        *[F.coalesce(F.sum(F.when(F.col(col) == v, F.col("n_rows"))), F.lit(0)).alias(f"n_{v}") for v in values]
    )


CITY_BUCKETS = CITY_ORDER
