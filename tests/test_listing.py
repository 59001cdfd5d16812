"""The stored listing against plain filters: counts, facet counts, pages, and what a page reads."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from postmill.operators import listing
from postmill.operators.rows import apply_facets

COLUMNS = "id long, city_norm string, category_filled string, level_filled string, work_format_norm string, source_family string, quality_tier string, english_required boolean"
SELECTIONS = [{}, {"city": ["a"]}, {"city": ["a", "b"], "category": ["x"]}, {"level": ["none such"]}, {"city": ["c"], "level": [], "quality_tier": ["A", "B"], "source": ["s"]}]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(2)
    pick = lambda xs: rng.choice(xs)
    rows = [(n * 3, pick(["a", "b", "c", None, ""]), pick(["x", "y"]), pick(["j", "s", None]), pick(["o", "r"]), pick(["s", "t"]), pick("ABCD"), pick([True, False])) for n in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5).cache()
    return df, listing.write_listing(df, str(tmp_path_factory.mktemp("listing")), ["id"], block=500)


@pytest.mark.parametrize("selection", SELECTIONS)
def test_counts_equal_the_filter(table, selection):
    df, store = table
    want = apply_facets(df, selection)
    assert store.count(selection) == want.count()
    pairs = F.array(*[F.struct(F.lit(x).alias("facet"), F.trim(F.col(listing.FACET_COLUMNS[x])).alias("value")) for x in listing.FACETS])
    counts = want.select(F.inline(pairs)).where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").count()
    assert sorted(map(tuple, store.facet_counts(selection).collect())) == sorted(map(tuple, counts.collect()))


@pytest.mark.parametrize("selection", SELECTIONS)
def test_pages_equal_the_sorted_filter(table, selection):
    df, store = table
    ids = sorted(r.id for r in apply_facets(df, selection).collect())
    for page in (1, 2, 7, 10_000):
        got = store.page(selection, page, 12).collect()
        assert [r.id for r in got] == ids[(page - 1) * 12 : page * 12]
        assert all(r.total == len(ids) and r.pages == max(-(-len(ids) // 12), 1) for r in got)


def test_late_pages_read_as_many_files_as_early_ones(table):
    _, store = table
    total = store.rows().select(F.input_file_name().alias("f")).distinct().count()
    read = lambda p: store.page({"category": ["x"]}, p, 12).select(F.input_file_name().alias("f")).distinct().count()
    assert read(1) <= 2 and read(150) <= 2 and total >= 8
    plan = store.page({"category": ["x"]}, 150, 12)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block", plan)


def test_many_chunks(spark, tmp_path):
    df = spark.range(100_000).select("id", (F.col("id") % 7).cast("string").alias("city_norm"))
    store = listing.write_listing(df, str(tmp_path), ["id"], ["city"])
    assert store.count({"city": ["3"]}) == 14286 and store.count({"city": ["3", "5"]}) == 28571
    assert [r.id for r in store.page({"city": ["3"]}, 1000, 12).collect()] == [7 * n + 3 for n in range(11988, 12000)]
    assert store.page({"city": ["3"]}, 1000, 12).first().pages == 1191


def test_empty(spark, tmp_path):
    store = listing.write_listing(spark.createDataFrame([], COLUMNS), str(tmp_path), ["id"])
    assert store.count({}) == 0 and store.facet_counts({"city": ["a"]}).count() == 0 and store.page({}, 1, 5).count() == 0
