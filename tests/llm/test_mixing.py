from __future__ import annotations

import duckdb
import pytest

from postmill.llm.mixing import mix_sources, mixing_sql
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, source string, size string"


def mixed(spark, rows):
    return sorted(map(tuple, mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def by_sql(spark, rows):
    con = duckdb.connect()
    documents = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM documents")
    return sorted(con.execute(mixing_sql()).fetchall(), key=str)


@pytest.fixture
def rows(rng):
    sources = ["b", "a", "Ä", "z", None, ""]
    out = [(n, prose(rng, rng.choice([0, 1, 5, 60, 700])), rng.choice([*sources, "a", "a", "a"]), "x") for n in range(300)]
    return out + [(None, "one two", "a", "x"), (7, None, "b", "x"), (8, "x y \x0b z", None, "x"), (9, "same row", "z", "x"), (9, "same row", "z", "x")]


def test_against_sorted_sums(spark, rows):
    assert mixed(spark, rows) == by_sql(spark, rows)


def test_targets_and_limits(spark, rows):
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    sources = got.drop_duplicates(["target", "source_size"])
    assert sources.target.sum() == pytest.approx(got["size"].sum()) and len(sources) == 6
    for _, part in got.groupby(["target", "source_size"]):
        assert part.target.iloc[0] <= 3 * part.source_size.iloc[0]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()


def test_targets_with_null_and_repeated_ids(spark, rng, monkeypatch):
    """A third of all ids null, one id on many texts, and one row many times: each source still misses its target by less than a document."""
    rows = [(None if n % 3 == 0 else 77 if n % 3 == 1 and n < 1500 else n, prose(rng, rng.choice([3, 20, 60])), rng.choice("abcd"), "x") for n in range(3000)]
    rows += [(5000, "one row " * 6, "a", "x")] * 700 + [(None, "again and again", "b", "x")] * 500
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7))
    for _, part in got.toPandas().groupby(["target", "source_size"]):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 60
        assert (part.taken <= 3 * part["size"]).all()
    want = sorted(map(tuple, got.collect()), key=str)
    assert want == by_sql(spark, rows)
    from postmill.llm import mixing
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert mixed(spark, rows) == want


@pytest.mark.parametrize("rows_", [[], [(1, None, None, "x")], [(1, "a b", "s", "x")], [(1, "", "s", "x"), (2, "a " * 50, "t", "x")]])
def test_small(spark, rows_):
    assert mixed(spark, rows_) == by_sql(spark, rows_)


def test_targets_by_repeated_resharing(spark, rng):
    """Shares by weight; whatever exceeds three times a source is shared again among the others, until nothing does."""
    from postmill.llm.mixing import source_targets

    for _ in range(6):
        sizes = {f"s{n:02}": rng.choice([0, 1, 7, 50, 400, 9000]) for n in range(rng.randint(1, 9))}
        weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes))}
        target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
        while left > 1e-9 and open_:
            heavy = sum(weight[s] for s in open_)
            for s in open_:
                target[s] += left * weight[s] / heavy
            left = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
            for s in list(open_):
                if target[s] >= 3 * sizes[s]:
                    target[s] = 3.0 * sizes[s]
                    open_.discard(s)
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == target
