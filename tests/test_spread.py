"""Group jobs against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.operators import spread


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 3000
    return pd.DataFrame({
        "id": np.arange(n), "k": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 40, n).astype(str)),
        "v": np.where(rng.random(n) < 0.1, np.nan, np.round(rng.normal(0, 1000, n), 1)),
    })


def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows).withColumn("v", F.nanvl("v", F.lit(None)))
    got = spread.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9, "lo": 0.0, "hi": 1.0}).toPandas().set_index("k")
    for k, g in rows.dropna().groupby("k"):
        want = g["v"].quantile([0.25, 0.5, 0.9, 0, 1]).to_numpy()
        assert np.allclose(got.loc[k, ["q1", "q2", "q9", "lo", "hi"]].astype(float), want)
        assert got.loc[k, "n_values"] == len(g)
    whole = spread.exact_median(df, [], "v", "m").first()
    assert whole["m"] == pytest.approx(rows["v"].median())


def test_attach_group_with_hot_key(spark, rows):
    df = spark.createDataFrame(rows[["id", "k"]])
    got = spread.attach_group(df, ["k"], [F.count(F.lit(1)).alias("n"), F.max("id").alias("top")], "id").toPandas()
    assert len(got) == len(rows)
    assert (got["n"] == got["k"].map(rows.groupby("k").size())).all()
    assert (got["top"] == got["k"].map(rows.groupby("k")["id"].max())).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_flag_repeats_any_partitioning(spark, rows, parts):
    df = spark.createDataFrame(rows[["id", "k"]]).repartition(parts)
    got = spread.flag_repeats(df, ["k"], "id").toPandas().sort_values("id")
    assert (got["is_duplicate"].to_numpy() == rows["k"].duplicated().to_numpy()).all()


def test_number_rows(spark, rows):
    df = spark.createDataFrame(rows[["id", "k"]]).repartition(5)
    got = spread.number_rows(df, [F.desc("k"), F.asc("id")]).toPandas().sort_values("row_no")
    want = rows.sort_values(["k", "id"], ascending=[False, True])
    assert got["row_no"].tolist() == list(range(len(rows)))
    assert got["id"].tolist() == want["id"].tolist()


@pytest.mark.parametrize("partitions", [1, 200])
def test_same_result_at_any_shuffle_width(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows).withColumn("v", F.nanvl("v", F.lit(None))).repartition(3)
        medians = spread.exact_median(df, ["k"], "v", "m").toPandas().set_index("k")["m"]
        heads = spread.head_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 2).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(medians.sort_index(), rows.dropna().groupby("k")["v"].median().sort_index())
    want = rows.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(2)
    assert sorted(heads["id"]) == sorted(want["id"])


def test_quantiles_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("nan", float(v)) for v in (1, 2, 3, 4, 5)] + [("nan", nan)] * 3 + [("nan", None)]
    rows += [("inf", v) for v in (-inf, -2.5, -1.0, 0.0, inf)] + [("same", 7.0)] * 9 + [("none", nan)]
    got = {r.k: r for r in spread.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.25, "m": 0.5}).collect()}
    assert {k: (r.m, r.n_values) for k, r in got.items()} == {"nan": (3.0, 5), "inf": (-1.0, 5), "same": (7.0, 9)}
    assert got["nan"].q == 2.0 and got["inf"].q == -2.5


def test_quantiles_in_a_narrow_band(spark):
    """All values within a hundredth: no window orders more than a small part of them."""
    values = 1.7e9 + np.random.default_rng(5).random(100_000) * 1.7e7
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = spread.exact_quantiles(df, [], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).first()
    assert np.allclose([got.q1, got.m, got.q3], np.quantile(values, [0.25, 0.5, 0.75]), rtol=0, atol=1e-6)
    cells = np.floor(spread.CELLS_PER_OCTAVE * np.log2(1 + values))
    assert np.unique(cells, return_counts=True)[1].max() < 1_000
