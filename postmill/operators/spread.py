"""Group-wise jobs that stay safe when one key holds a large share of all rows.

Nothing here brings a whole group into one task. Groups are combined before the
shuffle, flags travel on unique row ids, hot keys are salted, and quantiles are
read from counts of distinct values instead of from collected rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import ensure_checkpoint_dir

HOT_SHARE = 1024      # a key is hot above 1/1024 of all rows: at most 1024 hot keys
SALTS = 64
CELLS_PER_OCTAVE = 1 << 14


def seal(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` whose results later filters cannot unfold.

    A filter on a computed column is normally rewritten into the expressions the
    column comes from. Over a long chain of rules that rewriting grows without end,
    so the columns leave through a generator, which filters stay above of.
    """
    keep = [name for name in df.columns if name not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[col.alias(name) for name, col in cols.items()]))))


def first_ids(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the smallest value of the unique ``order`` column."""
    return df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)


def flag_repeats(df: DataFrame, keys: Sequence[str], order: str, out: str = "is_duplicate") -> DataFrame:
    """True for every row but the first of its key.

    The first rows are found by a combined ``min`` and joined back on the unique
    order column, so the join key is never skewed whatever the group sizes are.
    """
    firsts = first_ids(df, keys, order).withColumn("_first", F.lit(True))
    joined = df.join(firsts, order, "left")
    return joined.withColumn(out, F.col("_first").isNull()).drop("_first")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Spark trims each map partition to one row per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def head_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank_in_group") -> DataFrame:
    """First ``n`` rows per key with their rank; trimmed map-side like ``keep_first``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def attach_group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], spread: str) -> DataFrame:
    """Every row with aggregates of its group (a window sum without the window).

    Group rows are combined first. Keys above ``1 / HOT_SHARE`` of all rows are
    few by construction, so their list is broadcast; their rows are spread over
    ``SALTS`` buckets by a hash of ``spread`` and meet a replicated group row.
    Keys must not be null.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    total = stats.agg(F.sum("_n")).scalar()
    is_hot = F.col("_n") > total / F.lit(HOT_SHARE)
    hot = stats.filter(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salted = df.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)),
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    groups = stats.withColumn("_salt", F.explode(copies))
    return salted.join(groups, [*keys, "_salt"], "left").drop("_salt", "_hot", "_n")


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_no") -> DataFrame:
    """Global 0-based position in ``order`` (which must be total), without a one-task window.

    Rows are range-sorted, numbered inside their partition and written to the
    reliable checkpoint folder, so a lost executor cannot renumber them. The
    only thing summed globally is one count per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.orderBy(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + local)
        .drop("_part", "_mid", "_before")
    )


def _cell(value: Column) -> Column:
    """Monotone bucket of a double: about 1/24000 wide, 2^14 for each doubling."""
    size = F.floor(F.lit(float(CELLS_PER_OCTAVE)) * F.log2(F.lit(1.0) + F.abs(value)))
    return F.when(value < 0, -size).otherwise(size)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count: str = "n_values") -> DataFrame:
    """Exact linear-interpolated quantiles per key.

    Rows become (key, distinct value, count), combined map-side. Counts per
    value band, about 1/24000 wide, give the band that holds each wanted rank;
    only those bands are ordered. No task ever sees a whole group, and a key has
    at most some hundred thousand bands over the values that money takes. Null and NaN are no values. Keys must not be null; keys with no value
    give no row.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(v))
        .select(*keys, v.alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cell", _cell(F.col("_v")))
    )
    by_key = Window.partitionBy(*keys)
    cells = (
        counts.groupBy(*keys, "_cell")
        .agg(F.sum("_c").alias("_cc"))
        .withColumn("_end", F.sum("_cc").over(by_key.orderBy("_cell")))
        .withColumn("_n", F.sum("_cc").over(by_key))
        .withColumn("_before", F.col("_end") - F.col("_cc"))
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_n") - 1)

    wanted = None
    for p in probs.values():
        for rank in (F.floor(position(p)), F.ceil(position(p))):
            inside = (rank >= F.col("_before")) & (rank < F.col("_end"))
            wanted = inside if wanted is None else wanted | inside
    cells = cells.filter(wanted).select(*keys, "_cell", "_before", "_n")

    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_v")
    placed = (
        counts.join(cells, [*keys, "_cell"])
        .withColumn("_hi", F.col("_before") + F.sum("_c").over(in_cell))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    picks = []
    for i, p in enumerate(probs.values()):
        for side, rank in (("l", F.floor(position(p))), ("h", F.ceil(position(p)))):
            hit = (rank >= F.col("_lo")) & (rank < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    grouped = placed.groupBy(*keys) if keys else placed.groupBy()
    out = grouped.agg(F.max("_n").alias("_n"), *picks)
    values = [
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (position(p) - F.floor(position(p)))).alias(name)
        for i, (name, p) in enumerate(probs.items())
    ]
    return out.select(*keys, F.col("_n").alias(count), *values)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, count: str = "n_values") -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5}, count)
