"""A stored listing: rows in listing order, and a bitmap of row numbers for each facet value.

Rows are numbered once in the listing's order and lie in folders of BLOCK successive numbers. The index holds, for each facet value and each
run of 32 768 numbers (a *chunk*), the numbers of its rows as one bitmap of 4 KB. A selection is an or of bitmaps within a facet and an and
across facets, chunk by chunk; counts and pages come from the index, and only the folders in which a page's rows lie are read. Both parts are
Parquet; a new version of the listing is a new folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.operators.rows import FACET_COLUMNS
from postmill.operators.spread import number_rows

#: Rows of a folder, and row numbers of a bitmap (fixed by Spark's bitmap functions).
BLOCK, CHUNK = 1 << 16, 1 << 15
#: Facets of few values. One of very many (the company) would take a bitmap for nearly every row; it is filtered by its column.
FACETS = ("city", "category", "level", "work_format", "source", "quality_tier")
ALL = "*"


def _bits() -> list:
    """Chunk (from 1) and bit of a row number; the bitmap functions count from 1."""
    n = F.col("row_no") + 1
    return [F.bitmap_bucket_number(n).alias("chunk"), F.bitmap_bit_position(n).alias("bit")]


def write_listing(df: DataFrame, path: str, order: Sequence[str], facets: Sequence[str] = FACETS, block: int = BLOCK) -> Listing:
    """Store the rows of ``df`` in the order of the columns ``order`` (ascending, nulls last, total), with an index of ``facets``.

    Null and blank values of a facet have no bitmap: no selection asks for them.
    """
    columns = {x: FACET_COLUMNS.get(x, x) for x in facets}
    numbered = number_rows(df, [F.asc_nulls_last(x) for x in order], "row_no")
    # Numbers follow the order, so a range of them is one task's, and a folder has one file or two.
    placed = numbered.withColumn("block", F.floor(F.col("row_no") / block).cast("long"))
    placed.repartitionByRange("row_no").sortWithinPartitions("row_no").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    spark = df.sparkSession
    # The schema is given, as a listing without rows has no file to tell it.
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    pairs = F.array(F.struct(F.lit(ALL).alias("facet"), F.lit(ALL).alias("value")), *[
        F.struct(F.lit(x).alias("facet"), F.trim(F.col(column).cast("string")).alias("value")) for x, column in columns.items()])
    entries = rows.select("row_no", F.inline(pairs)).where("value IS NOT NULL AND value <> ''")
    # Values are combined where they lie; a chunk's bits meet once for each value.
    index = entries.select("facet", "value", *_bits()).groupBy("facet", "value", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    index.write.mode("overwrite").partitionBy("facet").parquet(f"{path}/index")
    return Listing(spark, path, block, placed.schema)


class Listing:
    """Counts and pages of a stored listing under a selection: facet → values, of which any will do; facets without values don't narrow."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, schema: StructType | None = None):
        self.spark, self.path, self.block, self.schema = spark, path, block, schema

    def rows(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/rows")

    def index(self) -> DataFrame:
        return self.spark.read.schema("facet string, value string, chunk long, bits binary").parquet(f"{self.path}/index")

    def selected(self, selection: Mapping[str, Sequence[str]]) -> DataFrame:
        """chunk, bits: the row numbers that meet the selection."""
        asked = {facet: list(values) for facet, values in selection.items() if values}
        index = self.index()
        if not asked:
            return index.where(F.col("facet") == ALL).select("chunk", "bits")
        wanted = F.lit(False)
        for facet, values in asked.items():
            wanted = wanted | ((F.col("facet") == facet) & F.col("value").isin(values))
        either = index.where(wanted).groupBy("chunk", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = either.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits"))
        # A chunk without rows of one of the facets has no bitmap of it, and no row.
        return both.where(F.col("n") == len(asked)).select("chunk", "bits")

    def count(self, selection: Mapping[str, Sequence[str]]) -> int:
        return self.selected(selection).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).first()["n"]

    def facet_counts(self, selection: Mapping[str, Sequence[str]]) -> DataFrame:
        """facet, value, n: rows of each value under the selection; values without a row are left out. Reads the index only."""
        met = self.selected(selection).withColumnRenamed("bits", "chosen")
        every = self.index().where(F.col("facet") != ALL).join(met, "chunk")
        pair = every.select("facet", "value", "chunk", F.explode(F.array("bits", "chosen")).alias("bits"))
        both = pair.groupBy("facet", "value", "chunk").agg(F.bitmap_and_agg("bits").alias("bits"))
        return both.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")

    def numbers(self, selection: Mapping[str, Sequence[str]], start: int, limit: int) -> list[int]:
        """Row numbers of the selected rows from place ``start`` on, ``limit`` at most: only the chunks that hold them are spelled out."""
        met = self.selected(selection).withColumn("n", F.bitmap_count("bits"))
        # One row per chunk of 32 768 listing rows goes through the window, with the counts alone.
        before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = met.select("chunk", "n").withColumn("before", before)
        hit = places.where((F.col("before") < start + limit) & (F.col("before") + F.col("n") > start)).select("chunk", "before")
        spelled = met.join(F.broadcast(hit.limit(limit)), "chunk")
        at = F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1)))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = spelled.select("chunk", "before", "bits", at.alias("bit")).where(F.getbit(byte, F.col("bit") % 8) == 1)
        placed = set_.select((F.col("before") + F.row_number().over(Window.partitionBy("chunk").orderBy("bit")) - 1).alias("place"), ((F.col("chunk") - 1) * CHUNK + F.col("bit")).alias("row_no"))
        return [r["row_no"] for r in placed.where((F.col("place") >= start) & (F.col("place") < start + limit)).orderBy("place").collect()]

    def page(self, selection: Mapping[str, Sequence[str]], page: int, limit: int) -> DataFrame:
        """Rows of a page (from 1), with the total and the page count on each row; the folders of its rows are read, and no others."""
        numbers = self.numbers(selection, (page - 1) * limit, limit)
        total = self.count(selection)
        blocks = sorted({n // self.block for n in numbers})
        rows = self.rows().where(F.col("block").isin(blocks) & F.col("row_no").isin(numbers)) if numbers else self.rows().limit(0)
        return rows.orderBy("row_no").drop("block").withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(max(-(-total // limit), 1)).cast("long")})
