"""Named queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.plans.fixtures import FIXTURES, base_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The test tables of one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table or view for heavy text work, dealt anew by a key so that long texts and few files don't make few tasks."""
        df = self.table(name) if name in base_tables else self.view(name)
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    def sql(self, body: str) -> DataFrame:
        text = with_views(body)
        names = "|".join(base_tables)
        text = re.sub(
            rf"\b(FROM|JOIN)\s+({names})\b",
            lambda m: f"{m[1]} parquet.`{self.dir}/{m[2]}.parquet` AS {m[2]}",
            text,
        )
        return self.spark.sql(text)


def with_views(body: str) -> str:
    """Put the derived views that ``body`` names in front of it, as a WITH list."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(FIXTURES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS (\n{FIXTURES[n].strip()}\n)" for n in needed)
    stripped = body.strip()
    if re.match(r"(?i)with\s", stripped):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` and, when SQL can say it, its check."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
