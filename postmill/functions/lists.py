"""Column builders for lists of skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import distinct_ignore_case, is_meaningful, let, squeeze

EMPTY = "array<string>"


def _trimmed(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def parse_list(text: Column) -> Column:
    """Text → list: JSON array, else a Python-style list, else parts between commas.

    A lone JSON or literal value is a list of one. Items are trimmed, blanks go,
    later spellings of the same item go.
    """
    return let(F.trim(text), _parse_list)


def _parse_list(body: Column) -> Column:
    absent = F.lower(body).isin("", "nan", "none", "null") | body.isNull()
    as_json = F.from_json(body, "array<string>")
    is_list = F.startswith(body, F.lit("[")) & F.endswith(body, F.lit("]"))
    as_literal = F.transform(
        F.regexp_extract_all(body, F.lit("'((?:[^'\\\\]|\\\\.)*)'|\"((?:[^\"\\\\]|\\\\.)*)\"|([^\\s,\\[\\]'\"]+)"), F.lit(0)),
        lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""),
    )
    quoted = F.regexp_extract(body, "^(['\"])(.*)\\1$", 2)
    parts = F.split(body, ",")
    json_ok = F.try_parse_json(body).isNotNull()
    items = (
        F.when(absent, F.array().cast(EMPTY))
        .when(is_list & json_ok, as_json)
        .when(is_list, as_literal)
        .when(quoted != "", F.array(quoted))
        .otherwise(parts)
    )
    return distinct_ignore_case(_trimmed(items))


def combine_lists(cols: Sequence[Column]) -> Column:
    """Several list columns as one, in order, first spelling kept."""
    return distinct_ignore_case(F.concat(*[F.coalesce(c, F.array().cast(EMPTY)) for c in cols]))


def parse_json_items(text: Column) -> Column:
    """JSON list of meaningful items; a JSON string is split on ``; , / |``; anything else is empty."""
    return let(squeeze(text), _parse_json_items)


def _parse_json_items(body: Column) -> Column:
    as_list = F.from_json(body, EMPTY)
    one = F.regexp_extract(body, '^"(.*)"$', 1)
    items = (
        F.when(F.startswith(body, F.lit("[")) & F.try_parse_json(body).isNotNull(), as_list)
        .when(one != "", F.split(one, "[;,/|]\\s*"))
        .otherwise(F.array().cast(EMPTY))
    )
    return F.filter(F.transform(items, lambda x: squeeze(x)), lambda x: is_meaningful(x, 1))
