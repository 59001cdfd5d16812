"""Column builders for text: spacing, missing words, keys, markup, lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.entities import unescape
from postmill.functions.vocab import MISSING_WORDS, TRUE_WORDS

# Every kind of white space, no-break blanks included.
SPACES = "(?U)\\s+"
KEY_CHARS = "[^0-9a-zа-яё]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Plain substring test against several words, as one pattern of quoted words."""
    return text.rlike("|".join(re.escape(word) for word in words))


def is_meaningful(text: Column, min_len: int = 2) -> Column:
    return let(squeeze(text), lambda t: (F.length(t) >= max(min_len, 1)) & ~F.lower(t).isin(MISSING_WORDS))


def is_missing_like(text: Column) -> Column:
    return F.lower(squeeze(text)).isin([*MISSING_WORDS, "[]"])


def is_missing_list(items: Column) -> Column:
    return items.isNull() | (F.size(items) == 0)


def standardize_missing(text: Column) -> Column:
    """Unescaped and squeezed text, null where it is a missing word."""
    return let(squeeze(unescape(text)), lambda t: F.when(~F.lower(t).isin(MISSING_WORDS), t))


def normalize_key(text: Column) -> Column:
    """Lower case letters and digits (Latin and Cyrillic) with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), KEY_CHARS, " "))


def clean_html(text: Column) -> Column:
    """Tags removed, six entities decoded, squeezed; blank becomes null."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return blank_to_null(squeeze(out))


def distinct_ignore_case(items: Column) -> Column:
    """First spelling of each item, in order."""
    def first_of_key(xs: Column) -> Column:
        return let(
            F.transform(xs, lambda x: F.lower(x)),
            lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1),
        )

    return let(items, first_of_key)


def strip_chars(text: Column, chars: str) -> Column:
    """Trim any of the given characters at both ends."""
    return F.btrim(text, F.lit(chars))


def split_list(text: Column) -> Column:
    """Items between ``| ; , /`` or line ends, trimmed of blanks and dashes, distinct ignoring case."""
    parts = F.split(F.coalesce(text, F.lit("")), "[|;,/\\n]+")
    items = F.filter(F.transform(parts, lambda x: strip_chars(squeeze(x), " -")), lambda x: x != "")
    return distinct_ignore_case(items)


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def lookup(text: Column, table: dict[str, str | int]) -> Column:
    """Value of a small fixed table, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), text)


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A regex group of the first match, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))
