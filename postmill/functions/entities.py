"""HTML character references: a text is split at ``&``, and what follows is looked up once in the full table of names."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
BAD = "�"

#: Names that count without a semicolon too, also with more letters behind them, and the longest of them.
_OPEN = {name: text for name, text in html5.items() if not name.endswith(";")}
_LONGEST = max(map(len, _OPEN))


def _nested(names: dict[str, str]) -> str:
    """Names by their first two letters, as JSON, so that a look-up passes few of them."""
    out: dict[str, dict[str, str]] = {}
    for name, text in names.items():
        out.setdefault(name[:2], {})[name] = text
    return json.dumps(out)


_ALL, _OPEN_JSON = _nested(html5), _nested(_OPEN)


def _windows(n: int) -> str:
    """What the numbers 128 to 159 stand for: windows-1252, where it has a sign."""
    return bytes([n]).decode("windows-1252", "ignore") or chr(n)


def _find(table: Column, name: Column) -> Column:
    return F.try_element_at(F.try_element_at(table, F.substring(name, 1, 2)), name)


def _number(ref: Column) -> Column:
    """The number of a numeric reference; one beyond all signs if it is too long."""
    hexed = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.ltrim(F.rtrim(F.when(hexed, F.substring(ref, 3, 1 << 30)).otherwise(F.substring(ref, 2, 1 << 30)), F.lit(";")), F.lit("0"))
    some = F.when(digits == "", "0").otherwise(digits)
    return F.when(F.length(digits) > 7, 1 << 30).otherwise(F.when(hexed, F.conv(some, 16, 10)).otherwise(some).cast("int"))


def unescape(text: Column) -> Column:
    """All named and numeric references decoded once, as browsers read them; a reference to nothing stays as it is."""
    every, open_ = F.from_json(F.lit(_ALL), "map<string,map<string,string>>"), F.from_json(F.lit(_OPEN_JSON), "map<string,map<string,string>>")

    def sign(n: Column) -> Column:
        windows = F.array(*[F.lit(_windows(k)) for k in range(128, 160)])
        none = n.between(1, 8) | n.isin(11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | ((n >= 0xFFFE) & (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), BAD)
            .when(n.between(128, 159), F.get(windows, n - 128))
            .when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    def named(ref: Column) -> Column:
        parts = [F.when(F.length(ref) > k, F.concat(_find(open_, F.substring(ref, 1, k)), F.substring(ref, k + 1, 1 << 30))) for k in range(_LONGEST, 1, -1)]
        return F.coalesce(_find(every, ref), *parts, F.concat(F.lit("&"), ref))

    def decode(piece: Column) -> Column:
        ref = F.regexp_extract(piece, REFERENCE, 0)
        rest = lambda r: F.substring(piece, F.length(r) + 1, F.length(piece))
        shown = lambda r: F.when(r == "", "&").when(r.startswith("#"), F.get(F.transform(F.array(_number(r)), sign), F.lit(0))).otherwise(named(r))
        return F.get(F.transform(F.array(ref), lambda r: F.concat(shown(r), rest(r))), F.lit(0))

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&", -1)
        after = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode)
        return F.when(F.contains(t, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(after, ""))).otherwise(t)

    return F.get(F.transform(F.array(text), whole), F.lit(0))
