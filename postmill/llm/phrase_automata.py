"""Substring dedup by repeated-phrase automata: words that an earlier document has too, in windows of 13, are removed."""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from postmill.llm.recurrence import Stretches, Windows, repeats, sha256

WINDOW_WORDS = 13
#: Stretches that one automaton is made for; those of one hash stay together.
SHARD_STRETCHES = 20_000
#: Word numbers become characters; the surrogates' block can't be used.
_SURROGATES, _SURROGATE_COUNT = 0xD800, 0x800


def _spelled(texts: list[bytes]) -> list[str]:
    """Each text with one character per word; equal words, and only those, have equal characters."""
    numbers: dict[bytes, str] = {}
    out = []
    for text in texts:
        word = []
        for w in text.split():
            c = numbers.get(w)
            if c is None:
                n = len(numbers) + 1
                c = numbers[w] = chr(n if n < _SURROGATES else n + _SURROGATE_COUNT)
            word.append(c)
        out.append("".join(word))
    return out


def recurring_phrases(spelled: list[str], docs: list[int], size: int) -> dict[str, int]:
    """Windows that at least two documents have, with the smallest of these."""
    least: dict[str, int] = {}
    many: set[str] = set()
    for text, doc in zip(spelled, docs, strict=True):
        for i in range(len(text) - size + 1):
            w = text[i : i + size]
            known = least.setdefault(w, doc)
            if known != doc:
                many.add(w)
                if doc < known:
                    least[w] = doc
    return {w: least[w] for w in many}


def later_windows(s: Stretches, size: int = WINDOW_WORDS, most: int = SHARD_STRETCHES) -> np.ndarray:
    """For each window of ``size`` words, in the stretches' order, whether a smaller document has the same words.

    The stretches, sorted by hash, are cut into sub-shards at changes of the hash. In each, the windows that recur are confirmed on
    their words and compiled into an automaton, through which all the stretches are streamed.
    """
    out = np.zeros(int(s.n.sum()), bool)
    base = np.append(0, np.cumsum(s.n))
    heads = np.append(np.flatnonzero(np.append(True, s.code[1:] != s.code[:-1])), len(s.n))
    g = 0
    while g < len(heads) - 1:
        to = max(g + 1, int(np.searchsorted(heads, heads[g] + most, side="right")) - 1)
        a, b = int(heads[g]), int(heads[to])
        spelled = _spelled([s.text[s.at[n] : s.at[n + 1]].tobytes() for n in range(a, b)])
        docs = s.doc[a:b].tolist()
        phrases = recurring_phrases(spelled, docs, size)
        if phrases:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for w, doc in phrases.items():
                automaton.add_word(w, doc)
            automaton.make_automaton()
            found = []
            for n, (text, doc) in enumerate(zip(spelled, docs, strict=True)):
                at = int(base[a + n]) - size + 1
                found += [at + end for end, first in automaton.iter(text) if first < doc]
            out[found] = True
        g = to
    return out


def dedup_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove from each text the words covered by a window of 13 that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returns one row per row: doc_id, n_words, n_removed, kept_sha256 (kept words
    joined by one space), and with ``with_text`` kept_text. Windows are judged on the input and never cross documents. A null
    or empty text has no words. Exact copies lose every word but for their smallest id (texts under 13 words lose none).
    Rows with the same id are not earlier than each other; a row without id keeps its words and takes none. Other
    columns are not read. An empty table gives an empty result.
    """

    def finish(text: bytes, copy: bool, runs: list[tuple[int, int]]) -> tuple:
        words = text.split()
        if copy and len(words) >= WINDOW_WORDS:
            runs = [(0, len(words))]
        kept, at = [], 0
        for i, j in runs:
            kept += words[at:i]
            at = j
        kept += words[at:]
        rest = b" ".join(kept)
        row = (len(words), len(words) - len(kept), sha256(rest))
        return (*row, rest.decode("utf-8", "replace")) if with_text else row

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return repeats(docs, id_col, text_col, Windows(WINDOW_WORDS, 5, words=True), later_windows, finish, schema)


def phrases_sql(size: int = WINDOW_WORDS) -> str:
    """DuckDB SQL for ``dedup_phrases`` over ``documents`` with distinct ids: every window of words, on small tables."""
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS k FROM u),
m AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
hit AS (SELECT doc_id, i, i + {size} AS j FROM x JOIN m USING (k) WHERE doc_id > first),
edge AS (SELECT *, CASE WHEN i <= lag(j) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
r AS (SELECT doc_id, run, min(i) AS i, max(j) AS j FROM numbered GROUP BY 1, 2),
p AS (
  SELECT doc_id, run, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY run), 1) AS a, i AS b FROM r
  UNION ALL SELECT doc_id, max(run) + 1, max(j), NULL FROM r GROUP BY doc_id),
q AS (SELECT doc_id, run, array_to_string(w[a:coalesce(b - 1, len(w))], ' ') AS piece FROM p JOIN t USING (doc_id) WHERE a <= coalesce(b - 1, len(w))),
k AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY run) AS rest FROM q GROUP BY doc_id),
s AS (SELECT doc_id, sum(j - i) AS n_removed FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE coalesce(rest, '') END) AS kept_sha256
FROM t LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"""
