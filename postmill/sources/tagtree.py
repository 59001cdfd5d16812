"""A page's tag tree as columns: its tokens, and its elements with their ends, depth and parent; all by array expressions on the row.

An end tag closes the nearest open element of its name and everything that is open inside it; one without an open element says nothing.
What is open at the end of the page ends there. Void elements and self-closed tags hold nothing, scripts and styles are one token, and
comments and declarations are no text. Rows are not exploded or shuffled: a page is read where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import let, squeeze, unescape

# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style"]

_VALUE = "(?:\"[^\"]*+\"|'[^']*+'|[^\\s>\"']++)"
#: Comments, scripts and styles, tags (with quoted values that may hold a ``>``), declarations, text, and a lone ``<``.
TOKEN = "(?is)<!--.*?(?:-->|\\z)|<(script|style)\\b[^>]*+>.*?(?:</\\1\\s*+>|\\z)|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*+>|[^<]++|<"
#: Tags that are worked on together; their results join those of the others once.
CHUNK = 256

_OPEN = "array<struct<at:int,name:string>>"
_DONE = "array<struct<start:int,end:int,depth:int,parent:int,name:string>>"


def _attribute(name: str) -> str:
    """The value of a named attribute of a start tag, quotes included; other attributes' values are passed over."""
    other = f"\\s++(?!{name}\\s*=)[^\\s=/>\"']++(?:\\s*+=\\s*+{_VALUE})?+"
    return f"(?is)^<[a-z][^\\s/>]*+(?:{other})*+\\s++{name}\\s*+=\\s*+({_VALUE})"


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of an attribute of a start tag; '' without it."""
    return unescape(F.regexp_replace(F.regexp_extract(tag, _attribute(name), 1), "^[\"']|[\"']$", ""))


def is_text(token: Column) -> Column:
    return (token == "<") | ~token.startswith("<")


def tree(html: Column) -> Column:
    """struct(tokens, elements): tokens are numbered from 0; an element's tokens lie between its start and its end.

    Elements come by their start. ``depth`` counts from 1, ``parent`` is the start of the element around it, -1 without one.
    """

    def tags(tokens: Column) -> Column:
        name = lambda t: F.lower(F.regexp_extract(t, "^</?([a-zA-Z][^\\s/>]*)", 1))
        every = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1).alias("kind"), F.when(t.startswith("<"), name(t)).otherwise("").alias("name")))
        return F.filter(every, lambda t: (t["name"] != "") & (t["kind"] != 0) & ~((t["kind"] == 1) & t["name"].isin(VOID + RAW)))

    def closed(open_: Column, first: Column, end: Column) -> Column:
        """The open elements from number ``first`` (from 1) on, as they end."""
        return F.transform(F.slice(open_, first, F.size(open_) - first + 1), lambda e, j: F.struct(
            e["at"].alias("start"), end.alias("end"), (first + j).cast("int").alias("depth"),
            F.coalesce(F.get(open_, first + j - 2)["at"], F.lit(-1)).alias("parent"), e["name"].alias("name")))

    def step(state: Column, tag: Column) -> Column:
        open_, done = state["open"], state["done"]
        back = F.array_position(F.reverse(F.transform(open_, lambda e: e["name"])), tag["name"]).cast("int")
        found = (tag["kind"] == -1) & (back > 0)
        first = F.size(open_) - back + 1
        return F.struct(
            F.when(tag["kind"] == 1, F.concat(open_, F.array(F.struct(tag["at"].alias("at"), tag["name"].alias("name")))))
            .when(found, F.slice(open_, F.lit(1), first - 1)).otherwise(open_).alias("open"),
            F.when(found, F.concat(done, closed(open_, first, tag["at"]))).otherwise(done).alias("done"))

    def chunk(state: Column, some: Column) -> Column:
        zero = F.struct(state["open"].alias("open"), F.array().cast(_DONE).alias("done"))
        return let(F.aggregate(some, zero, step), lambda s: F.struct(s["open"].alias("open"), F.concat(state["done"], F.array(s["done"])).alias("done")))

    def elements(tokens: Column) -> Column:
        def of(all_tags: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_tags) - 1, F.lit(0)), F.lit(CHUNK)), lambda a: F.slice(all_tags, a + 1, F.lit(CHUNK)))
            zero = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(f"array<{_DONE}>").alias("done"))
            whole = F.aggregate(chunks, zero, chunk)
            return let(whole, lambda s: F.array_sort(F.concat(F.flatten(s["done"]), closed(s["open"], F.lit(1), F.size(tokens)))))

        return let(tags(tokens), of)

    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: F.struct(t.alias("tokens"), elements(t).alias("elements")))


def has_class(tag: Column, css: str) -> Column:
    """Whether the start tag has the class, among others or alone."""
    return F.array_contains(F.split(squeeze(attribute(tag, "class")), " "), css)


def select(page: Column, name: str, css: str | None = None) -> Column:
    """Elements of a name, and of a class, in the order of the page."""
    def wanted(e: Column) -> Column:
        out = e["name"] == name
        return out if css is None else out & has_class(F.get(page["tokens"], e["start"]), css)

    return F.filter(page["elements"], wanted)


def within(page: Column, element: Column, names: list[str]) -> Column:
    """Elements of some names inside an element, in the order of the page."""
    return let(element, lambda x: F.filter(page["elements"], lambda e: e["name"].isin(names) & (e["start"] > x["start"]) & (e["end"] <= x["end"])))


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def text_of(page: Column, element: Column, gap: str = "", strip: bool = False) -> Column:
    """The decoded texts inside an element, joined by ``gap``; each trimmed, and blank ones left out, if ``strip``. Null without an element."""
    def read(e: Column) -> Column:
        inside = F.slice(page["tokens"], e["start"] + 2, F.greatest(e["end"] - e["start"] - 1, F.lit(0)))
        texts = F.transform(F.filter(inside, is_text), lambda t: squeeze_ends(unescape(t)) if strip else unescape(t))
        return F.array_join(F.filter(texts, lambda t: t != "") if strip else texts, gap)

    return let(element, read)


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def around(page: Column, at: Column) -> Column:
    """The innermost element around a token."""
    return let(at, lambda n: F.try_element_at(F.filter(page["elements"], lambda e: (e["start"] < n) & (e["end"] > n)), F.lit(-1)))


def first_text_with(page: Column, words: str) -> Column:
    """Number of the first text token that holds the words; null without one."""
    hits = F.transform(page["tokens"], lambda t, i: F.when(is_text(t) & F.contains(t, F.lit(words)), i))
    return first(F.filter(hits, lambda i: i.isNotNull()))


def following(page: Column, element: Column, name: str) -> Column:
    """The first element of a name that starts after another one has ended."""
    return let(element, lambda x: first(F.filter(page["elements"], lambda e: (e["name"] == name) & (e["start"] > x["end"]))))


def children(page: Column, element: Column, name: str) -> Column:
    """An element's direct children of a name."""
    return let(element, lambda x: F.filter(page["elements"], lambda e: (e["name"] == name) & (e["parent"] == x["start"])))
