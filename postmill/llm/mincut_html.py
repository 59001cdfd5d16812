"""Main text of HTML pages by minimum cut: block scores are terminal capacities, nearness in page and tree smooths the labels."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose inside is never text of the page: those of raw text, which only their end tag ends, and those with elements inside.
_RAW = "script|style|noscript|iframe|title|textarea"
_DROPPED = frozenset("template svg annotation annotation-xml object select button canvas audio video".split())
_FOREIGN = frozenset(["svg"])
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?![^\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
#: An attribute's name and value; what stands in quotes is no name.
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?|\"[^\"]*\"|'[^']*'")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_STOPS = re.compile(r"[.,;:!?…。，！？]")

_CONTAINERS = frozenset("html body article aside section nav header footer main div form fieldset ul ol menu dl table tbody thead tfoot tr td th figure details dialog blockquote center li dd dt".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 hgroup pre hr address caption figcaption legend summary head option optgroup label input".split())
_VOID = frozenset("input hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and words in class, id or role that mark what is not the article.
_APART = frozenset("nav aside footer form fieldset menu dialog".split())
_APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead header topbar footer foot contentinfo complementary copyright cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay dialog "
    "newsletter subscribe subscription signup login signin register search form comment comments commentlist reply replies respond response responses discussion disqus "
    "feedback share sharing social related recommended recommendations trending popular more widget toolbar pagination pager skip legal paywall "
    "kommentar kommentare comentario comentarios commentaire commentaires werbung anzeige anzeigen publicidad publicite anuncio anuncios teilen compartir partager "
    "navegacion seitenleiste seitenspalte hinweis hinweise aviso avisos".split()
)
#: Those of them that say as much inside an article as outside: readers' words, notices, adverts and offers.
_SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe subscription signup signin login "
    "comment comments commentlist reply replies respond responses discussion disqus related recommended recommendations trending share sharing social "
    "kommentar kommentare comentario comentarios commentaire commentaires werbung anzeige anzeigen publicidad publicite anuncio anuncios teilen compartir partager "
    "hinweis hinweise aviso avisos".split()
)
#: Words before and after these in a class or id made of several; with other words ("with-sidebar", "share-price") it is no mark.
_BEFORE = frozenset("site page main top bottom left right primary secondary global sub mobile desktop the".split())
_AFTER = frozenset(
    "box bar container wrapper wrap inner outer area list block section group row item items link links button buttons btn unit slot card cards icon icons title body panel "
    "posts articles stories news text message left right top bottom primary secondary main mobile desktop count meta reply thread".split()
)
#: Names of titles, no mark inside an article.
_TITLE_WORDS = frozenset("masthead header topbar banner".split())
#: What a mark costs a block: outside of articles, by its element or by one of _SURE_WORDS, and by another name inside an article.
_APART_COST, _NAMED_COST = 1200, 400
_MAIN_WORDS = frozenset("article content post entry main story body text".split())


@dataclass
class Block:
    """One stretch of text between block tags, and what its place says about it."""

    tag: str
    path: tuple[int, ...]
    apart: bool
    article: bool
    main: bool
    mark: int = 0
    inside: bool = False
    sure: bool = False
    text: str = ""
    linked: int = 0


@dataclass
class _Open:
    name: str
    number: int
    apart: bool
    article: bool
    main: bool
    mark: int = 0
    inside: bool = False
    sure: bool = False
    dropped: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    tag: str = "body"

    def close_block(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            shown = [o for o in self.open if not o.dropped]
            top = shown[-1] if shown else _Open("", 0, False, False, False)
            linked = len("".join(" ".join(unescape("".join(self.linked)).split())))
            self.blocks.append(Block(self.tag, tuple(o.number for o in shown), top.apart, top.article, top.main, top.mark, top.inside, top.sure, text, linked))
        self.parts, self.linked = [], []


def _names_apart(name: str, inside: bool) -> bool:
    """Whether one class, id or role says that this is not the article: a word of _APART_WORDS, alone or with _BEFORE and _AFTER."""
    parts = _WORD.findall(name)
    while parts and parts[0] in _BEFORE:
        parts = parts[1:]
    if not parts or parts[0] not in _APART_WORDS or (inside and parts[0] in _TITLE_WORDS):
        return False
    return all(p in _APART_WORDS or p in _AFTER or p.isdigit() for p in parts)


def _entered(name: str, attributes: str, above: _Open | None, number: int) -> _Open:
    names: list[str] = []
    hidden = False
    if attributes and not attributes.isspace():
        given: dict[str, str] = {}
        for key, *values in _ATTRIBUTE.findall(attributes):
            if key:
                given.setdefault(key.lower(), "".join(values))
        names = " ".join(given.get(k, "") for k in ("class", "id", "role")).lower().split()
        hidden = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or bool(_NOT_SHOWN.search(given.get("style", "")))
    above = above or _Open("", 0, False, False, False)
    article = name == "article" or above.article
    # A header inside an article is its title, one outside is the site's. The whole page or its body may be hidden at first.
    apart = ((hidden or name in _APART or (name == "header" and not article)) and name not in ("html", "body")) or above.apart
    main = name == "main" or any(w in _MAIN_WORDS for n in names for w in _WORD.findall(n)) or above.main
    # The outermost container that a name marks; what a mark inside an article says is less certain. Main text ends a mark from outside.
    mark, inside, sure = (0, False, False) if name == "main" else (above.mark, above.inside, above.sure)
    if name not in ("html", "body") and (not mark or (inside and not sure)):
        marks = [n for n in names if _names_apart(n, above.article)]
        if marks:
            mark, inside = mark or number, above.article
            sure = above.article and any(_SURE_WORDS & set(_WORD.findall(n)) for n in marks)
    return _Open(name, number, apart, article, main, mark, inside, sure)


def _broken(name: str, kinds: set[str]) -> bool:
    """Whether an element of this name can't be inside open dropped elements of these kinds, so that their end tags are missing."""
    if "template" in kinds:
        return False
    if kinds & _FOREIGN and "foreignobject" not in kinds:
        return name in _BLOCKS
    return name in ("article", "main", "body") or (name in ("button", "select") and name in kinds)


def page_blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; end tags that are missing or wrong are borne."""
    page, at, link, count = _Page(), 0, False, 0
    for m in _TOKEN.finditer(html):
        dropped = bool(page.open) and page.open[-1].dropped
        if m.start() > at and not dropped:
            text = html[at : m.start()]
            page.parts.append(text)
            if link:
                page.linked.append(text)
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            continue
        name, ends = name.lower(), bool(m[2] or m[5])
        attributes = m[4] or m[7] or ""
        if dropped and not ends:
            outer = next(k for k, o in enumerate(page.open) if o.dropped)
            kinds = {o.name for o in page.open[outer:]}
            if _broken(name, kinds):
                # A missing end tag: what can't be inside ends the element.
                del page.open[outer:]
                dropped = False
        if dropped or name in _DROPPED:
            if not ends:
                closed = attributes.endswith("/") and (name in _FOREIGN or kinds & _FOREIGN if dropped else name in _FOREIGN)
                if not closed and (name in _DROPPED or name in _CONTAINERS or name == "foreignobject"):
                    page.open.append(_Open(name, 0, False, False, False, dropped=True))
                continue
            at_name = next((k for k in range(len(page.open) - 1, -1, -1) if page.open[k].name == name), None)
            if at_name is None:
                continue
            if page.open[at_name].dropped:
                del page.open[at_name:]
                continue
            # The end tag of a container around it.
        if name == "a":
            link = not ends
            continue
        if name == "br":
            page.parts.append(" ")
            continue
        if name not in _BLOCKS:
            continue
        page.close_block()
        if ends:
            if name in _CONTAINERS and any(o.name == name for o in page.open):
                while page.open.pop().name != name:
                    pass
            page.tag = page.open[-1].name if page.open else "body"
            continue
        if name in _CONTAINERS:
            if name in ("li", "dd", "dt", "td", "th", "tr") and page.open and page.open[-1].name == name:
                page.open.pop()
            count += 1
            page.open.append(_entered(name, attributes, page.open[-1] if page.open else None, count))
            link = link and name not in ("li", "td", "div", "article", "section")
        if name not in _VOID:
            page.tag = name
    if not (page.open and page.open[-1].dropped):
        page.parts.append(html[at:])
    page.close_block()
    return page.blocks


def block_score(b: Block) -> int:
    """Hundredths of the log-odds that a block is content."""
    score = -50
    score += 300 if b.article else 150 if b.main else 0
    score += 150 if b.tag == "h1" else 60 if b.tag in _HEADINGS else 100 if b.tag == "p" else 50 if b.tag in ("blockquote", "pre", "figcaption", "td") else 0
    score += min(250, len(b.text) * 5 // 4)
    score += min(120, 30 * len(_STOPS.findall(b.text)))
    # A list of links is a menu, but in an article it may be its references.
    score -= (250 if b.article else 400) * b.linked // max(1, len(b.text))
    if b.apart:
        score -= _APART_COST
    elif b.mark:
        score -= _NAMED_COST if b.inside and not b.sure else _APART_COST
    if "©" in b.text:
        score -= 250
    return score


def _outweighed(blocks: list[Block]) -> None:
    """Takes the mark from the container with the most prose, if what no mark covers has less than a quarter of that."""
    prose: dict[int, int] = {}
    for b in blocks:
        if not b.apart and b.tag not in _HEADINGS:
            unmarked = block_score(b) + (0 if not b.mark else _NAMED_COST if b.inside and not b.sure else _APART_COST)
            if unmarked > 0 and (not b.inside):
                prose[b.mark] = prose.get(b.mark, 0) + len(b.text) - b.linked
    most = max((m for m in prose if m), key=lambda m: (prose[m], -m), default=0)
    if most and 4 * prose.get(0, 0) < prose[most]:
        for b in blocks:
            if b.mark == most:
                b.mark = 0


def _edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness between neighbours in the page, by their distance in the tree, and between a container's successive blocks."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            common = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                common += 1
            steps = len(a.path) + len(b.path) - 2 * common
            out.append((i - 1, i, 5 if (a.apart, a.mark) != (b.apart, b.mark) else 120 // (1 + steps)))
        near = last.get(b.path)
        if near is not None and near < i - 1:
            out.append((near, i, 60))
        last[b.path] = i
    return out


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that minimise the scores given up plus the weights of edges between unlike labels: maximum flow by blocking flows.

    A positive score is a capacity from the source (content), a negative one a capacity to the sink.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, forth: int, back: int) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            connect(source, i, s, 0)
        elif s < 0:
            connect(i, sink, -s, 0)
    for a, b, w in edges:
        if w > 0:
            connect(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in arcs[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                cut = len(path)
                for k in range(len(path) - 1, -1, -1):
                    room[path[k]] -= flow
                    room[path[k] ^ 1] += flow
                    if not room[path[k]]:
                        cut = k
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            go = arcs[v]
            while turn[v] < len(go) and not (room[go[turn[v]]] and level[to[go[turn[v]]]] == level[v] + 1):
                turn[v] += 1
            if turn[v] < len(go):
                path.append(go[turn[v]])
                v = to[path[-1]]
            elif not path:
                break
            else:
                v = to[path.pop() ^ 1]
                turn[v] += 1


def main_text(html: str | None) -> str:
    """The blocks on the content side of the cut, joined by an empty line."""
    blocks = page_blocks(html or "")
    _outweighed(blocks)
    scores = [block_score(b) for b in blocks]
    if min(scores, default=0) > 0:
        content = [True] * len(blocks)
    else:
        content = minimum_cut(scores, _edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``: the article's text from the whole html.

    Text is cut into blocks at block elements; references are decoded, and white space in a block becomes one space. n_chars counts
    code points. A null or empty page, or one without content, has an empty text. Rows are worked on by themselves: repeated and
    null ids stay as they are. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
