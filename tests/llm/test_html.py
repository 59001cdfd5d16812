from __future__ import annotations

import random
from itertools import product

import pytest

from postmill.llm.mincut_html import extract_pages, main_text, minimum_cut

LONG = "A sentence of the article that goes on for a while, with commas, and ends here."


def cost(labels, scores, edges):
    given_up = sum(max(s, 0) if not x else max(-s, 0) for x, s in zip(labels, scores, strict=True))
    return given_up + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.randint(-30, 30) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.randint(0, 20)) for _ in range(rng.randint(0, 14))] if n > 1 else []
        best = min(cost(x, scores, edges) for x in product([False, True], repeat=n))
        assert cost(minimum_cut(scores, edges), scores, edges) == best


CASES = {
    "": "",
    f"<p>{LONG}</p>": LONG,
    f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>Title</h1><p><b>{LONG}<br><p>Short.</p></article><footer>&copy; me &middot; {LONG}</footer>": f"Title\n\n{LONG}\n\nShort.",
    f"<div id=content><h2>Head &amp; more</h2><p>{LONG}</p><div class='ad-box'>{LONG}</div><p>a<b>b</b>&nbsp;c\n\t d</p></div><div id=comments><article class=comment><p>{LONG}</p></article></div>": f"Head & more\n\n{LONG}\n\nab c d",
    f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p>a{{}}</style><!-- <p>{LONG}</p> --><main><p title='a > b'>{LONG}": LONG,
    f"<article><p>{LONG}</p><form><label>{LONG}</label><input value=x></form><aside>{LONG}</aside></article><div class='cookie-notice'><p>{LONG}</p></div>": LONG,
    f"<article><p>1 &lt; 2 &#233;&#x44F; {LONG}</p></article><p clas": f"1 < 2 éя {LONG}",
    f"<article><header><h1>Title of it</h1></header><p>{LONG}</p><ul><li>One.<li>Two.</ul></article><header><a href=/>Site</a></header>": f"Title of it\n\n{LONG}\n\nOne.\n\nTwo.",
}


@pytest.mark.parametrize("html", list(CASES))
def test_pages(html):
    assert main_text(html) == CASES[html]


def test_table(spark):
    rows = [(n, "u", h, "x") for n, h in enumerate(CASES)] + [(1, "u", None, "x"), (None, None, "", "x"), (1, "u", None, "x"), (9, "u", f"<p>{LONG}</p>" * 20_000, "x"), (10, "u", "<" * 5000 + "</div>" * 500 + '<a href="', "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(len(r.text) == r.n_chars for r in got)
    assert got[-2].text == "\n\n".join([LONG] * 20_000)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_real_pages_keep_the_article_only(spark):
    """On the given pages the article's blocks are known: an independent reading of them gives the same text."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_pages(pages).join(pages.drop("url"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("wrapper", ['div class="wrapper with-sidebar"', 'div class="main no-sidebar"', 'div id="read-more-content"', 'section class="legal"', 'div class="sidebar"'])
def test_wrappers_keep_their_article(wrapper):
    html = f"<body><nav><a href=x>Home</a></nav><{wrapper}><article><p>{LONG}</p><p>{LONG} {LONG}</p></article></{wrapper.split()[0]}><footer>{LONG}</footer>"
    assert main_text(html) == f"{LONG}\n\n{LONG} {LONG}"


def test_names_inside_an_article():
    html = f'<article><header class="entry-header"><h1>Title of it</h1></header><p>{LONG}</p><div class="share-price"><p>{LONG}</p></div><div id="response"><p>{LONG}</p></div><div class="share-buttons"><a href=x>Send</a></div></article><div class="site-footer"><p>{LONG}</p></div>'
    assert main_text(html) == f"Title of it\n\n{LONG}\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize(
    "before",
    ['<svg class="i"/>', "<math/>", "<svg><path d=x /></svg>", "<svg><svg>in</svg>out</svg>", "<object>a<object>b</object>c</object>", "<svg><circle>"]
    + [f"<div><{name}>gone</div>" for name in ("button", "select", "object", "canvas", "audio", "video", "template")]
    + [f"<{name}>gone" for name in ("button", "select", "object", "canvas", "audio", "video")]
    + ["<template><article><p>gone</p></article></template>", "<button><div>gone</div></button>", "<svg><title>gone</title><foreignObject><div>gone</div></foreignObject></svg>"],
)
def test_dropped_elements_end(before):
    assert main_text(f"<body>{before}<article><p>{LONG}</p><p>a <svg><path/></svg>b</p></article>") == f"{LONG}\n\na b"
    assert main_text(f"<body><article><p>{LONG}</p></article>{before}") == LONG


P2 = f"{LONG} {LONG}"
SHAPES = {
    # Readers' words, notices and offers inside an article, however long.
    f'<article><p>{LONG}</p><section class="comments"><p>{P2}</p><p>{P2}</p></section></article>': LONG,
    f'<article><p>{LONG}</p><div id="kommentare"><div class="kommentar"><p>{P2}</p></div></div></article>': LONG,
    f'<article><div class="notice"><p>{P2}</p></div><p>{LONG}</p><div class="newsletter"><p>{P2}</p></div></article>': LONG,
    f'<article><p>{LONG}</p><div class="related posts"><p>{P2}</p></div></article>': LONG,
    # Values of attributes are no names.
    f'<article><section title="The hidden cost of it"><p>{LONG}</p></section><div aria-label="a hidden gem"><p>{P2}</p></div></article>': f"{LONG}\n\n{P2}",
    f"<article><p data-x='class=\"comments\"'>{LONG}</p><div title=' class=ad '><p>{P2}</p></div></article>": f"{LONG}\n\n{P2}",
    f'<article><div hidden><p>{P2}</p></div><div style="color: red; display : none"><p>{P2}</p></div><div aria-hidden="true"><p>{P2}</p></div><p>{LONG}</p></article>': LONG,
    f'<article><div HIDDEN="" class=x><p>{P2}</p></div><p>{LONG}</p></article>': LONG,
    f"<article><div aria-hidden=false><p>{LONG}</p></div></article>": LONG,
    # Formulas are text, their sources are not.
    f"<article><p>{LONG} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>": f"{LONG} So x=2 holds.",
    f"<article><p>{LONG} <math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation></semantics></math>.</p></article>": f"{LONG} y.",
    # An article may be another element's fallback.
    f'<body><object data="x.swf"><article><p>{LONG}</p></article></object>': LONG,
    # A list of references.
    f"<article><p>{LONG}</p><ul><li><a href=a>First reference, 2001</a><li><a href=b>Second reference, 2002</a><li><a href=c>Third one</a><li><a href=d>Fourth one</a></ul></article>":
        f"{LONG}\n\nFirst reference, 2001\n\nSecond reference, 2002\n\nThird one\n\nFourth one",
    f"<nav><ul><li><a href=a>Home</a><li><a href=b>About the site</a></ul></nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><article><p>{LONG}</p></article>": LONG,
    # More shapes.
    f'<article><blockquote><p>{LONG}</p></blockquote><figure><img src=x><figcaption>{LONG}</figcaption></figure></article>': f"{LONG}\n\n{LONG}",
    f"<article><h2>One</h2><p>{LONG}</p><h2>Two</h2><pre>code  here</pre><p>{P2}</p></article>": f"One\n\n{LONG}\n\nTwo\n\ncode here\n\n{P2}",
    f"<article><table><tr><td>{LONG}<td>{P2}</table></article>": f"{LONG}\n\n{P2}",
    f'<div class="entry-content"><p>{LONG}</p><p>{P2}</p></div><div class="sidebar"><p>{LONG}</p></div>': f"{LONG}\n\n{P2}",
    f'<main><p>{LONG}</p></main><div role="complementary"><p>{P2}</p></div>': LONG,
    f'<div role="banner"><p>{LONG}</p></div><article><p>{P2}</p></article><div role="contentinfo">{LONG}</div>': P2,
    f"<article><p>{LONG}<p>{P2}<form><p>{LONG}</p></form></article>": f"{LONG}\n\n{P2}",
    f"<article><p>{LONG}</p><aside><p>{P2}</p></aside><p>{P2}</p></article>": f"{LONG}\n\n{P2}",
    f'<div class="cookie-consent"><p>{P2}</p></div><article><p>{LONG}</p></article>': LONG,
    f"<article><dl><dt>Term<dd>{LONG}</dl></article>": f"Term\n\n{LONG}",
    f'<article><p>{LONG}</p><div class="publicidad">{P2}</div><div class="anzeige"><p>{P2}</p></div></article>': LONG,
    f"<article><details><summary>More of it</summary><p>{LONG}</p></details></article>": f"More of it\n\n{LONG}",
}


@pytest.mark.parametrize("html", list(SHAPES))
def test_page_shapes(html):
    assert main_text(html) == SHAPES[html]


def test_a_sentence_elsewhere_changes_nothing():
    """A mark inside an article does not depend on how much prose the rest of the page has."""
    html = f'<article><p>{LONG}</p><section class="comments">' + f"<p>{P2}</p>" * 30 + "</section></article>"
    assert main_text(html) == main_text(html.replace("<article>", f"<article><p>{P2}</p>", 1)).replace(f"{P2}\n\n", "", 1) == LONG
