"""The tag tree against a reader that keeps a stack, on made pages of all kinds and on the given ones."""

from __future__ import annotations

import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from postmill.sources import tagtree

TOKEN = re.compile(tagtree.TOKEN.replace("\\z", "\\Z"))


def brute(html):
    """Elements by their start: (start, end, depth, parent, name)."""
    tokens = [m[0] for m in TOKEN.finditer(html)]
    stack, done = [], []

    def close(k, end):
        for j in range(k, len(stack)):
            done.append((stack[j][0], end, j + 1, stack[j - 1][0] if j else -1, stack[j][1]))
        del stack[k:]

    for i, t in enumerate(tokens):
        m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", t)
        if not m or t.endswith("/>") and not m[1]:
            continue
        name = m[2].lower()
        if m[1]:
            at = [k for k, (_, n) in enumerate(stack) if n == name]
            if at:
                close(at[-1], i)
        elif name not in tagtree.VOID + tagtree.RAW:
            stack.append((i, name))
    close(0, len(tokens))
    return tokens, sorted(done)


def check(spark, pages):
    df = spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)
    for r in df.select("html", tagtree.tree(F.col("html")).alias("t")).collect():
        tokens, elements = brute(r.html)
        assert r.t.tokens == tokens and [tuple(e) for e in r.t.elements] == elements


def test_made_pages(spark):
    rng = random.Random(1)
    parts = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "<br/>", "<img src='a>b'>", "<li class=\"x y\">", "</li>", "<ul>", "</ul>", "text ", "a < b ", "&amp; ", "<!-- <div> -->", "<script>var a='<div>';</script>", "<STYLE>p{}</STYLE>", "</nosuch>", "<a title=\"</a>\">", "</A>", "<x-y/>", "<", "<!DOCTYPE html>"]
    check(spark, ["", "plain", "<p", "<!-- open", "<script>open", "<div><div><p>x", *("".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(150))])


def test_long_page(spark, monkeypatch):
    """Chunks change nothing, and a page of many thousand tags is read in a moment."""
    page = "<div><p>a<b>b</p></div>" * 40 + "<ul>" * 30 + "x" + "</ul>" * 20
    monkeypatch.setattr(tagtree, "CHUNK", 7)
    check(spark, [page])
    monkeypatch.undo()
    check(spark, ["<ul>" + "<li><a href='x'>item</a>" * 6000 + "</ul><p>end</p>"])


def test_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    check(spark, pages)


def one(spark, html, what):
    df = spark.createDataFrame([(html,)], "html string").select(tagtree.tree(F.col("html")).alias("t"))
    return df.select(what(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("tag", "want"), [
    ('<div class="a b">', True), ("<div CLASS='b'>", True), ("<div class=b>", True), ('<div id="1" data-class="b" class="a">', False), ('<div title=" class=\'b\'" class="c">', False),
    ('<div class="ab">', False), ("<div hidden class = \"x  b\t\">", True), ("<div>", False), ('<div class="b&amp;">', False)])
def test_classes(spark, tag, want):
    assert one(spark, f"{tag}x</div>", lambda t: F.size(tagtree.select(t, "div", "b"))) == int(want)


def test_texts_and_places(spark):
    html = '<main><h2>Head <i>line</i></h2><p> one &amp; <b> two</b> </p><ul><li>a<li>b</ul><ul><li>c</li></ul></main>'
    get = lambda what: one(spark, html, what)
    p = lambda t: tagtree.first(tagtree.select(t, "p"))
    assert get(lambda t: tagtree.text_of(t, p(t))) == " one &  two " and get(lambda t: tagtree.text_of(t, p(t), "", True)) == "one &two"
    assert get(lambda t: tagtree.text_of(t, tagtree.first(tagtree.select(t, "nosuch")))) is None
    h = lambda t: tagtree.around(t, tagtree.first_text_with(t, "Head"))
    assert get(lambda t: h(t)["name"]) == "h2"
    assert get(lambda t: F.size(tagtree.children(t, tagtree.following(t, h(t), "ul"), "li"))) == 1
    assert get(lambda t: F.size(tagtree.within(t, tagtree.following(t, h(t), "ul"), ["li"]))) == 2
    assert unescape("&amp;") == "&"
