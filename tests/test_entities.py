"""Character references against the standard library's reading."""

from __future__ import annotations

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from postmill.functions.text import unescape


def check(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    got = df.select("t", unescape(df.t).alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.u != html.unescape(r.t)] == []


def test_all_names(spark):
    check(spark, [f"a &{n} b &{n}x &{n};&{n}" for n in html5] + [f"&{n[:-1]}" for n in html5] + [f"&{n.lower()}" for n in html5])


def test_numbers(spark):
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 99999999999999999999]
    check(spark, [t for n in numbers for t in (f"&#{n};", f"x&#{n}y", f"&#x{n:x};", f"&#X{n:X} ", f"&#000{n};")])


def test_odd_texts(spark):
    rng = random.Random(5)
    parts = ["&", "&&", "&amp", ";", "lt", "&#", "&#x", "&#xZ;", "&notit;", "&notin;", " ", "é", "\n", "&ampamp;", "&amp;lt;", "x", "&nosuch;", "&" + "a" * 40 + ";", "&frac12", "&#128512;", "<b>"]
    check(spark, ["", "plain", *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(400))])
    assert spark.range(1).select(unescape(F.lit(None).cast("string"))).first()[0] is None
