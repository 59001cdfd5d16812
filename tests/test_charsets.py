"""Files of several charsets, read in small byte ranges, against a plain CSV reader."""

from __future__ import annotations

import csv
import io
import random

from postmill.sources import tables


def test_ranges_of_many_charsets(spark, tmp_path):
    rng = random.Random(11)
    parts = ["слово", "plain", "ё№", 'a "quoted" one', "two\nlines", "\n\n", "comma, here", "«x»", " ", "\r\nwindows", '"', "end\n"]
    want = []
    for name, charset, mark in (("a", "utf-8", ""), ("b", "utf-8-sig", ""), ("c", "windows-1251", ""), ("d", "windows-1251", ""), ("e", "utf-8", "")):
        rows = [(str(n), "".join(rng.choices(parts, k=rng.randint(0, 6))) + mark, rng.choice(["x", "да"])) for n in range(0 if name == "e" else 150)]
        if name == "d":
            rows[70] = ("70", "long\n" * 4000 + "ё", "x")  # one record over many ranges
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\r\n" if name == "c" else "\n", quoting=csv.QUOTE_MINIMAL)
        out.writerows([("id", "body", "flag"), *rows])
        (tmp_path / f"{name}.csv").write_bytes(text.getvalue().encode(charset))
        want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = tables.scan_any_charset(spark, f"{tmp_path}/*.csv", "id int, body string, flag string")
        got = sorted((str(r.id), r.body or "", r.flag) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # Blanks around unquoted values belong to the value here and there.
    assert got == sorted(want)
