import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import duck, rows_of
from twinfold.llm import licenses as L

FILES = [
    ("LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/COPYING.txt", "Some words here.\nLicensed under the Apache License, Version 2.0."), ("a/b/c/y.py", None),
    ("a/b/c/own.py", "# This work is licensed under the GNU General Public License, version 3\ncode"), ("top.py", ""), ("ab/z.py", "all rights of way reserved for trains"), (None, "Released under the MIT License."), (None, None),
    ("a/b/c/long.py", "word " * 50000 + "\nAll rights reserved."), ("a/b/c/y.py", None),
]


def test_own_and_inherited(spark):
    got = {(r.path, r.license, r.origin, r.license_dir) for r in L.scan(spark.createDataFrame(FILES, "path string, text string")).collect()}
    assert got == {
        ("LICENSE", "MIT", "own", ""), ("a/x.py", "MIT", "inherited", ""), ("a/b/COPYING.txt", "Apache-2.0", "own", "a/b"), ("a/b/c/y.py", "Apache-2.0", "inherited", "a/b"),
        ("a/b/c/own.py", "GPL-3.0", "own", "a/b/c"), ("top.py", "MIT", "inherited", ""), ("ab/z.py", "MIT", "inherited", ""), (None, "MIT", "own", None), (None, None, None, None), ("a/b/c/long.py", "Proprietary", "own", "a/b/c"),
    }


GPL = """/*
 * Copyright (C) 2020 Some Body
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main() {{ return 0; }}
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0

import os
"""
KNOWN = [
    (GPL.format("", "3"), "GPL-3.0"), (GPL.format("", "2"), "GPL-2.0"), (GPL.format("Lesser ", "2.1"), "LGPL-2.1"), (GPL.format("Affero ", "3"), "AGPL-3.0"), (APACHE, "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY 3.0", "CC-BY-3.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY 2.0", None),
    ("Licensed under the Apache License, Version 1.0", None), ("Licensed under the Apache Software License, Version 1.1", "Apache-1.1"), ("Licensed under the Eclipse Public License, Version 2.0", "EPL-2.0"),
    ("This license plate was made in a public place.", None), ("", None), (None, None),
    *((t, n) for n, t, _, _ in L.TEMPLATES),
]


def test_headers_notices_and_full_texts(spark):
    rows = [(f"d{i}/x.c", t) for i, (t, _) in enumerate(KNOWN)] + [(f"l{i}/LICENSE", "Copyright 2020\r\n\r\n" + (t or "").replace(". ", ".\r\n\r\n")) for i, (t, _) in enumerate(KNOWN)]
    got = {r.path: r.license for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {i: got[f"d{i}/x.c"] for i in range(len(KNOWN))} == {i: n for i, (_, n) in enumerate(KNOWN)}
    assert {i: got[f"l{i}/LICENSE"] for i in range(len(KNOWN))} == {i: n for i, (_, n) in enumerate(KNOWN)}


def plain_cosine(text, template):
    """By plain counting."""
    weight, other = L.idf()
    a, b = (Counter(re.findall(L.TERM, x.lower())) for x in (text, template))
    w = lambda x: weight.get(x, other)
    norm = lambda c: math.sqrt(sum((n * w(x)) ** 2 for x, n in c.items()))
    return sum(a[x] * b[x] * w(x) ** 2 for x in a) / (norm(a) * norm(b))


def test_scores_are_cosines(spark):
    for text in ("Licensed under the Apache License, Version 2.0 by us all", "Released under the the MIT License License"):
        got = spark.range(1).select(L.own_license(F.lit(text), threshold=0.0).alias("m")).first().m
        best = max((plain_cosine(text, t), n) for n, t, must, never in L.TEMPLATES if set(must) <= set(re.findall(L.TERM, text.lower())) and not set(never) & set(re.findall(L.TERM, text.lower())))
        assert got.score == pytest.approx(best[0])
        assert got.license == best[1]


def test_clashing_columns_and_ties(spark):
    rows = [("a/LICENSE", "Released under the MIT License", 1, "x", "y"), ("a/COPYING", "Released under the MIT License", 2, "x", "y"), ("a/b.py", "code", 3, "x", "y"), ("a/b.py", "code", 3, "x", "y")]
    d = spark.createDataFrame(rows, "path string, text string, dir int, license string, m string")
    got = sorted(tuple(r) for r in L.scan(d, ("dir", "m", "license")).select("dir", "m", "path", "license", "origin").collect())
    assert got == [(1, "y", "a/LICENSE", "MIT", "own"), (2, "y", "a/COPYING", "MIT", "own"), (3, "y", "a/b.py", "MIT", "inherited"), (3, "y", "a/b.py", "MIT", "inherited")]


def test_no_files(spark):
    assert L.scan(spark.createDataFrame([], "path string, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf_dir, sf):
    d = sf_dir.replace("sf0.001", sf)
    assert rows_of(L.op8_licenses(spark, d).toPandas()) == rows_of(duck(d).sql(L.op8_sql()).df())
