"""License scan: sparse TF-IDF cosine of headers and licence files to templates, and inheritance from ancestor directories.
DataFrame functions only.

What is compared with each template: of a licence file the whole text; of any file its blocks (paragraphs, such as the comment
at a file's head, without comment marks and with their wrapped lines joined), and the sentences of lines and of blocks;
all only where they hold a word that licenses use. Templates are the full texts of short licenses, the notices that long ones
prescribe, and the sentences by which licenses are declared. Term weights (sparse maps) come from the templates. A template names its
identifying terms, such as the version, that must stand in what it is found in, and terms of its relatives
that must not. A file's own license is the best template, at THRESHOLD or more. A file without one inherits that of the
licence file in its nearest ancestor directory, by a join of the distinct directories' ancestors with the directories that
hold licence files.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import bind
from .common import stage, table

THRESHOLD = 0.6
#: Resolved directories up to which they are broadcast; beyond they are joined by a shuffle.
MAX_BROADCAST_DIRS = 50_000
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
CUE = r"(?i)licen[sc]|rights reserved|redistribut|permission is|copyright|public domain"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.][^/]*)?$"
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"""
_BSD_BOTH = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, {1}.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU {0}General Public License for more details."""
_GNU_ONE = "This work is licensed under the GNU {}General Public License, version {}"
_GNU_KIN = {"": ("lesser", "affero", "library"), "Lesser ": ("affero",), "Affero ": ("lesser",)}
_CC_KIN = ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
# License, text, terms that must stand in a match, terms that must not.
TEMPLATES = (
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1", ("apache", "1.1"), ()),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "2.0"), ()),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache", "2.0"), ()),
    ("BSD", _BSD, ("redistribution",), ()),
    ("BSD-2-Clause", " ".join([_BSD + ":", _BSD_BOTH, _BSD_END]), ("redistributions", "binary"), ("neither",)),
    ("BSD-3-Clause", " ".join([_BSD + ":", _BSD_BOTH, _BSD_NAME, _BSD_END]), ("redistributions", "binary", "neither"), ()),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost", "1.0"), ()),
    *((f"CC-{k.upper()}-{v}", f"Licensed under CC {k.upper()} {v}", (k, v), tuple(x for x in _CC_KIN if x not in (k, "by"))) for k in _CC_KIN for v in ("3.0", "4.0")),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0", ("cc0", "1.0"), ()),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0", ("eclipse", "2.0"), ()),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License, Version 2.0", ("eclipse", "2.0"), ()),
    *((f"{n}-{v}", _GNU_ONE.format(k, w), ("general", w), _GNU_KIN[k]) for n, k, v, w in (("GPL", "", "2.0", "2"), ("GPL", "", "3.0", "3"), ("LGPL", "Lesser ", "2.1", "2.1"), ("LGPL", "Lesser ", "3.0", "3"), ("AGPL", "Affero ", "3.0", "3"))),
    *((f"{n}-{v}", _GNU.format(k, f"either version {w} of the License, or (at your option) any later version"), ("general", w), _GNU_KIN[k]) for n, k, v, w in (("GPL", "", "2.0", "2"), ("GPL", "", "3.0", "3"), ("LGPL", "Lesser ", "2.1", "2.1"), ("LGPL", "Lesser ", "3.0", "3"), ("AGPL", "Affero ", "3.0", "3"))),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("fee", "granted"), ()),
    ("MIT", "Released under the MIT License", ("mit",), ()),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("charge", "granted"), ()),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""", ("charge", "sublicense"), ()),
    ("MPL-1.1", "Licensed under the Mozilla Public License, Version 1.1", ("mozilla", "1.1"), ()),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0", ("mozilla", "2.0"), ()),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""", ("mozilla", "2.0"), ()),
    ("Proprietary", "All rights reserved", ("rights", "reserved"), ()),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered",), ()),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source
        distribution.""", ("granted", "altered"), ()),
)
Template = tuple[str, str, tuple[str, ...], tuple[str, ...]]
# Marks of comments at the start of a line, ends of blocks and of sentences, and joints of wrapped lines.
MARKS = r"(^|\n)[ \t]*(?:/[*]+|[*]+/?|//+|#+|--+|;+|%+|<!--)[ \t]*"
BLOCK_END = r"\n[ \t]*\n"
SENTENCE_END = r"([.!?])[ \t]+"
JOINT = r"[ \t]*\n[ \t]*"


def idf(templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[str, float], float]:
    """Weight of each term of the templates, and of any other term."""
    sets = [set(re.findall(TERM, t[1].lower())) for t in templates]
    df = Counter(x for s in sets for x in s)
    n = len(templates)
    return {x: math.log((1 + n) / (1 + k)) + 1 for x, k in sorted(df.items())}, math.log(1 + n) + 1


def vectors(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, dict[str, float], tuple[str, ...], tuple[str, ...]]]:
    """Name, unit vector, and terms that must and must not stand, of each template; each weight is times the term's idf, so that a sum over words is a dot product."""
    weight, _ = idf(templates)
    out = []
    for name, text, must, never in templates:
        tf = Counter(re.findall(TERM, text.lower()))
        norm = math.sqrt(sum((k * weight[x]) ** 2 for x, k in tf.items()))
        out.append((name, {x: k * weight[x] / norm * weight[x] for x, k in sorted(tf.items())}, must, never))
    return out


def _map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _dot(toks: Column, weights: Column) -> Column:
    return F.aggregate(toks, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(weights, x), F.lit(0.0)))


def statements(text: Column, is_licence_file: Column) -> Column:
    """What of a text is compared: sentences of its lines and blocks, blocks, and of a licence file the whole; each with a license word."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r", ""), MARKS, "$1")

    def of(plain: Column) -> Column:
        blocks = F.transform(F.split(plain, BLOCK_END, -1), lambda x: F.regexp_replace(x, JOINT, " "))
        sentences = lambda x: F.split(F.regexp_replace(x, SENTENCE_END, "$1\n"), "\n", -1)
        whole = F.when(is_licence_file, F.array(F.regexp_replace(plain, r"\s*\n\s*", " "))).otherwise(F.array().cast("array<string>"))
        every = bind(F.filter(blocks, lambda x: x.rlike(CUE)), lambda b: F.concat(sentences(plain), b, F.flatten(F.transform(b, sentences)), whole))
        return F.array_distinct(F.filter(every, lambda x: x.rlike(CUE)))

    return bind(plain, of)


def _norm(toks: Column, of) -> Column:  # noqa: ANN001
    """Length of the vector of terms: the sorted terms' runs, squared and added up."""
    start = F.struct(F.lit("").alias("term"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    close = lambda a: a["sum"] + F.pow(a["n"] * of(a["term"]), F.lit(2.0))
    step = lambda a, x: F.struct(x.alias("term"), F.when(a["term"] == x, a["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(a["term"] == x, a["sum"]).otherwise(close(a)).alias("sum"))
    return F.sqrt(F.aggregate(F.array_sort(toks), start, step, close))


def own_license(text: Column, is_licence_file: Column | None = None, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """struct(score, license) of the best statement of the whole text, null below the threshold; ties go to the later name."""
    weight, other = idf(templates)
    of = lambda x: F.coalesce(F.try_element_at(_map(weight), x), F.lit(other))

    def best(toks: Column) -> Column:
        def rated(norm: Column, known: Column) -> Column:
            dots = []
            for name, v, must, never in vectors(templates):
                fits = F.forall(F.array(*map(F.lit, must)), lambda x: F.array_contains(known, x))
                fits = fits & ~F.arrays_overlap(known, F.array(*map(F.lit, never))) if never else fits
                dots.append(F.when(fits, F.struct((_dot(known, _map(v)) / F.greatest(norm, F.lit(1e-9))).alias("score"), F.lit(name).alias("license"))))
            return F.array_max(F.array(*dots))

        known = F.filter(toks, lambda x: F.try_element_at(_map(weight), x).isNotNull())
        return bind(_norm(toks, of), lambda n: bind(known, lambda k: rated(n, k)))

    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(TERM), F.lit(0))
    every = statements(text, F.lit(False) if is_licence_file is None else is_licence_file)
    found = F.array_max(F.filter(F.transform(every, lambda s: bind(words(s), best)), lambda s: s["score"] >= threshold))
    return F.when(text.rlike(CUE), found)


def scan(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, license, score, origin (own, inherited or null), license_dir, and the columns in keep, for each row of files (path, text).

    Null and empty texts have no own license; a file with null path inherits none and is no licence file; very long texts are scanned whole. Of several licence files in
    a directory the best match counts, then the later license and path. Repeated rows are scanned alike. Root-level files have the directory ''. An
    empty table gives no row. Columns in keep that are named like one of the result's own give way to it; other columns are ignored.
    """
    keep = tuple(c for c in keep if c not in ("license", "score", "origin", "license_dir"))
    m = own_license(F.col("text"), F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
    files = files.select(*[F.col(c).alias(f"kept_{c}" if c in keep else c) for c in files.columns if c in keep or c in ("path", "text")], *([F.col("path")] if "path" in keep else []))
    named, keep = keep, tuple(f"kept_{c}" for c in keep)
    rows = files.select(*keep, *(["path"] if "path" not in keep else []), m.alias("m"))
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), "")))
    rows = stage(rows.select(*keep, *(["path"] if "path" not in keep else []), "dir", "m.score", "m.license"), "ownlicenses")
    holders = rows.filter(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    holders = holders.groupBy(F.col("dir").alias("hd")).agg(F.max(F.struct("score", "license", "path")).alias("h"))
    dirs = rows.filter(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("over")))
    above = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.over").join(holders, F.col("over") == F.col("hd"))
    near = above.groupBy(F.col("dir").alias("nd")).agg(F.max(F.struct("depth", "h", "hd")).alias("n"))
    near = stage(near.select("nd", F.col("n.h.license").alias("nl"), F.col("n.h.score").alias("ns"), F.col("n.hd").alias("nh")), "neardirs")
    few = near.count() <= MAX_BROADCAST_DIRS
    each = rows.join(F.broadcast(near) if few else near, (F.col("dir") == F.col("nd")) & F.col("license").isNull(), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("nl").isNotNull(), "inherited")
    where = F.when(F.col("license").isNotNull(), F.col("dir")).otherwise(F.col("nh"))
    return each.select(*[F.col(f"kept_{c}").alias(c) for c in named], *(["path"] if "path" not in named else []), F.coalesce("license", "nl").alias("license"), F.coalesce("score", "ns").alias("score"), origin.alias("origin"), where.alias("license_dir"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a virtual tree: source / thousand / id, where every hundredth id is a licence file, and every thousandth that of its source."""
    d = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(F.coalesce(F.col("doc_id") % 1000, F.lit(1)) != 0, F.expr("cast(coalesce(doc_id, 0) div 1000 as string)")), F.when(F.coalesce(F.col("doc_id") % 100, F.lit(1)) == 0, "LICENSE").otherwise(d))
    files = table(spark, sf_dir, "documents").withColumn("path", path)
    out = scan(files, ("doc_id",))
    return out.select("doc_id", "license", F.round("score", 6).alias("score"), "origin", "license_dir")


def _sql_map(d: dict[str, float]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in d.items()) + "}"


def _sql_list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


def op8_sql() -> str:
    weight, other = idf()
    rows = ", ".join(f"('{n}', {_sql_map(v)}, {_sql_list(must)}, {_sql_list(never)})" for n, v, must, never in vectors())
    sentences = rf"string_split(regexp_replace({{}}, '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10))"
    return rf"""
WITH t(license, v, must, never) AS (VALUES {rows}),
f AS (SELECT row_number() OVER () AS rid, doc_id, text,
        concat_ws('/', coalesce(source, 'none'), CASE WHEN doc_id % 1000 <> 0 THEN (doc_id // 1000)::VARCHAR END, CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id::VARCHAR END) AS path FROM documents),
p0 AS (SELECT rid, path, regexp_replace(regexp_replace(text, '\r', '', 'g'), '{MARKS}', '\1', 'g') AS plain FROM f WHERE regexp_matches(text, '{CUE}')),
p1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(plain, '{BLOCK_END}'), lambda x: regexp_replace(x, '{JOINT}', ' ', 'g')), lambda x: regexp_matches(x, '{CUE}')) AS blocks FROM p0),
s AS (SELECT rid, unnest(list_distinct(list_concat(list_concat({sentences.format('plain')}, blocks), list_concat(flatten(list_transform(blocks, lambda b: {sentences.format('b')})),
        CASE WHEN path LIKE '%/LICENSE' THEN [regexp_replace(plain, '\s*\n\s*', ' ', 'g')] ELSE [] END)))) AS x FROM p1),
k AS (SELECT rid, regexp_extract_all(lower(x), '{TERM}') AS toks FROM s WHERE regexp_matches(x, '{CUE}')),
n AS (SELECT rid, toks, sqrt(list_sum(list_transform(map_entries(list_aggregate(toks, 'histogram')), lambda e: pow(e.value * coalesce({_sql_map(weight)}[e.key], {other!r}), 2)))) AS norm FROM k),
c AS (SELECT rid, license, list_sum(list_transform(toks, lambda x: coalesce(v[x], 0.0::DOUBLE))) / greatest(norm, 1e-9) AS score FROM n, t WHERE list_has_all(toks, must) AND NOT list_has_any(toks, never)),
m AS (SELECT rid, arg_max(license, (score, license)) AS license, max(score) AS score FROM c WHERE score >= {THRESHOLD} GROUP BY rid),
r AS (SELECT f.rid, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, license, score FROM f LEFT JOIN m ON f.rid = m.rid),
h AS (SELECT dir AS hd, arg_max(license, (score, license, path)) AS license, max(score) AS score FROM r WHERE license IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir),
g AS (SELECT r.rid, arg_max(h.license, length(h.hd)) AS nl, arg_max(h.score, length(h.hd)) AS ns, arg_max(h.hd, length(h.hd)) AS nh
      FROM r JOIN h ON r.license IS NULL AND (r.dir = h.hd OR starts_with(r.dir, h.hd || '/')) GROUP BY r.rid)
SELECT doc_id, coalesce(license, nl) AS license, round(coalesce(score, ns), 6) AS score,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN nl IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN license IS NOT NULL THEN dir ELSE nh END AS license_dir
FROM r LEFT JOIN g ON r.rid = g.rid
"""
