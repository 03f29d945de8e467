"""Licence scans: TF-IDF cosine of pieces of text to templates, then inheritance along paths.  DataFrame functions only.

Pieces of a text: its lines and sentences, its paragraphs, its leading comment
(the header), and the whole of it; comment marks are taken off the last three.
Templates are short notices, standard headers, headings and texts of licences,
and SPDX lines.  A piece can reach the threshold for a template only if it has
one of the template's heaviest terms (those left when the lightest are taken
away while their norm stays below the threshold).  One pass keeps of every text
the template terms that it has: document frequencies come from those, and only
texts with a heavy term are cut into pieces, which are weighed term by term.  A
term that no template has weighs 1, the least weight there is.

Texts are keyed by their hash, so copies are scanned once and no row numbers
are needed.  A file whose words mostly lie in licence pieces, or whose name says
so, is a licence file and declares the licence of its directory.  A file without
a licence of its own takes that of the nearest ancestor directory that has one:
distinct directories are expanded into ancestors and joined with the declared
ones by path.  Files meet both small tables by a join that is broadcast after a
count and salted beyond it, so a directory may hold any share of the files.

Defined cases: null text has no pieces; a null path lies in the root; equal
scores go to the first licence name; several licence files of one directory:
the most frequent licence, then the first name; repeated rows get a row each;
texts of any length are cut whole; columns of the files that are named like the
four that are added are replaced by them; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, SALTS, materialize, text_of

# Names, short notices, standard headers and texts of public licences.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "Released under the Unlicense."),
]
HEADINGS = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version."
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: "
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
TEXTS = [
    ("AGPL-3.0", _GNU.format("Affero ", 3)),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", _BSD + _AS_IS),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty.",
    ),
    ("GPL-2.0", _GNU.format("", 2)),
    ("GPL-3.0", _GNU.format("", 3)),
    (
        "ISC",
        _ISC + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("ISC", _ISC),
    ("LGPL-3.0", _GNU.format("Lesser ", 3)),
    (
        "MIT",
        _MIT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MIT", _MIT),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
]
#: An SPDX line for each licence.
TEMPLATES = NOTICES + HEADINGS + TEXTS + [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in NOTICES + HEADINGS + TEXTS})]
THRESHOLD = 0.8
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
PIECES = r"\n+|(?<=[.!?;])[ \t]+"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: Share of a file's words in licence pieces from which it is a licence file.
FILE_SHARE = 0.5
#: Marks of comments at the start of a line, a leading comment, and what parts paragraphs.
COMMENT = r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)[ \t]?"
HEADER = r"^(?:[ \t]*(?:(?://|#|/?\*|--|;|%|<!--)[^\n]*)?(?:\n|$))+"
PARAGRAPH = r"\n[ \t]*\n+"


def _terms(text: str) -> list[str]:
    import re

    return re.findall(TERM, text.lower())


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), F.lit(1))


def template_weights(df_of: dict[str, int], n: int, templates=TEMPLATES) -> tuple[dict[str, float], list[dict[str, float]]]:
    """idf of each template term, and each template's unit vector."""
    idf = {t: math.log((n + 1) / (df_of.get(t, 0) + 1)) + 1 for _, text in templates for t in _terms(text)}
    out = []
    for _, text in templates:
        ts = _terms(text)
        v = {t: ts.count(t) * idf[t] for t in set(ts)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return idf, out


def heavy_terms(vectors: list[dict[str, float]], threshold: float = THRESHOLD) -> set[str]:
    """Terms of which a piece must have one to reach the threshold for some template."""
    out: set[str] = set()
    for v in vectors:
        light = 0.0
        for t, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
            light += x * x
            if math.sqrt(light) >= threshold:
                out.add(t)
    return out


def pieces(text: Column) -> Column:
    """kind (0 lines and sentences, 1 paragraphs, 2 the header, 3 the whole) and text of each piece."""
    clean = lambda c: F.regexp_replace(c, COMMENT, "")
    made = [F.split(text, PIECES), F.split(clean(text), PARAGRAPH), F.array(clean(F.regexp_extract(text, HEADER, 0))), F.array(clean(text))]
    # A second parameter of the lambda would be the index in the array.
    of = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("line"))
    return F.concat(*[F.transform(c, of(kind)) for kind, c in enumerate(made)])


def scan(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """files: text.  A row per licence piece of each distinct text: th (its hash), kind, license, similarity, words."""
    spark = files.sparkSession
    vocab = sorted({t for _, text in templates for t in _terms(text)})
    rows = files.select(F.xxhash64(text_of(files)).alias("th"), text_of(files).alias("text"))
    lits = F.array(*[F.lit(t) for t in vocab])
    seen = materialize(rows.select("th", F.array_intersect(F.split(F.lower("text"), r"[^a-z0-9.-]+|[.-](?![a-z0-9])"), lits).alias("terms")), "licence-terms")
    n = seen.count()
    df_rows = seen.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row per template term at most
    idf, vectors = template_weights({r["t"]: r["df"] for r in df_rows}, n, templates)
    heavy = F.array(*[F.lit(t) for t in sorted(heavy_terms(vectors, threshold))])
    # A text qualifies for a template if the terms that it has weigh enough there: no piece of it can have more.
    vec = [(i, templates[i][0], t, x) for i, v in enumerate(vectors) for t, x in sorted(v.items())]
    # Template-sized tables; their size is that of the templates.
    vecs = F.broadcast(spark.createDataFrame(vec, "template int, license string, v_term string, v double"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    some = seen.filter(F.arrays_overlap("terms", heavy)).dropDuplicates(["th"]).select("th", F.explode("terms").alias("term")).join(vecs, F.col("term") == F.col("v_term"))
    may = some.groupBy("th", "template").agg(F.sum(F.col("v") * F.col("v")).alias("w")).filter(F.col("w") >= threshold * threshold - 1e-9).select("th").distinct()
    may = materialize(may, "licence-candidates")
    texts = _left_small(rows, may.select(F.col("th").alias("m_th")), F.col("th") == F.col("m_th"), F.xxhash64(F.length("text"))).filter("m_th is not null").dropDuplicates(["th"])
    cut = texts.select("th", F.posexplode(pieces(F.col("text"))).alias("piece", "p")).select("th", "piece", "p.kind", tokens(F.col("p.line")).alias("tok")).filter(F.arrays_overlap("tok", heavy))
    cut = materialize(cut, "licence-pieces")
    tf = cut.select("th", "piece", "kind", F.size("tok").alias("words"), F.explode("tok").alias("term")).groupBy("th", "piece", "kind", "words", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(idfs, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norms = weighed.groupBy("th", "piece", "kind", "words").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vecs, F.col("term") == F.col("v_term")).groupBy(F.col("th").alias("t2"), F.col("piece").alias("p2"), "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    sims = dots.join(norms, (F.col("th") == F.col("t2")) & (F.col("piece") == F.col("p2"))).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "license"))
    return sims.groupBy("th", "piece", "kind", "words").agg(best.alias("b")).select("th", "kind", "b.license", (-F.col("b.s")).alias("similarity"), "words")


def _left_small(rows: DataFrame, table: DataFrame, on: Column, salt: Column) -> DataFrame:
    """Left join to a table of one row per key, a key of which may hold most rows: broadcast after a count, salted beyond."""
    if table.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), on, "left")
    spread = table.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt1", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return salted.join(spread, on & (F.col("__salt1") == F.col("__salt2")), "left").drop("__salt1", "__salt2")


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(d: Column) -> Column:
    """The directory and all above it, root ('') included."""
    parts = F.filter(F.split(d, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


ADDED = ("license", "similarity", "scope", "declared_by")


def licences(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """files: path, text and any others.  All columns but the text, and license, similarity, scope and declared_by.

    scope: own, inherited, or null; declared_by: the directory that an inherited licence is from.
    """
    cols = [c for c in files.columns if c != "text" and c not in ADDED]
    found = materialize(scan(files, threshold, templates), "licence-found")
    best = found.groupBy("th").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("own"))
    # A whole file may be similar for its header alone, so it does not tell how many of its words are of a licence.
    share = found.withColumn("words", F.when(F.col("kind") < 3, F.col("words")).otherwise(0)).groupBy("th", "kind").agg(F.sum("words").alias("w")).groupBy(F.col("th").alias("w_th")).agg(F.max("w").alias("l_words"))
    own = materialize(best.join(share, F.col("th") == F.col("w_th")).select(F.col("th").alias("o_th"), F.col("own.s").alias("o_s"), F.col("own.license").alias("o_license"), "l_words"), "licence-own")
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    named = F.regexp_extract(path, "([^/]*)$", 1).rlike(LICENCE_NAME)
    # Words are counted for texts with licence pieces alone.
    rows = files.select(*[F.col(f"`{c}`") for c in cols], F.xxhash64(text_of(files)).alias("__th"), text_of(files).alias("__text")).withColumn("__dir", directory(path))
    rows = _left_small(rows, own, F.col("__th") == F.col("o_th"), F.xxhash64("__dir", path))
    words = F.when(F.col("o_th").isNotNull(), F.size(tokens(F.col("__text"))))
    rows = materialize(rows.withColumn("__declares", F.coalesce(F.col("o_th").isNotNull() & (named | (F.col("l_words") >= FILE_SHARE * words)), F.lit(False))).drop("__text", "__th", "o_th", "l_words"), "licence-rows")
    votes = rows.filter("__declares").groupBy("__dir", F.col("o_license").alias("license")).agg(F.count("*").alias("n"))
    declared = votes.groupBy(F.col("__dir").alias("d_dir")).agg(F.min(F.struct((-F.col("n")).alias("n"), "license"))["license"].alias("d_license"))
    declared = materialize(declared, "licence-declared")
    dirs = rows.select("__dir").distinct().select("__dir", F.explode(ancestors(F.col("__dir"))).alias("above"))
    near = dirs.join(declared, F.col("above") == F.col("d_dir")).groupBy(F.col("__dir").alias("n_dir")).agg(F.max(F.struct(F.length("above").alias("depth"), F.col("above").alias("dir"), "d_license")).alias("near"))
    out = _left_small(rows, materialize(near.select("n_dir", F.col("near.dir").alias("n_from"), F.col("near.d_license").alias("n_license")), "licence-near"), F.col("__dir") == F.col("n_dir"), F.xxhash64("path", "o_s"))
    mine = F.col("o_license").isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in cols],
        F.coalesce("o_license", "n_license").alias("license"),
        (-F.col("o_s")).alias("similarity"),
        F.when(mine, F.lit("own")).when(F.col("n_license").isNotNull(), F.lit("inherited")).alias("scope"),
        F.when(~mine, F.col("n_from")).alias("declared_by"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The documents as files source/lang/doc_id: doc_id, path, license, similarity, scope, declared_by."""
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("_")), F.coalesce(F.col("lang").cast("string"), F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return licences(docs.select("doc_id", path.alias("path"), text_of(docs).alias("text")))
