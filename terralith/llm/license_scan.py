"""License scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance along paths.

With DataFrame functions only.  The weights come from the document frequencies of the templates' terms over the whole
corpus; terms in no template count as one kind of term that is as rare as can be, which keeps their length in the
cosine.  Two units are compared to the templates: every line (a header statement) and the whole text.  A text is a licence
file if its whole is close to a whole licence text, or if its name says so and a licence is found in it; a notice at the
head of a source file, however short the file, is a header.
Terms that together hold so much of a template's length that no unit without them can reach the threshold are its
anchors; only units with an anchor are worked out, which loses nothing.  A text without a licence of its own takes
that of the licence file in its nearest ancestor directory: the distinct directories are joined with their ancestors,
then the texts with their directories.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import saved

THRESHOLD = 0.6

# Usual statements of common licences (notices), in natural order.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
NOTICES = len(TEMPLATES)  # templates from here on are whole texts
FILE_NAME = "^(.*[._-])?(license|licence|copying|notice)s?([._-].*)?$"  # the lower-cased last part of a licence file's path
# Whole licence texts, without their copyright lines.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES += [
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. This notice may not be removed or altered from any source distribution."""),
]
OTHER = ""  # stands for every term that no template has


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^\p{L}\p{N}]+"), "")


def _template_terms(templates: list[tuple[str, str]]) -> list[dict[str, int]]:
    out = []
    for _, text in templates:
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        out.append({w: words.count(w) for w in words})
    return out


def anchors(weights: list[dict[str, float]], threshold: float, texts_with: dict[str, int]) -> list[str]:
    """Terms without one of which no unit reaches the threshold with any template: what a template has besides is too
    short. Terms that stand in few texts for the length that they hold are taken first."""
    out: set[str] = set()
    for w in weights:
        whole, left = sum(x * x for x in w.values()), sum(x * x for t, x in w.items() if t not in out)
        for term, x in sorted(((t, x) for t, x in w.items() if t not in out), key=lambda p: ((1 + texts_with.get(p[0], 0)) / p[1] ** 2, p[0])):
            if left < whole * threshold * threshold * 0.999:
                break
            out.add(term)
            left -= x * x
    return sorted(out)


def scan_licenses(df: DataFrame, id_col: str, text_col: str, path: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, notices: int = NOTICES) -> DataFrame:
    """One row per row of ``df``: id, ``path``, ``license`` (null if none), ``score`` (the cosine; null without an own
    licence), ``found_in`` (header, file or inherited) and ``license_dir`` (the directory it is inherited from).

    ``score`` is the best cosine of a line or of the whole text. The first ``notices`` templates are notices, the others
    whole licence texts. A text whose whole reaches the threshold with a whole licence text, whatever its lines score, is a
    licence file of its directory under its best name as a whole (a line may stand in several licences); a text whose path
    ends in a name like LICENSE, COPYING or NOTICE is one if any licence is found in it, under its best name as a whole, or
    else that of its best line. Among several files of a directory the name that sorts first counts. Other texts take the
    name of their best unit, on ties the whole text, then the name that sorts first. Null texts and empty ones hold no licence but inherit one; null paths inherit nothing. Rows that
    repeat an id, path and text give equal rows. An empty table gives an empty result; other columns aren't read.
    """
    spark, terms = df.sparkSession, _template_terms(templates)
    vocabulary = sorted({t for w in terms for t in w})
    known = F.array(*(F.lit(t) for t in vocabulary))
    rows = df.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))

    # Document frequencies of the templates' terms over all texts, and the number of texts: a few hundred numbers.
    counted = rows.select(F.explode(F.concat(F.array_intersect(known, _terms(F.coalesce("text", F.lit("")))), F.array(F.lit(OTHER)))).alias("term"))
    df_of = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.count("*").alias("n")).collect()}
    texts = df_of.get(OTHER, 0)
    idf = {t: math.log((1 + texts) / (1 + df_of.get(t, 0))) + 1 for t in vocabulary} | {OTHER: math.log(1 + texts) + 1}
    weights = [{t: n * idf[t] for t, n in w.items()} for w in terms]
    lengths = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    wanted = anchors(weights, threshold, df_of)

    anchored = lambda c: F.arrays_overlap(_terms(c), F.array(*(F.lit(t) for t in wanted)))
    lines = F.filter(F.split("text", "\n"), anchored)
    unit = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("unit"))
    units = rows.where(F.col("text").isNotNull() & anchored(F.col("text"))).select(
        "id", "path", F.xxhash64("text").alias("h"), F.explode(F.concat(F.transform(F.array_distinct(lines), lambda x: unit(1, x)), F.array(unit(0, F.col("text"))))).alias("u")
    ).select("id", "path", "h", "u.*").where(anchored(F.col("unit")))
    # Term frequencies of a unit: one row per unit and term; the templates' side is a fixed small table.
    numbered = units.select("id", "path", "h", "kind", F.xxhash64("unit").alias("unit"), F.explode(_terms(F.col("unit"))).alias("term"))
    tf = numbered.groupBy("id", "path", "h", "kind", "unit", "term").agg(F.count("*").alias("tf"))
    idf_rows = spark.createDataFrame(sorted((t, float(x)) for t, x in idf.items() if t), "term string, idf double")
    entries = spark.createDataFrame([(t, i, name, x / length) for i, ((name, _), w, length) in enumerate(zip(templates, weights, lengths, strict=True)) for t, x in sorted(w.items())], "term string, template int, name string, w double")
    weighed = tf.join(F.broadcast(idf_rows), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(float(idf[OTHER]))))
    unit_key = ["id", "path", "h", "kind", "unit"]
    norm = weighed.groupBy(*unit_key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "x"))).alias("known"))
    dots = norm.select(*unit_key, "norm", F.explode("known").alias("k")).select(*unit_key, "norm", "k.*").join(F.broadcast(entries), "term")
    scores = dots.groupBy(*unit_key, "template", "name").agg((F.sum(F.col("x") * F.col("w")) / F.first("norm")).alias("score")).where(F.col("score") >= threshold)
    ranked = F.struct((-F.round("score", 9)).alias("s"), "kind", "name")
    named = F.coalesce(F.lower(F.substring_index("path", "/", -1)).rlike(FILE_NAME), F.lit(False))
    whole = named | ((F.col("kind") == 0) & (F.col("template") >= notices))
    best = scores.groupBy("id", "path", "h").agg(F.min(ranked).alias("b"), F.min(F.when(whole, F.struct("kind", ranked.alias("r"), "name"))).alias("w"))
    own = saved(best.select("id", "path", "h", F.coalesce("w.name", "b.name").alias("license"), (-F.col("b.s")).alias("score"), F.when(F.col("w").isNotNull(), "file").otherwise("header").alias("found_in"), F.col("w.name").alias("whole")))

    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    files = own.where("found_in = 'file' and path is not null").groupBy(parent(F.col("path")).alias("license_dir")).agg(F.min("whole").alias("license"))
    folder = rows.where("path is not null").select(parent(F.col("path")).alias("dir")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))
    inherited = folder.select("dir", F.explode(F.array_distinct(above)).alias("license_dir")).join(files, "license_dir")
    inherited = inherited.groupBy("dir").agg(F.max_by(F.struct("license", "license_dir"), F.length("license_dir")).alias("from"))

    slim = rows.select("id", "path", F.xxhash64("text").alias("h"), parent(F.col("path")).alias("dir"))
    o = own.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("h").alias("o_h"), "license", "score", "found_in")
    out = slim.join(o, F.col("id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")) & (F.col("h") == F.col("o_h")), "left").join(inherited, "dir", "left")
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "from.license").alias("license"), "score",
        F.coalesce("found_in", F.when(F.col("from").isNotNull(), "inherited")).alias("found_in"),
        F.when(F.col("found_in").isNull(), F.col("from.license_dir")).alias("license_dir"),
    )
