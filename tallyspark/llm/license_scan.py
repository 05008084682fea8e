"""License scans with MinHash bands over text windows (operator 2).

Templates are license notices. Texts and templates become sequences of hashed
five-word shingles (lower-cased runs of a-z and 0-9). A template of t shingles
belongs to the class of the next power of two c; texts are read in windows of 2c
shingles at every c-th place, so whatever run of c shingles a text holds, a window
holds it whole. A window retrieves the templates of its class that share a band:
``BANDS`` MinHash values, one row each. A template of which the window holds four
fifths has a Jaccard similarity of at least 0.19 with it, so it is missed with a
probability below (1 - 0.19) ** BANDS, about 0.001 at 32 bands. Exact shingle
containment then decides. A window can only share a band's row if it holds the
shingle that has the template's least value there (its lead), so leads are looked up
in the texts, and the bands of the windows around each are worked out and compared.

A text longer than ``LONG_WORDS`` words is a whole license: it is cut into parts of ``PART_WORDS``
words, each a template, and the license is found in a document that holds half of its parts.

All of it is DataFrame functions. Templates are scanned for ``PASS_TEMPLATES`` at a time, which
bounds the tables that are broadcast; where there are more, the documents are written once
and read again for each further pass.

Edge cases: null and empty texts and texts of fewer than five words match nothing;
a template needs five words; repeated rows are reported each (``row`` tells them
apart); null ids are reported with a null id; a text that holds a notice several
times counts the windows that hold it (up to two for each) and has the first place
of its words; an empty table gives no rows; only the named columns
are read.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.scratch import materialize

WORDS = 5
BANDS = 32
CONTAINED = 0.8
#: Templates of one pass over the documents.
PASS_TEMPLATES = 200
#: Words from which on a license is known by its parts, the words of a part, and the share of the parts that tells it.
LONG_WORDS, PART_WORDS = 256, 128
PARTS_FOUND = 0.5
#: Whole texts of licenses, a file each, as their authors give them out.
WHOLE = Path(__file__).resolve().parent / "licenses"

# Notices as the licenses' own texts word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    # Whole short licenses.
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _shingles(words: str) -> Column:
    """Hash of every five-word shingle of the array column ``words``, in order."""
    places = F.sequence(F.lit(1), F.size(words) - (WORDS - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(*(F.element_at(F.col(words), i + j) for j in range(WORDS))))
    return F.when(F.size(words) >= WORDS, hashes).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: str) -> Column:
    """The MinHash value of each band."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(F.col(shingles), lambda h: F.xxhash64(h, b)))
    )


def _leads(shingles: str) -> Column:
    """The distinct shingles whose values are the bands' MinHash values."""
    valued = lambda b: F.transform(F.col(shingles), lambda h: F.struct(F.xxhash64(h, b).alias("value"), h.alias("lead")))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(valued(b))["lead"]))


def known_templates() -> list[tuple[str, str]]:
    """The notices above, and the whole licenses of the folder ``WHOLE``."""
    return TEMPLATES + [(path.stem, path.read_text("utf-8")) for path in sorted(WHOLE.glob("*.txt"))]


def template_parts(templates: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """(number of the template, parts it takes, license, text) of each template or part of one; parts take up all words, the last the rest."""
    out = []
    for k, (name, text) in enumerate(templates):
        words = text.split()
        n = max(1, len(words) // PART_WORDS) if len(words) > LONG_WORDS else 1
        edges = [i * PART_WORDS for i in range(n)] + [len(words)]
        out += [(k, n, name, " ".join(words[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def template_table(spark: SparkSession, parts: list[tuple[int, int, str, str]], first: int = 0) -> DataFrame:
    """(template, whole, needed, license, size_class, tset, bands, leads) of templates of five words or more, numbered from ``first``."""
    entry = lambda i, k, n, name, text: F.struct(
        F.lit(first + i).alias("template"), F.lit(k).alias("whole"), F.lit(math.ceil(PARTS_FOUND * n)).alias("needed"), F.lit(name).alias("license"), F.lit(text).alias("text")
    )
    listed = F.array(*(entry(i, *part) for i, part in enumerate(parts or [(0, 1, "", "")])))
    rows = spark.range(1).select(F.inline(listed)).withColumn("words", _words("text")).filter(F.size("words") >= WORDS)
    rows = rows.withColumn("seq", _shingles("words"))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("seq")))).cast("int")
    return rows.select("template", "whole", "needed", "license", size.alias("size_class"), F.array_distinct("seq").alias("tset"), _bands("seq").alias("bands"), _leads("seq").alias("leads"))


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, doc_id, license, containment, n_windows, first_word) of each text and license found in it."""
    parts = template_parts(known_templates() if templates is None else templates)
    texts = docs.select(F.lit(None).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if len(parts) > PASS_TEMPLATES:
        texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "license-documents")
    found = [_matched(texts, parts[at : at + PASS_TEMPLATES], at) for at in range(0, max(1, len(parts)), PASS_TEMPLATES)]
    matched = found[0]
    for more in found[1:]:
        matched = matched.unionByName(more)
    best = _best(matched)
    told = best.groupBy("row", "doc_id", "whole", "license").agg(
        F.max("contained").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min(F.array_min("at")).cast("long").alias("first_word"),
        F.count_distinct("template").alias("n_parts"), F.max("needed").alias("needed"),
    )
    return told.filter("n_parts >= needed").groupBy("row", "doc_id", "license").agg(
        F.max("containment").alias("containment"), F.sum("n_windows").alias("n_windows"), F.min("first_word").alias("first_word")
    )


def _matched(texts: DataFrame, parts: list[tuple[int, int, str, str]], first: int) -> DataFrame:
    """(row, doc_id, size_class, w, template, ...) of the windows of ``texts`` that hold four fifths of one of ``parts``."""
    notices = materialize(template_table(texts.sparkSession, parts, first).coalesce(1), "license-templates")
    leads = notices.select("size_class", F.explode("leads").alias("h")).distinct()  # PASS_TEMPLATES * BANDS rows at most
    known = [r[0] for r in leads.select("h").distinct().collect()] or [0]
    rows = texts.select("row", "doc_id", _words("text").alias("words"))
    # The row number keeps the filter below from being pushed into the words, which would split a text anew per shingle.
    number = F.coalesce("row", F.monotonically_increasing_id())
    rows = rows.select(number.alias("row"), "doc_id", _shingles("words").alias("seq"))
    held = materialize(rows.filter(F.exists("seq", lambda h: h.isin(known))), "license-texts")

    touched = held.select("row", F.posexplode("seq").alias("pos", "h")).join(F.broadcast(leads), "h")
    around = F.explode(F.array(*(F.floor(F.col("pos") / F.col("size_class") - back).cast("int") for back in (0, 1)))).alias("w")
    places = touched.select("row", "size_class", around).filter("w >= 0").distinct()
    windows = places.join(held, "row").select(
        "row", "doc_id", "size_class", "w", F.expr("slice(seq, w * size_class + 1, 2 * size_class)").alias("part")
    )
    banded = windows.withColumn("bands", _bands("part")).select("*", F.posexplode("bands").alias("band", "value")).drop("bands")
    of_template = notices.select("template", "whole", "needed", "license", "size_class", "tset", F.posexplode("bands").alias("band", "value"))
    retrieved = banded.join(F.broadcast(of_template), ["size_class", "band", "value"])
    per_window = retrieved.groupBy("row", "doc_id", "size_class", "w", "template").agg(
        *(F.first(c).alias(c) for c in ("whole", "needed", "license", "part", "tset"))
    )
    contained = F.size(F.array_intersect("tset", "part")) / F.size("tset")
    places_of = F.expr("filter(transform(part, (h, i) -> if(array_contains(tset, h), w * size_class + i, -1)), x -> x >= 0)")
    matched = per_window.withColumn("contained", contained).filter(F.col("contained") >= CONTAINED).withColumn("at", places_of)
    return materialize(matched.drop("part", "tset"), "license-matched")


def _best(matched: DataFrame) -> DataFrame:
    """``matched`` without what another license of the size class, there or a window off, has with more words around it, or with the same words and more of its own text held."""
    more = matched.select("row", "size_class", F.explode(F.array(*(F.col("w") + i for i in (-1, 0, 1)))).alias("w"), F.col("license").alias("other"), F.col("at").alias("wide"), F.col("contained").alias("more"))
    better = (F.size("wide") > F.size("at")) | ((F.size("wide") == F.size("at")) & (F.col("more") > F.col("contained")))
    inside = better & (F.size(F.array_except("at", "wide")) == 0) & (F.col("other") != F.col("license"))
    beaten = matched.join(more, ["row", "size_class", "w"]).filter(inside).select("row", "size_class", "w", "template").distinct()
    return matched.join(beaten, ["row", "size_class", "w", "template"], "left_anti")
