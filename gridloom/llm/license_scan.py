"""Licence notices by TF-IDF cosine to templates, inherited from directories; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import stored

LEAST_COSINE = 0.7
_SIZES = 1 << 16  # above the words of any template
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)

#: Customary one-line notices of common licences, then headers, titles and full texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license, see the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
     "the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
     "later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
     "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD_2 + _AS_IS),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _AS_IS),
]


def terms(text: Column) -> Column:
    """Lower-cased (A-Z) words, numbers and names joined by dots or hyphens."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def template_terms(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """``template`` (its number), ``license``, ``term`` and ``tf``."""
    rows = docs.sparkSession.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string"
    )
    return rows.withColumn("term", F.explode(terms(F.col("text")))).groupBy("template", "license", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``term`` and ``df`` (rows that hold it) of every term; the row with an empty term counts all rows."""
    held = F.coalesce(F.array_distinct(terms(F.col(text_col))), F.array().cast("array<string>"))
    return docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_weights(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term`` and ``idf`` of the distinct ``wanted`` terms, by document frequency over all rows."""
    n = counts.where("term = ''").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n")).first()["n"]
    joined = wanted.join(counts, "term", "left")
    return joined.select("term", (F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf"))


def telling_terms(weighted: list[tuple[int, str, float, float]], least: float) -> set[tuple[int, str]]:
    """Templates with those terms of which a passage must have one to reach the cosine ``least`` with it.

    The commonest terms of a template whose joint length stays below ``least`` cannot reach
    it by themselves.  The input is template, term, weight and idf, so its size is the templates'.
    """
    needed, by_template = set(), {}
    for template, term, weight, idf in weighted:
        by_template.setdefault(template, []).append((idf, term, weight))
    for template, found in by_template.items():
        length, light = math.sqrt(sum(w * w for _, _, w in found)), 0.0
        for _, term, weight in sorted(found):
            light += weight * weight
            if math.sqrt(light) >= (least - 1e-9) * length:
                needed.add((template, term))
    return needed


def passages(words: str, templates: list[tuple[str, str]], telling: set[tuple[int, str]]) -> Column:
    """Runs of the words of the array column ``words``, across line breaks, that put a telling term in its place in a template.

    A run is as long as its template.  Those of templates with more than sixteen words begin
    at every eighth of their length and are longer by an eighth, so that they hold each place.
    """
    seeds: dict[str, set[tuple[int, int, int]]] = {}
    for number, (_, text) in enumerate(templates):
        held = re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))
        step = len(held) // 8 if len(held) > 16 else 1
        for place, term in enumerate(held):
            if (number, term) in telling:
                seeds.setdefault(term, set()).add((place, step, len(held) + step - 1))
    places = F.create_map(*(
        x for term, found in sorted(seeds.items())
        for x in (F.lit(term), F.array(*(
            F.struct(F.lit(p).alias("place"), F.lit(s).alias("step"), F.lit(n).alias("size")) for p, s, n in sorted(found)
        )))
    ))

    # a run as one long, begin before size, so that they are made distinct by hashing
    def runs(word, i):
        return F.transform(F.coalesce(places[word], F.array().cast("array<struct<place:int,step:int,size:int>>")), lambda s: (
            F.floor(F.greatest(i - s["place"], F.lit(0)) / s["step"]).cast("long") * s["step"] * _SIZES + s["size"]
        ))

    found = F.array_distinct(F.flatten(F.transform(words, runs)))
    return F.transform(found, lambda r: F.array_join(
        F.slice(words, F.floor(r / _SIZES).cast("int") + 1, (r % _SIZES).cast("int")), " "
    ))


def notices(
    docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]], least: float
) -> DataFrame:
    """``id``, ``own_license`` and ``score`` of each document with a passage at or above the cosine ``least``.

    Passages are single lines and, for notices that are wrapped, stand within longer lines or
    are whole licence texts, runs of words as long as a template (see ``passages``).

    Word weights, also those of words in no template, count all documents.  Passages without a telling term cannot match and are
    passed over.  The best one decides; of equal scores the first template.
    """
    counts = stored(term_counts(docs, text_col), "counts")
    held = template_terms(docs, templates)
    known = stored(term_weights(counts, held.select("term").distinct()), "idf")
    parts = held.join(known, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("template")))
    unit = parts.withColumn("w", F.col("w") / length).select("template", "license", "term", "w")
    telling = telling_terms([tuple(r) for r in parts.select("template", "term", "w", "idf").collect()], least)
    sought = F.array(*map(F.lit, sorted({term for _, term in telling})))
    near = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.arrays_overlap(terms(F.col(text_col)), sought))
    single = near.select("id", F.explode(F.split("text", "\n")).alias("line")).where(F.arrays_overlap(terms(F.col("line")), sought))
    listed = near.select("id", terms(F.col("text")).alias("words"))
    # an inner explode would be tested below the list of words, which then is made anew for each run
    run = listed.select("id", F.explode_outer(passages("words", templates, telling)).alias("line")).where("line IS NOT NULL")
    # passages of one document with the same words have the same score; from here on a hash stands for the text
    worded = single.unionByName(run).select("id", F.array_join(terms(F.col("line")), " ").alias("line")).distinct()
    key = F.unhex(F.md5("line"))
    lines = stored(worded.select("id", key.alias("key"), F.explode(F.split("line", " ")).alias("term")).groupBy("id", "key", "term").agg(
        F.count(F.lit(1)).alias("tf")
    ), "candidates")
    weights = stored(term_weights(counts, lines.select("term").distinct()), "weights")
    words = lines.join(weights, "term").withColumn("v", F.col("tf") * F.col("idf"))
    words = words.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("id", "key"))))
    scores = words.join(unit, "term").groupBy("id", "key", "template", "license").agg(
        (F.sum(F.col("v") * F.col("w")) / F.max("norm")).alias("cosine")
    ).withColumn("score", F.round("cosine", 6)).where(F.col("score") >= least)
    best = F.max(F.struct("score", (-F.col("template")).alias("order"), "license")).alias("best")
    return scores.groupBy("id").agg(best).select("id", F.col("best.license").alias("own_license"), "best.score")


def parent(path: Column) -> Column:
    """The path without its last part; the root directory is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """Add ``directory`` and, from its nearest ancestor directory with a licence file, ``inherited`` and ``inherited_from``.

    ``files`` has ``path``, ``own_license``, ``score`` and ``is_license_file``.  Several licence
    files of one directory: the best score, then the first path.  Ancestors are looked up for
    each distinct directory, not for each file.
    """
    placed = files.withColumn("directory", parent(F.col("path")))
    first = W.partitionBy("directory").orderBy(F.desc("score"), "path")
    declared = (
        placed.where("is_license_file AND own_license IS NOT NULL")
        .groupBy("directory", "own_license", "score").agg(F.min("path").alias("path"))
        .withColumn("n", F.row_number().over(first)).where("n = 1")
        .select(F.col("directory").alias("ancestor"), F.col("own_license").alias("inherited"))
    )
    cuts = F.split("directory", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda n: F.array_join(F.slice(cuts, F.lit(1), n), "/"))
    wanted = placed.select("directory").distinct().withColumn("ancestor", F.explode(F.array_distinct(ups)))
    nearest = wanted.join(declared, "ancestor").groupBy("directory").agg(
        F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "inherited")).alias("best")
    ).select("directory", F.col("best.inherited").alias("inherited"), F.col("best.ancestor").alias("inherited_from"))
    return placed.join(nearest, "directory", "left")


def license_scan(
    files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
    license_file: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE,
) -> DataFrame:
    """One row per row of ``files``: id, ``path``, ``own_license``, ``score``, ``inherited``, ``inherited_from``, ``license``.

    A file's own notice wins over its directory's.  ``license_file`` says which files declare
    for their directory (default: names that begin with licen[sc]e or copying); they still have
    their own notice.  Null and empty texts have no notice, a null path is the root directory's.
    Rows that repeat an id share the notices of all of them.
    """
    if license_file is None:
        license_file = F.lower(F.regexp_extract(F.col(path_col), "[^/]*$", 0)).rlike("^(licen[sc]e|copying)")
    found = notices(files, id_col, text_col, templates, least).withColumnRenamed("id", "_id")
    thin = files.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"),
        F.coalesce(license_file, F.lit(False)).alias("is_license_file"),
    )
    joined = thin.join(found, thin["id"].eqNullSafe(found["_id"]), "left").drop("_id")
    whole = inherit(stored(joined, "notices"))
    return whole.select(
        F.col("id").alias(id_col), "path", "own_license", "score", "inherited", "inherited_from",
        F.coalesce("own_license", "inherited").alias("license"),
    )
