"""Licence scans: TF-IDF cosine of a file's statements to licence templates, then inheritance from licence files above.

A statement is a line, and of a licence file (by its name) the whole text as well. Its words are weighted by how few
lines of the whole corpus have them, as the templates' are; words that no template has count as if one line had them.
Lines are held against sentences as headers have them, whole texts against licences' texts. A statement matches the
template to which its cosine is largest, if that is ``LEAST`` or more; a file's licence is its best statement's. A file
without one inherits from the licence file in the nearest directory on its path: ancestors are joined by their paths,
the longest that meets wins.

Every line of every file takes part. A line's words that no template has only make its cosines smaller, so lines whose
other words can't reach ``LEAST`` with any template are left out before they are scored: by a bound on the cosine, which
holds whatever words the corpus has most.

Edge cases: a null or empty text has no statement; a null path inherits nothing, and is no licence file; equal cosines go
to the licence first in the alphabet; a cosine of exactly ``LEAST`` is a match; texts of any length are read whole;
repeated rows give one output row each, and their lines count for each; without files there is no row; columns of any
name can be kept.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

LEAST = 0.55

#: How licences are named in headers, and sentences that mark their texts.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at www.apache.org licenses LICENSE-2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: The texts of licences that fit in a file, as their authors ask to be copied.
TEXTS = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
        " In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."
        " In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits,"
        " whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
        " In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        " This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
        " In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
        " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,"
        " for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
        " See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
]
NAMES = "(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def _words(text: str) -> Column:
    return F.expr(f"filter(transform(split(lower({text}), '[^a-z0-9.+-]+', -1), w -> trim(BOTH '.' FROM w)), w -> w <> '')")


def _templates(spark: SparkSession, sentences: list[tuple[str, str]], texts: list[tuple[str, str]]) -> DataFrame:
    """template, whole (whether it is a whole text), license, word, tf of a bounded list."""
    listed = [(i, i >= len(sentences), name, text) for i, (name, text) in enumerate([*sentences, *texts])]
    rows = spark.createDataFrame(listed, "template int, whole boolean, license string, text string")
    return rows.select("template", "whole", "license", F.explode(_words("text")).alias("word")).groupBy("template", "whole", "license", "word").agg(F.count(F.lit(1)).alias("tf"))


def _reaches(words: str, weighted: DataFrame, counts: dict[str, int], unseen: float) -> Column:
    """False only for lines whose cosine to every template is below ``LEAST``.

    The dot product is at most the sum, over the line's words, of idf times the word's largest weight in any template; the
    line's norm is at least that of the words no template has, each with weight ``unseen``.
    """
    most = {r["word"]: r["most"] for r in weighted.groupBy("word").agg(F.max(F.col("idf") * F.col("w")).alias("most")).collect()}
    if not most:
        return F.lit(False)
    ordered = sorted(most, key=lambda w: (-counts.get(w, 0), w))  # looked up from the front
    value = F.create_map(*[F.lit(x) for w in ordered for x in (w, most[w])])

    def reaches(own: Column, known: Column) -> Column:
        dot = F.aggregate(known, F.lit(0.0), lambda s, w: s + F.element_at(value, w))
        return (F.size(known) > 0) & (dot >= F.sqrt(F.size(own) - F.size(known)) * F.lit((LEAST - 1e-6) * unseen))

    # Arrays of one element bind a name to what would otherwise be worked out again at every mention.
    return F.exists(F.array(words), lambda own: F.exists(F.array(F.filter(own, lambda w: w.isin(ordered))), lambda known: reaches(own, known)))


def statements(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """file, line (null for a whole text), license, score: the best template of every statement that matches one.

    ``files``: file, text, and licence (whether its text as a whole is a statement too). Equal files are told apart.
    """
    spark = files.sparkSession
    words = saved(_templates(spark, templates, texts), "licenses-templates")
    vocabulary = [r[0] for r in words.select("word").distinct().orderBy("word").collect()]  # as long as the templates are
    known = F.lit(vocabulary)
    lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("words", _words("text")).drop("text")
    # How many lines have each of the templates' words; the list of these is short, so nothing large is shuffled.
    own = F.array_intersect(F.col("words"), known)
    counted = lines.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    counts = {r["word"]: r["df"] for r in counted.collect()}
    total = counts.pop("", 0)
    idf = spark.createDataFrame([(w, float(counts.get(w, 0))) for w in vocabulary], "word string, df double").select("word", F.log((F.lit(float(total)) + 1) / (F.col("df") + 1)).alias("idf"))
    unseen = F.log((F.lit(float(total)) + 1) / F.lit(2.0))
    weighted = words.join(F.broadcast(idf), "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighted = saved(weighted.join(norms, "template").where("norm > 0").select("template", "whole", "license", "word", (F.col("w") / F.col("norm")).alias("w")), "licenses-weights")
    # All that follows is about few rows: lines that may match, and licence files.
    hopeful = lines.where(_reaches("words", weighted.where("not whole").join(F.broadcast(idf), "word"), counts, log((total + 1) / 2) if total else 0.0))
    entire = files.where("licence").select("file", F.lit(None).cast("int").alias("line"), _words("text").alias("words"))
    rows = hopeful.unionByName(entire).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "file", "line", F.col("line").isNull().alias("whole"), F.explode("words").alias("own"))
    key = ["row", "file", "line", "whole"]
    tf = each.groupBy(*key, "own").agg(F.count(F.lit(1)).alias("tf"))
    # The statement's own norm: words of templates by their counts, all others as seen once.
    tf = tf.join(F.broadcast(idf), tf["own"] == idf["word"], "left").select(*key, "word", (F.col("tf") * F.coalesce("idf", unseen)).alias("own"))
    terms = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "own")))  # no more than the templates have words
    lengths = tf.groupBy(*key).agg(F.sum(F.col("own") * F.col("own")).alias("square"), terms.alias("terms"))
    dots = lengths.select(*key, "square", F.inline("terms"))
    scored = dots.join(F.broadcast(weighted), ["word", "whole"]).groupBy(*key, "square", "template", "license").agg(F.sum(F.col("own") * F.col("w")).alias("dot"))
    score = F.round(F.col("dot") / F.sqrt("square"), 6).alias("score")
    fitting = scored.select(*key, "license", score).where(F.col("score") >= LEAST)
    best = fitting.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select("file", "line", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


def licensed(files: DataFrame, keep: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """``keep``, path, license, score, origin (header, directory or null) and source (the licence file inherited from)."""
    numbered = files.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    key = F.struct("path", F.xxhash64("text").alias("mark"))
    is_licence = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(NAMES), F.lit(False))
    own = statements(numbered.select(key.alias("file"), "text", is_licence.alias("licence")))  # repeated rows give the same twice
    own = saved(own.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select("file", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score")), "licenses-own")
    folder = F.regexp_extract("path", "^(.*?)[^/]*$", 1)
    governing = own.select(F.col("file.path").alias("path"), "license", "score").where(F.regexp_extract("path", "([^/]*)$", 1).rlike(NAMES))
    governing = governing.groupBy(folder.alias("above")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", "path")).alias("g"))
    # Each directory looks upwards once, however many files it has.
    folders = numbered.where("path is not null").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    nearest = folders.select("folder", F.explode(F.array_distinct(above)).alias("above")).join(governing, "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "g")).alias("x")).select("folder", F.col("x.g").alias("g"))
    rows = numbered.select("*", key.alias("file"), folder.alias("folder")).drop("text")
    rows = rows.join(own, rows["file"].eqNullSafe(own["file"]), "left").drop(own["file"]).join(nearest, "folder", "left")
    inherits = F.col("license").isNull() & F.col("g").isNotNull()
    return rows.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "path",
        F.coalesce("license", "g.license").alias("license"),
        F.coalesce("score", -F.col("g.minus")).alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(inherits, "directory").alias("origin"),
        F.when(inherits, F.col("g.path")).alias("source"),
    )


def document_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files, by source and language and in folders of a hundred. Texts that speak of a licence are licence files:
    short ones of their source and language, others of their folder.
    """
    docs = table(spark, sf_dir, "documents")
    above, own = F.concat_ws("/", "source", "lang"), F.floor(F.col("doc_id") / 100).cast("string")
    says = F.coalesce(F.col("text").rlike("(?i)licen[cs]e"), F.lit(False))
    name = F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))
    path = F.when(says & (F.length("text") < 2_000), F.concat_ws("/", above, name)).when(says, F.concat_ws("/", above, own, name)).otherwise(F.concat_ws("/", above, own, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licensed(docs.select("doc_id", path.alias("path"), "text"), ["doc_id"])
