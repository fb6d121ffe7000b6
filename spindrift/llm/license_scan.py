"""License scans: TF-IDF cosine of headers and license files to license templates, then inheritance from the nearest directory.

DataFrame functions only. Of every whole text three kinds of pieces are compared: lines that hold a cue (license,
copyright, ...), headers (of each block between blank lines, the lines at most REACH lines from one with a cue), and the
whole text, if headers are HALF of it or its file name is a license file's. Pieces are first reduced to distinct ones, whatever their number of occurrences. Tokens are
runs of letters or digits, so comment marks don't count; they are weighed by tf x idf, where document frequencies count
all distinct pieces of the corpus and the templates. The sparse dot products come from a join on tokens with the
templates' weights (a fixed list, broadcast). A piece resembles a notice at LEAST or more and the text of a license at
LEAST_TEXT or more, and takes the license of the most similar template.

A document's own license is its whole text's, else its best header's, else its best line's. It is a license file if its
whole text or name is one's, or if such lines or headers are HALF of its characters or more. A directory's license is its license files' best;
every directory takes that of its nearest ancestor that has one (itself included), found by a join on ancestor paths of
the distinct directories, and its documents without a license of their own inherit it.

Defined results: null and empty texts have no license of their own; a null path inherits nothing; ties in similarity go
to the license that sorts first; repeated rows are returned as often; a null doc_id's row has no license of its own.
Only doc_id, path and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

QUERY = "op5_license_scan"
LEAST, LEAST_TEXT, HALF = 0.6, 0.8, 0.5
CUES = ["licen", "copyright", "spdx", "all rights reserved", "public domain", "permission", "redistribution"]
WHOLE, BLOCK, LINE = 0, 1, 2
REACH = 3
BLANK_LINE = r"\n[\x20\x09\r]*\n"
FILE_NAME = r"^(un)?licen[cs]e|^copying|^notice|^copyright"
#: Notices of common licenses, as lines and headers have them.
NOTICES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "bsd-3-clause": ["Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "mit": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "proprietary": ["Copyright. All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
#: Whole texts of short licenses, without names of holders.
TEXTS = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause": f"Copyright (c) All rights reserved. {_CLAUSES} {_DISCLAIMER}",
    "bsd-3-clause": f"Copyright (c) All rights reserved. {_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "isc": "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS,
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " For more information, please refer to http://unlicense.org/",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: template, license, similarity that it takes, text.
TEMPLATES = [(f"{name}#{i}", name, LEAST, t) for name, ts in NOTICES.items() for i, t in enumerate(ts)] + [(f"{name}#text", name, LEAST_TEXT, t) for name, t in TEXTS.items()]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def _pieces(docs: DataFrame) -> DataFrame:
    """doc_id, kind, piece, length of the text, named (whether the file's name is a license's)."""
    low, cue = F.lower("text"), "|".join(CUES)
    some = F.lit(False)
    for c in CUES:
        some = some | low.contains(c)
    named = F.coalesce(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(FILE_NAME), F.lit(False))
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", named.alias("named")).where(some | F.col("named"))
    cued = lambda parts: F.filter(parts, lambda x: F.lower(x).rlike(cue))

    def header(block: Column) -> Column:
        lines = F.split(block, "\n")
        marks = F.transform(lines, lambda x: F.lower(x).rlike(cue))
        near = lambda i: F.exists(F.slice(marks, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)) + REACH + 1), lambda m: m)
        return F.array_join(F.filter(lines, lambda x, i: near(i)), "\n")

    docs = docs.select("doc_id", "text", "named", F.transform(cued(F.split("text", BLANK_LINE)), header).alias("headers"))
    share = F.aggregate("headers", F.lit(0), lambda a, x: a + F.length(x)) >= HALF * F.length("text")
    of = lambda kind, parts: F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("piece")))
    whole = F.when(F.col("named") | share, F.array("text")).otherwise(F.array().cast("array<string>"))
    every = F.concat(of(LINE, cued(F.split("text", "\n"))), of(BLOCK, F.col("headers")), of(WHOLE, whole))
    return docs.select("doc_id", F.inline(every), F.length("text").alias("whole"), "named")


def piece_licenses(pieces: DataFrame, s: C.Scratch) -> DataFrame:
    """id (MD5 of the piece), license, similarity of the distinct pieces that resemble a template."""
    rows = F.array(*(F.struct(F.lit(t).alias("template"), F.lit(name).alias("license"), F.lit(least).alias("least"), F.lit(text).alias("text")) for t, name, least, text in TEMPLATES))
    templates = pieces.sparkSession.range(1).select(F.inline(rows)).select("template", "license", "least", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("template", "license", "least", "token").agg(F.count("*").alias("tf"))
    distinct = s.light(pieces.groupBy(F.md5("piece").alias("id")).agg(F.first("piece").alias("piece")), "license-pieces")
    tf = s.light(distinct.select("id", F.explode(_tokens(F.col("piece"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf")), "license-tokens")
    n = distinct.count() + len(TEMPLATES)
    df = tf.groupBy("token").agg(F.count("*").alias("df")).unionByName(templates.groupBy("token").agg(F.count("*").alias("df"))).groupBy("token").agg(F.sum("df").alias("df"))
    idf = C.small(s.light(df.select("token", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")), "license-idf"))
    weigh = lambda x: x.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    told = weigh(templates)
    told = told.join(told.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "template").select("template", "license", "least", "token", (F.col("w") / F.col("norm")).alias("tw"))
    told = F.broadcast(s.light(told, "license-templates"))
    w = weigh(tf)
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = w.join(told, "token").groupBy("id", "template", "license", "least").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    best = dot.join(norm, "id").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= F.col("least"))
    return best.groupBy("id").agg(F.min_by(F.struct("license", "similarity"), F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select("id", "b.license", "b.similarity")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, similarity, basis (own, inherited or none), directory (that it comes from). docs: doc_id, path, text."""
    docs = docs.select("doc_id", "path", "text")
    with C.Scratch(docs.sparkSession) as s:
        found = s.table(_pieces(docs), "license-found")
        s.sized(found.count(), 100_000)
        told = C.small(s.light(piece_licenses(found, s), "license-told"))
        hits = found.select("doc_id", "kind", F.md5("piece").alias("id"), F.length("piece").alias("chars"), "whole", "named").join(told, "id")
        own = hits.groupBy("doc_id").agg(
            F.min_by(F.struct("license", "similarity"), F.struct("kind", (-F.col("similarity")).alias("s"), "license")).alias("b"),
            (F.max((F.col("kind") == WHOLE) | F.col("named")) | (F.greatest(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("chars"))), F.lit(0)) for k in (BLOCK, LINE))) >= HALF * F.max("whole"))).alias("file"),
        )
        own = s.light(own.select("doc_id", "b.*", "file"), "license-own")
        parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
        placed = docs.select("doc_id", "path", parent.alias("dir"))
        files = placed.where("dir is not null").join(C.small(own.where("file"), own), "doc_id")
        dirs = files.groupBy("dir").agg(F.min_by(F.struct("license", "similarity"), F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select(F.col("dir").alias("from_dir"), "b.*")
        dirs = s.light(dirs, "license-dirs")
        parts = F.split("dir", "/")
        ancestors = F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit("")))
        each = placed.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors).alias("from_dir"))
        near = each.join(C.small(dirs), "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "license", "similarity"), F.length("from_dir")).alias("d"))
        near = s.light(near.select("dir", "d.*"), "license-near").toDF("dir", "from_dir", "dir_license", "dir_similarity")
        out = placed.join(C.small(own.select("doc_id", F.col("license").alias("own_license"), F.col("similarity").alias("own_similarity")), own), "doc_id", "left").join(C.small(near), "dir", "left")
        has = F.col("own_license").isNotNull()
        basis = F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
        out = out.select("doc_id", "path", F.coalesce("own_license", "dir_license").alias("license"), F.when(has, F.col("own_similarity")).otherwise(F.col("dir_similarity")).alias("similarity"), basis.alias("basis"), F.when(~has, F.col("from_dir")).alias("directory"))
        return C.materialize(out, "license-scan")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out as source / hundreds / tens / id."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), (F.floor(F.col("doc_id") / 100) % 10).cast("string"), F.col("doc_id").cast("string"))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


def _sql() -> str:
    """The query's rows in DuckDB's SQL."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(t)}, {quoted(name)}, {least}, {quoted(text)})" for t, name, least, text in TEMPLATES)
    tokens = r"unnest(regexp_extract_all(lower(piece), '[\p{L}]+|[0-9]+(?:\.[0-9]+)*'))"
    cue = "|".join(CUES)
    return rf"""
WITH templates(template, license, least, piece) AS (VALUES {values}),
placed AS (
  SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_matches(lower(string_split(path, '/')[-1]), '{FILE_NAME}') AS named, text FROM (
    SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 % 10 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, text FROM documents)
), likely AS (
  SELECT doc_id, text, named FROM placed WHERE text IS NOT NULL AND (named OR regexp_matches(lower(text), '{cue}'))
), blocks AS (
  SELECT doc_id, text, named, string_split(x, chr(10)) AS lines, list_transform(string_split(x, chr(10)), lambda y: regexp_matches(lower(y), '{cue}')) AS marks
  FROM (SELECT *, unnest(regexp_split_to_array(text, '{BLANK_LINE}')) AS x FROM likely) WHERE regexp_matches(lower(x), '{cue}')
), headers AS (
  SELECT doc_id, text, named, array_to_string(list_filter(lines, lambda y, i: list_contains(list_slice(marks, greatest(i - {REACH}, 1), i + {REACH}), true)), chr(10)) AS h FROM blocks
), covered AS (
  SELECT doc_id, sum(length(h)) AS chars FROM headers GROUP BY doc_id
), found AS (
  SELECT doc_id, {LINE} AS kind, trim(x, ' ') AS piece, length(text) AS whole, named FROM (SELECT *, unnest(string_split(text, chr(10))) AS x FROM likely) WHERE regexp_matches(lower(x), '{cue}')
  UNION ALL SELECT doc_id, {BLOCK}, trim(h, ' '), length(text), named FROM headers
  UNION ALL SELECT doc_id, {WHOLE}, trim(text, ' '), length(text), named FROM likely LEFT JOIN covered USING (doc_id) WHERE named OR chars >= {HALF} * length(text)
), pieces AS (SELECT DISTINCT piece FROM found),
tf AS (SELECT piece, token, count(*) AS tf FROM (SELECT piece, {tokens} AS token FROM pieces) GROUP BY piece, token),
ttf AS (SELECT template, license, least, token, count(*) AS tf FROM (SELECT template, license, least, {tokens} AS token FROM templates) GROUP BY template, license, least, token),
total AS (SELECT (SELECT count(*) FROM pieces) + (SELECT count(*) FROM templates) AS n),
idf AS (
  SELECT token, ln((1.0::DOUBLE + (SELECT n FROM total)) / (1.0::DOUBLE + count(*))) + 1 AS idf
  FROM (SELECT token FROM tf UNION ALL SELECT token FROM ttf) GROUP BY token
), told AS (
  SELECT template, license, least, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tw FROM ttf JOIN idf USING (token)
), weighed AS (SELECT piece, token, tf * idf AS w FROM tf JOIN idf USING (token)),
norm AS (SELECT piece, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY piece),
dot AS (SELECT piece, template, license, least, sum(w * tw) AS dot FROM weighed JOIN told USING (token) GROUP BY piece, template, license, least),
best AS (
  SELECT piece, license, similarity FROM (SELECT piece, license, least, round(dot / norm, 6) AS similarity FROM dot JOIN norm USING (piece)) WHERE similarity >= least
  QUALIFY row_number() OVER (PARTITION BY piece ORDER BY similarity DESC, license) = 1
), own AS (
  SELECT doc_id, license, similarity,
    bool_or(kind = {WHOLE} OR named) OVER d OR greatest(coalesce(sum(CASE WHEN kind = {BLOCK} THEN length(piece) END) OVER d, 0), coalesce(sum(CASE WHEN kind = {LINE} THEN length(piece) END) OVER d, 0)) >= {HALF} * whole AS is_file
  FROM found JOIN best USING (piece) WINDOW d AS (PARTITION BY doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, similarity DESC, license) = 1
), dirs AS (
  SELECT dir AS from_dir, license, similarity FROM placed JOIN own USING (doc_id) WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1
), near AS (
  SELECT dir, from_dir, license, similarity FROM (SELECT DISTINCT dir FROM placed) JOIN dirs ON dir = from_dir OR starts_with(dir, from_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(from_dir) DESC) = 1
)
SELECT doc_id, path, coalesce(o.license, n.license) AS license, CASE WHEN o.license IS NOT NULL THEN o.similarity ELSE n.similarity END AS similarity,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, CASE WHEN o.license IS NULL THEN from_dir END AS directory
FROM placed LEFT JOIN own o USING (doc_id) LEFT JOIN near n USING (dir)
"""


SQL = _sql()
