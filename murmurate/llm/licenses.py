"""License scans: MinHash bands over overlapping word windows retrieve templates, exact
shingle containment verifies them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, written

SHINGLE = 5
#: Windows of text hold this many shingles; templates that a text without a window can match
#: (of fewer shingles, or of so few that WIDE - 1 of them are enough) are looked up by windows
#: of a single one, in every text. Windows start every STRIDE shingles in texts, everywhere in
#: templates, so that a verbatim window always has its equal among the template's.
WIDE, STRIDE = 8, 4
#: Bands of one row each, every one with a hash function of its own: a text window of Jaccard
#: similarity j to a template window is retrieved with probability 1 - (1 - j) ** BANDS. Where a
#: text holds 3/4 of a template, some window of it holds 6 of 8 shingles, and a window of text at
#: most two places off holds 4 of the same 8 (j = 1/3: 0.9985), mostly more (6: 0.9999996); and a
#: match is missed only if all its windows are.
BANDS = 16
CONTAINMENT = 0.75
#: Up to this many keys of all templates are a literal set in the plan; more are joined.
LITERAL_KEYS = 100_000

#: Well-known public licence notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingle_hashes(words: Column) -> Column:
    """64-bit hashes of every run of SHINGLE words in order; of fewer words, of all as one."""
    full = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, full).otherwise(F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>")))


def _shingle_texts(words: Column) -> Column:
    full = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    return F.array_distinct(F.when(F.size(words) >= SHINGLE, full).otherwise(F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))))


def _permuted(hashes: Column) -> list[Column]:
    """The hashes as each band orders them: hashed again with the band's number."""

    def by(band: int) -> Column:
        return F.transform(hashes, lambda x: F.xxhash64(F.lit(band), x))

    return [by(b).alias(f"_p{b}") for b in range(BANDS)]


def _wide_keys(stride: int) -> Column:
    """The band keys of all windows of WIDE shingles, from the columns of ``_permuted``; the
    last window reaches the end."""

    def keys(b: int) -> Column:
        last = F.size(f"_p{b}") - WIDE
        starts = F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))
        return F.transform(starts, lambda s: F.xxhash64(F.lit(b), F.array_min(F.slice(f"_p{b}", s + 1, WIDE))))

    return F.when(F.size("_p0") >= WIDE, F.array_distinct(F.concat(*(keys(b) for b in range(BANDS))))).otherwise(F.array().cast("array<long>"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row ``id_col, license, n_shingles, n_matched`` for every text and template of which
    the text holds at least ``containment`` of the distinct five-word shingles (A-Z lowered).

    ``n_shingles`` counts the template's distinct shingles and ``n_matched`` those in the whole
    text. Null and empty texts match nothing; null ids are passed on; rows alike in id and text
    give one row for each template; templates without a word are left out; other columns are
    not passed on.

    Whole texts of any length are scanned; a match at several places, or by several windows, is one.

    Plan: a text goes on only if one of its shingles is a template's, which loses nothing and
    which few texts pass; of those, band keys are looked up inside each row. Both look-ups are in
    literal sets; with more than LITERAL_KEYS keys they are joins, whose sides AQE chooses by size.
    No text is shuffled but those with a candidate, once, to verify each candidate once.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "license string, _template string")
    t = given.withColumn("_w", _words(F.col("_template"))).withColumn("_h", _shingle_hashes(F.col("_w"))).withColumn("_need", _shingle_texts(F.col("_w")))
    t = t.withColumn("_wide", (F.size("_h") >= WIDE) & (F.size("_need") * F.lit(float(containment)) > WIDE - 1)).where(F.size("_w") > 0)
    t = written(t.select("license", "_need", "_wide", "_h", *_permuted(F.col("_h"))).select("license", "_need", "_wide", "_h", F.when(F.col("_wide"), _wide_keys(1)).otherwise(F.array_distinct("_h")).alias("_keys")))
    bands, needs = t.select(F.explode("_keys").alias("_key"), "license"), t.select("license", "_need")
    n_keys = t.agg(F.coalesce(F.sum(F.size("_keys") + F.size("_h")), F.lit(0))).first()[0]

    # Each array has a projection of its own and is used there more than once, so that none is
    # computed anew inside a lambda; explode_outer lets no filter on them be pushed below.
    hashed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _words(F.col(text_col)).alias("_w")).select("_id", "_text", _shingle_hashes(F.col("_w")).alias("_h"))
    if n_keys <= LITERAL_KEYS:
        rows = t.select("_keys", "_wide", "_h").collect()
        wide, single = (sorted({k for r in rows if r["_wide"] == w for k in r["_keys"]}) for w in (True, False))
        every = sorted({k for r in rows for k in r["_h"]})
        some = lambda known: ", ".join(f"{k}L" for k in known) or "NULL"  # noqa: E731  as text, which is far faster than a column for each
        among = lambda keys, known: F.expr(f"filter({keys}, x -> x IN ({some(known)}))")
        hashed = hashed.select("_id", "_text", F.when(F.expr(f"exists(_h, x -> x IN ({some(every)}))"), F.col("_h")).alias("_h"))
        hashed = hashed.select("_id", "_text", F.explode_outer(F.array("_h")).alias("_h")).where("_h IS NOT NULL").select("*", *_permuted(F.col("_h")))
        hashed = hashed.select("_id", "_text", "_h", _wide_keys(STRIDE).alias("_k"))
        hits = F.array_distinct(F.concat(among("_h", single), among("_k", wide)))
        candidates = hashed.select("_id", "_text", F.explode_outer(hits).alias("_key")).where("_key IS NOT NULL").join(F.broadcast(bands), "_key")
    else:
        every = t.select(F.explode("_h").alias("_x")).distinct()
        rows = hashed.select("_id", F.xxhash64("_text").alias("_t"), F.explode(F.array_distinct("_h")).alias("_x")).join(every, "_x", "left_semi").select("_id", "_t").distinct()
        own = hashed.withColumn("_t", F.xxhash64("_text"))
        near = own.join(rows.withColumnRenamed("_id", "_id2").withColumnRenamed("_t", "_t2"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_t") == F.col("_t2")), "left_semi").drop("_t")
        near = near.select("*", *_permuted(F.col("_h")))
        keys = near.select("_id", "_text", F.explode(F.array_distinct(F.concat("_h", _wide_keys(STRIDE)))).alias("_key"))
        candidates = keys.join(bands, "_key")
    candidates = candidates.groupBy("_id", F.xxhash64("_text").alias("_t"), "license").agg(F.first("_text").alias("_text"))
    texts = candidates.select("_id", "license", _words(F.col("_text")).alias("_w")).select("_id", "license", _shingle_texts(F.col("_w")).alias("_have"))
    return (
        texts.join(F.broadcast(needs) if n_keys <= LITERAL_KEYS else needs, "license")
        .select(F.col("_id").alias(id_col), "license", F.size("_need").alias("n_shingles"), F.size(F.array_intersect("_need", "_have")).alias("n_matched"))
        .where(F.col("n_matched") >= F.lit(containment) * F.col("n_shingles"))
    )


def oracle(templates: dict[str, str] | None = None) -> str:
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in (TEMPLATES if templates is None else templates).items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingles = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
    return f"""
WITH t(license, body) AS (VALUES {values}),
tw AS (SELECT license, regexp_extract_all({lower.format("body")}, '{WORD}') AS w FROM t),
ts AS (SELECT license, {shingles} AS need FROM tw),
dw AS (SELECT doc_id, regexp_extract_all({lower.format("text")}, '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, {shingles} AS have FROM dw),
n AS (SELECT DISTINCT unnest(need) AS s FROM ts),
e AS (SELECT doc_id, unnest(have) AS s FROM d),
h AS (SELECT doc_id, list(s) AS have FROM e WHERE s IN (SELECT s FROM n) GROUP BY doc_id)
SELECT DISTINCT doc_id, license, CAST(len(need) AS INTEGER) AS n_shingles, CAST(len(list_intersect(need, have)) AS INTEGER) AS n_matched
FROM h, ts WHERE len(list_intersect(need, have)) >= {CONTAINMENT} * len(need)
"""
