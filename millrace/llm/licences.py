"""Licence scans, in DataFrame operations only.

Units of a file, its lines and its paragraphs, are compared with licence templates by the cosine of
sparse TF-IDF vectors; a file without a licence of its own takes that of the licence file in its
nearest ancestor directory, found by joins on paths. Marks of comments and copyright lines
are taken off first, so a notice wrapped over several commented lines is one paragraph. An
SPDX identifier counts as a unit of similarity 1.

A licence file is called LICENSE, COPYING or alike and has a licensed unit, or is a text (by its name no
source code) half of which are licensed units; an SPDX identifier speaks for its own file alone.

Document frequencies are counted for all words over all files. Of the units only
those are scored that hold a telling word: of each template the heaviest words are telling, so
many that what the others weigh stays under the least similarity. So a unit without one
cannot reach it, and none is lost.

Defined results: a null text or path has no licence; empty texts have none; of
several licensed units the most similar (then the first line, then the shorter unit) counts, of equal templates the
first by name, of those that name one; of several licence files in a directory those called so come first, then the most similar, then the
first by path; repeated rows are scanned alike, as a file is told by all it says (id, path and text); a
relative path lies in the root; an empty table gives no rows. Columns that results are
named like are called <name>_in.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.columns import col, fresh, renamed
from millrace.storage import materialize, size_checked

#: Notices as they stand in headers, and what licence texts begin with: licence, text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    # paragraphs that several licences have: they make a text a licence, but name none
    (None, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (None, "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    (None, "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    (None, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (None, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (None, "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
]
LEAST = 0.7
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Marks of comments at the start or end of a line.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+!?|#+|--+|;+|%+|<!--|\"{3}|'{3})?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
COPYRIGHT = r"(?im)^.{0,8}copyright\b[^\n]*?(?:\.(?=\s)|$)|\ball rights reserved\.?"
#: Names of files that hold their directory's licence, and of texts that may.
NAMES = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|copyright)(?:[.-][^/]*)?$"
TEXTS = r"(?i)(?:^|/)[^/.]+(?:\.(?:txt|md|rst|html?))?$"
#: Share of a text's words from which on its licensed units make it its directory's licence file.
LICENCE_SHARE = 0.5


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, with inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def frequencies(files: DataFrame, text: str) -> DataFrame:
    """(word, df): in how many files each word stands; counted up before anything is shuffled."""
    return files.select(F.explode(F.array_distinct(words_of(col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def file_key(files: DataFrame, *names: str) -> Column:
    """A hash of what a file says; nulls are told from values."""
    return F.xxhash64(*(x for c in names for x in (col(c).isNull(), col(c))))


def telling(weights: dict[str, float], templates: list[tuple[str, str]], split, least: float) -> set[str]:
    """Words of which a unit that is `least` similar to a template holds one."""
    out = set()
    for _, notice in templates:
        counts: dict[str, int] = {}
        for w in split(notice):
            counts[w] = counts.get(w, 0) + 1
        parts = sorted(((c * weights[w]) ** 2, w) for w, c in counts.items())
        left = total = sum(x for x, _ in parts)
        while parts and math.sqrt(left / total) >= least - 1e-9:
            x, w = parts.pop()
            left -= x
            out.add(w)
    return out


def alternatives(words: list[str]) -> str:
    """A pattern of the words in which those with one beginning share it, so a text's sign is compared once for all of them."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + (alternatives(sorted(rest)) if len(rest) > 1 else re.escape(rest[0])) for c, rest in sorted(by.items()) if c]
    firsts = "".join(re.escape(c) for c in sorted(by) if c)
    return f"(?:(?=[{firsts}])(?:{'|'.join(parts)})" + ("|)" if "" in by else ")") if parts else ""


def _split(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def headers(files: DataFrame, key: str, text: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(key, licence, similarity, line, share): the best licensed unit of every file that has one, and the share of the file's words in such units.

    key: a column that tells files apart; rows of equal keys must have equal texts. Only scored units are joined and
    grouped, by key and unit, so no group outgrows a file.
    """
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    df = materialize(frequencies(files, text), "frequencies")
    n = files.where(col(text).isNotNull()).count()
    weigh = lambda c: F.log1p(F.lit(float(max(1, n))) / F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)))
    # as many rows as the templates have words
    every = spark.createDataFrame([(w,) for w in sorted({w for _, t in templates for w in _split(t)})], "word string")
    idf = every.join(df, "word", "left").select("word", weigh(F.col("df")).alias("idf"))
    weights = {r.word: r.idf for r in idf.collect()}
    told: dict[str, list[float]] = {}
    for i, (_, notice) in enumerate(templates):
        own: dict[str, float] = {}
        for w in _split(notice):
            own[w] = own.get(w, 0.0) + weights[w]
        norm = math.sqrt(sum(x * x for x in own.values()))
        for w, x in own.items():
            told.setdefault(w, [0.0] * len(templates))[i] = x / norm
    # a row for each word of a template, with its weight in every one of them
    vectors = spark.createDataFrame(sorted(told.items()), "word string, tw array<double>")
    names = F.array(*(F.lit(name) for name, _ in templates)).cast("array<string>")
    hints = sorted(telling(weights, templates, _split, least))
    hint = "(?i)SPDX-License-Identifier:|(?<![a-z0-9])" + alternatives(hints) + "(?![a-z0-9])"
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), r"\r\n?", "\n"), MARKS, ""), COPYRIGHT, "")
    found = files.where(col(text).rlike(hint)).select(col(key).alias("key"), clean.alias("t")).dropDuplicates(["key"])
    before = Window.partitionBy("key").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    paras = found.select("key", F.size(words_of(F.col("t"))).alias("whole"), F.posexplode(F.split("t", "\n\n")).alias("p", "para")).withColumn("start", F.coalesce(F.sum(F.size(F.split("para", "\n")) + 1).over(before), F.lit(0)))
    held = paras.where(F.col("para").rlike(hint))
    lines = held.select("key", "whole", "p", "start", F.posexplode(F.split("para", "\n")).alias("i", "unit")).where(F.col("unit").rlike(hint)).select("key", "whole", "p", (F.col("start") + F.col("i")).alias("at"), F.lit(0).alias("long"), "unit")
    units = lines.unionByName(held.select("key", "whole", "p", (F.col("start") + F.length(F.regexp_extract("para", "^\n*", 0))).alias("at"), F.lit(1).alias("long"), F.col("para").alias("unit")))
    units = units.withColumn("u", F.md5("unit"))
    by = ["key", "p", "at", "long"]
    # a unit that many files have is scored once
    tf = units.select("u", "unit").dropDuplicates(["u"]).select("u", F.explode(words_of(F.col("unit"))).alias("word")).groupBy("u", "word").agg(F.count("*").alias("tf"))
    weighted = tf.join(df, "word", "left").withColumn("w", F.col("tf") * weigh(F.col("df")))
    over = Window.partitionBy("u")
    mine = weighted.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(over))).withColumn("size", F.sum("tf").over(over))
    # a unit's words meet those of the templates once, whatever number of templates has them; what is gathered is bounded by the templates
    met = mine.join(F.broadcast(vectors), "word").groupBy("u", "size", "norm").agg(F.collect_list(F.struct("w", "tw")).alias("words"))
    dots = F.aggregate("words", F.array_repeat(F.lit(0.0), len(templates)), lambda sums, x: F.zip_with(sums, x["tw"], lambda a, b: a + x["w"] * b))
    alike = F.transform("dots", lambda dot, i: F.struct((-F.round(dot / F.col("norm"), 9)).alias("s"), F.get(names, i).alias("name"), (dot / F.col("norm")).alias("similarity"), dot.alias("dot")))
    most = F.array_min(F.filter(alike, lambda x: (x["dot"] > 0) & (x["similarity"] >= least)))
    best_of = met.select("u", "size", "norm", dots.alias("dots")).select("u", "size", most.alias("m")).where("m is not null").select("u", "size", "m.name", "m.similarity")
    scored = units.select(*by, "whole", "u").join(size_checked(materialize(best_of, "units")), "u")
    spdx = F.regexp_extract("unit", SPDX, 1)
    tagged = lines.where(spdx != "").select(*by, "whole", F.lit(0).alias("size"), spdx.alias("name"), F.lit(1.0).alias("similarity"))
    all_of = scored.select(*by, "whole", "size", "name", "similarity").unionByName(tagged)
    choice = F.min(F.when(F.col("name").isNotNull(), F.struct((-F.round("similarity", 9)).alias("s"), "at", "long", "name")))
    unit = all_of.groupBy(*by, "whole").agg(F.max("size").alias("size"), choice.alias("b"))
    # a paragraph is licensed as a whole, or for those of its lines that are
    para = unit.groupBy("key", "p", "whole").agg(F.greatest(F.coalesce(F.max(F.when(F.col("long") == 1, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("long") == 0, F.col("size"))), F.lit(0))).alias("size"), F.min("b").alias("b"))
    best = para.groupBy("key").agg(F.min("b").alias("b"), (F.sum("size") / F.max("whole")).alias("share")).where("b is not null")
    return best.select(F.col("key").alias(key), F.col("b.name").alias("licence"), (-F.col("b.s")).alias("similarity"), F.col("b.at").cast("long").alias("line"), F.col("share"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def inherit(files: DataFrame, path: str = "path", own: str = "licence", similarity: str = "similarity", is_licence: str = "is_licence") -> DataFrame:
    """files with inherited (licence) and inherited_from (directory) of the nearest ancestor with a licence file.

    Directories, not files, are joined with their ancestors: first one row for each
    directory, then files with theirs; a directory of any size is only met by its row. The root is "".
    """
    files = renamed(files, "inherited", "inherited_from")
    (here,) = fresh(files, "directory")
    placed = files.withColumn(here, directory(col(path)))
    given = placed.where(col(is_licence) & col(own).isNotNull() & col(path).isNotNull()).groupBy(col(here).alias("anc")).agg(F.min(F.struct((~col(path).rlike(NAMES)).alias("n"), (-col(similarity)).alias("s"), col(path).alias("p"), col(own).alias("l"))).alias("g")).select("anc", F.col("g.l").alias("inherited"))
    dirs = placed.where(col(path).isNotNull()).select(col(here).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, 1, i), "/"))))
    up = dirs.select("dir", F.explode(chain).alias("anc")).join(given, "anc")
    nearest = up.groupBy("dir").agg(F.max(F.struct(F.length("anc").alias("n"), "anc", "inherited")).alias("m")).select(F.col("dir").alias(here), F.col("m.inherited").alias("inherited"), F.col("m.anc").alias("inherited_from"))
    return placed.join(nearest, here, "left").drop(here)


def scan(files: DataFrame, path: str = "path", text: str = "text", licence_files: Column | None = None, **how) -> DataFrame:
    """files with licence, similarity, line, is_licence, inherited, inherited_from and effective.

    licence_files: which files hold their directory's licence if they have one; by default those of such names, and
    texts with LICENCE_SHARE of their words in licensed units.
    """
    files = renamed(files, "licence", "similarity", "line", "is_licence", "inherited", "inherited_from", "effective")
    key, share = fresh(files, "key", "share")
    keyed = files.withColumn(key, file_key(files, *(c for c in files.columns)))
    found = headers(keyed, key, text, **how).withColumnRenamed("share", share)
    met = keyed.join(found, key, "left")
    decides = licence_files if licence_files is not None else col(path).rlike(NAMES) | (col(path).rlike(TEXTS) & (F.col(share) >= LICENCE_SHARE))
    out = inherit(met.withColumn("is_licence", F.coalesce(F.col("licence").isNotNull() & decides, F.lit(False))), path)
    return out.withColumn("effective", F.coalesce("licence", "inherited")).drop(key, share)


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id; one that is mostly its notice is its directory's licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    files = docs.select("doc_id", F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files).select("doc_id", "path", "licence", F.round("similarity", 6).alias("similarity"), "line", "inherited", "inherited_from", "effective")
