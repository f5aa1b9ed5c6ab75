"""Licence scans: TF-IDF cosine of licence texts to templates, then inheritance from the nearest directory above.

1. A file is compared as a whole if it is named as a licence file; so are its runs (of comment lines, or of other lines),
   its paragraphs and its lines that hold a cue. Distinct ones are scored once, however many files share them.
2. A text's vector has a weight for each of its terms; the inverse document frequencies count all these texts of all files.
   Terms that no template has weigh as if they were in none. Its licence is that of the template of the greatest cosine,
   if that is ALIKE or more. A template is a notice or a licence's own words.
3. A file's own licence is that of its widest text that has one: the whole, then a run, a paragraph, a line, and the best of
   these; a mere claim of copyright (CLAIM) counts only if nothing else is found. A file is a licence file if it is named as
   one or if its notices, or the text that told its licence, make up a third of it; it covers its directory. A file without
   a licence of its own takes that of the nearest directory above it that a licence file covers; directories meet covered
   ones in equality joins over their ancestors.

Everything is DataFrame operations. Defined results: null and empty texts have no notice and inherit; a null path has no
directory; of several licence files of one directory the one with the greatest score counts, then the smallest path and
licence; ties between texts or templates go to the smallest name; repeated rows get equal results; no text is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tables import cut, table

#: The SPDX name of a licence and notices by which files refer to it.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
)
#: The words of short licences, paragraph by paragraph, and titles and notices of long ones.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.",
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission.",
)
TEXTS = (
    ("BSD-2-Clause", (*_BSD, _AS_IS)),
    ("BSD-3-Clause", (*_BSD, *_BSD_NAMES, _AS_IS)),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    )),
    ("MIT", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    )),
    ("AGPL-3.0", ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",)),
    ("Apache-2.0", ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",)),
    ("Apache-2.0", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License '
        "at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    )),
    ("GPL-2.0", ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",)),
    ("GPL-2.0", (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version.",
    )),
    ("GPL-3.0", ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    )),
    ("LGPL-3.0", ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    )),
    ("MPL-2.0", ("Mozilla Public License Version 2.0",)),
)
#: What texts are compared with: notices, whole licences, and the first paragraphs of licences, which grant the rights.
FORMS = (*TEMPLATES, *((name, " ".join(text)) for name, text in TEXTS), *((name, text[0]) for name, text in TEXTS if len(text) > 1))
CLAIM = "Proprietary"
#: What makes a line a notice, and names of licence files.
CUES = ("licen", "copyright", "spdx", "all rights reserved", "public domain", "creative commons")
FILES = r"^(licen[cs]e|copying|notice|unlicense)(\..*)?$"
ALIKE = 0.6
#: The start of a comment line, and the lines that part paragraphs: blank ones and those of comment marks.
COMMENT, BLANK = r"[ \t]*(?://|/\*|\*|#|;|--|<!--|%)", r"\n[ \t\r/*#;%!<>-]*\n"
#: Parts the runs of comment lines from other lines; in a text it parts a run too.
_PART = "\x1d"


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}]+|[0-9]+)"), F.lit(1))


def _vectors(lines: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of a column of distinct texts."""
    return lines.select(F.col(key), F.explode(_terms(F.col("line"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _cued(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CUES)), lambda cue: F.contains(text, cue))


def _lower(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def notices(text: Column) -> Column:
    """The lines of a text in lower case that hold a cue, without white space at their ends."""
    return F.transform(F.filter(F.split(text, "\n"), _cued), lambda x: F.trim(x))


def runs(text: Column) -> Column:
    """The longest runs of comment lines, or of other lines, of a text."""
    parted = F.regexp_replace(text, rf"(?dm)^({COMMENT}.*)\n(?!{COMMENT})", f"$1{_PART}\n")
    parted = F.regexp_replace(parted, rf"(?dm)^(?!{COMMENT})(.*)\n(?={COMMENT})", f"$1{_PART}\n")
    return F.split(parted, _PART)


def units(text: Column, named: Column) -> Column:
    """(kind, line) of what of a text in lower case is compared with templates: 0 the whole, 1 runs, 2 paragraphs, 3 lines."""
    tell = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line")))
    several = lambda found: F.filter(found, lambda x: _cued(x) & F.contains(F.trim(x), F.lit("\n")))
    none = F.array().cast("array<struct<kind:int,line:string>>")
    several_parts = lambda run: F.size(F.split(run, BLANK)) > 1  # noqa: E731  (a run of one paragraph is one text)
    parts = F.flatten(F.transform(F.filter(runs(text), several_parts), lambda run: F.split(run, BLANK)))
    wide = F.concat(tell(1, several(runs(text))), tell(2, several(parts)), tell(3, notices(text)))
    return F.concat(F.when(named, tell(0, F.array(text))).otherwise(none), F.when(_cued(text), wide).otherwise(none))


def score_notices(lines: DataFrame, templates=FORMS, alike: float = ALIKE) -> DataFrame:
    """(key, licence, score) of the texts that are like a template; lines: (key, line, n), n texts of the corpus are this line."""
    spark = lines.sparkSession
    forms = spark.createDataFrame([(i, name, form.lower()) for i, (name, form) in enumerate(templates)], "t int, licence string, line string")
    form_terms = _vectors(forms, "t")
    vocabulary = form_terms.select("term").distinct()
    total = lines.agg(F.sum("n")).first()[0] or 0
    used = lines.select("n", F.explode(F.array_distinct(_terms(F.col("line")))).alias("term")).join(F.broadcast(vocabulary), "term", "left_semi")  # as large as the templates
    counts = used.groupBy("term").agg(F.sum("n").alias("df"))
    idf = cut(vocabulary.join(counts, "term", "left").select("term", (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")))
    other = F.log(F.lit(1.0 + total)) + 1
    of_line = _vectors(lines, "key").join(F.broadcast(idf), "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", other)).alias("w"))
    norms = of_line.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    of_form = form_terms.join(F.broadcast(idf), "term").select("t", "term", (F.col("tf") * F.col("idf")).alias("v"))
    form_norms = of_form.groupBy("t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("form_norm"))
    of_form = cut(of_form.join(form_norms, "t").join(forms.select("t", "licence"), "t"))
    dots = of_line.join(F.broadcast(of_form), "term").groupBy("key", "t", "licence").agg(F.sum(F.col("w") * F.col("v") / F.col("form_norm")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= alike)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("key", "b.licence", (-F.col("b.s")).alias("score"))


def _above(dir: Column) -> Column:
    """A directory and all directories above it, nearest first, as (depth, dir); "" is the root."""
    parts = F.split(dir, "/")
    depth = F.when(dir == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """(id, path, notices, own_licence, own_score, licence_file, licence, origin, origin_path) of each row."""
    where = F.regexp_replace(F.col(path), r"^/+|/+$|/+(?=/)", "")
    files = df.select(F.col(id).alias("id"), where.alias("path"), _lower(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    named = F.coalesce(F.lower(F.regexp_extract("path", r"[^/]*$", 0)).rlike(FILES), F.lit(False))
    files = files.select("id", "path", "row", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.length("text").alias("size"), named.alias("named"), units(F.col("text"), named).alias("units"))
    keyed = lambda u: F.struct(u["kind"].alias("kind"), F.unhex(F.sha2(u["line"], 256)).alias("name"), F.length(u["line"]).alias("size"))
    texts = files.select(F.explode("units.line").alias("line")).groupBy(F.unhex(F.sha2("line", 256)).alias("name")).agg(F.count("*").alias("n"), F.first("line").alias("line"))
    lines = cut(texts.withColumn("key", F.monotonically_increasing_id()))
    files = cut(files.withColumn("units", F.transform("units", keyed)))  # texts are not kept, their sizes and hashes are
    told = files.select("row", F.explode("units").alias("u")).select("row", "u.kind", "u.name", "u.size")
    scored = cut(score_notices(lines).join(lines.select("key", "name"), "key").drop("key"))
    order = F.struct((F.col("licence") == CLAIM).alias("claim"), "kind", (-F.col("score")).alias("s"), "licence", (-F.col("told.size")).alias("size"))
    own = told.alias("told").join(scored, "name").groupBy("row").agg(F.min(order).alias("o"))
    own = own.select("row", F.col("o.licence").alias("own_licence"), (-F.col("o.s")).alias("own_score"), (-F.col("o.size")).alias("own_size"))
    lined = F.filter("units", lambda u: u["kind"] == 3)
    told_size = F.greatest(F.aggregate(lined, F.lit(0), lambda a, u: a + u["size"]), F.coalesce("own_size", F.lit(0)))
    covering = F.col("own_licence").isNotNull() & (F.col("named") | (3 * told_size >= F.col("size")))
    found = cut(files.join(own, "row", "left").select("id", "path", "dir", F.size(lined).alias("notices"), "own_licence", "own_score", covering.alias("licence_file")))
    covers = found.where("licence_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_licence")).alias("c"))
    covers = covers.select("dir", F.col("c.own_licence").alias("licence"), F.col("c.path").alias("from"))
    places = found.where("dir is not null").select("dir").distinct()
    near = places.select(F.col("dir").alias("of"), F.explode(_above(F.col("dir"))).alias("a")).select("of", "a.depth", "a.dir").join(covers, "dir")
    near = cut(near.groupBy("of").agg(F.max(F.struct("depth", "licence", "from")).alias("n")).select("of", "n.licence", "n.from"))
    out = found.join(near, found.dir == near.of, "left")
    has = F.col("own_licence").isNotNull()
    return out.select(
        F.col("id").alias(id), "path", "notices", "own_licence", "own_score", "licence_file",
        F.coalesce("own_licence", "licence").alias("licence"),
        F.when(has, "notice").when(F.col("licence").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("from")).alias("origin_path"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents have no paths; they are filed by source and by the digits of their id: source/thousands/hundreds/id.txt."""
    thousands, hundreds = F.floor(F.col("doc_id") / 1000), F.pmod(F.floor(F.col("doc_id") / 100), F.lit(10))
    return docs.withColumn("path", F.concat_ws("/", "source", thousands, hundreds, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(with_paths(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
