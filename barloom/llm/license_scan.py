"""Licence detection and inheritance along directories.

Every unit of a file is a sparse TF-IDF vector. Its cosine to the templates decides
which licence the unit states. Units are lines, and of every paragraph (comment
marks removed) its clauses and its two and three joined lines, all against the
one-sentence TEMPLATES; header blocks (the leading comment, paragraphs, up to four
in a row) against the NOTICES; and whole files against NOTICES and full licence
texts. A file has the licence of its whole text if that is one, else of its best unit;
a licence file gives its licence to its directory; a file without its own inherits
that of the nearest directory above it.

Blocks and whole files have a vectoriser of their own with 1 + ln(tf), so that common
words of a long text do not decide. They are made of files that hold one of STEMS,
as every notice and full text does, and whole files also of all that are named as a licence.

The vectoriser is fitted on the templates: idf(t) = ln((1 + N) / (1 + df)) + 1 with
N templates; a term of no template has df 0, so foreign words lengthen a line
and lower its cosine. A unit can reach the threshold only if it holds one of the
needed terms of a template: terms are taken, long ones first, until those left over
are too short a vector to reach it (very short ones count together). Texts, lines and
units without them are passed by exactly, not by chance, after plain searches; only
the others are split into terms, and these are joined to the templates' terms.

Everything is DataFrame functions. Templates are literals of this module and the files in
`licence_texts`; of the Creative Commons licences there are statements only, no full text.

Defined cases: null and empty texts state no licence. Ties between templates go to
the first licence by name, then to lines before other units, between lines to the smallest
number; line_no is null for other units. Repeated rows of
a path state the same licence and are reported each. A null path is a file in
the directory '' that inherits nothing. Several licence files in a directory: the
best score decides, then the name. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import cut

# Usual statements of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
          "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
          "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
              "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
              "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
              "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
              "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
           "http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_AS_IS = ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                 "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")
_GNU = ("{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, "
        "either version {2} of the License, or (at your option) any later version.")
_GNU_AS_IS = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
              "PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.")
#: Notices as they stand in headers and short licence files, each whole and its first part alone.
NOTICES = [
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"), ("BSD-3-Clause", _BSD), ("BSD-3-Clause", f"{_BSD} {_BSD_AS_IS}"),
    *[(name, text) for name, lesser, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-3.0", "Lesser ", "3"))
      for head in [_GNU.format("This program", lesser, version)] for text in (head, f"{head} {_GNU_AS_IS.format(lesser)}")],
    ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_KEEP}"), ("MIT", f"{_MIT} {_MIT_KEEP} {_AS_IS}"), ("MPL-2.0", _MPL),
]
FULL_TEXTS = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
#: Every notice and full text holds one of these.
STEMS = ("licen", "redistribut", "permission")
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.].*)?$"
THRESHOLD = 0.8
#: Marks at the start of a comment line; a line that holds nothing else is blank.
COMMENT = r"(?m)^[ \t]*(?:[/*#;%!\"'<>|-]+|(?:dnl|rem|REM|[.][.])(?=\s|$))?[ \t]*"
PARAGRAPH_END = r"[ \t]*\r?\n[ \t]*\r?\n[ \t\r\n]*"
CLAUSE_END = r";\s+|[.:!?][\"')\]]*\s+(?=[^a-z0-9\s])"
#: Pairs of marks around a comment of several lines, and the start of a line that is one. No pattern of this module
#: repeats a group: the matcher would go one call deeper for every round.
AROUND = [("/*", "*/"), ("<!--", "-->"), ('"""', '"""')]
LINE_COMMENT = r"^[ \t]*(?://|#|--|;|%|dnl\b)"
SEPARATORS = r"[^a-z0-9.]+"
EDGE_DOTS = r"^[.]+|[.]+$"


def template_terms(text: str) -> Counter:
    return Counter(t for t in (x.strip(".") for x in re.split(SEPARATORS, text.lower())) if t)


def weights(templates=TEMPLATES, sublinear: bool = False) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """idf of the templates' terms, idf of any other term, unit vectors of the templates."""
    counts = [template_terms(t) for _, t in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    other = math.log(1 + len(templates)) + 1
    units = []
    for c in counts:
        v = {t: (1 + math.log(n) if sublinear else n) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        units.append({t: x / norm for t, x in v.items()})
    return idf, other, units


def needed_terms(units: list[dict[str, float]], threshold: float, short: int = 2) -> tuple[list[str], list[tuple[str, ...]]]:
    """Terms of which a unit must hold one, or else all of one of the tuples, to reach the threshold with any template.

    By Cauchy's inequality the cosine is at most the length of the template's part that the unit shares.
    Terms of at most `short` letters stand in other words of any language; where a template is
    still reached without its longer terms, those short ones without which it is not go together.
    """
    some, together = set(), set()
    enough = (threshold - 1e-9) ** 2
    for unit in units:
        rest = 1.0
        left = dict(unit)
        for t, x in sorted(unit.items(), key=lambda e: (-len(e[0]), -e[1], e[0])):
            if rest < enough or len(t) <= short:
                break
            some.add(t)
            rest -= x * x
            del left[t]
        if rest >= enough:
            must = tuple(sorted(t for t, x in left.items() if rest - x * x < enough))
            if must:
                together.add(must)
            else:
                some.update(left)
    return sorted(some), sorted(together)


def once(text: Column, holds) -> Column:
    """holds(text) with the expression of the text worked out once, not again for every search in it."""
    return F.exists(F.array(text), holds)


def may_reach(text: Column, needed: tuple[list[str], list[tuple[str, ...]]]) -> Column:
    """Whether a lower-case text holds what needed_terms asks for, as parts of words: plain searches, no pattern."""
    some, together = needed
    parts = [t for t in some if not any(o != t and o in t for o in some)]
    holds = lambda x, ts: reduce(lambda a, b: a & b, [x.contains(t) for t in ts])
    return once(text, lambda x: reduce(lambda a, b: a | b, [holds(x, (t,)) for t in parts] + [holds(x, ts) for ts in together]))


def can_reach(terms: Column, needed: tuple[list[str], list[tuple[str, ...]]]) -> Column:
    """The same of the terms of a unit."""
    some, together = needed
    alone = F.arrays_overlap(terms, F.array(*[F.lit(t) for t in some]))
    return reduce(lambda a, b: a | b, [alone] + [reduce(lambda a, b: a & b, [F.array_contains(terms, t) for t in ts]) for ts in together])


def reaching_terms(line: Column, needed) -> Column:
    """Rows of the terms of a lower-case line, none where the line cannot reach: they are split once, and not again for every term that is asked for."""
    return F.explode(F.filter(F.array(line_terms(line)), lambda terms: can_reach(terms, needed)))


def has_stem(text: Column) -> Column:
    """Whether a lower-case text holds one of STEMS."""
    return once(text, lambda x: reduce(lambda a, b: a | b, [x.contains(s) for s in STEMS]))


def candidates(texts: DataFrame, needed, licence_name: str) -> DataFrame:
    """path, text_ and the marks lines_ and blocks_ of the texts that have units of either sort: every text is searched once."""
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(licence_name), F.lit(False))
    marks = F.transform(F.array(F.lower("text_")), lambda x: F.struct(F.coalesce(may_reach(x, needed), F.lit(False)).alias("lines_"),
                                                                     (F.coalesce(has_stem(x), F.lit(False)) | named).alias("blocks_")))
    held = texts.select("path", "text_", F.explode(F.filter(marks, lambda m: m["lines_"] | m["blocks_"])).alias("m"))
    return held.select("path", "text_", "m.lines_", "m.blocks_")


def line_terms(line: Column) -> Column:
    """Terms of a lower-case line."""
    return F.filter(F.transform(F.split(line, SEPARATORS), lambda x: F.regexp_replace(x, EDGE_DOTS, "")), lambda x: x != "")


def many_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of thousands of literals, as one: an expression per value would take minutes to plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{schema}>>")))


def runs(parts: Column, n: int) -> Column:
    """Every n neighbours of an array, joined."""

    def of(ps: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(ps) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(ps, i, n)))
        return F.when(F.size(ps) >= n, some).otherwise(F.array().cast("array<string>"))

    # Bound once: inside the inner lambda the expression of the parts would run again for every element.
    return F.transform(F.array(parts), of)[0]


def leading_comment(text: Column) -> Column:
    """The comment that a text begins with, after a "#!" line; empty if it begins with none."""
    body = F.regexp_replace(text, r"^\s+", "")
    body = F.when(body.startswith("#!"), F.regexp_replace(F.regexp_replace(body, r"^#![^\n]*", ""), r"^\s+", "")).otherwise(body)
    lines = F.split(body, "\n")
    first_other = F.array_position(F.transform(lines, lambda x: ~x.rlike(LINE_COMMENT)), True)
    out = F.array_join(F.when(first_other == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(first_other - 1, F.lit(0)).cast("int"))), "\n")
    for begin, end in AROUND:
        stop = F.locate(end, body, len(begin) + 1)
        out = F.when(body.startswith(begin), F.when(stop > 0, F.substring(body, F.lit(1), stop - 1)).otherwise("")).otherwise(out)
    return F.coalesce(out, F.lit(""))


def joined_units(files: DataFrame, needed) -> DataFrame:
    """path, kind, no, line of clauses and of two and three joined lines of paragraphs; needed: what a unit must hold."""
    paragraphs = files.where("lines_") \
        .select("path", F.explode(F.split(F.regexp_replace("text_", COMMENT, ""), PARAGRAPH_END)).alias("p")).where(may_reach(F.lower("p"), needed))
    rows = F.split("p", r"\r?\n")
    clauses = F.split(F.regexp_replace("p", r"\s+", " "), CLAUSE_END)
    units = paragraphs.select("path", F.explode(F.concat(clauses, runs(rows, 2), runs(rows, 3))).alias("line")).select("path", F.lower("line").alias("line")).where(may_reach(F.col("line"), needed))
    return units.select("path", F.lit("joined").alias("kind"), F.xxhash64("line").alias("no"), "line")


def block_units(files: DataFrame) -> DataFrame:
    """path, kind, no, line of header blocks and whole files."""
    found = files.where("blocks_").select("path", F.lower("text_").alias("low_"), F.filter(F.split(F.regexp_replace("text_", COMMENT, ""), PARAGRAPH_END), lambda x: F.trim(x) != "").alias("ps"),
                        leading_comment(F.col("text_")).alias("head"))
    blocks = found.select("path", F.explode(F.concat(F.array("head"), *[runs(F.col("ps"), n) for n in (1, 2, 3, 4)])).alias("line")).select("path", F.lit("block").alias("kind"), F.lower("line").alias("line")) \
        .where(has_stem(F.col("line")))
    whole = found.select("path", F.lit("file").alias("kind"), F.col("low_").alias("line"))
    return blocks.unionByName(whole).select("path", "kind", F.xxhash64("line").alias("no"), "line")


def scored(held: DataFrame, templates, threshold: float, sublinear: bool = False) -> DataFrame:
    """path, kind, no, licence, score of the units in held (path, kind, no, terms) that reach the threshold with a template."""
    spark = held.sparkSession
    idf, other, units = weights(templates, sublinear)
    # One exchange of the units; terms, norms and products are summed where a unit lies.
    placed = held.repartition("path", "kind", "no")
    terms = placed.select("path", "kind", "no", F.explode("terms").alias("term")).groupBy("path", "kind", "no", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    known = many_rows(spark, sorted(idf.items()), "term string, idf double")
    terms = terms.join(known, "term", "left").select("path", "kind", "no", "term", (tf * F.coalesce("idf", F.lit(other))).alias("x"))
    norms = terms.groupBy("path", "kind", "no").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    sparse = many_rows(spark, [(t, k, templates[k][0], x) for k, unit in enumerate(units) for t, x in sorted(unit.items())],
                       "term string, template int, licence string, w double")
    dots = terms.join(sparse, "term").groupBy("path", "kind", "no", "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    both = dots.join(norms.withColumnsRenamed({"path": "path_", "kind": "kind_", "no": "no_"}),
                     F.col("path").eqNullSafe(F.col("path_")) & (F.col("kind") == F.col("kind_")) & (F.col("no") == F.col("no_")))
    # Rounded, so that ties do not hang on the order of sums.
    return both.select("path", "kind", "no", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)


def stated(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES, licence_name: str = LICENCE_NAME,
           notices=(*NOTICES, *FULL_TEXTS)) -> DataFrame:
    """path, licence, score, line_no of the whole text or else the best unit of each file that states a licence."""
    _, _, units = weights(templates)
    needed = needed_terms(units, threshold)
    # Texts with units are few and read three times; the others are searched once and read no more.
    texts = cut(candidates(files.select(F.col(path).alias("path"), F.col(text).alias("text_")), needed, licence_name), "licence-texts")
    lines = texts.where("lines_") \
        .select("path", F.lit("line").alias("kind"), F.posexplode_outer(F.split(F.lower("text_"), "\n")).alias("no", "line")) \
        .where(may_reach(F.col("line"), needed)).withColumn("no", F.col("no").cast("long"))
    held = lines.unionByName(joined_units(texts, needed)).select("path", "kind", "no", reaching_terms(F.col("line"), needed).alias("terms"))
    # Equal units of a path (repeated rows) are one.
    held = cut(held.distinct(), "licence-lines")
    blocks = cut(block_units(texts).select("path", "kind", "no", line_terms(F.col("line")).alias("terms")).distinct(), "licence-blocks")
    every = scored(held, templates, threshold).unionByName(scored(blocks, notices, threshold, sublinear=True))
    order = F.struct((F.col("kind") != "file").alias("part"), (-F.col("score")).alias("m"), "licence", (F.col("kind") != "line").alias("other"), "no", "kind")
    best = every.groupBy("path").agg(F.min(order).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.m")).alias("score"),
                       F.when(F.col("b.kind") == "line", F.col("b.no")).cast("int").alias("line_no"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(dir_: Column) -> Column:
    """A directory and all above it, down to the root ''."""
    parts = F.split(dir_, "/")
    return F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))


def inherited(files: DataFrame, licences: DataFrame, licence_name: str, path: str = "path") -> DataFrame:
    """dir_, dir_licence, from_dir for the distinct directories of files that have a licence at or above them.

    Directories are joined, not files: a directory with a third of all files is one row here.
    licences: path, licence, score as `stated` gives them.
    """
    own = licences.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(licence_name))
    own = own.groupBy(directory(F.col("path")).alias("from_dir")).agg(F.min(F.struct((-F.col("score")).alias("m"), "licence")).alias("b"))
    own = own.select("from_dir", F.col("b.licence").alias("dir_licence"))
    dirs = files.where(F.col(path).isNotNull()).select(directory(F.col(path)).alias("dir_")).distinct()
    up = dirs.select("dir_", F.explode(ancestors(F.col("dir_"))).alias("from_dir")).join(own, "from_dir")
    near = up.groupBy("dir_").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "dir_licence")).alias("b"))
    return near.select("dir_", F.col("b.dir_licence").alias("dir_licence"), F.col("b.from_dir").alias("from_dir"))


def scan(files: DataFrame, path: str = "path", text: str = "text", licence_name: str = LICENCE_NAME,
         threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of files: path, stated licence and score, inherited licence and the directory it comes from, licence in force.

    keep: further columns of files to return.
    """
    found = cut(stated(files, path, text, threshold, licence_name=licence_name), "stated-licences")
    above = cut(inherited(files, found, licence_name, path), "directory-licences")
    rows = files.select(F.col(path).alias("path"), *keep).withColumn("dir_", directory(F.col("path")))
    own = found.select(F.col("path").alias("path_"), "licence", "score")
    out = rows.join(own, rows["path"] == own["path_"], "left").join(above, "dir_", "left")
    return out.select(*keep, "path", F.col("licence").alias("stated"), "score",
                      F.when(F.col("licence").isNull(), F.col("dir_licence")).alias("inherited"),
                      F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"),
                      F.coalesce("licence", "dir_licence").alias("in_force"))


def corpus_files(docs: DataFrame) -> DataFrame:
    """The documents table as a tree of files: source / package of 1000 / module of 50 / file.

    The first file of a package lies at its top as LICENSE, that of every other module in the module.
    """
    k = F.col("doc_id")
    package = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.format_string("/p%05d", (k / 1000).cast("long")))
    module = F.concat(package, F.format_string("/m%02d", ((k % 1000) / 50).cast("long")))
    path = F.when(k % 1000 == 0, F.concat(package, F.lit("/LICENSE"))).when(k % 50 == 0, F.concat(module, F.lit("/LICENSE"))) \
        .otherwise(F.concat(module, F.format_string("/f%d.txt", k)))
    return docs.select("doc_id", path.alias("path"), "text")
