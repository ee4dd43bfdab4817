"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize, skew_join

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. ",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. "
    "You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>.",
)
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: The notices by which public licences ask to be named, by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
)
#: Their titles; a GNU title that names no version stands for any of them.
TITLES = (
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License"),
    ("GPL-1.0-or-later", _GPL), ("GPL-3.0", f"{_GPL} Version 3, 29 June 2007"), ("GPL-2.0", f"{_GPL} Version 2, June 1991"),
    ("LGPL-2.0-or-later", _LGPL), ("LGPL-3.0", f"{_LGPL} Version 3, 29 June 2007"), ("LGPL-2.1", f"{_LGPL} Version 2.1, February 1999"),
    ("AGPL-3.0", _AGPL), ("AGPL-3.0", f"{_AGPL} Version 3, 19 November 2007"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"), ("CC0-1.0", "CC0 1.0 Universal"),
)
#: Headers of source files, whole and, where they have paragraphs, by the one that names the licence.
HEADERS = (
    ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    *((name, part) for name, words, version in (("GPL-2.0", _GPL, "2"), ("GPL-3.0", _GPL, "3"), ("LGPL-2.1", _LGPL, "2.1"), ("LGPL-3.0", _LGPL, "3"), ("AGPL-3.0", _AGPL, "3")) for part in (_GNU[0].format(words, version), "".join(_GNU).format(words, version))),
)
#: Identifiers as tags have them.
TAGS = tuple(
    (name, f"SPDX-License-Identifier: {tag}")
    for name in ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "MPL-1.1", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
    for tag in ((name, f"{name}-only", f"{name}-or-later") if "GPL" in name else (name,))
)


def _bodies() -> tuple:
    """The licence texts in ``licenses``, read by the driver. That of the AGPL is the GPL's with its own name and network clause."""
    texts = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    network = "Remote Network Interaction. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version from a network server at no charge."
    texts["AGPL-3.0"] = f"{re.sub('GNU General Public License', _AGPL, texts['GPL-3.0'], flags=re.I)}\n{network}"
    return tuple(texts.items())


TEMPLATES = NOTICES + TITLES + HEADERS + TAGS + _bodies()
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain|released under|governed by"
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
LEAST = 0.75
#: A file of this name speaks for its directory.
NAMED = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)(?:\.[a-z]+)?$"
#: Lines that a comment mark begins, and where blocks end once these stand between two \x01: at an empty line and where comments begin or end.
COMMENT = r"(?md)^([ \t]*(?://|#|/?\*|--|;|%|<!--).*)$"
BETWEEN = r"\x01\n(?!\x01)|(?<!\x01)\n(?=\x01)|\n[ \t\r]*(?=\n)"
#: What is compared: a licence file as a whole, a block of lines, a line. The earlier kind decides.
FILE, BLOCK, LINE = range(3)


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})"), 1)


def units(path: Column, text: Column) -> Column:
    """(kind, unit) of all that is compared of a file: each is one vector."""
    cue = lambda x: x.rlike(CUE)
    several = lambda x: F.rtrim(x).contains("\n")
    kind = lambda k, found: F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("unit")))
    named = F.coalesce(path.rlike(NAMED), F.lit(False))
    lines = F.filter(F.split(text, r"\r?\n"), cue)
    marked = F.regexp_replace(F.translate(text, "\x01", " "), COMMENT, "\x01$1\x01")
    blocks = F.when(cue(text), F.filter(F.transform(F.split(marked, BETWEEN), lambda x: F.trim(F.translate(x, "\x01", ""))), lambda x: cue(x) & several(x) & ~(named & (x == F.trim(text))))).otherwise(F.array().cast("array<string>"))
    whole = F.when(named & several(text), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(kind(FILE, whole), kind(BLOCK, blocks), kind(LINE, lines))


def directory(path: Column) -> Column:
    """The folder of a path; the empty text at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, license, score, origin, from_dir) for each row of ``files``.

    Compared with the templates are each line of the whole text that has a cue, each block of
    several lines (a comment, or what stands between empty lines) that has such a line, and the
    whole text of files named LICENSE, COPYING or NOTICE: term counts weighted by idf over all
    that is compared in the corpus, cosine, the best one at ``least`` or above. Equal units are
    compared once, however many files repeat them. A file's own licence is that of its whole,
    else of its best block, else of its best line (ties by name); origin is ``header``. A file
    without one takes the licence that most files named LICENSE, COPYING or NOTICE in the nearest
    directory at or above it show (ties by name); origin is ``directory``. Else the licence is
    null and origin ``none``.
    Only the template vocabulary is broadcast, whose size is fixed. Null and empty texts have no
    licence of their own; a null path has no directory. Rows that repeat an id are one file.
    """
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("id", "path", F.explode_outer(units(F.col("path"), F.col("text"))).alias("u")).select("id", "path", "u.kind", "u.unit")
    rows = rows.withColumn("line", F.unhex(F.md5("unit")))
    rows = materialize(rows.distinct(), "licence-units")  # ids, paths and units; the texts are read once
    shown = rows.where("line IS NOT NULL")
    # grouped by the key alone: the terms below are counted where their unit lies
    lines = shown.groupBy("line").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("times"))
    counted = lines.select("line", "times", F.explode(terms(F.col("unit"))).alias("term")).groupBy("line", "times", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = rows.drop("unit")

    template = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "no int, license string, notice string")
    t_terms = template.select("no", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy("no", "license", "term").agg(F.count(F.lit(1)).alias("t_tf"))
    vocabulary = F.broadcast(t_terms.select("term").distinct())
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("total"))
    df = counted.join(vocabulary, "term").groupBy("term").agg(F.sum("times").alias("df"))
    known = vocabulary.join(df, "term", "left").crossJoin(total).select("term", idf(F.coalesce("df", F.lit(0)), F.col("total")).alias("idf"))
    known = F.broadcast(known)
    rare = idf(F.lit(0), F.col("total"))

    t_weights = t_terms.join(known, "term").withColumn("w", F.col("t_tf") * F.col("idf"))
    t_norms = t_weights.groupBy("no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    t_weights = F.broadcast(t_weights.join(t_norms, "no").select("no", "license", "term", "w", "t_norm"))
    weighted = counted.join(known, "term", "left").crossJoin(F.broadcast(total)).withColumn("lw", F.col("tf") * F.coalesce("idf", rare))
    norms = weighted.groupBy("line").agg(F.sqrt(F.sum(F.col("lw") * F.col("lw"))).alias("norm"))
    dots = weighted.join(t_weights, "term").groupBy("line", "no", "license", "t_norm").agg(F.sum(F.col("lw") * F.col("w")).alias("dot"))
    scores = dots.join(norms, "line").select("line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score")).where(F.col("score") >= least)
    best = scores.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))

    ranked = F.when(F.col("best").isNotNull(), F.struct("kind", "best.s", "best.license"))
    own = skew_join(rows, best, ["line"], F.col("id")).groupBy("id", "path").agg(F.min(ranked).alias("best"))
    own = materialize(own.select("id", "path", F.col("best.license").alias("own"), (-F.col("best.s")).alias("score")), "licence-own")

    folder = directory(F.col("path"))
    votes = own.where(F.col("own").isNotNull() & F.col("path").rlike(NAMED)).groupBy(folder.alias("dir"), "own").agg(F.count(F.lit(1)).alias("n"))
    spoken = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("v")).select("dir", F.col("v.own").alias("given"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.when(folder == "", F.lit(0)).otherwise(F.size(parts))), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("dir"), k.alias("depth")))
    bare = own.where("own IS NULL AND path IS NOT NULL").select("id", "path", F.explode(above).alias("a")).select("id", "path", "a.dir", "a.depth")
    heirs = skew_join(bare, spoken, ["dir"], F.col("id"), "inner").groupBy("id", "path").agg(F.max(F.struct("depth", "dir", "given")).alias("h"))
    out = own.join(heirs, ["id", "path"], "left")
    origin = F.when(F.col("own").isNotNull(), "header").when(F.col("h").isNotNull(), "directory").otherwise("none")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("own", "h.given").alias("license"), "score", origin.alias("origin"), F.when(F.col("own").isNull(), F.col("h.dir")).alias("from_dir"))


def idf(df: Column, total: Column) -> Column:
    return F.log((total + 1) / (df + 1)) + 1


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / shelf of ids; one with a notice is its folder's LICENSE."""
    notice = F.coalesce("text", F.lit("")).rlike(CUE)
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 500).cast("string"))
    name = F.when(notice, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", "path", "text")
