"""Licence detection by TF-IDF cosine and inheritance along directories, in DataFrame functions only (operator 9).

* A licence has several templates: SPDX lines, short notices, headers, and the blocks of its full text.
* Units are the lines of a text, their sentences, and its blocks between lines without words, that hold a term which
  templates have and other texts are not full of.
* A unit's terms are its lower-cased words and numbers.  Inverse document frequencies come from all units of all
  texts together with the templates.  A template's term weighs at least what it weighs among the templates alone, so that
  licence words stay telling where notices are common, and a term that no template has at most ``OTHER``, so that a rare name
  in a notice does not hide it.  Only terms that a template has are kept one by one, the others count in the unit's norm, so
  the vectors that are shuffled are sparse.
* A unit's licences are those with a template of cosine ``LEAST`` or more whose naming term it holds; a text's is the
  best of its units', of equal ones the one with more templates met.  A bare reservation of rights counts only in texts
  where no grant is found.
* A file is a licence file if its name says so or if one licence's units hold ``FILE_SHARE`` of its words.  A file without a licence of
  its own takes the one of the nearest directory above it that has a licence file, found by joining each directory's
  ancestors to the directories that declare one.

Terms restrict what is a notice, not which texts are read: every text is searched whole.

Defined results: null text is the empty text without units; a null path is the root; ties go to the template first
in the alphabet; of several licence files in a directory the highest score, then the first path wins; repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.llm.common import materialize, row_key, text_col

# Notices of common licences, each with its name in SPDX and the terms without which it is not meant.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {0} {1} International License"
#: Licence, the name that SPDX lines and short notices give it, its long name.
NAMED = [
    ("AGPL-3.0", "AGPL-3.0-or-later", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0-1.0", "Creative Commons Zero 1.0 Universal, CC0 Public Domain Dedication"),
    ("GPL-2.0", "GPL-2.0-or-later", "GNU General Public License, version 2"),
    ("GPL-3.0", "GPL-3.0-or-later", "GNU General Public License, version 3"),
    ("ISC", "ISC", "ISC License"),
    ("LGPL-2.1", "LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "LGPL-3.0-or-later", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT", "MIT License"),
    ("MPL-2.0", "MPL-2.0", "Mozilla Public License, v. 2.0"),
]
#: Terms of which one form or the other must stand in a unit; a licence is not named without.
MUST = {
    "AGPL-3.0": "agpl|affero", "Apache-2.0": "apache", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "CC-BY-4.0": "cc|creative", "CC-BY-NC-4.0": "nc|noncommercial", "CC-BY-NC-ND-4.0": "nd|noderivatives", "CC-BY-NC-SA-4.0": "sa|sharealike",
    "CC-BY-ND-4.0": "nd|noderivatives", "CC-BY-SA-4.0": "sa|sharealike", "CC0-1.0": "cc0|zero", "GPL-2.0": "gpl|gnu", "GPL-3.0": "gpl|gnu", "ISC": "isc", "LGPL-2.1": "lgpl|lesser", "LGPL-3.0": "lgpl|lesser", "MIT": "mit", "MPL-2.0": "mpl|mozilla",
}
#: Headers and full texts by blocks: licence, terms that must stand in the unit, notice.
TEXTS = [
    ("AGPL-3.0", "affero", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "apache", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "redistribution", _BSD),
    ("BSD-3-Clause", "redistribution", _BSD),
    ("BSD-3-Clause", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("BSD-3-Clause", "neither", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "neither", _BSD + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "cc|creative", _CC.format("Attribution", "4.0") + ", CC BY 4.0"),
    ("CC-BY-NC-4.0", "nc|noncommercial", "Licensed under CC BY-NC 4.0"),
    ("GPL-2.0", "gnu", _GNU.format("General Public License", "2")),
    ("GPL-2.0", "gnu", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "gnu", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "gnu", _GNU.format("General Public License", "3")),
    ("GPL-3.0", "gnu", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "gnu", "it under the terms of the GNU General Public License as published by"),
    ("GPL-3.0", "gnu", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "lesser", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "lesser", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "lesser", _GNU.format("Lesser General Public License", "3")),
    ("LGPL-3.0", "lesser", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "lesser", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "affero", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MIT", "mit", "Released under the MIT License"),
    ("MIT", "permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "permission", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "permission", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "reproduced", "Copyright All rights reserved. No part may be reproduced without permission"),
]
#: Reservations, which stand beside many grants: a text's licence only where no grant is found.
RESERVED = [("Proprietary", "reserved", "All rights reserved"), ("Proprietary", "reserved", "Copyright (c) All rights reserved")]
#: Disclaimers of full texts and headers, which stand beside their grants: like reservations they decide only where no grant is found.
DISCLAIMERS = [
    ("Apache-2.0", "warranties", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "merchantability", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("GPL-3.0", "gnu", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "disclaims", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("MIT", "noninfringement", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
]
TEMPLATES = [(x, 0, must, notice) for x, must, notice in TEXTS]
TEMPLATES += [(x, 0, MUST[x], f"{lead} {name}") for x, spdx, long in NAMED for lead, name in (("SPDX-License-Identifier:", spdx), ("SPDX-License-Identifier:", x), ("Licensed under", x), ("License:", x), ("This work is licensed under the", long), ("", long))]
TEMPLATES += [(x, 1, must, notice) for x, must, notice in RESERVED + DISCLAIMERS]
#: Words of templates that other texts are full of: a unit that has only these is no notice.
COMMON = set("a above all and any are as at be by can c code conditions copies copy derived do except fee file files following for form forms free from general holder if in is it its january june february november later list may met name names no not of on one option or other part person persons portions products program prior provided public published publish purpose rights sell shall source subject terms that the this to under use used version was whom with without work you v http https www org 0 1 2 3 4 19 29 1991 1999 2004 2007 mit materials either neither nor obtain obtaining one appear including included deal merge must party retain reproduce specific written sa nd nc by cc0 zero international universal domain isc but details even express fitness governing holders hope implied kind language law limitations limited more particular purpose regard required see specific unless useful will writing agreed applicable an author contributors disclaimed basis distributed permissions".split())
LEAST, FILE_SHARE = 0.6, 0.5
#: The most that a term weighs which no template has.
OTHER = 2.0
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def terms(text: Column) -> Column:
    """Lower-cased words and numbers, with licence spelt as in templates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "licenc", "licens"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words(notice: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", notice.lower())


#: The terms of templates by which units are found.
ANCHORS = sorted({w for *_, notice in TEMPLATES for w in _words(notice)} - COMMON)
_ANCHORED = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(sorted({w.replace("licens", "licen[sc]") for w in ANCHORS}, reverse=True)) + r")(?![\p{L}\p{N}])"


def _unit_texts(text: Column) -> Column:
    """Lines, their sentences and blocks with an anchor; equal ones count once."""
    with_anchor = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike(_ANCHORED))
    lines, blocks = with_anchor(F.split(text, r"\r?\n")), F.split(text, r"\r?\n(?:[^\p{L}\p{N}\n]*+\n)++")
    sentences = F.flatten(F.transform(lines, lambda p: F.split(p, r"(?<=[.;!?])\s+")))
    return F.when(text.rlike(_ANCHORED), F.array_distinct(F.concat(lines, with_anchor(sentences), with_anchor(blocks)))).otherwise(F.array().cast("array<string>"))


def detect(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files (key, path, text) to a written table key, path, own (license, score) or null, licence_file."""
    read = files.withColumn("units", _unit_texts(F.col("text")))
    words = F.size(terms(F.col("text")))
    units = materialize(spark, read.select("key", "path", F.when(F.size("units") > 0, words).alias("words"), F.transform("units", lambda u: terms(u)).alias("units")), "licence-units")
    listed = [(i, *t) for i, t in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(listed, "template int, license string, rank int, must string, notice string").select("template", "license", "rank", F.split("must", r"\|").alias("must"), terms(F.col("notice")).alias("terms"))

    some = units.where(F.size("units") > 0).dropDuplicates(["key"])
    each = some.select("key", "words", F.posexplode("units").alias("unit", "terms"))
    bag = each.select("key", "unit", F.explode("terms").alias("term")).groupBy("key", "unit", "term").agg(F.count("*").alias("tf"))
    bag = materialize(spark, bag, "licence-terms")
    stated = templates.select("template", "license", "rank", "must", F.explode("terms").alias("term")).groupBy("template", "license", "rank", "must", "term").agg(F.count("*").alias("tf"))
    total = bag.select("key", "unit").distinct().count() + len(TEMPLATES)
    frequency = bag.select("term").unionByName(stated.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    among = stated.groupBy("term").agg((F.log(F.lit(1.0 + len(TEMPLATES)) / (1 + F.count("*"))) + 1).alias("among"))
    whole = (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")
    every = frequency.select("term", whole)
    among = among.join(every, "term").select("term", F.greatest("idf", "among").alias("idf"))
    # Other terms weigh OTHER unless they stand in a share of the units; that many terms are no more than a few times a unit's mean.
    frequent = every.join(F.broadcast(among.select("term")), "term", "left_anti").where(F.col("idf") < OTHER)
    idf = materialize(spark, among.unionByName(frequent), "licence-weights")
    weighed = bag.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(OTHER)))
    norms = weighed.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    shapes = stated.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = shapes.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    shapes = shapes.join(lengths, "template").select("template", "license", "rank", "term", F.array_contains("must", F.col("term")).alias("must"), (F.col("w") / F.col("norm")).alias("t"))
    shapes = shapes.groupBy("term").agg(F.collect_list(F.struct("template", "license", "rank", "must", "t")).alias("shapes"))
    met = weighed.join(F.broadcast(shapes), "term").select("key", "unit", "w", F.explode("shapes").alias("s"))  # the templates' terms: a fixed table
    dots = met.groupBy("key", "unit", "s.template", "s.license", "s.rank").agg(F.sum(F.col("w") * F.col("s.t")).alias("dot"), F.max("s.must").alias("meant")).where("meant")
    scored = dots.join(norms, ["key", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= LEAST)
    best = scored.groupBy("key", "unit", "license", "rank").agg(F.max("score").alias("score"), F.collect_set("template").alias("met"))
    sized = best.join(each.select("key", "unit", "words", F.size("terms").alias("n")), ["key", "unit"])
    by_license = sized.groupBy("key", "rank", "license").agg(F.max("score").alias("score"), F.flatten(F.collect_set("met")).alias("met"), F.max("n").alias("n"))
    order = F.struct("rank", (-F.col("score")).alias("s"), (-F.size(F.array_distinct("met"))).alias("met"), "license", (-F.col("n")).alias("n"))
    chosen = by_license.groupBy("key").agg(F.min(order).alias("b"))
    held = sized.groupBy("key").agg(F.max(F.col("n") / F.col("words")).alias("share"), F.count_distinct("unit").alias("notices"))
    own = chosen.join(held, "key").select("key", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score"), "share", "notices")
    is_file = F.col("own").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("share") >= FILE_SHARE))
    return materialize(spark, units.select("key", "path").join(own, "key", "left").withColumn("licence_file", F.coalesce(is_file, F.lit(False))), "licences")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(spark: SparkSession, detected: DataFrame) -> DataFrame:
    """Add ``license``, ``score`` and ``from_dir`` (where an inherited licence is declared) to detected files."""
    placed = detected.withColumn("dir", directory(F.col("path")))
    order = F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own").alias("license"))
    declared = placed.where("licence_file").groupBy("dir").agg(F.min(order).alias("d")).select(F.col("dir").alias("above"), F.col("d.license").alias("dir_license"), (-F.col("d.s")).alias("dir_score"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    dirs = placed.select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("a")).select("dir", "a.depth", "a.above")
    nearest = dirs.join(declared, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license", "dir_score")).alias("n"))
    nearest = materialize(spark, nearest, "licence-dirs")  # read back, so that a directory with very many files can be split in the join
    joined = placed.join(nearest, "dir", "left")
    return joined.withColumn("license", F.coalesce("own", "n.dir_license")).withColumn("score", F.coalesce("own_score", "n.dir_score")).withColumn("from_dir", F.when(F.col("own").isNull(), F.col("n.above"))).drop("n", "dir")


def scan(spark: SparkSession, docs: DataFrame, path: Column, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, path, own licence, its score, and the effective licence with where it comes from."""
    files = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), text_col(docs, text).alias("text"))
    keyed = files.select(row_key(F.col("doc_id"), F.concat_ws("\n", "path", "text")).alias("key"), "path", "text")
    out = inherit(spark, detect(spark, keyed))
    return out.select(F.substring_index("key", ":", 1).try_cast("long").alias("doc_id"), "path", "own", "own_score", F.coalesce("notices", F.lit(0)).cast("long").alias("notices"), "licence_file", "license", "score", "from_dir")
