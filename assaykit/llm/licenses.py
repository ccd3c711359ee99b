"""Licence scans: units of text against licence templates by Dice coefficient over word bigrams.

A document's lines, its blocks between blank lines and the whole of it are units. A unit is lower-cased, anything
but letters and digits becomes one space, and its distinct word bigrams are compared with each template's: Dice =
2 * shared / (unit's + template's). A unit is of the template with the highest value, at ``threshold`` or more (ties: by
licence, then by template text).

What no matching unit covers is searched for notices among other words: windows of as many words as a template has slide over it, also across
lines and blank lines, where they hold one of the template's pivots. Of windows that overlap the best one is a unit; ``NOTICES`` are templates for windows only.
The SQL knows lines, blocks and whole texts; the two are equal where all notices stand on lines or in blocks of their own.

Two bounds prune, neither loses a match. By size: Dice >= t needs a unit of t / (2 - t) to (2 - t) / t times the template's bigrams, so
units meet templates by an equality join on their number of bigrams. By content: of a template's n bigrams a match
holds all but n - ceil(n * t / (2 - t)), so it holds at least one of any one more than that; a document without any of those is left at once.

Everything is DataFrame functions. Only the template tables, whose size is fixed here, are broadcast; documents without any of those bigrams aren't shuffled, the few others
are written once and read twice.

Odd input: null texts and texts of fewer than two words have no bigram and match nothing. Units of one document that normalise to the
same text count once, and so do rows with the same doc_id (null ids are one document). An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import written

THRESHOLD = 0.8

# Licences and the wording of their notices, as widely published.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
)
# Standard notices looked for in windows only, beside all of TEMPLATES.
NOTICES: tuple[tuple[str, str], ...] = (
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)
# Words too common to tell licences from prose.
_COMMON = frozenset("a an and any are as at be by for from in is it may not of on or that the this to under was will with you your".split())


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_range(n: int, threshold: float) -> range:
    """The numbers of bigrams a unit may have to reach the threshold with a template of n."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return range(max(1, int(low - 1e-9) + (low - int(low) > 1e-9)), int(high + 1e-9) + 1)


def pivots(bigrams: list[str], threshold: float) -> list[str]:
    """Bigrams of which every match of the template holds at least one, the least common ones by their words."""
    n = len(bigrams)
    least = n * threshold / (2 - threshold)
    may_lack = n - (int(least - 1e-9) + 1)
    rare = sorted(bigrams, key=lambda b: (sum(w in _COMMON for w in b.split()), -len(b), b))
    return rare[: may_lack + 1]


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(norm: Column) -> Column:
    words = F.split(norm, " ")
    return F.array_distinct(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def _template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    rows = [(name, text, grams, n) for name, text in templates for grams in [template_bigrams(text)] for n in size_range(len(grams), threshold)]
    return spark.createDataFrame(rows, "license string, template string, t_bigrams array<string>, n_bigrams int")


def _windows(rest: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """doc_id, license, value, norm of the windows that match in ``rest`` (doc_id, words). A window has as many words as its
    template and holds one of its pivots. Of windows of a row that overlap the best stands: by value, then the longer, then by licence and place."""
    table = []
    for license, text in templates:
        grams = template_bigrams(text)
        size = len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())
        table += [(pivot, license, grams, size) for pivot in pivots(grams, threshold)]
    wanted = F.broadcast(rest.sparkSession.createDataFrame(table, "pivot string, license string, t_bigrams array<string>, size int"))
    rest = rest.withColumn("row_", F.monotonically_increasing_id())
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    hits = rest.select("row_", "doc_id", "words", F.posexplode(pairs).alias("p", "pivot")).join(wanted, "pivot")
    # places where such a window may begin, from 0, so that it holds the pivot and ends within the words
    first, last = F.greatest(F.lit(0), F.col("p") + 2 - F.col("size")), F.least(F.col("p"), F.greatest(F.lit(0), F.size("words") - F.col("size")))
    begins = hits.filter(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    window = F.slice("words", F.col("at") + 1, F.col("size"))
    cut = begins.withColumn("norm", F.array_join(window, " ")).withColumn("bigrams", F.array_compact(_bigrams(F.col("norm"))))
    value = 2.0 * F.size(F.array_intersect("bigrams", "t_bigrams")) / (F.size("bigrams") + F.size("t_bigrams"))
    found = cut.withColumn("value", value).filter(F.col("value") >= threshold)
    one = F.struct((-F.col("value")).alias("v"), (-F.col("size")).alias("s"), "license", "at", "norm")
    ranked = F.array_sort(F.collect_set(one))
    per_row = found.groupBy("row_", F.col("doc_id")).agg(ranked.alias("ranked"))
    apart = lambda x, y: (x["at"] >= y["at"] - y["s"]) | (y["at"] >= x["at"] - x["s"])
    nothing = F.slice("ranked", 1, 0)
    stands = F.aggregate("ranked", nothing, lambda kept, x: F.when(F.forall(kept, lambda y: apart(x, y)), F.concat(kept, F.array(x))).otherwise(kept))
    return per_row.select("doc_id", F.explode(stands).alias("w")).select("doc_id", "w.license", (-F.col("w.v")).alias("value"), "w.norm")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """doc_id, license, dice (the best unit's, 6 decimals), n_units of every document (doc_id, text) and licence found in it."""
    spark = docs.sparkSession
    markers = sorted({b for _, text in templates + notices for b in pivots(template_bigrams(text), threshold)})
    has_marker = lambda bigrams: F.arrays_overlap(bigrams, F.array(*map(F.lit, markers)))
    # zip_with pads the shorter array with null: the last word's pair is null, and no marker
    rows = written(docs.select("doc_id", "text").filter(has_marker(_bigrams(_norm(F.col("text"))))), "license-rows")
    lines, parts = F.split("text", "\n"), F.split("text", "\n\n+")
    units = rows.select("doc_id", F.explode(F.array_distinct(F.concat(lines, parts, F.array("text")))).alias("unit"))
    units = units.select("doc_id", _norm(F.col("unit")).alias("norm")).filter(F.instr("norm", " ") > 0)
    units = units.withColumn("bigrams", F.array_compact(_bigrams(F.col("norm")))).withColumn("n_bigrams", F.size("bigrams"))
    both = units.join(F.broadcast(_template_table(spark, templates, threshold)), "n_bigrams")
    shared = F.size(F.array_intersect("bigrams", "t_bigrams"))
    scored = both.select("doc_id", "norm", "license", "template", (2.0 * shared / (F.col("n_bigrams") + F.size("t_bigrams"))).alias("value")).filter(F.col("value") >= threshold)
    # the best template of each unit: highest value, then first by name
    best = scored.groupBy("doc_id", "norm").agg(F.min(F.struct((-F.col("value")).alias("v"), "license", "template")).alias("b"))
    best = best.select("doc_id", "norm", F.col("b.license").alias("license"), (-F.col("b.v")).alias("value"))
    # windows are taken of what no matching unit covers: its lines become a word that no template has
    matched = best.groupBy(F.col("doc_id").alias("own_id")).agg(F.collect_set("norm").alias("norms"))
    rest = rows.join(matched, F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    taken = lambda unit: F.coalesce(F.array_contains("norms", _norm(unit)), F.lit(False))
    gone = F.lit("#")
    blocks = F.transform(F.split("text", "\n\n+"), lambda x: F.when(taken(x), gone).otherwise(x))
    kept = F.transform(F.split(F.array_join(blocks, "\n"), "\n"), lambda x: F.when(taken(x) | (x == gone), gone).otherwise(_norm(x)))
    norm = F.when(taken(F.col("text")), F.lit("")).otherwise(F.trim(F.regexp_replace(F.array_join(kept, " "), " +", " ")))
    rest = rest.withColumn("norm", norm).filter(has_marker(_bigrams(F.col("norm")))).select("doc_id", F.split("norm", " ").alias("words"))
    found = _windows(rest, templates + notices, threshold).groupBy("doc_id", "norm").agg(F.min(F.struct((-F.col("value")).alias("v"), "license")).alias("b"))
    every = best.unionByName(found.select("doc_id", "norm", F.col("b.license").alias("license"), (-F.col("b.v")).alias("value")))
    return every.groupBy("doc_id", "license").agg(F.round(F.max("value"), 6).alias("dice"), F.count("*").alias("n_units"))


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same by comparing every unit with every template."""
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in templates)
    norm = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(string_split({0}, ' '))), lambda i: string_split({0}, ' ')[i] || ' ' || string_split({0}, ' ')[i + 1]))"
    return f"""
WITH t AS (SELECT license, template, {grams.format("n")} AS tb FROM (SELECT license, template, {norm.format("template")} AS n FROM (VALUES {quoted}) v(license, template))),
u AS (SELECT DISTINCT doc_id, {norm.format("unit")} AS norm
      FROM (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n\\n+'), [text])) AS unit FROM documents)),
b AS (SELECT doc_id, norm, {grams.format("norm")} AS ub FROM u WHERE contains(norm, ' ')),
s AS (SELECT doc_id, norm, license, template, 2.0::DOUBLE * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS value FROM b, t
      WHERE len(ub) BETWEEN len(tb) * {threshold} / {2 - threshold} - 1 AND len(tb) * {2 - threshold} / {threshold} + 1),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY value DESC, license, template) AS k FROM s WHERE value >= {threshold})
SELECT doc_id, license, round(max(value), 6) AS dice, count(*) AS n_units FROM k WHERE k = 1 GROUP BY doc_id, license
"""
