"""License scans with DataFrame functions alone: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# SPDX identifiers and wordings of public license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission of the copyright holder."),
    ("proprietary", "All rights reserved."),
)

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Relatives of the notices above, told apart by DECIDING, and whole texts; the long GNU and Apache texts by their titles.
RELATIVES = (
    *((f"{name}-{v}", f"This work is licensed under the GNU {title} License, version {v.removesuffix('.0')}.") for name, title, v in (("GPL", "General Public", "2.0"), ("LGPL", "Lesser General Public", "2.1"), ("LGPL", "Lesser General Public", "3.0"), ("AGPL", "Affero General Public", "3.0"))),
    *((f"{name}-{v}", f"This work is licensed under the GNU {title} License, version {v}.") for name, title, v in (("GPL", "General Public", "2.0"), ("GPL", "General Public", "3.0"), ("LGPL", "Lesser General Public", "3.0"), ("AGPL", "Affero General Public", "3.0"))),
    *((f"{name}-{v}-or-later", _GNU.format(title, v.removesuffix(".0"))) for name, title, v in (("GPL", "General Public", "2.0"), ("LGPL", "Lesser General Public", "2.1"), ("LGPL", "Lesser General Public", "3.0"), ("AGPL", "Affero General Public", "3.0"))),
    *((f"{name}-{v}", f"GNU {title} LICENSE Version {v.removesuffix('.0')}, {date}") for name, title, v, date in (("GPL", "GENERAL PUBLIC", "2.0", "June 1991"), ("GPL", "GENERAL PUBLIC", "3.0", "29 June 2007"), ("LGPL", "LESSER GENERAL PUBLIC", "2.1", "February 1999"), ("LGPL", "LESSER GENERAL PUBLIC", "3.0", "29 June 2007"), ("AGPL", "AFFERO GENERAL PUBLIC", "3.0", "19 November 2007"))),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons Attribution-{t} 4.0 International License.") for k, t in (("BY-NC", "NonCommercial"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives"))),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", TEMPLATES[1][1] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
#: Three-word phrases that tell a license from its relatives: a window must hold all shingles of the template that are among its license's.
DECIDING = {
    "Apache-2.0": ("license version 2.0",), "Apache-1.1": ("license version 1.1",),
    "GPL-2.0": ("license version 2", "license version 2.0", "gnu general public"), "GPL-3.0": ("license version 3", "license version 3.0", "gnu general public"),
    "LGPL-2.1": ("license version 2.1", "gnu lesser general"), "LGPL-3.0": ("license version 3", "license version 3.0", "gnu lesser general"), "AGPL-3.0": ("license version 3", "license version 3.0", "gnu affero general"),
    "GPL-2.0-or-later": ("either version 2", "version 2 of", "any later version", "gnu general public"), "GPL-3.0-or-later": ("either version 3", "version 3 of", "any later version", "gnu general public"),
    "LGPL-2.1-or-later": ("either version 2.1", "version 2.1 of", "any later version", "gnu lesser general"), "LGPL-3.0-or-later": ("either version 3", "version 3 of", "any later version", "gnu lesser general"),
    "AGPL-3.0-or-later": ("either version 3", "version 3 of", "any later version", "gnu affero general"),
    "MPL-2.0": ("license v 2.0",), "BSD-2-Clause": ("the distribution this", "distribution this software"), "BSD-3-Clause": ("to endorse or", "endorse or promote"),
    "CC-BY-4.0": ("commons attribution 4.0", "cc by 4.0"), "CC-BY-SA-4.0": ("commons attribution sharealike", "attribution sharealike 4.0", "by sa 4.0", "cc by sa"),
    "CC-BY-NC-4.0": ("attribution noncommercial 4.0", "by nc 4.0"), "CC-BY-ND-4.0": ("commons attribution noderivatives", "attribution noderivatives 4.0", "cc by nd"),
    "CC-BY-NC-SA-4.0": ("noncommercial sharealike 4.0", "nc sa 4.0"), "CC-BY-NC-ND-4.0": ("noncommercial noderivatives 4.0", "nc nd 4.0"),
}

SHINGLE = 3
#: Least share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Largest probability that a window which holds a template shares no band with it.
MISS = 1e-6
#: Window lengths in shingles; each starts half a window after the one before. A template is sought in windows of at least twice its
#: shingles; longer templates double the last length.
WINDOWS = (4, 16, 32, 64, 128)
_PRIME = (1 << 31) - 1


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner dots, hyphens and underscores dropped at the ends."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])"), lambda w: F.length(w) > 0)


def shingle_texts(words: Column, k: int = SHINGLE) -> Column:
    """The distinct k-word shingles themselves."""
    some = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def shingles_of(words: Column, k: int = SHINGLE) -> Column:
    """31-bit hashes of the k-word shingles, in order; none with fewer words. words is evaluated once, each word hashed once."""
    one = lambda h, i: F.pmod(F.xxhash64(*[F.element_at(h, i + j) for j in range(k)]), F.lit(_PRIME))
    row = lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: one(h, i))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), row)[0]


def bands_for(window: int, template: int) -> int:
    """Bands of one row each such that a window that holds the template is missed with probability MISS at most.

    Of two sets of w and t shingles that share a part c of the second, the likeness is at least c t / (w + (1 - c) t).
    """
    least = CONTAINMENT * template / (window + (1 - CONTAINMENT) * template)
    return math.ceil(math.log(MISS) / math.log(1 - least))


def band_keys(shingles: Column, bands: int) -> Column:
    """(band, minimum) of each band's own hash over a set of shingles."""
    key = lambda i: F.array_min(F.transform(shingles, lambda x: (x * ((i * 2_654_435_761 + 1_013_904_223) % _PRIME + 1) + i * 97_531) % _PRIME))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bands - 1).cast("bigint")), lambda i: F.struct(i.alias("band"), key(i).alias("key")))


def template_table(spark: SparkSession, templates=TEMPLATES + RELATIVES) -> DataFrame:
    """(template, license, shingles, texts, must, window): a row per template, hashes and texts of its shingles, its deciding shingles, its window the shortest of at least twice its shingles."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("shingles", F.array_distinct(shingles_of(F.col("words"))))
    phrases = spark.createDataFrame([(name, p) for name, ps in DECIDING.items() for p in ps], "license string, phrase string")
    phrases = phrases.select("license", shingle_texts(words_of(F.col("phrase")))[0].alias("p")).groupBy("license").agg(F.collect_list("p").alias("phrases"))
    rows = rows.withColumn("texts", shingle_texts(F.col("words")))
    rows = rows.join(F.broadcast(phrases), "license", "left").withColumn("must", F.array_intersect("texts", F.coalesce("phrases", F.array().cast("array<string>"))))
    fits = [F.when(F.size("shingles") * 2 <= w, F.lit(w)) for w in WINDOWS]
    longer = F.lit(WINDOWS[-1]) * F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles") * 2 / WINDOWS[-1])))
    return rows.select("template", "license", "shingles", "texts", "must", F.coalesce(*fits, longer.cast("int")).alias("window")).where(F.size("shingles") > 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES + RELATIVES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, template, containment, start_word, n_windows: a row per row of docs and template that it holds.

    A template is held if a window of the whole text that shares a band with it holds CONTAINMENT of its distinct shingles and all its deciding ones; containment and
    start_word are of the best window, the first on ties. Null texts, texts of fewer words than a shingle and an empty
    table give no rows; rows that repeat an id share one result. The templates are a fixed list, so they may be
    broadcast; the documents are never paired with one another.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    fixed = known.collect()
    sizes = sorted({r["window"] for r in fixed})
    least = {w: min(len(r["shingles"]) for r in fixed if r["window"] == w) for w in sizes}
    sought = {w: sorted({x for r in fixed if r["window"] == w for x in r["shingles"]}) for w in sizes}
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])

    # A band of one row is shared only through a shared shingle: texts and windows without any of a template need no bands.
    read = docs.select(F.col(id_col).cast("long").alias("id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    read = read.select("id", "w", shingles_of(F.col("w")).alias("s"))
    read = read.where(F.arrays_overlap("s", listed(sorted({x for xs in sought.values() for x in xs}))))
    n = F.size("s")
    starts = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - w) / (w // 2)).cast("int"))), lambda i: F.struct(F.lit(w).alias("window"), (i * (w // 2)).alias("start")))
    part = lambda at: F.slice("s", at["start"] + 1, at["window"])
    shares = lambda at: F.coalesce(*[F.when(at["window"] == w, F.arrays_overlap(part(at), listed(sought[w]))) for w in sizes])
    windows = read.withColumn("at", F.explode(F.filter(F.concat(*[starts(w) for w in sizes]), shares)))
    windows = windows.select("id", "at.window", "at.start", F.array_distinct(part(F.col("at"))).alias("s"), F.slice("w", F.col("at.start") + 1, F.col("at.window") + (SHINGLE - 1)).alias("w"))

    bands = {w: bands_for(w, least[w]) for w in sizes}
    keyed = lambda df: df.withColumn("b", F.explode(F.coalesce(*[F.when(F.col("window") == w, band_keys(F.col("s"), bands[w])) for w in sizes])))
    index = keyed(known.withColumnRenamed("shingles", "s")).select("template", "license", "must", "window", "texts", "b.band", "b.key")
    met = keyed(windows).select("id", "window", "start", "w", "b.band", "b.key").join(F.broadcast(index), ["window", "band", "key"])
    # the bands only propose; what is held is counted in the shingles themselves
    met = met.select("id", "license", "template", "start", "texts", "must", shingle_texts(F.col("w")).alias("there"))
    held = F.size(F.array_intersect("there", "texts")) / F.size("texts")
    met = met.where(F.size(F.array_except("must", "there")) == 0)
    met = met.select("id", "license", "template", "start", held.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = F.max(F.struct("containment", (-F.col("start")).alias("at"))).alias("best")
    found = met.groupBy("id", "license", "template").agg(best, F.count_distinct("start").alias("n_windows"))
    return found.select(F.col("id").alias(id_col), "license", "template", F.round("best.containment", 6).alias("containment"), (-F.col("best.at")).cast("long").alias("start_word"), "n_windows")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
