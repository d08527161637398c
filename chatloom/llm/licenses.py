"""Licence scans: TF-IDF cosine of headers and licence files to templates; then inheritance down the directories.

A word's weight is its inverse document frequency over all texts. A first pass counts the texts of every word into a
table; the templates' words are few and go to all tasks. Units are windows of one to some twenty neighbouring lines, which
headers may be wrapped over, and whole licence files. A unit is compared as a sparse vector of its words: its products with
all templates need the templates' words only, its length needs the others too. With the least weight that a word can
have, 1, for those, few units are still like enough to a template; only their other words are joined with the table.

Of a licence file, only what speaks for the whole of it counts: a unit of half of its words or more, or its title, the first lines
with words, which must be a known title nearly word for word. A paragraph that many licences share thus names none of them. A unit must
have the numbers of its licence's version, if the template has them, and be closer to its licence than to any other by a margin.

A file has the licence of its best unit if that is like enough to some template, else that of the nearest directory above
it with a licence file that has one. Directories are resolved first, one row each, by a join of their ancestors with
those that have a licence; files then join their directory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm import arrays
from chatloom.llm.decontamination import words
from chatloom.scratch import written

THRESHOLD = 0.7
#: Least cosine of a licence file to a whole text, and of a title.
FILE_THRESHOLD, TITLE_THRESHOLD = 0.85, 0.97
#: A unit's cosine to its licence is larger than to any other licence by so much.
MARGIN = 0.005
#: Windows of these many neighbouring lines are compared.
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 20)
#: A task's count of words is sent off beyond this many.
FLUSH = 1 << 20
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|unlicense)(\\.[a-z]+)?$"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_FORMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public wordings by which works state their licence, headers and whole licence texts.
TEMPLATES = (
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_FORMS + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_FORMS + _BSD_NAMES + _BSD_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)

#: Headers of licences whose wordings differ in a word or number only.
TEMPLATES += (
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)

#: How whole licence texts begin.
TITLES = (
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"), ("MIT", "The MIT License"), ("MIT", "MIT License"), ("ISC", "ISC License"),
)


def _vocabulary(templates: tuple[tuple[str, str], ...]) -> np.ndarray:
    return np.unique(words(*arrays.text_bytes(pa.array([t for _, t in templates])))[0])


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)``: how many of a task's texts, or of each stretch of them that fits into memory, hold each word."""
    def rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(part[0].view(np.int64)), pa.array(part[1])], ["word", "n"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, _, raw, offsets in arrays.pieces(batch.column(0)):
            held.append(np.unique(arrays.sets(*words(raw, offsets))[0], return_counts=True))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [_summed(held)]
                if len(held[0][0]) > FLUSH // 2:
                    yield rows(held.pop())
    if held:
        yield rows(_summed(held))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, back = np.unique(names, return_inverse=True)
    return found, np.bincount(back, weights=n).astype(np.int64)


#: What a unit is: a window of a file's lines, half of a licence file or more, or the title of one.
WINDOW, FILE, TITLE = 0, 1, 2
LEAST = (THRESHOLD, FILE_THRESHOLD, TITLE_THRESHOLD)


def _numbers_of(name: str) -> set[int]:
    """The words that stand for a licence's version: of GPL-3.0, those of 3.0."""
    version = name.rpartition("-")[2]
    return set(words(*arrays.text_bytes(pa.array([version])))[0].view(np.int64).tolist()) if version[:1].isdigit() else set()


@dataclass
class Matcher:
    names: list[str]
    vocabulary: np.ndarray
    idf: np.ndarray
    #: weight of each word in each template, scaled to length 1
    templates: np.ndarray
    #: words that a unit must have, by template, and how many they are
    needed: np.ndarray
    n_titles: int

    @staticmethod
    def of(templates: tuple[tuple[str, str], ...], counts: dict[int, int], n: int, n_titles: int = 0) -> Matcher:
        """The last ``n_titles`` of ``templates`` are titles."""
        vocabulary = _vocabulary(templates)
        idf = np.array([math.log((n + 1) / (counts.get(x, 0) + 1)) + 1 for x in vocabulary.view(np.int64).tolist()])
        table, needed = (np.zeros((len(vocabulary), len(templates))) for _ in range(2))
        for j, (name, text) in enumerate(templates):
            hashes, _ = words(*arrays.text_bytes(pa.array([text])))
            np.add.at(table[:, j], np.searchsorted(vocabulary, hashes), 1)
            own = [x for x in np.unique(hashes) if int(x.view(np.int64)) in _numbers_of(name)]
            needed[np.searchsorted(vocabulary, np.array(own, vocabulary.dtype)), j] = 1
        table *= idf[:, None]
        return Matcher([x for x, _ in templates], vocabulary, idf, table / np.linalg.norm(table, axis=0), needed, n_titles)

    def candidates(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> Iterator[tuple[int, int, float, float, np.ndarray, np.ndarray]]:
        """``(unit, template, product, square of the length by known words, other words, their times)`` of units that may be like enough.

        Unit u is the words from ``starts[u]`` to ``ends[u]``; all are of one kind.
        """
        if not len(hashes) or not len(starts):
            return
        titles = np.arange(len(self.names)) >= len(self.names) - self.n_titles
        columns = np.flatnonzero(titles == (kind == TITLE))
        table, needed, least = self.templates[:, columns], self.needed[:, columns], LEAST[kind]
        all_needed, heaviest = needed.sum(axis=0), table.max(axis=1)
        names = np.unique(np.array(self.names)[columns], return_inverse=True)[1]
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        upto = lambda x: np.append(0.0, np.cumsum(x))
        # a unit's vector is at least as long as with every word counted once a time and weight 1 for those in no template
        square, most = upto(np.where(known, self.idf[at] ** 2, 1.0)), upto(np.where(known, self.idf[at] * heaviest[at], 0.0))
        near = most[ends] - most[starts] >= least * np.sqrt(np.maximum(square[ends] - square[starts], 0)) - 1e-6
        for unit in np.flatnonzero(near & (ends > starts)).tolist():
            own, times = np.unique(hashes[starts[unit] : ends[unit]], return_counts=True)
            place = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            hit = self.vocabulary[place] == own
            vector = times[hit] * self.idf[place[hit]]
            products = (vector[:, None] * table[place[hit]]).sum(axis=0)
            square_known = float((vector**2).sum())
            shortest = math.sqrt(square_known + float((times[~hit] ** 2).sum()))
            if products.max() < least * shortest - 1e-9:
                continue
            products = np.where(needed[place[hit]].sum(axis=0) == all_needed, products, -1.0)
            j = int(products.argmax())
            other = products[names != names[j]].max(initial=-1.0)
            if products[j] >= least * shortest - 1e-9 and products[j] - other >= MARGIN * shortest:
                yield unit, int(columns[j]), float(products[j]), square_known, own[~hit], times[~hit]


def _lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets of lines, row of each line)``."""
    cuts = np.union1d(offsets, np.flatnonzero(raw == 10) + 1)
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def own_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, titles: tuple[tuple[str, str], ...] = TITLES, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """``key, path, is_licence_file, licence, score`` of every file, by its own text; licence null if none is like enough."""
    spark = files.sparkSession
    counts = files.select(F.col(text).alias("text")).mapInArrow(_document_frequency, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts, n = written(counts, "licences-words"), files.count()
    templates = (*templates, *titles)
    of_templates = counts.where(F.col("word").isin(_vocabulary(templates).view(np.int64).tolist())).collect()  # as many rows as the templates have words
    matcher = spark.sparkContext.broadcast(Matcher.of(templates, {r["word"]: r["n"] for r in of_templates}, n, len(titles)))
    near = pa.list_(pa.struct([("template", pa.int32()), ("product", pa.float64()), ("square", pa.float64()), ("least", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, serial = matcher.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            whole = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, raw, offsets in arrays.pieces(batch.column(2)):
                rows = last - first
                cuts, row_of = _lines_of(raw, offsets)
                hashes, bounds = words(raw, cuts)
                found: list[list[dict]] = [[] for _ in range(rows)]
                units = [(bounds[: len(row_of) + 1 - k], bounds[k:], row_of[: len(row_of) + 1 - k], row_of[k - 1 :]) for k in WINDOWS if k <= len(row_of)]
                units = [(a[x == y], b[x == y], x[x == y]) for a, b, x, y in units]
                ends = np.searchsorted(row_of, np.arange(rows + 1))
                files_ = np.flatnonzero(whole[first:last])
                units.append((bounds[ends[files_]], bounds[ends[files_ + 1]], files_))
                begins, stops = bounds[ends[:-1]], bounds[ends[1:]]
                for a, b, row in units:
                    licence_file, none = whole[first:last][row], np.zeros(len(row), bool)
                    half = licence_file & (2 * (b - a) >= stops[row] - begins[row]) if len(row) else none
                    top = licence_file & (a == begins[row]) if len(row) else none
                    for pick, kind in ((~licence_file, WINDOW), (half, FILE), (top, TITLE)):
                        a_, b_, row_ = a[pick], b[pick], row[pick]
                        for unit, j, product, square, others, times in m.candidates(hashes, a_, b_, kind):
                            found[row_[unit]].append({"template": j, "product": product, "square": square, "least": LEAST[kind], "words": others.view(np.int64), "times": times})
                own = [batch.column(c).slice(first, rows) for c in (0, 1, 3)]
                yield pa.record_batch([pa.array(serial + np.arange(rows)), *own, pa.array(found, near)], ["row", "key", "path", "is_licence_file", "near"])
                serial += rows

    kind = files.select(F.col(key)).schema[0].dataType.simpleString()
    named = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"), named.alias("is_licence_file"))
    schema = f"row bigint, key {kind}, path string, is_licence_file boolean, near array<struct<template int, product double, square double, least double, words array<bigint>, times array<bigint>>>"
    rows = written(rows.mapInArrow(task, schema), "licences-near")
    units = rows.select("row", F.posexplode("near").alias("unit", "u")).select("row", "unit", "u.*")
    others = units.select("row", "unit", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "unit", F.col("w.words").alias("word"), "w.times")
    idf = F.log((F.lit(float(n)) + 1) / (F.col("n") + 1)) + 1
    lengths = others.join(counts, "word").groupBy("row", "unit").agg(F.sum((F.col("times") * idf) ** 2).alias("more"))
    score = F.col("product") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    scored = units.drop("words", "times").join(lengths, ["row", "unit"], "left").withColumn("score", F.round(score, 9)).where(F.col("score") >= F.col("least"))
    best = scored.groupBy("row").agg(F.max(F.struct("score", (-F.col("template")).alias("before"))).alias("best"))
    licence = F.element_at(F.array(*(F.lit(x) for x, _ in templates)), (1 - F.col("best.before")).cast("int"))
    out = rows.drop("near").join(best, "row", "left")
    return out.select(F.col("key").alias(key), "path", "is_licence_file", F.when(F.col("best").isNotNull(), licence).alias("licence"), F.coalesce("best.score", F.lit(0.0)).alias("score"))


def directory(path: Column) -> Column:
    """The part before the last slash; empty at the top; null for a null path."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def licensed(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, titles: tuple[tuple[str, str], ...] = TITLES, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """``key, path, licence, how, score``: ``how`` is header, file or inherited, or null if the file has no licence.

    Ties between licence files of one directory go to the higher score, then the name. Null or empty text: no licence of its
    own. Null path: no directory to inherit from. Repeated rows are judged alike. Empty table: no rows. Other columns don't
    matter, whatever their names.
    """
    own = written(own_licences(files, templates, titles, text, path, key), "licences-own")
    own = own.withColumn("dir", directory(F.col(path)))
    given = own.where("is_licence_file AND licence IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.max_by("licence", F.struct("score", "licence")).alias("given"))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("ancestor", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/")))
    met = above.distinct().join(given.withColumnRenamed("dir", "ancestor"), "ancestor")
    nearest = met.groupBy("dir").agg(F.max_by("given", "depth").alias("inherited"))
    out = own.join(nearest, "dir", "left")
    how = F.when(F.col("licence").isNotNull(), F.when(F.col("is_licence_file"), "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited")
    return out.select(key, path, F.coalesce("licence", "inherited").alias("licence"), how.alias("how"), F.round("score", 6).alias("score"))
