"""License scans: TF-IDF cosine to templates, then inheritance by directory (operator 7).

Every sentence or line of a text, and every two that follow each other, is a possible header,
and the whole text is a possible license file. Their words, weighted by term frequency and
inverse document frequency over all texts, are compared by cosine with the header templates
and with whole license texts; words that no template has weigh as words that no text has. The
best template at or above the threshold gives the text its license. Nothing is looked for
first: comparisons are skipped only where the template's weights on the words in common bound
the cosine below the threshold, which is exact.

A text is a license file of its directory if its path says so, or if as a whole it is close to
a whole license text. Texts without a license of their own take that of the nearest directory
above them with a license file: directories are joined with the directories above them, so no
join is on files alone.

Nulls: a null text has no header, a null path neither owns nor inherits. Of several license
files in a directory the highest cosine counts, then the last license by name; likewise among
the headers of a text. Repeated rows are judged alike, very long texts whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palaver.llm import text as tx
from palaver.llm.shared import Scratch, arrow_rows, lean

COSINE = 0.6
FILE_COSINE = 0.8
#: Different words that a header has in common with its template at least: one word alone says nothing.
LEAST_SHARED = 2
MAX_BROADCAST_DIRS = 100_000

#: What license notices commonly say.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication license", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("Copyright. All rights reserved.",),
}
#: Whole license texts, as license files hold them; GPL and Apache by the notices they ask for.
FILES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""",
}
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|copyright|notice|unlicense)([.-][^/]*)?$"
#: As the separator of words, but it leaves line ends and the stops of sentences.
_SEPARATOR = tx.regex.compile(r"[^\p{L}\p{M}\p{N}\n.!?]+")
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


def words_of(text: str) -> list[str]:
    return tx.SEPARATOR.sub(" ", text.lower()).split()


def vocabulary() -> list[str]:
    texts = [t for ts in TEMPLATES.values() for t in ts] + list(FILES.values())
    return sorted({w for t in texts for w in words_of(t)})


def document_frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each word of the templates occurs, and how many texts there are."""
    names = vocabulary()
    hashes, _, _, _ = tx.words(pa.array(names, pa.string()))
    order = np.argsort(hashes)
    known = hashes[order]
    few = _slots(known)

    def run(batches):
        count, total = np.zeros(len(names), np.int64), 0
        for b in batches:
            for _, part in tx.chunks(b.column(0)):
                found, rows, _, _ = tx.words(tx.plain(part))
                hit, at = _look_up(known, few, found)
                row = np.repeat(np.arange(len(part)), np.diff(rows))[hit]
                count += np.bincount(np.unique(row * len(known) + at) % len(known), minlength=len(known))
                total += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(order, -1)), pa.array(np.append(count, total))], ["word", "n"])

    rows = files.select(F.col("text").cast("string")).mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r["word"]: r["n"] for r in rows}
    return {w: by.get(i, 0) for i, w in enumerate(names)}, by.get(-1, 0)


def _slots(known: np.ndarray) -> np.ndarray:
    few = np.zeros(1 << 16, bool)
    few[(known >> np.uint64(48)).astype(np.int64)] = True
    return few


def _look_up(known: np.ndarray, few: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in found, positions in known) of what both have."""
    some = np.flatnonzero(few[(found >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, found[some]), len(known) - 1)
    same = known[at] == found[some]
    return some[same], at[same]


class Templates:
    """Sparse unit vectors of one kind of template, and what bounds a cosine with them."""

    def __init__(self, named: list[tuple[str, str]], frequency: dict[str, int], texts: int):
        names = sorted(frequency)
        hashes, _, _, _ = tx.words(pa.array(names, pa.string()))
        order = np.argsort(hashes)
        self.known, self.few = hashes[order], _slots(hashes)
        self.idf = np.array([math.log((texts + 1) / (frequency[names[i]] + 1)) + 1 for i in order])
        self.rare = math.log(texts + 1) + 1
        self.names = [n for n, _ in named]
        self.matrix = np.zeros((len(named), len(names)))
        for k, (_, t) in enumerate(named):
            found, _, _, _ = tx.words(tx.plain(pa.array([t])))
            _, at = _look_up(self.known, self.few, found)
            word, n = np.unique(at, return_counts=True)
            self.matrix[k, word] = (1 + np.log(n)) * self.idf[word]
            self.matrix[k] /= np.linalg.norm(self.matrix[k])
        #: The most that a word of the text can add to the square of a cosine with any template.
        self.most = (self.matrix**2).max(axis=0)

    def best(self, hashes: np.ndarray) -> tuple[float, str | None]:
        """Highest cosine of the words with a template, and that template's license."""
        word, n = np.unique(hashes, return_counts=True)
        hit, at = _look_up(self.known, self.few, word)
        weight = np.full(len(word), self.rare)
        weight[hit] = self.idf[at]
        weight = weight * (1 + np.log(n))
        if not len(hit):
            return 0.0, None
        shared = self.matrix[:, at]
        cosines = shared @ weight[hit] / np.linalg.norm(weight)
        cosines[(shared > 0).sum(axis=1) < LEAST_SHARED] = 0.0
        return max((round(c, 9), n) for c, n in zip(cosines.tolist(), self.names, strict=True))

    def search(self, hashes: np.ndarray, hit: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, cosine: float):
        """(stretch, its best cosine, license) of the stretches hashes[start:end] that reach the cosine.

        hit, at: which of the hashes are words of templates, and which words.
        """
        total = np.concatenate(([0.0], np.cumsum(self.most[at])))
        # Repeated words count more than once here, so the bound is on the safe side.
        bound = total[np.searchsorted(hit, ends)] - total[np.searchsorted(hit, starts)]
        for i in np.flatnonzero(bound >= cosine * cosine - 1e-9).tolist():
            c, name = self.best(hashes[starts[i] : ends[i]])
            if name is not None and c >= cosine:
                yield i, c, name


class Matcher:
    def __init__(self, frequency: dict[str, int], texts: int):
        self.headers = Templates([(name, t) for name, ts in TEMPLATES.items() for t in ts], frequency, texts)
        self.files = Templates(list(FILES.items()), frequency, texts)

    def judge(self, texts: pa.Array, cosine: float, file_cosine: float):
        """Per text: license, its cosine, and whether the whole text is a license text."""
        lowered = tx.plain(texts, _SEPARATOR)
        hashes, rows, word_starts, _ = tx.words(lowered)
        data, offsets = tx.raw(lowered)
        own: list[str | None] = [None] * len(texts)
        score, whole = np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not len(hashes):
            return own, score, whole
        after = np.append(data[1:], np.uint8(32))
        breaks = np.flatnonzero((data == 10) | (_ENDS[data] & _BLANK[after])) + 1
        cuts = np.unique(np.searchsorted(word_starts, np.concatenate((offsets, breaks))))
        cuts = cuts[cuts < len(hashes)]
        ends = np.append(cuts[1:], len(hashes))
        text_of = np.searchsorted(rows, cuts, "right") - 1
        joined = np.flatnonzero(text_of[1:] == text_of[:-1])
        starts = np.concatenate((cuts, cuts[joined]))
        hit, at = _look_up(self.headers.known, self.headers.few, hashes)
        stretches = (starts, np.concatenate((ends, ends[joined + 1])), np.concatenate((text_of, text_of[joined])))
        filled = np.flatnonzero(np.diff(rows))
        for kind, (lo, hi, of), least in ((self.headers, stretches, cosine), (self.files, (rows[filled], rows[filled + 1], filled), file_cosine)):
            for i, c, name in kind.search(hashes, hit, at, lo, hi, least):
                r = int(of[i])
                whole[r] |= kind is self.files
                if (c, name) > (score[r], own[r] or ""):
                    own[r], score[r] = name, c
        return own, score, whole


def scan_headers(files: DataFrame, cosine: float = COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """files (path, text and more) without text, with _own, _score and _whole: license, its cosine, whether the text is a license text."""
    sent = files.sparkSession.sparkContext.broadcast(document_frequencies(files))
    keep = [c for c in files.columns if c.lower() not in ("text", "_own", "_score", "_whole")]

    def run(batches):
        matcher = Matcher(*sent.value)
        for b in batches:
            for at, part in tx.chunks(b.column(len(keep))):
                own, score, whole = matcher.judge(part, cosine, file_cosine)
                rows = [c.slice(at, len(part)) for c in b.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(own, pa.string()), pa.array(score), pa.array(whole)], [*keep, "_own", "_score", "_whole"])

    arrow_rows(files.sparkSession, 2000)
    rows = files.select(*keep, F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(lean(run), schema + ", _own string, _score double, _whole boolean")


def ancestors(folder):
    """The folder and those above it, deepest first, with their depth."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("above"), k.alias("depth")))


def scan(files: DataFrame, cosine: float = COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """files without text, with license, cosine and origin: header, file (the text is a license text), inherited or null."""
    scratch = Scratch(files.sparkSession)
    found = scan_headers(files, cosine, file_cosine).withColumn("_folder", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), ""))
    found = scratch.put(found, "headers")
    is_file = F.col("_own").isNotNull() & F.col("_folder").isNotNull() & (F.col("path").rlike(FILE_NAME) | F.col("_whole"))
    owners = found.where(is_file).groupBy(F.col("_folder").alias("above")).agg(F.max(F.struct("_score", "_own")).alias("given"))
    folders = found.select("_folder").where("_folder is not null").distinct()
    above = folders.select("_folder", F.explode(ancestors(F.col("_folder"))).alias("x")).select("_folder", "x.above", "x.depth")
    given = above.join(owners, "above").groupBy("_folder").agg(F.max(F.struct("depth", "given")).alias("g")).select("_folder", F.col("g.given._own").alias("_license"), F.col("g.given._score").alias("_cosine"))
    given = scratch.put(given, "given")
    if given.count() <= MAX_BROADCAST_DIRS:
        given = F.broadcast(given)
    out = found.join(given, "_folder", "left")
    origin = F.when(F.col("_own").isNotNull(), F.when(F.col("_whole"), "file").otherwise("header")).when(F.col("_license").isNotNull(), "inherited")
    keep = [c for c in files.columns if c.lower() not in ("text", "license", "cosine", "origin")]
    return out.select(*keep, F.coalesce("_own", "_license").alias("license"), F.when(F.col("_own").isNotNull(), F.col("_score")).otherwise(F.col("_cosine")).alias("cosine"), origin.alias("origin"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files; a source is a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files).select("doc_id", "path", "license", "cosine", "origin")
