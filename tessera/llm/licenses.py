"""License scans: sparse TF-IDF cosine of headers and license files to templates, then nearest-ancestor inheritance by path joins.

Templates are notices, SPDX identifier lines and full texts. Their vocabulary is their words and pairs of adjacent words; document
frequencies of the vocabulary are counted over all documents (a count a term is all that reaches the driver). The rarest words of
a template are its anchors. Wherever an anchor stands in a text, the window that would hold the template is compared with it, and
every text is compared as a whole with every template too. All vectors are sparse: terms with weights, and words that no template
has count in the norm with the greatest weight. The best template at `threshold` or more is the file's own license. A license file,
by its name or because it is a license as a whole, gives its license to its directory, and files without a license of their own take
that of the nearest directory above: paths are exploded into their ancestors and joined with the licensed directories, the deepest
of which counts.

Defined results. Null and empty texts have no notice. A null path is the root's. A null id is kept. Rows that repeat an id are
scanned each for itself. Of templates that are equally near, the first counts. Of several license files of one directory the one with
the largest similarity counts, then the first license by name. An empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import id_key, real_id, row_batches, ship, text_of, written

ship(__name__)

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {n} of the
License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."""
# SPDX identifiers with the wording of their notices and, where it is short, their full text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", GNU_NOTICE.format(kind="General", n=3)),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GNU_NOTICE.format(kind="General", n=2)),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GNU_NOTICE.format(kind="Lesser General", n=3)),
    ("AGPL-3.0", GNU_NOTICE.format(kind="Affero General", n=3)),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met. BSD 3-Clause License."),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted
to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is prohibited."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES) if name != "Proprietary"]
#: Anchors of a template, and the similarity from which a text is a license as a whole.
ANCHORS, WHOLE = 3, 0.9
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "id long, path string, n_words long, license string, similarity double, whole double"


def template_words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().translate(bytes(A.LOWERED)))


def _codes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return A.word_codes(np.frombuffer(b"".join(words), dtype=np.uint8), ends - [len(w) for w in words], ends)


def pair_codes(codes: np.ndarray) -> np.ndarray:
    return A.mix(codes[:-1] * np.uint64(3) + codes[1:])


class Vocabulary:
    """The templates' terms with their weights; a template is a sparse vector, kept by term."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.texts = [_codes(template_words(t)) for _, t in templates]
        self.keys = np.unique(np.concatenate([np.concatenate([t, pair_codes(t)]) for t in self.texts]))
        self.weigh(np.zeros(len(self.keys)), 0)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def weigh(self, frequency: np.ndarray, documents: int) -> Vocabulary:
        self.idf = np.log((1 + documents) / (1 + frequency)) + 1
        self.unknown = float(np.log(1 + documents) + 1)
        term, template, weight, anchors = [], [], [], []
        for j, t in enumerate(self.texts):
            words = self.find(t)
            at, n = np.unique(np.concatenate([words, self.find(pair_codes(t))]), return_counts=True)
            w = n * self.idf[at]
            term.append(at), template.append(np.full(len(at), j)), weight.append(w / np.linalg.norm(w))
            # The first place of each of the rarest words; of equally rare ones, the earlier.
            first = {int(w): i for i, w in reversed(list(enumerate(words)))}
            for w in sorted(first, key=lambda w: (frequency[w], first[w]))[:ANCHORS]:
                anchors.append((w, j, first[w], len(t)))
        term, template, weight = (np.concatenate(x) for x in (term, template, weight))
        order = np.argsort(term, kind="stable")
        self.template, self.weight = template[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.keys) + 1))
        anchors = np.array(sorted(anchors), dtype=np.int64)
        self.anchor_of, self.anchor_word = anchors[:, 1:], anchors[:, 0]
        self.anchor_start = np.searchsorted(self.anchor_word, np.arange(len(self.keys) + 1))
        return self

    def terms(self, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The term of every word, and of the pair that begins with it; -1: none, or no pair."""
        words, pairs = self.find(codes), np.full(len(codes), -1, dtype=np.int64)
        if len(codes) > 1:
            pairs[:-1] = np.where(row[1:] == row[:-1], self.find(pair_codes(codes)), -1)
        return words, pairs

    def cosines(self, words: np.ndarray, pairs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(span, template, cosine) for the spans of words and all templates that share a term with them."""
        width = ends - starts
        at, span = A.ranges(starts, width), np.repeat(np.arange(len(starts)), width)
        inner = at + 1 < ends[span]
        term, owner = np.concatenate([words[at], pairs[at[inner]]]), np.concatenate([span, span[inner]])
        n_pairs = np.maximum(width - 1, 0)
        known = term >= 0
        key, tf = np.unique(owner[known] * len(self.keys) + term[known], return_counts=True)
        owner, term = key // len(self.keys), key % len(self.keys)
        weight = tf * self.idf[term]
        other = width + n_pairs - np.bincount(owner, tf, len(starts))
        norm = np.sqrt(np.bincount(owner, weight**2, len(starts)) + np.maximum(other, 0) * self.unknown**2)
        count = self.start[term + 1] - self.start[term]
        entry, each = A.ranges(self.start[term], count), np.repeat(np.arange(len(term)), count)
        cell, inverse = np.unique(owner[each] * len(self.names) + self.template[entry], return_inverse=True)
        dot = np.bincount(inverse, weight[each] * self.weight[entry], len(cell))
        span, template = cell // len(self.names), cell % len(self.names)
        return span, template, dot / np.maximum(norm[span], 1e-12)


def _word_codes(data, offsets, lo, hi):
    buf = A.LOWERED[data[offsets[lo] : offsets[hi]]]
    starts, ends, at = A.words(buf, offsets[lo : hi + 1] - offsets[lo], A.ALNUM)
    return A.word_codes(buf, starts, ends), at


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How many rows hold each term, and the rows. docs: (id, text, path)."""

    def count(batches):
        total, rows = np.zeros(len(vocabulary.keys), dtype=np.int64), 0
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(1))
            rows += batch.num_rows
            for lo, hi in A.chunks(offsets):
                codes, at = _word_codes(data, offsets, lo, hi)
                row = A.rows_of(at)
                term = np.concatenate(vocabulary.terms(codes, row))
                row = np.concatenate([row, row])
                seen = np.unique(row[term >= 0] * len(vocabulary.keys) + term[term >= 0])
                total += np.bincount(seen % len(vocabulary.keys), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), type=pa.int64()), pa.array(np.append(total[at], rows), type=pa.int64())], names=["term", "n"])

    got = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(len(vocabulary.keys))
    for r in got:
        if r["term"] >= 0:
            frequency[r["term"]] = r["n"]
    return frequency, sum(r["n"] for r in got if r["term"] < 0)


def best_of(row: np.ndarray, template: np.ndarray, cosine: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest cosine of each row, and its template; of equals the first."""
    order = np.lexsort((template, -np.round(cosine, 12), row))
    row, template, cosine = row[order], template[order], cosine[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    best, which = np.zeros(n), np.full(n, -1, dtype=np.int64)
    best[row[first]], which[row[first]] = cosine[first], template[first]
    return best, which


def notices(vocabulary: Vocabulary, threshold: float):
    """mapInArrow: (id, text, path) to SCHEMA, one row a text. similarity: the best of all windows and the whole; whole: of the whole text alone."""

    def work(batches):
        v = vocabulary
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(1))
            best, whole = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            which = np.full(batch.num_rows, -1, dtype=np.int64)
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for lo, hi in A.chunks(offsets):
                codes, at = _word_codes(data, offsets, lo, hi)
                n_words[lo:hi] = np.diff(at)
                if not len(codes):
                    continue
                row = A.rows_of(at)
                words, pairs = v.terms(codes, row)
                whole[lo:hi], _ = alone = best_of(*v.cosines(words, pairs, at[:-1], at[1:]), hi - lo)
                # A window for each anchor and template, where the template would stand.
                place = np.flatnonzero(words >= 0)
                count = v.anchor_start[words[place] + 1] - v.anchor_start[words[place]]
                entry, place = A.ranges(v.anchor_start[words[place]], count), np.repeat(place, count)
                template, back, width = v.anchor_of[entry].T
                starts = np.maximum(place - back, at[row[place]])
                ends = np.minimum(place - back + width, at[row[place] + 1])
                span, met, cosine = v.cosines(words, pairs, starts, ends)
                own = met == template[span]
                near = best_of(row[place][span[own]], met[own], cosine[own], hi - lo)
                better = near[0] > alone[0] + 1e-12
                best[lo:hi], which[lo:hi] = np.where(better, near[0], alone[0]), np.where(better, near[1], alone[1])
            name = [v.names[j] if j >= 0 and b >= threshold else None for j, b in zip(which, best)]
            number = lambda x: pa.array(np.round(np.minimum(x, 1), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words), pa.array(name, type=pa.string()), number(best), number(whole)], names=["id", "path", "n_words", "license", "similarity", "whole"])

    return work


def inherited(files: DataFrame) -> DataFrame:
    """files: (id, path, license, similarity, is_license_file). Adds origin ('own', 'inherited', 'none') and license_dir."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    dirs = (
        files.where("is_license_file AND license IS NOT NULL").select(folder.alias("dir"), "license", "similarity")
        .groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "license")).alias("m")).select("dir", F.col("m.license").alias("given"))
    )
    parts = F.split(folder, "/")
    # '' is the root; 'a/b' has the ancestors 'a/b', 'a' and ''.
    above = F.concat(F.array(F.lit("")), F.when(folder == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    need = files.where("license IS NULL").select(F.col("id").alias("__id"), F.col("path").alias("__path"), F.explode(above).alias("dir"))
    nearest = (
        need.join(dirs, "dir").groupBy("__id", "__path").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "given")).alias("m"))
        .select("__id", "__path", F.col("m.dir").alias("license_dir"), F.col("m.given").alias("given"))
    )
    out = files.join(nearest, (F.col("id") == F.col("__id")) & (F.col("path") == F.col("__path")) & F.col("license").isNull(), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.coalesce("license", "given").alias("license"), "similarity", origin.alias("origin"), "license_dir", "is_license_file")


def license_scan(docs: DataFrame, path: Column, threshold: float = 0.7, license_file: Column | None = None, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """license_file: a condition on (path, n_words, license, similarity, whole); by default the usual names of license files, or a text that is a license as a whole.

    templates: (license, text) rows; texts may be whole licenses.
    """
    row_batches(docs.sparkSession)
    texts = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    vocabulary = Vocabulary(templates)
    vocabulary.weigh(*document_frequencies(texts, vocabulary))
    found = written(texts.mapInArrow(notices(vocabulary, threshold), SCHEMA), "notices")
    named = F.lower("path").rlike(r"(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$") | (F.col("whole") >= WHOLE)
    return inherited(found.withColumn("is_license_file", license_file if license_file is not None else named))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no paths; `source/lang/doc_id` stands for one. A document that is a license as a whole gives it to its folder; is_license_file says which are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = license_scan(docs, F.concat_ws("/", "source", "lang", "doc_id"))
    return out.select(real_id("id").alias("doc_id"), "license", F.round("similarity", 6).alias("similarity"), "origin", "license_dir", "is_license_file")
