"""License scans with a positional index of rare words.

Templates are indexed by word and position. Of each template, the words of highest inverse document frequency (counted
over all files) and those of its key phrase are looked up wherever a file has them; each occurrence votes for the place
at which the template would start, votes of one template within a few words of each other are one candidate, and a
candidate counts only if the template's mandatory key phrase stands there. A part of a licence votes as the whole would,
if it holds the key phrase. Exact phrases of the base set are verified the same way, word by word from their rarest word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import documents, small_batches

#: Phrases whose places are all listed, with their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates: label, licence text or the notice by which files name it, mandatory key phrase (fixed values). Marks and
#: capitals don't count; names, years and addresses are left out.
TEMPLATES = {
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "permission is hereby granted free of charge",
    ),
    "apache-2": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        "apache license version 2",
    ),
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
        "redistribution and use in source and binary forms",
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        "for any purpose with or without fee is hereby granted",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
        "the origin of this software must not be misrepresented",
    ),
    "gpl": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
        "gnu general public license",
    ),
    "lgpl": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
        "gnu lesser general public license",
    ),
    "mpl-2": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    "proprietary": (
        """All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any
        means, including photocopying, recording, or other electronic or mechanical methods, without the prior written
        permission of the publisher.""",
        "all rights reserved",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
        of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
        for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to
        be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
        law.""",
        "released into the public domain",
    ),
}
RARE, DRIFT = 6, 3
#: Bytes that separate words; all others, but for A-Z, stand for themselves.
SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_UPPER = bytes(range(0x41, 0x5B))
TABLE = bytes((b + 32) if b in _UPPER else 0x20 if b in SEPARATORS else b for b in range(256))

PHRASE_WORDS = {tuple(p.encode().split()): label for p, label in PHRASES.items()}
TEMPLATE_WORDS = {label: tuple(part.encode().translate(TABLE).split() for part in parts) for label, parts in TEMPLATES.items()}
VOCABULARY = frozenset(w for p in PHRASE_WORDS for w in p) | frozenset(w for t, _ in TEMPLATE_WORDS.values() for w in t)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many texts each licence word occurs, and the number of texts; counts of each task are added up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(sorted(VOCABULARY), 0)
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                for w in VOCABULARY.intersection(words_of(t)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts] + [""]), pa.array([*counts.values(), n], pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per licence word
    found = {r.word.encode(): int(r.n) for r in rows}
    return found, found.pop(b"", 0)


def inverse_frequencies(counts: dict[bytes, int], n: int) -> dict[bytes, float]:
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in VOCABULARY}


class Index:
    """Postings (label, position) of each template's rarest words and its key phrase's, and the rarest words of base phrases."""

    def __init__(self, idf: dict[bytes, float]) -> None:
        self.idf = idf
        self.postings: dict[bytes, list[tuple[str, int]]] = {}
        for label, (text, key) in TEMPLATE_WORDS.items():
            rarest = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))[:RARE]
            rare = {*rarest(text), *rarest(key)}
            for at, w in enumerate(text):
                if w in rare:
                    self.postings.setdefault(w, []).append((label, at))
        self.anchors: dict[bytes, list[tuple[tuple[bytes, ...], int]]] = {}
        for phrase in PHRASE_WORDS:
            rarest = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
            self.anchors.setdefault(phrase[rarest], []).append((phrase, rarest))
        self.weight = {label: sum(idf[w] for w in text) for label, (text, _) in TEMPLATE_WORDS.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """((start, label) of base phrases, labels of templates, best share of a template's weight that is there)."""
        present = VOCABULARY.intersection(words)
        if not present:
            return [], set(), 0.0
        wanted = self.postings.keys() | self.anchors.keys()
        base, votes = [], {}
        for at, w in enumerate(words):
            if w not in wanted:
                continue
            for phrase, off in self.anchors.get(w, ()):
                if at >= off and tuple(words[at - off : at - off + len(phrase)]) == phrase:
                    base.append((at - off, PHRASE_WORDS[phrase]))
            for label, off in self.postings.get(w, ()):
                votes.setdefault((label, (at - off) // DRIFT), set()).add(w)
        labels, best = set(), 0.0
        for (label, cell), voters in votes.items():
            if len(voters | votes.get((label, cell + 1), set())) < 2:
                continue
            text, key = TEMPLATE_WORDS[label]
            low = max(0, cell * DRIFT - DRIFT)
            here = words[low : cell * DRIFT + len(text) + 3 * DRIFT]
            if not any(here[i : i + len(key)] == key for i in range(len(here) - len(key) + 1)):
                continue
            labels.add(label)
            there = set(here)
            best = max(best, sum(self.idf[w] for w in text if w in there) / self.weight[label])
        return sorted(set(base)), labels, best


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places array<struct<start, label>>, templates array<string>, score of every row of docs.

    score is 1 with a base phrase, else the best share of a template's idf weight. Null and empty texts have no words
    and no places. Rows that repeat are scanned as often as they came; rows without doc_id are scanned too. Further
    columns are ignored.
    """
    idf = inverse_frequencies(*document_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            sizes, places, labels, scores = [], [], [], []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                base, own, best = index.scan(words)
                sizes.append(len(words))
                places.append([{"start": a, "label": label} for a, label in base])
                labels.append(sorted(own))
                scores.append(1.0 if base else min(best, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "places", "templates", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, places array<struct<start: long, label: string>>, templates array<string>, score double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir))
    starts, base = F.col("places.start"), F.array_distinct(F.col("places.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.col("templates"))), ",").alias("labels"),
        "score",
    )
