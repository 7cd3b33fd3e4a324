"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of `BLOCK` words, or of two, four, ... times as many for longer templates; windows start every half block, so that a
passage of half a block's words lies in one of them however its lines break.  A template has the shortest blocks of which half holds
it, and matches a block that holds at least `threshold` of its distinct words; every such block is found.  Words are ordered by their frequency in the
corpus, rarest first, and a template is looked up only by its prefix, the |t| - a + 1 rarest of its
words (a = ceil(threshold |t|), the overlap needed): a block without any of these cannot match.
Length filter: the block has at least a of the templates' words.  Positional filter: what is left
of both lists after the shared word can still reach a.  Candidates are verified by their overlap.

Base phrases are templates of threshold 1; blocks that match are searched for the phrase's words in
sequence.

Templates are a written list of notices and whole license texts, so the index sent to the tasks has a fixed size (`MAX_TOKENS` is
checked); any other list may be given.  Whole texts are scanned in one pass, after one that counts the templates' words.

Defined results: a null or empty text has no words, labels '' and score 0; a very long text is scanned whole, block by block; labels that tie
are all given, words of equal frequency are ordered by their letters; null ids are carried;
repeated rows are reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import map_batches, table, text_bytes

BLOCK, THRESHOLD, MAX_TOKENS = 64, 0.8, 100_000

#: The contract's phrases.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Further templates of our own: text, label.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work has been released into the public domain", "public-domain"),
    # whole texts, without the line that names year and holder: fixed values
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
        OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
        BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
        BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-2-clause",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
        "zlib",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        "apache-2.0",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the
        GNU General Public License along with this program.""",
        "gpl-3.0",
    ),
)

#: A-Z to a-z, ASCII that is neither letter nor digit to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Template:
    words: list[bytes]
    label: str
    threshold: float
    phrase: bool  # its words must stand in sequence

    def __post_init__(self) -> None:
        self.block = BLOCK
        while len(self.words) > self.block // 2 + 1:
            self.block *= 2
        self.tokens = sorted(set(self.words))
        self.need = max(1, ceil(self.threshold * len(self.tokens) - 1e-9))


def make_templates(base=BASE, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = [Template(words_of(p.encode()), label, 1.0, True) for p, label in base]
    out += [Template(words_of(t.encode()), label, threshold, False) for t, label in templates]
    if sum(len(t.tokens) for t in out) > MAX_TOKENS:
        raise ValueError(f"templates exceed {MAX_TOKENS} words together")
    return [t for t in out if t.words]


class Index:
    """Templates by the words of their prefixes; word numbers follow the frequency, rarest first."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]) -> None:
        vocabulary = sorted({w for t in templates for w in t.tokens}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = templates
        self.lists = [sorted(self.rank[w] for w in t.tokens) for t in templates]
        self.sets = [set(x) for x in self.lists]
        self.sequences = [np.array([self.rank[w] for w in t.words]) for t in templates]
        #: by block length: prefix words to (template, place in its order), and which words these are
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, (t, own) in enumerate(zip(templates, self.lists, strict=True)):
            for i, token in enumerate(own[: len(own) - t.need + 1]):
                self.postings.setdefault(t.block, {}).setdefault(token, []).append((number, i))
        self.is_prefix = {}
        for block, postings in self.postings.items():
            self.is_prefix[block] = np.zeros(len(vocabulary) + 1, bool)  # the last place stands for other words
            self.is_prefix[block][list(postings)] = True

    def ranks(self, words: list[bytes]) -> np.ndarray:
        get = self.rank.get
        return np.fromiter([get(w, -1) for w in words], np.int32, len(words))

    def matches(self, ranks: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first word of the block, overlap)."""
        for block, postings in self.postings.items():
            at, step = np.flatnonzero(self.is_prefix[block][ranks]), block // 2
            for k in np.unique(np.concatenate((at // step, np.maximum(at // step - 1, 0)))).tolist():
                own = np.unique(ranks[k * step : k * step + block])
                own = own[own >= 0].tolist()
                tried = set()
                for j, token in enumerate(own):
                    for number, i in postings.get(token, ()):
                        need = self.templates[number].need
                        if number in tried or len(own) < need or min(len(self.lists[number]) - i, len(own) - j) < need:
                            continue
                        tried.add(number)
                        overlap = len(self.sets[number].intersection(own))
                        if overlap >= need:
                            yield number, k * step, overlap

    def places(self, number: int, ranks: np.ndarray, first: int) -> np.ndarray:
        """Where the words of a template stand in sequence in the block, starts of the next block left out."""
        seq = self.sequences[number]
        block = ranks[first : first + self.templates[number].block // 2 + len(seq) - 1]
        n = len(block) - len(seq) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        ok = np.ones(n, bool)
        for i, token in enumerate(seq.tolist()):
            ok &= block[i : i + n] == token
        return np.flatnonzero(ok) + first

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], set[str], float, list[tuple[int, int, str, float]]]:
        """-> words, places of phrases, labels of phrases, all labels, score, spans (first, last word, label, share)."""
        words = words_of(text)
        ranks = self.ranks(words)
        places, base, labels, score, spans = [], set(), set(), 0.0, []
        for number, first, overlap in self.matches(ranks):
            t = self.templates[number]
            if t.phrase:
                found = self.places(number, ranks, first).tolist()
                places += found
                spans += [(p, p + len(t.words) - 1, t.label, 1.0) for p in found]
                if found:
                    base.add(t.label)
                    score = 1.0
            else:
                share = overlap / len(t.tokens)
                labels.add(t.label)
                score = max(score, share)
                spans.append((first, min(first + t.block, len(words)) - 1, t.label, share))
        return len(words), places, base, labels | base, score, spans


def frequencies(docs: DataFrame, templates: list[Template]) -> dict[bytes, int]:
    """How often the templates' words stand in all texts; one row per template word comes back."""
    index = Index(templates, {})
    vocabulary = list(index.rank)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        n = np.zeros(len(vocabulary) + 1, np.int64)
        for t in batch.column(0):
            n += np.bincount(index.ranks(words_of(t.as_py())) + 1, minlength=len(n))
        at = np.flatnonzero(n[1:])
        return {"word": at, "n": n[1:][at]}

    counts = map_batches(docs.select(text_bytes(F.col("text")).alias("text")), run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {vocabulary[r["word"]]: r["n"] for r in counts.collect()}


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """-> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    templates = templates or make_templates()
    index = Index(templates, frequencies(docs, templates))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        cols: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for t in batch.column(1):
            n, places, base, labels, score, spans = index.scan(t.as_py())
            row = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
            for c, v in zip(cols, (*row, [dict(zip(("first", "last", "label", "share"), s, strict=True)) for s in spans]), strict=True):
                cols[c].append(v)
        return cols | {"doc_id": batch.column(0)}

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<first bigint, last bigint, label string, share double>>"
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text")), run, schema)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases, labels and score."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    values = ", ".join(f"('{' '.join(w.decode() for w in t.words)}', '{t.label}', {len(t.tokens)}, {t.need}, {str(t.phrase).lower()}, {t.block})" for t in make_templates())
    return (
        r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents
), t(txt, label, n, need, phrase, size) AS (VALUES """
        + values
        + r"""), p AS (
  SELECT txt, label, n, need, phrase, size, string_split(txt, ' ') AS ws, list_distinct(string_split(txt, ' ')) AS own FROM t
), b AS (
  SELECT r, size, unnest(range(0, len(w), size // 2)) AS first, w FROM d, (SELECT DISTINCT size FROM p WHERE NOT phrase)
), bl AS (
  SELECT r, size, list_distinct(w[first + 1:first + size]) AS ws FROM b
), m AS (
  SELECT r, label, len(list_intersect(own, bl.ws)) / n::DOUBLE AS share
  FROM bl JOIN p ON bl.size = p.size WHERE NOT phrase AND len(list_intersect(own, bl.ws)) >= need
), ph AS (
  SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(ws)] = ws)) AS place FROM d, p WHERE phrase
), ba AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ph GROUP BY r
), al AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT r, label, share FROM m UNION ALL SELECT r, label, 1.0 FROM ph) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN ba USING (r) LEFT JOIN al USING (r)
"""
    )


OP1_SQL = _sql()
