"""Operator 2: licence scan by matching statistics over a suffix automaton.

The templates' words form one generalised suffix automaton. A file streams
through it once; at each word the automaton holds the longest run of words,
ending there, that stands in some template (the matching statistic). Runs of
``MIN_RUN`` words or more chain along one template: each next run starts within
``GAP`` words of the file and later in the template. A chain that covers
``MIN_COVER`` of its template, or ``LONG_COVER`` words of a long one, is a span
with the template's label, if at least one of its runs stands in no template of
another label: what licences share, such as their disclaimers, names none of them.

Base phrases are counted at all their places by an exact look at the words that
end one; a file that has one scores 1.

Defined results: null and empty texts have no words, no labels and score 0; a
text of any length is scanned whole; repeated rows get equal results; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import ship, table

MIN_RUN, GAP = 3, 8
MIN_COVER, LONG_COVER = 0.6, 24

#: phrases whose places are counted, and their labels (fixed values)
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# passages that several licences share (fixed values)
_AS_IS = (
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors {0}be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_GNU = (
    "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software "
    "foundation either version {2} of the license or at your option any later version this {0} is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1}general public license for more details you "
    "should have received a copy of the gnu {1}general public license along with this {0}"
)
#: texts and notices of licences, as words (fixed values)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software" + _AS_IS.format("or copyright holders "),
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", _GNU.format("program", "", "3")),
    ("gpl", _GNU.format("program", "", "2")),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", _GNU.format("library", "lesser ", "2 1")),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", _GNU.format("program", "affero ", "3")),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
        "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims "
        "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
        "or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not "
        "be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment "
        "in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and "
        "must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    ),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any "
        "means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law" + _AS_IS.format(""),
    ),
)

# bytes that are no word characters become blanks
_BLANK = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANK).split()


@dataclass
class SuffixAutomaton:
    """A generalised suffix automaton of sequences; every state knows where its words end."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for ``w`` after ``p`` that holds nothing longer than that."""
        q = self.step[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, name: int, words: list[int]) -> None:
        """Insert a sequence from the root."""
        last = 0
        for at, w in enumerate(words):
            if w in self.step[last]:
                last = self._split(last, w)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and w not in self.step[p]:
                    self.step[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, w)
                last = new
            self.ends[last].append((name, at + 1))

    def close(self) -> SuffixAutomaton:
        """Hand the end places down the suffix links."""
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        self.ends = [sorted(set(e)) for e in self.ends]
        return self


class LicenceScanner:
    """Finds covered spans of templates in files."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [(label, text.encode().split()) for label, text in templates]
        self.base = [(text.encode().split(), label) for text, label in base]
        self.by_last: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for words, label in self.base:
            self.by_last.setdefault(words[-1], []).append((words, label))
        self.vocab: dict[bytes, int] = {}
        for _, words in self.templates:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        self.automaton = SuffixAutomaton()
        for k, (_, words) in enumerate(self.templates):
            self.automaton.add(k, [self.vocab[w] for w in words])
        self.automaton.close()
        #: by state: whether all templates that have its words are of one label
        self.own = [len({self.templates[t][0] for t, _ in e}) == 1 for e in self.automaton.ends]

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Maximal runs (end, words, state) of ``MIN_RUN`` words or more, in order."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        state = run = 0
        before = -1
        least = MIN_RUN
        get = self.vocab.get
        for at, w in enumerate(map(get, words)):
            if w is None:
                continue
            if at != before + 1:
                if run >= least:
                    yield before + 1, run, state
                state = run = 0
            before = at
            nxt = step[state].get(w)
            if nxt is not None:
                state, run = nxt, run + 1
                continue
            if run >= least:
                yield at, run, state
            while state and w not in step[state]:
                state = link[state]
            run = length[state]
            if w in step[state]:
                state, run = step[state][w], run + 1
        if run >= least:
            yield before + 1, run, state

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, coverage) of accepted chains."""
        chains: dict[int, list[int]] = {}
        found = []

        def close(t: int) -> None:
            start, end, _, covered, own = chains.pop(t)
            size = len(self.templates[t][1])
            if own and (covered >= MIN_COVER * size or covered >= LONG_COVER):
                found.append((t, start, end, min(1.0, covered / size)))

        for end, run, state in self.runs(words):
            own = self.own[state]
            for t, place in self.automaton.ends[state]:
                chain = chains.get(t)
                if chain and end - run - chain[1] <= GAP and place > chain[2]:
                    fresh = min(run, end - chain[1], place - chain[2])
                    if fresh > 0:
                        chain[1], chain[2], chain[3], chain[4] = end, place, chain[3] + fresh, chain[4] or own
                        continue
                if chain:
                    if chain[1] >= end:  # an earlier place of the same words
                        continue
                    close(t)
                chains[t] = [end - run, end, place, run, own]
        for t in list(chains):
            close(t)
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        out = []
        for last, phrases in self.by_last.items():
            at = -1
            for _ in range(words.count(last)):
                at = words.index(last, at + 1)
                for phrase, label in phrases:
                    first = at - len(phrase) + 1
                    if first >= 0 and words[first : at + 1] == phrase:
                        out.append((first, label))
        return sorted(out)


@lru_cache(1)
def default_scanner() -> LicenceScanner:
    """The scanner of ``TEMPLATES`` and ``BASE``."""
    return LicenceScanner()


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))


def scan(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, places, spans) of every file; ``places`` are those of base phrases."""
    ship(files.sparkSession)
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = default_scanner()
        for b in batches:
            n, places, spans = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                n.append(len(words))
                places.append([{"label": x, "first": i} for i, x in scanner.base_places(words)])
                spans.append([{"label": scanner.templates[t][0], "first": a, "end": e, "coverage": c} for t, a, e, c in scanner.spans(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, _SPANS)], names=["id", "n_words", "places", "spans"])

    rows = files.select(F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(
        run,
        "id bigint, n_words bigint, places array<struct<label:string,first:bigint>>, "
        "spans array<struct<label:string,first:bigint,end:bigint,coverage:double>>",
    )
    return got.withColumnRenamed("id", key)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence places and labels of all documents."""
    first = F.col("places.first")
    base = F.col("places.label")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.col("spans.label")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
        "spans",
    )
