"""Licence scans: matching statistics against a generalised suffix automaton of licence words, chained into spans."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_rows, read, small, utf8

#: The phrases whose places are the base of every scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of common licences, as published with them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost-1", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Share of a template's words that a chain must cover for its label.
COVERED = 0.8
#: Words of a match that counts, and of the gap between chained matches.
SEED, GAP = 3, 32
_WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the places in sequences where each state's words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        at = []
        for k, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._extend(last, w)
                at.append((last, k, i))
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for k, sequence in enumerate(sequences):  # a state's words may have grown since: walk again
            v = 0
            for i, w in enumerate(sequence):
                v = self.next[v][w]
                self.ends[v].add((k, i))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.size[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]  # sequences that end here in full: (length, which)
        for k, sequence in enumerate(sequences):
            v = 0
            for w in sequence:
                v = self.next[v][w]
            self.whole[v].append((len(sequence), k))
        for v in sorted(range(1, len(self.next)), key=lambda v: self.size[v]):
            self.whole[v] = self.whole[v] + (self.whole[self.link[v]] if self.link[v] > 0 else [])

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, size: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return new

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest suffix that some sequence holds, word by word."""
        v, n = 0, 0
        for w in ids:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if w in self.next[v]:
                v, n = self.next[v][w], n + 1
            else:
                n = 0
            yield v, n


class Scanner:
    """What a text holds of PHRASES and TEMPLATES."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES):
        texts = [*((label, p) for p, label in phrases.items()), *templates]
        self.labels = [label for label, _ in texts]
        split = [words(t.encode()) for _, t in texts]
        self.phrases = len(phrases)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.sequences = [[self.vocabulary[w] for w in s] for s in split]
        self.lengths = [len(s) for s in self.sequences]
        self.automaton = Automaton(self.sequences)
        n = len(self.vocabulary)
        self.seeds = np.unique([(a * n + b) * n + c for s in self.sequences for a, b, c in zip(s, s[1:], s[2:])])

    def scan(self, text: bytes) -> dict:
        """n_words, base places and labels, and spans (label, first word, end word, covered share)."""
        w = words(text)
        out = {"n_words": len(w), "places": [], "spans": [], "score": 0.0}
        if len(w) < SEED:
            return out
        get = self.vocabulary.get
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        n = len(self.vocabulary)
        three = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        at = np.minimum(np.searchsorted(self.seeds, three), len(self.seeds) - 1)
        seeds = np.flatnonzero((self.seeds[at] == three) & (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0))
        if not len(seeds):
            return out
        # matches of SEED words or more lie within stretches of overlapping seeds
        breaks = np.flatnonzero(np.diff(seeds) > 1) + 1
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for part in np.split(seeds, breaks):
            first, end = int(part[0]), int(part[-1]) + SEED
            path = list(self.automaton.stream(ids[first:end].tolist()))
            for i, (v, size) in enumerate(path):
                if size < SEED:
                    continue
                for length, k in self.automaton.whole[v]:
                    if k < self.phrases and length <= size:
                        out["places"].append((first + i - length + 1, self.labels[k]))
                if i + 1 == len(path) or path[i + 1][1] <= size:  # it goes no further to the right
                    for k, last in self.automaton.ends[v]:
                        if last + 1 >= size:
                            matches[k].append((first + i + 1, last + 1, size))
        for k, found in matches.items():
            chains, best = self._chains(k, found)
            out["spans"] += [(self.labels[k], begin, end, share) for share, begin, end in chains]
            out["score"] = max(out["score"], best)
        return out

    def _chains(self, k: int, found: list[tuple[int, int, int]]) -> tuple[list[tuple[float, int, int]], float]:
        """The chains of sequence k that cover COVERED, best first and none over another, and the largest share of any chain."""
        taken: list[tuple[float, int, int]] = []
        most = 0.0
        pieces = [found]
        while pieces:
            found = pieces.pop()
            ends = self._chain(k, found)
            most = max(most, max(share for share, _, _ in ends))
            new: list[tuple[int, int]] = []  # in text order
            for share, begin, end in sorted((x for x in ends if x[0] >= COVERED), key=lambda x: (-x[0], x[2] - x[1], x[2])):
                at = bisect_left(new, (begin, end))
                if (not at or new[at - 1][1] <= begin) and (at == len(new) or end <= new[at][0]):
                    new.insert(at, (begin, end))
                    taken.append((share, begin, end))
            rest: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by the stretches before it
            for x in found if new else ():
                for y in self._outside(x, new):
                    rest[bisect_left(new, (y[0], 0))].append(y)
            pieces += rest.values()
        return taken, most

    def _outside(self, match: tuple[int, int, int], stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """The parts of SEED words or more of a match that lie in none of the stretches."""
        end, last, size = match
        begin = end - size
        at = max(bisect_left(stretches, (begin, 0)) - 1, 0)
        for first, after in [*takewhile(lambda x: x[0] < end, stretches[at : at + size + 2]), (end, end)]:
            if first - begin >= SEED:
                yield first, last - (end - first), first - begin
            begin = max(begin, after)

    def _chain(self, k: int, found: list[tuple[int, int, int]]) -> list[tuple[float, int, int]]:
        """(share, first word, end) at each match (text end, own end, length): most of sequence k that matches up to it cover in one order on both sides, gaps bounded; of equal ones the shortest."""
        found = sorted(set(found))
        best: list[tuple[int, int]] = []  # covered words, first word
        low = 0
        longest = max(size for _, _, size in found)
        for i, (end, last, size) in enumerate(found):
            top = (size, end - size)
            while found[low][0] < end - longest - GAP:
                low += 1
            for j in range(low, i):
                e, l, _ = found[j]
                new = min(size, end - e, last - l)  # words that j has not covered, on either side
                if new > 0 and end - new - e <= GAP:
                    top = max(top, (best[j][0] + new, best[j][1]))
            best.append(top)
        return [(n / self.lengths[k], first, end) for (n, first), (end, _, _) in zip(best, found)]


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for every row of docs(doc_id, text, ...): words, base places, labels, score and template spans.

    n_base counts the places of PHRASES, first_word and last_word are the first and last place (null without any),
    base_labels and labels are distinct, sorted and comma-joined; labels adds those of templates of which a chain
    covers COVERED. score is the largest share covered of any phrase or template. spans lists label:first:end in
    words, end exclusive, of every chain that covers COVERED; those of one template do not overlap, and of equal chains
    the shortest, then the first counts. A null or empty text has no words and score 0; a very long one is streamed
    through the automaton whole. Repeated rows keep a row each; other columns are not used; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        s = scanner()
        for b in small(batches):
            out = defaultdict(list)
            for text in utf8(b.column(1)):
                x = s.scan(text)
                places = [p for p, _ in x["places"]]
                base = {label for _, label in x["places"]}
                out["n_words"].append(x["n_words"])
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {label for label, *_ in x["spans"]})))
                out["score"].append(min(1.0, x["score"]))
                out["spans"].append(",".join(f"{label}:{i}:{j}" for label, i, j, _ in sorted(x["spans"], key=lambda z: (z[1], z[0]))))
            if b.num_rows:
                yield {"doc_id": b.column(0)} | out

    return map_rows(documents(docs), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string", run)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
