"""Licence scans: a generalised suffix automaton over the words of licence templates.

Each text is streamed through the automaton word by word, which gives at every word the longest run of words ending
there that some template holds (matching statistics). Matches that cannot be extended and are long enough are chained,
template by template, in the order of both text and template; a chain's words over the template's words are its
coverage, and all chains that do not overlap a better one of their template are spans. Templates are paragraphs, so a file
that holds part of a licence is found by that part. Base phrases are found at all their places, beside that.

A text without words (or null) has n_words 0, no label and score 0. Very long texts cost time in proportion; words that
no template holds end a match, so the automaton only walks over runs of template words. Repeated rows are scanned each
on its own. Of chains that tie the earlier is taken first. An empty table gives no rows. Only the text is read and the
columns to keep are passed on; others may have any names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and paragraphs of public licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
MIN_MATCH = 3  #: shortest match, in words, that enters a chain
MIN_COVERAGE = 0.75  #: share of a template that its chain must cover for the label
PHRASE_SCORE = 0.5  #: score of a text with a base phrase and no better coverage of a template
MAX_GAP = 12  #: words between two matches of a chain, in the text or the template

_WORD_BYTE = np.zeros(256, bool)
for _b in range(256):
    _WORD_BYTE[_b] = not (_b <= 0x2F or 0x3A <= _b <= 0x60 or 0x7B <= _b <= 0x7F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = np.random.default_rng(20).integers(0, 1 << 63, (64, 256), dtype=np.uint64)


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(0x41, 0x5B)})


def words_of(text: str) -> list[str]:
    return WORD.findall(lower_ascii(text))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word in UTF-8 `data`, lower-cased."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    here = np.flatnonzero(_WORD_BYTE[raw])
    if not len(here):
        return here, np.zeros(0, np.uint64)
    start = np.ones(len(here), bool)
    start[1:] = np.diff(here) > 1
    first = np.flatnonzero(start)
    place = np.arange(len(here)) - np.repeat(first, np.diff(np.append(first, len(here))))
    return here[first], np.add.reduceat(_MIX[place & 63, raw[here]], first)


@dataclass
class Automaton:
    """Generalised suffix automaton: states' transitions, links, longest lengths and, for long states, the ends of their
    occurrences as (template, index of the last word)."""

    step: list[dict[int, int]]
    link: list[int]
    size: list[int]
    ends: list[list[tuple[int, int]]]


def build(sequences: Sequence[Sequence[int]], min_match: int) -> Automaton:
    a = Automaton([{}], [-1], [0], [[]])

    def new(size: int, step: dict[int, int], link: int) -> int:
        a.step.append(step), a.size.append(size), a.link.append(link), a.ends.append([])
        return len(a.step) - 1

    def split(p: int, c: int) -> int:
        """The state for p's longest string and c, of exactly that length."""
        q = a.step[p][c]
        if a.size[q] == a.size[p] + 1:
            return q
        clone = new(a.size[p] + 1, dict(a.step[q]), a.link[q])
        a.link[q] = clone
        while p >= 0 and a.step[p].get(c) == q:
            a.step[p][c] = clone
            p = a.link[p]
        return clone

    for k, seq in enumerate(sequences):
        last = 0
        for i, c in enumerate(seq):
            if c in a.step[last]:
                last = split(last, c)
            else:
                cur, p = new(a.size[last] + 1, {}, 0), last
                while p >= 0 and c not in a.step[p]:
                    a.step[p][c] = cur
                    p = a.link[p]
                if p >= 0:
                    a.link[cur] = split(p, c)
                last = cur
            a.ends[last].append((k, i))
    for s in sorted(range(1, len(a.size)), key=lambda s: -a.size[s]):
        if a.size[a.link[s]] >= min_match:
            a.ends[a.link[s]] += a.ends[s]
    return a


def maximal_matches(a: Automaton, tokens: Sequence[int], min_match: int) -> list[tuple[int, int, int]]:
    """(index of the last token, length, state) of the matches that the next token does not extend."""
    found, state, size = [], 0, 0
    for i, c in enumerate(tokens):
        before = (state, size)
        while state and c not in a.step[state]:
            state = a.link[state]
            size = a.size[state]
        if c in a.step[state]:
            state, size = a.step[state][c], size + 1
        else:
            size = 0
        if size <= before[1] and before[1] >= min_match:
            found.append((i - 1, before[1], before[0]))
    if size >= min_match:
        found.append((len(tokens) - 1, size, state))
    return found


def chains(matches: list[tuple[int, int, int, int]], max_gap: int) -> list[tuple[int, int, int, int]]:
    """(template, first text word, last text word, words covered): of each template the best chain, then the next best that
    overlaps none before it, and so on; of equal ones the earlier.

    matches: (template, end in text, end in template, length). A chain goes forward in both; overlaps count once. A match
    looks back as far as a gap and the template's longest match reach, so time grows with the text and not with its square."""
    out: list[tuple[int, int, int, int]] = []
    by: dict[int, set[tuple[int, int, int]]] = {}
    for k, *rest in matches:
        by.setdefault(k, set()).add(tuple(rest))
    for k in sorted(by):
        own = sorted(by[k])
        reach = max_gap + max(m[2] for m in own)
        score, first = [m[2] for m in own], [m[0] - m[2] + 1 for m in own]
        low = 0
        for i, (te, pe, size) in enumerate(own):
            while own[low][0] < te - size - reach:
                low += 1
            for j in range(i - 1, low - 1, -1):
                t0, p0, _ = own[j]
                new = min(size, te - t0, pe - p0)
                if new > 0 and te - new - t0 <= max_gap and pe - new - p0 <= max_gap and score[j] + new > score[i]:
                    score[i], first[i] = score[j] + new, first[j]
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(own)), key=lambda i: (-score[i], own[i][0])):
            span = (first[i], own[i][0])
            at = bisect.bisect(taken, span)
            if (at and taken[at - 1][1] >= span[0]) or (at < len(taken) and taken[at][0] <= span[1]):
                continue
            taken.insert(at, span)
            out.append((k, *span, score[i]))
    return out


class Scanner:
    """Templates and phrases made ready for scanning; it travels to executors whole (its size is the templates')."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, *, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP):
        self.labels, self.min_match, self.min_coverage, self.max_gap = [label for label, _ in templates], min_match, min_coverage, max_gap
        split = [words_of(t) for _, t in templates]
        vocab = sorted({w for ws in [*split, *(words_of(p) for p in phrases)] for w in ws})
        hashes = np.array([hash_words(w.encode())[1][0] for w in vocab] or [0], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        number = {w: i + 1 for i, w in enumerate(vocab)}
        self.sizes = [len(ws) for ws in split]
        self.automaton = build([[number[w] for w in ws] for ws in split], min_match)
        self.phrases = [([number[w] for w in words_of(p)], label) for p, label in phrases.items()]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of template words, else 0."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        out[some] = np.where(self.hashes[at] == hashes[some], self.ids[at], 0)
        return out

    def scan(self, texts: list[str]) -> list[dict]:
        """For each text: n_words, base places [(word, label)], spans [(label, first, last, coverage)]."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
        first, hashes = hash_words(b"\n".join(coded))
        doc = np.searchsorted(ends, first, side="right")
        number = self.known(hashes)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = [{"n_words": int(n), "base": [], "matches": []} for n in np.diff(cut)]
        for words, label in self.phrases:
            hit = number == words[0]
            for k, w in enumerate(words[1:], 1):
                hit[: len(hit) - k] &= (number[k:] == w) & (doc[k:] == doc[:-k])
                hit[len(hit) - k :] = False
            for i in np.flatnonzero(hit):
                out[doc[i]]["base"].append((int(i - cut[doc[i]]), label))
        some = np.flatnonzero(number)
        if len(some):
            new = np.ones(len(some), bool)
            new[1:] = (np.diff(some) > 1) | (doc[some[1:]] != doc[some[:-1]])
            at = np.flatnonzero(new)
            runs = np.diff(np.append(at, len(some)))
            for a, n in zip(some[at[runs >= self.min_match]].tolist(), runs[runs >= self.min_match].tolist(), strict=True):
                d = int(doc[a])
                for end, size, state in maximal_matches(self.automaton, number[a : a + n].tolist(), self.min_match):
                    out[d]["matches"] += [(k, int(a + end - cut[d]), p, size) for k, p in self.automaton.ends[state]]
        for x in out:
            x["base"].sort()
            x["spans"] = [(self.labels[k], a, b, n / self.sizes[k]) for k, a, b, n in chains(x.pop("matches"), self.max_gap)]
        return out


def scan_licences(docs: DataFrame, scanner: Scanner, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of each row with n_words, base places and template spans."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(texts: list[str]) -> list[list]:
        found = [x for i, j in base.blocks(texts) for x in shared.value.scan(texts[i:j])]
        spans = [[{"label": s[0], "first": s[1], "last": s[2], "coverage": s[3]} for s in x["spans"]] for x in found]
        return [[x["n_words"] for x in found], [[{"word": w, "label": label} for w, label in x["base"]] for x in found], spans]

    return base.map_texts(docs, text, keep, "n_words long, base array<struct<word:long,label:string>>, spans array<struct<label:string,first:long,last:long,coverage:double>>", run)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(base.table(spark, sf_dir, "documents"), Scanner())
    sure = F.filter("spans", lambda s: s["coverage"] >= MIN_COVERAGE)
    base_labels, own = F.transform("base", lambda b: b["label"]), F.transform(sure, lambda s: s["label"])
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        names(base_labels).alias("base_labels"), names(F.concat(base_labels, own)).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0), F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))).alias("score"),
    )


QUERIES = {"op6_licences": op6_licences}
ORACLE_SQL: dict[str, str] = {}
