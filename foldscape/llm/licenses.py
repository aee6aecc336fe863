"""Licence scan by a generalised suffix automaton of licence words.

The automaton holds every template, word by word.  A text is streamed through it: at
each word the state is that of the longest run of words, ending here, that stands in
some template (matching statistics).  For templates of SHORT words or more, maximal runs of at least LONG words are chained,
in order in both texts with gaps of at most GAP words, by dynamic programming; such a template is found where a chain covers at
least COVERED of its words, a shorter one, in which each word may be the one that matters, where all its words stand.  Of
templates found at overlapping places the one that covers most words counts alone, so that a licence isn't taken for one whose
name is part of its own.  The phrases of the base are counted at each place where all their words stand.

Only pairs of neighbouring words that stand together in a template can be part of a run
of two or more, so other words only reset the automaton and are skipped at once.

Defined results: a null or empty text has no words and no labels, and score 0; repeated
documents are each scanned; a very long text is scanned whole, in pieces of its own.  Other columns pass through.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_from_text, chunks, flat
from .words import Vocabulary, word_list, words

SHORT = 20
LONG = 4
GAP = 12
COVERED = 0.7
#: Phrases that count wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Passages and names of public licences and notices, and their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0", "dedicated this work to the public domain by waiving all of his or her rights"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("artistic", "you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("artistic", "under the terms of the Artistic License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("agpl", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"),
    ("mit", "under the MIT License"),
    ("mit", "The MIT License"),
    ("isc", "under the ISC License"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("bsd", "under the BSD License"),
    ("apache-2.0", "Apache License 2.0"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("gpl", "GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License 2.0"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
    ("epl", "Eclipse Public License"),
    ("bsl-1.0", "Boost Software License"),
    ("artistic", "Artistic License 2.0"),
    ("unlicense", "released under the Unlicense"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc0", "Creative Commons Zero"),
]
#: Creative Commons: the conditions of each licence, in the words of its name and in its short form, and its versions.
CONDITIONS = {"by": ["Attribution"], "sa": ["ShareAlike", "Share Alike"], "nc": ["NonCommercial", "Non Commercial"], "nd": ["NoDerivatives", "NoDerivs", "No Derivatives"]}
LICENCES = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
VERSIONS = ["", "1.0", "2.0", "2.5", "3.0", "4.0"]


def creative_commons() -> list[tuple[str, str]]:
    """Every name and short form of these licences, with and without a version."""
    out = []
    for name in LICENCES:
        words_ = [" ".join(w) for w in itertools.product(*(CONDITIONS[c] for c in name.split("-")))]
        forms = [f"Creative Commons {w}" for w in words_] + ([f"CC {name}"] if name != "by" else [])
        out += [(f"cc-{name}", f"{form} {v}".strip()) for form in [*forms, f"CC {name}"] for v in VERSIONS if v or form in forms]
    return list(dict.fromkeys(out))


TEMPLATES = NOTICES + creative_commons()


@dataclass
class Automaton:
    """Of all templates, numbered in order; words are ids. State 0 is the empty run."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: (template, number of its words up to here) of the states' runs
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # the word is there already, from another template
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, word, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.ends[copy] = []
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    @classmethod
    def of(cls, templates: list[list[int]]) -> Automaton:
        out = cls()
        for t in templates:
            last = 0
            for w in t:
                last = out._extend(last, w)
        for k, t in enumerate(templates):
            state = 0
            for i, w in enumerate(t):
                state = out.next[state][w]
                at = state
                while at > 0:  # the state and its shorter runs end here
                    out.ends[at].append((k, i + 1))
                    at = out.link[at]
        return out

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run that ends here) at each word."""
        state, length = 0, 0
        for w in run:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(w, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        texts = [t for _, t in templates] + list(phrases)
        self.labels = [x for x, _ in templates] + list(phrases.values())
        self.n_templates = len(templates)
        lists = [word_list(t) for t in texts]
        self.vocabulary = Vocabulary(w for x in lists for w in x)
        ids = [[self.vocabulary.number[w] for w in x] for x in lists]
        self.sizes = [len(x) for x in ids]
        self.automaton = Automaton.of(ids)
        n = len(self.vocabulary) + 1
        self.pairs = np.zeros((n, n), dtype=bool)
        for x in ids:
            self.pairs[x[:-1], x[1:]] = True
        self.single = np.zeros(n, dtype=bool)
        for x in ids:
            self.single[x[0]] |= len(x) == 1
        #: for each state: what its runs and their ends, LONG or more words, match (template, words up to here, most words),
        #: whether one ends its template, and the phrases that end here (phrase, words)
        self.matches: list[list[tuple[int, int, int]]] = []
        self.complete: list[bool] = []
        self.phrase_ends: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.next)):
            most: dict[tuple[int, int], int] = {}
            at = state
            while at > 0:
                for place in self.automaton.ends[at]:
                    most.setdefault(place, self.automaton.length[at])
                at = self.automaton.link[at]
            self.matches.append([(k, i, n) for (k, i), n in most.items() if k < self.n_templates and (n >= LONG or i == self.sizes[k] <= n)])
            self.complete.append(any(i == self.sizes[k] for k, i, _ in self.matches[-1]))
            self.phrase_ends.append([(k, i) for (k, i), n in most.items() if k >= self.n_templates and i == self.sizes[k] <= n])

    def scan(self, run: list[int], start: int, base: list[tuple[int, int]], runs: list[tuple[int, int, int, int]]) -> None:
        """Adds (place, phrase) of phrases and (place, template, its place, length) of long maximal runs."""
        stats = list(self.automaton.statistics(run))
        for i, (state, length) in enumerate(stats):
            for k, size in self.phrase_ends[state]:
                if length >= size:
                    base.append((start + i + 1 - size, k))
            if self.matches[state]:
                maximal = i + 1 == len(stats) or stats[i + 1][1] <= length
                if maximal or self.complete[state]:
                    for k, end, most in self.matches[state]:
                        n = min(length, most, end)
                        if n == self.sizes[k] or n >= LONG and maximal or n >= LONG and end == self.sizes[k]:
                            runs.append((start + i + 1 - n, k, end - n, n))

    def chained(self, runs: list[tuple[int, int, int, int]]) -> tuple[dict[int, float], list[tuple[int, int, int, int]]]:
        """(the best share of each template that a chain of runs covers, where templates are found as (words, first, end, template)).

        A run follows another if it goes on behind it in both texts, with gaps of at most GAP words; where it begins
        ahead of the other's end, only its words behind that count.  Of the runs that one can follow, the best is taken.
        A short template's chains are single runs.
        """
        best: dict[int, int] = {}
        found: list[tuple[int, int, int, int]] = []
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # of each template: where a chain ends in both texts, its words and its start
        for place, k, at, length in sorted(runs):
            most, begin = length, place
            if self.sizes[k] >= SHORT:
                chains = [c for c in open_.get(k, ()) if c[0] >= place - GAP]
                for end, done, words_, start in chains:
                    cut = max(0, end - place, done - at)
                    if cut < length and place + cut - end <= GAP and at + cut - done <= GAP and words_ + length - cut > most:
                        most, begin = words_ + length - cut, start
                chains.append((place + length, at + length, most, begin))
                open_[k] = chains
            if most >= (COVERED if self.sizes[k] >= SHORT else 1) * self.sizes[k]:
                found.append((most, begin, place + length, k))
            best[k] = max(best.get(k, 0), most)
        return {k: min(1.0, n / self.sizes[k]) for k, n in best.items()}, found

    @staticmethod
    def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of found templates those that no other with more words overlaps (of equal ones the earlier), by place."""
        starts: list[int] = []
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], x[1], x[3])):
            i = bisect.bisect_left(starts, x[2])  # those that begin ahead of its end, apart from one another: the last ends last
            if i and kept[i - 1][2] > x[1]:
                continue
            i = bisect.bisect_left(starts, x[1])
            starts.insert(i, x[1])
            kept.insert(i, x)
        return kept


_scanners: dict = {}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score; license_spans: label:first word:end of what is found."""
    given = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_spans string"

    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        name = repr(given)
        if name not in _scanners:
            _scanners[name] = Scanner(*given)
        s = _scanners[name]
        for column in columns:
            data, offsets = flat(column)
            out: list[tuple] = []
            for i, j in chunks(offsets):
                off = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                w = words(part, off)
                ids = s.vocabulary.ids(w, part)
                counts = np.diff(w.first)
                doc = np.repeat(np.arange(j - i), counts)
                together = np.zeros(len(ids), dtype=bool)
                if len(ids) > 1:
                    together[1:] = s.pairs[ids[:-1], ids[1:]] & (doc[1:] == doc[:-1])
                joined = together.copy()
                joined[:-1] |= together[1:]
                joined |= s.single[ids]
                at = np.flatnonzero(joined)
                found: dict[int, tuple[list, list]] = {}
                if len(at):
                    cuts = np.flatnonzero(~together[at])
                    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                        d = int(doc[at[a]])
                        base, runs = found.setdefault(d, ([], []))
                        s.scan(ids[at[a] : at[a] + z - a].tolist(), int(at[a] - w.first[d]), base, runs)
                for d, n in enumerate(counts.tolist()):
                    base, runs = found.get(d, ([], []))
                    share, whole = s.chained(runs)
                    whole = s.apart(whole)
                    own = {s.labels[k] for _, k in base}
                    more = {s.labels[k] for *_, k in whole}
                    places = [p for p, _ in base]
                    spans = ",".join(f"{s.labels[k]}:{a}:{z}" for _, a, z, k in whole)
                    out.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if base else max(share.values(), default=0.0), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield [pa.array([r[c] for r in out], type=k) for c, k in enumerate(kinds)]

    return add_from_text(docs, work, schema, text_col)
