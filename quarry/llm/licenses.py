"""License scans: templates with optional and replaceable regions as automata over words.

A template is wording in the markup of license lists: ``<<beginOptional>>`` to
``<<endOptional>>`` may be absent, ``<<var;name="x";match="...">>`` stands for other
words. All templates are compiled into one automaton over words; its sets of
states are made when first reached. It starts where two words can open a template, and
a template is accepted where all its mandatory wording matches word for word.
Case, punctuation and white space don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import flat
from quarry.session import table

#: Bytes that part words: ASCII without digits and letters. Upper case is looked at as lower case.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = False
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r'<<(beginOptional|endOptional|var)((?:;\w+=(?:"[^"]*"|[^;">]*))*)>>')
_MATCH = re.compile(r'match="([^"]*)"')
#: Words that an unbounded replaceable region takes at most, and sets of states that are kept.
GAP, KEPT = 60, 50_000

#: Phrases of the base labels. Fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_GRANT = '<<var;name="how";match="released|licensed|distributed|available|published">> under <<beginOptional>>the terms of <<endOptional>>the '
_GNU = '<<beginOptional>>as published by the Free Software Foundation <<beginOptional>>either <<endOptional>><<endOptional>><<beginOptional>>version <<endOptional>>'
_CC = 'licensed under <<var;name="article";match="a|the">> Creative Commons '
_CC_END = ' <<var;name="version";match="1|2|3|4">> <<var;name="minor";match="0|5">>'
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY <<var;name="who";match=".{1,20}">> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED '
)
_BSD = (
    "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    '<<beginOptional>>1 <<endOptional>>Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer '
    '<<beginOptional>>2 <<endOptional>>Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution '
)
#: Wording of public licenses and of the notices that point to them. Fixed values.
TEMPLATES = (
    ("mit", 'Permission is hereby granted free of charge to any person obtaining a copy of <<var;name="what";match="this software|this software and associated documentation files">> <<beginOptional>>the Software <<endOptional>>to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions The above copyright notice and this permission notice <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial portions of the Software'),
    ("mit", _GRANT + "MIT License"),
    ("apache-2", 'Licensed under the Apache License Version 2 0 the License you may not use this <<var;name="what";match="file|work|software|project">> except in compliance with the License You may obtain a copy of the License at'),
    ("apache-2", _GRANT + "Apache License <<beginOptional>>Version <<endOptional>>2 0"),
    ("bsd-2-clause", _BSD + _AS_IS),
    ("bsd-3-clause", _BSD + '<<beginOptional>>3 <<endOptional>>Neither the name of <<var;name="who";match=".{1,20}">> may be used to endorse or promote products derived from this software without specific prior written permission <<beginOptional>>' + _AS_IS + "<<endOptional>>"),
    ("isc", 'Permission to use copy modify and <<beginOptional>>or <<endOptional>>distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies'),
    ("zlib", "This software is provided as is without any express or implied warranty In no event will the authors be held liable for any damages arising from the use of this software Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl-2", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License " + _GNU + "2"),
    ("gpl-3", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License " + _GNU + "3"),
    ("gpl-3", 'redistribute it and or modify it under the terms of the GNU General Public License <<beginOptional>>as published by the Free Software Foundation <<endOptional>>either version 3'),
    ("lgpl-3", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU Lesser General Public License " + _GNU + "3"),
    ("agpl-3", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU Affero General Public License " + _GNU + "3"),
    ("mpl-2", 'This Source Code Form is subject to the terms of the Mozilla Public License v 2 0'),
    ("cc0", 'To the extent possible under law <<var;name="who";match=".{1,20}">> has waived all copyright and related or neighboring rights to'),
    ("cc-by", _CC + "Attribution" + _CC_END),
    ("cc-by-sa", _CC + "Attribution <<var;name=\"form\";match=\"ShareAlike|Share Alike\">>" + _CC_END),
    ("cc-by-nd", _CC + "Attribution <<var;name=\"form\";match=\"NoDerivatives|NoDerivs|No Derivatives\">>" + _CC_END),
    ("cc-by-nc", _CC + 'Attribution <<var;name="form";match="NonCommercial|Non Commercial">>' + _CC_END),
    ("cc-by-nc", "licensed under <<beginOptional>>the <<endOptional>>CC BY NC" + _CC_END),
    ("cc-by", "licensed under <<beginOptional>>the <<endOptional>>CC BY" + _CC_END),
    ("cc-by-sa", "licensed under <<beginOptional>>the <<endOptional>>CC BY SA" + _CC_END),
    ("mit", "SPDX License Identifier MIT"),
    ("apache-2", "SPDX License Identifier Apache 2 0"),
    ("bsd-3-clause", "SPDX License Identifier BSD 3 Clause"),
)


def words_in(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def parsed(template: str) -> list[tuple]:
    """Items of a template: ("word", w), ("any", least, most), ("one", [words, ...]) and ("optional", items).

    ``match`` of a replaceable region is ``.+``, ``.*`` or ``.{least,most}``, counted
    in words, or alternatives parted by ``|``. Optional regions can be nested.
    """
    open_items, at = [[]], 0
    for m in [*_MARKUP.finditer(template), None]:
        open_items[-1] += [("word", w) for w in words_in(template[at : m.start() if m else None])]
        if not m:
            break
        at = m.end()
        if m[1] == "beginOptional":
            open_items.append([])
        elif m[1] == "endOptional":
            if len(open_items) < 2:
                raise ValueError("an optional region ends that wasn't begun")
            inner = open_items.pop()
            open_items[-1].append(("optional", inner))
        else:
            given = _MATCH.search(m[2])
            value = given[1] if given else ".+"
            if bounds := re.fullmatch(r"\.(?:([*+])|\{(\d+),(\d*)\})", value):
                least = {"*": 0, "+": 1}[bounds[1]] if bounds[1] else int(bounds[2])
                open_items[-1].append(("any", least, int(bounds[3]) if bounds[3] else max(GAP, least)))
            else:
                open_items[-1].append(("one", [words_in(v) for v in value.strip("()").split("|")]))
    if len(open_items) > 1:
        raise ValueError("an optional region isn't ended")
    return open_items[0]


def mandatory(items: list[tuple]) -> int:
    """Words that a match must at least have as they are given."""
    return sum(1 if kind == "word" else min(map(len, rest[0])) if kind == "one" else 0 for kind, *rest in items)


class Automaton:
    """All templates at once; states are numbers, and a set of states is made when first reached."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.on: list[dict[str, list[int]]] = []
        self.any: list[list[int]] = []
        self.skip: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.labels, self.weights, starts = [], [], []
        for k, (label, text) in enumerate(templates):
            items = parsed(text)
            start = self._state()
            end = self._add(items, start)
            self.ends[end] = k
            self.labels.append(label)
            self.weights.append(mandatory(items))
            starts.append(start)
        self.known = {w for arcs in self.on for w in arcs}
        self.start = self._closed(starts)
        self.reached: dict[tuple, tuple[frozenset, tuple]] = {}
        if any(self.any[s] for s in self.start) or any(s in self.ends for s in self.start):
            raise ValueError("a template must begin with a word")
        #: Two words that can begin a template; None: any second word will do.
        self.openings = set()
        for w in {w for s in self.start for w in self.on[s]}:
            after, ends = self.step(self.start, w)
            if ends or any(self.any[s] for s in after):
                self.openings.add((w, None))
            else:
                self.openings |= {(w, v) for s in after for v in self.on[s]}

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.skip.append([])
        return len(self.on) - 1

    def _add(self, items: list[tuple], at: int) -> int:
        for kind, *rest in items:
            if kind == "word":
                to = self._state()
                self.on[at].setdefault(rest[0], []).append(to)
            elif kind == "optional":
                to = self._add(rest[0], at)
                last = self._state()
                self.skip[to].append(last)
                self.skip[at].append(last)
                to = last
            elif kind == "one":
                to = self._state()
                for words in rest[0]:
                    self.skip[self._add([("word", w) for w in words], at)].append(to)
            else:
                least, most = rest
                chain = [at] + [self._state() for _ in range(most)]
                to = self._state()
                for n, s in enumerate(chain):
                    if n < most:
                        self.any[s].append(chain[n + 1])
                    if n >= least:
                        self.skip[s].append(to)
            at = to
        return at

    def _closed(self, states: list[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: str) -> tuple[frozenset, tuple]:
        """The states behind ``word``, and the numbers of the templates that end there."""
        key = (states, word if word in self.known else None)
        if key not in self.reached:
            if len(self.reached) > KEPT:
                self.reached.clear()
            after = self._closed([t for s in states for t in (*self.on[s].get(word, ()), *self.any[s])])
            self.reached[key] = after, tuple(sorted({self.ends[s] for s in after if s in self.ends}))
        return self.reached[key]

    def matches(self, word, start: int, stop: int) -> dict[int, int]:
        """Of the templates that begin at ``start``, their last word but one; ``word`` gives a word by its place."""
        states, found = self.start, {}
        for i in range(start, stop):
            states, ends = self.step(states, word(i))
            if not states:
                break
            found |= dict.fromkeys(ends, i + 1)
        return found


@lru_cache(4)
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(templates)


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    return flat.span_hashes(np.frombuffer(b"".join(raw), np.uint8), (off[:-1], off[1:]), values=flat._TABLE[flat.LOWER])[0]


class Scanner:
    """Places of phrases and templates in the words of a batch of texts."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str]):
        self.automaton = automaton(templates)
        self.phrases = [(words_in(p), label) for p, label in phrases.items()]
        self.hashed = [_hash(words) for words, _ in self.phrases]
        pairs: dict[str, list] = {}
        for first, second in self.automaton.openings:
            pairs.setdefault(first, []).append(second)
        self.openings = [(h, None if None in pairs[w] else np.sort(_hash(pairs[w]))) for w, h in zip(pairs, _hash(list(pairs)), strict=True)]

    def scan(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Bounds of each text's words, places of phrases and of templates (first word, word behind, number)."""
        starts, ends, bounds = flat.spans(buf, off, BREAK)
        h = flat.span_hashes(buf, (starts, ends), values=flat._TABLE[flat.LOWER])[0]

        def word(i: int) -> str:
            return bytes(flat.LOWER[buf[starts[i] : ends[i]]]).decode()

        stop = np.repeat(bounds[1:], np.diff(bounds))  # of the text, for each word
        places = []
        for k, ((words, _), want) in enumerate(zip(self.phrases, self.hashed, strict=True)):
            at = np.flatnonzero(h == want[0])
            at = at[at + len(words) <= stop[at]]
            for n in range(1, len(words)):
                at = at[h[at + n] == want[n]]
            places += [(i, i + len(words), k) for i in at.tolist() if [word(j) for j in range(i, i + len(words))] == words]
        found = []
        for first, seconds in self.openings:
            at = np.flatnonzero(h == first)
            if seconds is not None:
                at = at[at + 1 < stop[at]]
                at = at[np.isin(h[at + 1], seconds)]
            for i in at.tolist():  # words are read again, so equal hashes of different words do no harm
                found += [(i, end, k) for k, end in self.automaton.matches(word, i, int(stop[i])).items()]
        return bounds, places, found


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, start long, stop long>>"


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each document (doc_id, text): its words, places of phrases, labels, score, and all matches of both kinds.

    Words are runs of digits, a to z and all beyond ASCII, with A to Z in lower
    case; places are numbers of words. A template's match is its longest from a
    start. ``score`` is 1 - 0.5 ** (w / 4) for the longest wording of w fixed words
    that was found, 0 without any. Null texts have no words; texts are scanned
    whole and in blocks; repeated rows are scanned each; a word where several
    templates begin gives each of them; other columns are ignored; no rows give
    none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        labels = [label for _, label in scanner.phrases], scanner.automaton.labels
        weights = [len(w) for w, _ in scanner.phrases], scanner.automaton.weights
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])
        for batch in flat.slices(batches, "text"):
            bounds, *both = scanner.scan(*flat.flat(batch.column(1)))
            rows = [([], []) for _ in range(batch.num_rows)]
            for kind, hits in enumerate(both):
                docs_of = np.searchsorted(bounds, [i for i, _, _ in hits], side="right") - 1
                for d, (i, end, k) in zip(docs_of.tolist(), hits, strict=True):
                    rows[d][kind].append((i - int(bounds[d]), end - int(bounds[d]), k))
            out = []
            for doc_id, n, (base, own) in zip(batch.column(0).to_pylist(), np.diff(bounds).tolist(), rows, strict=True):
                names = [{labels[kind][k] for _, _, k in hits} for kind, hits in enumerate((base, own))]
                most = max([0, *(weights[kind][k] for kind, hits in enumerate((base, own)) for _, _, k in hits)])
                at = [i for i, _, _ in base]
                matches = sorted({(i, end, labels[kind][k]) for kind, hits in enumerate((base, own)) for i, end, k in hits})
                out.append({
                    "doc_id": doc_id, "n_words": n, "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(names[0])), "labels": ",".join(sorted(names[0] | names[1])),
                    "score": 1 - 0.5 ** (most / 4), "matches": [{"label": x, "start": i, "stop": end} for i, end, x in matches],
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("matches")
