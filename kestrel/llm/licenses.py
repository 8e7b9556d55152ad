"""Licence scan with a generalised suffix automaton of licence texts.

All templates' words go into one automaton, which knows every run of words of
every template. A document's words are streamed through it: at each word it gives
the longest run ending there that some template has (the matching statistics).
Runs of ``LEAST_RUN`` words or more that go on in neither direction are matches; those
that follow each other in the document and in a template alike are chained into a
span, and a span that covers enough of its template is a finding, so changed
names, years or versions don't hide a licence.

Words that no template has end every run, so only stretches of known words are
streamed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

LEAST_RUN = 4
#: A span covers this share of its template's words at least ...
LEAST_COVER = 0.6
#: ... and skips so many words between two matches at most.
MOST_GAP = 24

# The base phrases, and words of well-known public licence notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and
     associated documentation files the software to deal in the software without restriction including without
     limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"""),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in
     compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"""),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu
     general public license as published by the free software foundation either version"""),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided
     that the following conditions are met"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is
     hereby granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)

# ASCII letters and digits and all bytes from 0x80 on make words
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of ASCII letters and digits and of
    characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton: a state for each class of runs that end at the
    same places of the templates."""

    def __init__(self, templates: list[list[int]]):
        self.templates = templates
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends.setdefault(last, []).append((k, i))
        # places of a state are also those of the states its suffix links reach
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for state, places in ends.items():
            while state > 0 and self.size[state] >= LEAST_RUN:
                self.ends[state] += places
                state = self.link[state]

    def _new(self, size: int, link: int, arcs: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(dict(arcs))
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for runs of p followed by w, parted from q if q has longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(self.size[p] + 1, self.link[q], self.next[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier template has this run
            return self._split(last, w, self.next[last][w])
        state, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, self.next[p][w])
        return state

    def matches(self, words: list[int], offset: int):
        """(end in the document, words, (template, place of its last word)) of the
        runs of ``LEAST_RUN`` words or more that go on in neither direction. The
        longest run's places come first, then those that only its ends have."""
        state, run = 0, 0
        for i, w in enumerate([*words, -1]):
            s, size, seen = state, run, set()
            while size >= LEAST_RUN:
                for k, at in self.ends[s]:
                    if (k, at) not in seen:
                        seen.add((k, at))
                        if at + 1 == len(self.templates[k]) or self.templates[k][at + 1] != w:
                            yield offset + i, size, (k, at)
                s = self.link[s]
                size = self.size[s]
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1


@dataclass(frozen=True)
class Span:
    label: str
    template: int
    start: int  # first word in the document
    end: int  # word after the last
    cover: float  # share of the template's words


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.labels = [x[0] for x in templates]
        words = [words_of(x[1]) for x in templates]
        self.sizes = [len(x) for x in words]
        self.number = {w: i for i, w in enumerate(sorted({w for x in words for w in x} | {b"mit", b"apache", b"general", b"public", b"license"}))}
        self.automaton = SuffixAutomaton([[self.number[w] for w in x] for x in words])
        self.phrases = [([self.number[w] for w in words_of(p)], label) for p, label in PHRASES.items()]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int32)

    def base(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of every place where a phrase's words stand in a row."""
        out = []
        last = np.nonzero(ids == self.number[b"license"])[0]
        for i in last.tolist():
            for phrase, label in self.phrases:
                at = i - len(phrase) + 1
                if at >= 0 and ids[at:i + 1].tolist() == phrase:
                    out.append((at, label))
        return out

    def spans(self, ids: np.ndarray) -> list[Span]:
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.nonzero(known[1:] != known[:-1])[0]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= LEAST_RUN:
                for end, size, (k, i) in self.automaton.matches(ids[a:b].tolist(), a):
                    found.setdefault(k, []).append((end - size, i - size + 1, size))
        chains = [x for k, runs in found.items() for x in self._chain(k, sorted(set(runs)))]
        # where spans overlap, that with the most words of its template stands
        out: list[Span] = []
        for x in sorted(chains, key=lambda x: (-round(x.cover * self.sizes[x.template]), -x.cover, x.start, x.template)):
            if not any(x.start < y.end and y.start < x.end for y in out):
                out.append(x)
        return sorted(out, key=lambda x: x.start)

    def _chain(self, k: int, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Runs (document place, template place, words) that go on in both are put
        together greedily, from left to right."""
        out, open_ = [], None
        for d, t, size in runs:
            if open_:
                start, doc_end, tem_end, cover = open_
                skip = max(0, doc_end - d, tem_end - t)
                if d + size > doc_end and t + size > tem_end and skip < size and d - doc_end <= MOST_GAP:
                    open_ = (start, d + size, t + size, cover + size - skip)
                    continue
                out.append(open_)
            open_ = (d, d + size, t + size, size)
        if open_:
            out.append(open_)
        return [Span(self.labels[k], k, a, b, c / self.sizes[k]) for a, b, _, c in out if c / self.sizes[k] >= LEAST_COVER]


@lru_cache(maxsize=2)
def scanner() -> Scanner:
    return Scanner()


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, start, end, cover): every template span found, in words from 0."""
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        s = scanner()
        for b in slices(batches, 512):
            got = [(i, x) for i, t in enumerate(b.column(1).to_pylist()) for x in s.spans(s.numbers(words_of(t)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.array([x.label for _, x in got], pa.string()),
                 pa.array([x.start for _, x in got], pa.int64()), pa.array([x.end for _, x in got], pa.int64()),
                 pa.array([x.cover for _, x in got], pa.float64())], ["id", "label", "start", "end", "cover"])

    return src.mapInArrow(run, f"id {kind}, label string, start bigint, end bigint, cover double").withColumnRenamed("id", id_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for
    every row.

    n_base counts the places of all base phrases; first_word and last_word are
    their smallest and largest start (NULL without any). labels are the base ones
    and those of the template spans; score is the best span's share of its template,
    1 where a base phrase stands. NULL and empty texts have no words and no labels.
    """
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        s = scanner()
        for b in slices(batches, 512):
            cols = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                ids = s.numbers(words_of(t))
                base, spans = s.base(ids), s.spans(ids)
                at = [x for x, _ in base]
                own = {x for _, x in base}
                row = (len(ids), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                       ",".join(sorted(own | {x.label for x in spans})),
                       1.0 if base else max((min(1.0, x.cover) for x in spans), default=0.0))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], NAMES)

    return src.mapInArrow(run, f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                               "base_labels string, labels string, score double").withColumnRenamed("id", id_col)


NAMES = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
