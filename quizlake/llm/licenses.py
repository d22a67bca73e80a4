"""Licence scans by a generalised suffix automaton (operator 12).

The words of all licence templates go into one suffix automaton (``Automaton``). A
text is streamed through it: after each word, the state and length say the longest
run of words that ends there and stands in some template (matching statistics).
Runs that cannot be extended and are long enough are matches; matches of one
template that follow each other in the text and in the template, with few words
between, are chained (``chains``), and a chain that covers enough of its template
is a span with that template's label. Phrases go through the same automaton: a
phrase stands wherever the current run ends with it.

Texts are cut into words in C and looked up as arrays; only where two neighbouring
words are neighbours in a template does the automaton walk.

Defined cases: a null or empty text has no words, no labels and score 0; repeated
rows are scanned each; a template or phrase needs two words; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_table, map_arrow, pieces, small_parts

#: Letters, digits, and every character beyond ASCII; A-Z are lower-cased.
FOLD = fold_table(lambda b: b >= 0x80 or chr(b).isalnum())

# FIXED VALUES: how public licences are named, announced and worded.
NAMES = {"apache-2.0": ["apache license version 2 0"], "bsd": ["bsd license", "bsd 2 clause license", "bsd 3 clause license"],
         "cc0-1.0": ["cc0 1 0"], "cc-by-4.0": ["cc by 4 0"], "cc-by-nc-4.0": ["cc by nc 4 0"], "cc-by-nd-4.0": ["cc by nd 4 0"],
         "cc-by-sa-4.0": ["cc by sa 4 0"], "gpl-2.0": ["gnu general public license version 2"],
         "gpl-3.0": ["gnu general public license version 3"], "lgpl-3.0": ["gnu lesser general public license version 3"],
         "agpl-3.0": ["gnu affero general public license version 3"], "mit": ["mit license"], "mpl-2.0": ["mozilla public license version 2 0"]}
LEADS = ["licensed under", "licensed under the", "released under", "released under the", "distributed under the"]
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
TEMPLATES = [(label, f"{lead} {name}") for label, names in NAMES.items() for name in names for lead in LEADS] + NOTICES

LEAST_RUN, MOST_GAP, LEAST_COVER = 4, 6, 0.8
SCANNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())])))])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences (each given as numbers)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, end) whose prefix this state stands for
        for k, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self._extend(state, word)
                self.ends[state].append((k, at + 1))
        self.below: list[list[int]] = [[] for _ in self.link]
        for s, up in enumerate(self.link[1:], 1):
            self.below[up].append(s)
        self._found: dict[int, list[tuple[int, int]]] = {}

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, before: int, word: int) -> int:
        """The state reached from ``before`` by ``word`` for strings one longer than
        those of ``before``: the next state itself or a copy of it cut to that length."""
        to = self.next[before][word]
        if self.length[to] == self.length[before] + 1:
            return to
        copy = self._new(self.length[before] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while before != -1 and self.next[before].get(word) == to:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # known from an earlier sequence
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last != -1:
            self.link[new] = self._split(last, word)
        return new

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state

    def places(self, state: int) -> list[tuple[int, int]]:
        """All (sequence, end) where the strings of a state end: its subtree of links."""
        if state not in self._found:
            out, open_states = [], [state]
            while open_states:
                s = open_states.pop()
                out += self.ends[s]
                open_states += self.below[s]
            self._found[state] = sorted(out)
        return self._found[state]

    def statistics(self, words: list[int]):
        """(state, length) after each word: the longest run of words that ends there
        and stands in a sequence."""
        state = length = 0
        edges, link, longest = self.next, self.link, self.length
        for word in words:
            while state and word not in edges[state]:
                state = link[state]
                length = longest[state]
            if word in edges[state]:
                state, length = edges[state][word], length + 1
            yield state, length


def chains(matches: list[tuple[int, int, int]], size: int, gap: int, least: float) -> list[tuple[int, int, float]]:
    """(start, end, share of the template covered) of the best chains that do not
    overlap, from matches (start and end in the text, start in a template of ``size``
    words). A match follows another if it is further on in both and at most ``gap``
    words lie between them in each; common words count once."""
    matches = sorted(set(matches))
    ends = [e for _, e, _ in matches]
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends with a match, its start
    reach = max((e - s for s, e, _ in matches), default=0)
    low = 0
    for k, (s, e, t) in enumerate(matches):
        covered, start = e - s, s
        while matches[low][0] + reach + gap < s:  # too far back for any later match
            low += 1
        for j in range(low, k):
            ps, pe, pt = matches[j]
            pt_end = pt + pe - ps
            if ps < s and pe < e and pt < t and pt_end < t + e - s and s - pe <= gap and t - pt_end <= gap:
                gain = e - s - max(0, pe - s, pt_end - t)
                if gain > 0 and best[j][0] + gain > covered:
                    covered, start = best[j][0] + gain, best[j][1]
        best.append((covered, start))
    out: list[tuple[int, int, float]] = []
    last_end = None
    for k in sorted(range(len(best)), key=lambda k: (best[k][1], -best[k][0], ends[k])):
        covered, start = best[k]
        if covered < least * size:
            continue
        if last_end is not None and start < last_end:
            if covered / size > out[-1][2]:
                out[-1], last_end = (out[-1][0], max(last_end, ends[k]), min(1.0, covered / size)), max(last_end, ends[k])
            continue
        out.append((start, ends[k], min(1.0, covered / size)))
        last_end = ends[k]
    return out


class Scanner:
    """The automaton of templates and phrases with all that a scan needs."""

    def __init__(self, templates, phrases, least_run: int, most_gap: int, least_cover: float):
        self.gap, self.cover = most_gap, least_cover
        texts = [words_of(t) for _, t in [*templates, *phrases]]
        if any(len(w) < 2 for w in texts):
            raise ValueError("a template or phrase has at least two words")
        self.codes = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        sequences = [[self.codes[w] for w in t] for t in texts]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences]
        self.least = [min(least_run, len(s)) for s in sequences]
        self.shortest = min(self.least, default=2)
        self.automaton = Automaton(sequences)
        follow = {a * len(self.codes) + b for s in sequences for a, b in zip(s, s[1:], strict=False)}
        self.follow = np.array(sorted(follow), dtype=np.int64)
        # phrases that end where a state's strings end: (least length, phrase)
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        self.phrases = [(label, len(s)) for (label, _), s in zip(phrases, sequences[len(templates):], strict=True)]
        for k, s in enumerate(sequences[len(templates):]):
            open_states = [self.automaton.state_of(s)]
            while open_states:
                state = open_states.pop()
                self.ending[state].append((len(s), k))
                open_states += self.automaton.below[state]

    def codes_of(self, text: str) -> np.ndarray:
        look = self.codes.get
        return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(look, w, repeat(-1)), np.int64, len(w))
                                                        for w in pieces(text.encode().translate(FOLD)))])

    def scan(self, text: str) -> tuple:
        """n_words, phrase places as (start, phrase), spans as (start, end, label, cover)."""
        code = self.codes_of(text)
        pair = code[:-1] * len(self.codes) + code[1:]
        at = np.minimum(np.searchsorted(self.follow, pair), max(0, len(self.follow) - 1))
        joined = (code[:-1] >= 0) & (code[1:] >= 0) & (self.follow[at] == pair) if len(self.follow) else np.zeros(len(pair), bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            run = code[s:e + 1].tolist()
            stats = [*self.automaton.statistics(run), (0, 0)]
            for k, (state, length) in enumerate(stats[:-1]):
                for need, phrase in self.ending[state]:
                    if length >= need:
                        places.append((s + k + 1 - need, phrase))
                if length >= self.shortest and stats[k + 1][1] <= length:  # cannot be extended
                    for sequence, end in self.automaton.places(state):
                        if sequence < len(self.labels) and length >= self.least[sequence]:
                            matches.setdefault(sequence, []).append((s + k + 1 - length, s + k + 1, end - length))
        spans = sorted((a, b, self.labels[t], c) for t, found in matches.items()
                       for a, b, c in chains(found, self.sizes[t], self.gap, self.cover))
        return len(code), places, spans


def _scan(batches, templates, phrases, least_run, most_gap, least_cover):
    scanner = Scanner(templates, phrases, least_run, most_gap, least_cover)
    for b in batches:
        for p in small_parts(b, 1):
            out = {n: [] for n in SCANNED.names}
            for key, text in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                n, places, spans = scanner.scan(text or "")
                starts = [s for s, _ in places]
                base = {scanner.phrases[k][0] for _, k in places}
                row = (key, n, len(places), min(starts, default=None), max(starts, default=None), sorted(base),
                       sorted(base | {label for _, _, label, _ in spans}), 1.0 if places else max((c for *_, c in spans), default=0.0),
                       [{"label": label, "start": s, "end": e, "cover": c} for s, e, label, c in spans])
                for name, value in zip(SCANNED.names, row, strict=True):
                    out[name].append(value)
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string())] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(SCANNED.names, kinds, strict=True)], names=SCANNED.names)


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str]] = TEMPLATES, least_run: int = LEAST_RUN,
                  most_gap: int = MOST_GAP, least_cover: float = LEAST_COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its words, the places of the ``phrases`` (label, words) and the
    first and last of them, the labels of phrases alone (base_labels) and of phrases
    and template spans (labels), score (1 with a phrase, else the largest share of a
    template that a span covers) and the spans (words from 0, end exclusive).

    Templates and phrases are a parameter of fixed size: they go to every task."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(rows, _scan, SCANNED, templates=list(templates), phrases=list(phrases), least_run=least_run, most_gap=most_gap,
                     least_cover=least_cover)
