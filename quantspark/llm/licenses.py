"""Licence scan: matching statistics against a generalised suffix automaton of licence tokens, chained into spans."""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantspark.llm.common import ALNUM_WORDS, WordHasher, bytes_of, groups_of_texts, joined, small_batches

# The base phrases of the contract and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices that licences ask to be put into works, as published, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the Software), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
)


@dataclass(frozen=True)
class LicenseConfig:
    #: Shortest match that is chained, in words; most words between two matches of a chain, in document and template.
    min_match: int = 4
    max_gap: int = 12
    #: Share of a template's words that a chain must cover.
    coverage: float = 0.6


def words_of(text: str) -> list[str]:
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


class SuffixAutomaton:
    """Generalised suffix automaton of several token sequences: the states are the classes of their substrings."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Of every state, the sequences it occurs in, each with the end of its first occurrence there.
        self.where: list[dict[int, int]] = [{}]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        # A second walk, when the states are final, marks every suffix of every prefix.
        for k, sequence in enumerate(sequences):
            state = 0
            for i, token in enumerate(sequence):
                state = self.next[state][token]
                at = state
                while at > 0 and k not in self.where[at]:
                    self.where[at][k] = i + 1
                    at = self.link[at]

    def _state(self, length: int, like: int | None = None) -> int:
        self.length.append(length)
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.where.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state for the substrings of ``q`` that ``p`` reaches; q itself if that is all of them."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # known from an earlier sequence
            return self._split(last, self.next[last][token], token)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][token], token)
        return new

    def stream(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each token, the state and length of the longest suffix that is a substring."""
        state = length = 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state, length = self.next[state][t], length + 1
            yield state, length


class LicenseScanner:
    def __init__(self, cfg: LicenseConfig = LicenseConfig(), templates=TEMPLATES, phrases=BASE_PHRASES) -> None:
        self.cfg, self.phrases = cfg, [(words_of(p), label) for p, label in phrases]
        self.templates = [(label, words_of(t)) for label, t in templates]
        sequences = [w for _, w in self.templates] + [w for w, _ in self.phrases]
        words = sorted({w for s in sequences for w in s})
        number = {w: i for i, w in enumerate(words)}
        self.coded = [[number[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(self.coded)
        self.hasher = WordHasher(ALNUM_WORDS)
        buf, _ = joined([w.encode() for w in words])
        hashes = self.hasher(buf)[2]
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.size = len(words)
        self.pairs = np.unique([a * self.size + b for s in self.coded for a, b in zip(s, s[1:], strict=False)])
        self.last_words = np.array([number[w[-1]] for w, _ in self.phrases])
        # Of every phrase, the states whose strings end in it (with at least its length matched).
        self.ends: dict[int, list[int]] = {}
        for k, (w, _) in enumerate(self.phrases):
            state = 0
            for x in w:
                state = self.automaton.next[state][number[x]]
            for v in range(1, len(self.automaton.link)):
                up = v
                while up > 0 and up != state:
                    up = self.automaton.link[up]
                if up == state:
                    self.ends.setdefault(v, []).append(k)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the words of the templates, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def runs(self, token: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words of one text that can hold a match: each two neighbours stand together in a template, and
        there are enough of them for a chained match or they hold the last word of a base phrase."""
        if len(token) < 2:
            return
        known = np.isin(token[:-1] * self.size + token[1:], self.pairs) & (token[:-1] >= 0) & (token[1:] >= 0) & (doc[:-1] == doc[1:])
        edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        ends_phrase = np.concatenate(([0], np.cumsum(np.isin(token, self.last_words))))
        use = (end - start >= self.cfg.min_match) | (ends_phrase[end] > ends_phrase[start + 1])
        yield from zip(start[use].tolist(), end[use].tolist(), strict=True)

    def matches(self, token: np.ndarray, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Of one stretch: base places (first word, phrase), and maximal matches (start, end, template, end there)."""
        places, found, before = [], [], None
        for i, (state, length) in enumerate(self.automaton.stream(token[start:end].tolist()), start):
            for k in self.ends.get(state, ()):
                n = len(self.phrases[k][0])
                if length >= n:
                    places.append((i - n + 1, k))
            if before and length <= before[2]:
                found.append(before)
            before = (i + 1, state, length) if length >= self.cfg.min_match else None
        if before:
            found.append(before)
        chainable = [
            (at - length, at, k, there)
            for at, state, length in found
            for k, there in self.automaton.where[state].items()
            if k < len(self.templates)
        ]
        return places, chainable

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of the template spans that enough matches cover.

        Matches of one template are chained while they go forward in both texts and leave small gaps.
        """
        out, gap = [], self.cfg.max_gap
        for k in sorted({m[2] for m in matches}):
            label, words = self.templates[k]
            chain = None
            for s, e, _, there in sorted(m for m in matches if m[2] == k):
                begin = there - (e - s)
                if chain and 0 <= s - chain[1] <= gap and -gap <= begin - chain[2] <= gap and begin >= chain[3]:
                    chain = [chain[0], e, there, begin, chain[4] + (e - s)]
                else:
                    if chain:
                        out.append((label, chain[0], chain[1], min(1.0, chain[4] / len(words))))
                    chain = [s, e, there, begin, e - s]
            if chain:
                out.append((label, chain[0], chain[1], min(1.0, chain[4] / len(words))))
        return [c for c in out if c[3] >= self.cfg.coverage]

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]]:
        """Of every text: number of words, base places (first word, phrase), template spans."""
        buf, at = joined(texts)
        start, _, hashes = self.hasher(buf)
        doc = np.searchsorted(at, start, side="right") - 1
        count = np.bincount(doc, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        token = self.tokens(hashes)
        places: dict[int, list] = {}
        matched: dict[int, list] = {}
        for a, b in self.runs(token, doc):
            d = int(doc[a])
            p, m = self.matches(token, a, b)
            places.setdefault(d, []).extend((i - int(first[d]), k) for i, k in p)
            matched.setdefault(d, []).extend((s - int(first[d]), e - int(first[d]), k, there) for s, e, k, there in m)
        return [(int(count[d]), places.get(d, []), self.chains(matched.get(d, []))) for d in range(len(texts))]


def scan_licenses(docs: DataFrame, cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row for each document.

    Every whole text (null: empty) streams through the automaton once. Base places are the phrases standing
    consecutively; spans are template stretches (label, first word, end, coverage) chained from long matches. score
    is 1 with a base phrase, else the best coverage, else 0. Empty texts have no words, places or labels; repeated
    rows repeat; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(cfg)
        for batch in batches:
            texts = bytes_of(batch.column(1))
            rows = []
            for a, b in groups_of_texts(texts):
                for n, places, spans in scanner.scan(texts[a:b]):
                    base = sorted({scanner.phrases[k][1] for _, k in places})
                    every = sorted({*base, *(s[0] for s in spans)})
                    at = [i for i, _ in places]
                    rows.append((
                        n, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every),
                        1.0 if base else max((s[3] for s in spans), default=0.0),
                        [{"label": s[0], "first": s[1], "end": s[2], "coverage": s[3]} for s in spans],
                    ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:int,end:int,coverage:double>>",
    )
