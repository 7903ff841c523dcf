"""Licence scans with a generalised suffix automaton.

One automaton holds the words of all licence templates and of the plain phrases. A
document's words are streamed through it and give, at every word, the longest
stretch of templates that ends there. Plain phrases are read off these
statistics; stretches of ``least`` words or more that can't be continued are chained, in
the order of a template and with gaps of at most ``gap`` words, to spans of the document.
A span that covers ``cover`` of its template gives the template's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import as_bytes, modest_batches, ship, small_batches

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Characteristic passages of public licences.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
    "license, visit http://creativecommons.org/licenses/by/4.0/",
}
GAP_BYTES = bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122))
SPACED = bytes(32 if i in GAP_BYTES else i for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only): ASCII letters and digits and whatever is not ASCII."""
    return (text or b"").lower().translate(SPACED).split()


@dataclass
class Automaton:
    """States have transitions by word number, a suffix link, a length, and where in templates their words end."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    following: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.following.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _divided(self, state: int, word: int) -> int:
        """The target of a transition, divided first if it also stands for longer stretches."""
        target = self.following[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.following[target], self.link[target])
        self.link[target] = copy
        while state >= 0 and self.following[state].get(word) == target:
            self.following[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes], number: int) -> None:
        """Add a template; ``number`` below zero is a phrase, whose places are of no interest."""
        last = 0
        for place, raw in enumerate(words):
            word = self.vocabulary.setdefault(raw, len(self.vocabulary) + 1)
            if word in self.following[last]:
                last = self._divided(last, word)
            else:
                new, state = self._state(self.length[last] + 1, {}, 0), last
                while state >= 0 and word not in self.following[state]:
                    self.following[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._divided(state, word)
                last = new
            if number >= 0:
                self.ends[last].add((number, place + 1))

    def finish(self) -> None:
        """Hand the places of long stretches on to their suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def state_of(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.following[state][self.vocabulary[word]]
        return state


class Scanner:
    """Everything that a task needs to scan texts."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int, gap: int, cover: float):
        self.least, self.gap, self.cover = least, gap, cover
        self.labels = list(templates)
        texts = [words_of(t.encode()) for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton()
        for number, words in enumerate(texts):
            self.automaton.add(words, number)
        split = {p: words_of(p.encode()) for p in phrases}
        for words in split.values():
            self.automaton.add(words, -1)
        self.automaton.finish()
        own: dict[int, list[tuple[int, str]]] = {}
        for phrase, words in split.items():
            own.setdefault(self.automaton.state_of(words), []).append((len(words), phrases[phrase]))
        self.phrases = []
        for state in range(len(self.automaton.length)):
            found = []
            while state > 0:
                found += own.get(state, [])
                state = self.automaton.link[state]
            self.phrases.append(tuple(found))

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Places (start, label) of phrases, and long stretches (end, length, state) that no next word continues."""
        following, link, length = self.automaton.following, self.automaton.link, self.automaton.length
        known, phrases = self.automaton.vocabulary.get, self.phrases
        base, stretches = [], []
        state = size = 0
        for at, word in enumerate(map(known, words)):
            if word is None:
                if size >= self.least:
                    stretches.append((at, size, state))
                state = size = 0
                continue
            if word not in following[state]:
                if size >= self.least:
                    stretches.append((at, size, state))
                while state and word not in following[state]:
                    state = link[state]
                    size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
            for count, label in phrases[state]:
                if count <= size:
                    base.append((at + 1 - count, label))
        if size >= self.least:
            stretches.append((len(words), size, state))
        return base, stretches

    def spans(self, stretches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share of the template) of chains; a chain ends where nothing follows within the gap."""
        found, chains = [], {}
        for end, size, state in stretches:
            start = end - size
            for number, place in self.automaton.ends[state]:
                first = place - size
                live = [c for c in chains.get(number, []) if start - c[1] <= self.gap]
                found += [(self.labels[number], c[0], c[1], c[3] / self.sizes[number]) for c in chains.get(number, []) if start - c[1] > self.gap]
                best = max((c for c in live if c[2] <= first and c[1] <= end), key=lambda c: c[3], default=None)
                if best:
                    live.remove(best)
                    live.append((best[0], end, place, best[3] + size))
                else:
                    live.append((start, end, place, size))
                chains[number] = live
        found += [(self.labels[n], c[0], c[1], c[3] / self.sizes[n]) for n, live in chains.items() for c in live]
        return sorted(s for s in found if s[3] >= self.cover)

    def scan(self, text: bytes | None) -> dict[str, object]:
        words = words_of(text)
        base, stretches = self.matches(words)
        spans = self.spans(stretches)
        starts = [at for at, _ in base]
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": sorted({label for _, label in base}),
            "spans": [dict(zip(("label", "start", "end", "share"), s)) for s in spans],
        }


FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "spans array<struct<label:string,start:long,end:long,share:double>>"
)
ARROW = pa.struct(
    [
        *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
    ]
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    least: int = 5,
    gap: int = 20,
    cover: float = 0.5,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, spans) of every row.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are the
    smallest and largest (null if there is none); ``spans`` are places of templates
    in words of the text. Null and empty texts have no words.
    """
    given = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, least, gap, cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*given)
        for batch in small_batches(batches):
            found = pa.array([scanner.scan(t) for t in as_bytes(batch.column(1))], ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], ["doc_id", *(f.name for f in ARROW)])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return modest_batches(texts).mapInArrow(run, f"doc_id {kind}, {FOUND}")


ship(__name__)
