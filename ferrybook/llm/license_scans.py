"""License notices, by token automata compiled from templates with markup.

A template is a license text with marked regions: ``[[...]]`` may be missing,
``{{n}}`` stands for up to n words of any kind (a name, a year). All other words are
mandatory and must be there exactly and in order. Case and punctuation do not count,
as both sides are compared as words. Each template becomes an automaton over words;
it is run wherever its first words stand in a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrybook.llm.words import chunks, punctuation_table, split_words

# The base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Wording of public licenses and of the usual notices.
PERMISSION = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice [[(including the next paragraph)]] shall be included in all copies or substantial
portions of the Software. [[THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.]]
"""
REDISTRIBUTION = """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: [[1]] Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. [[2]] Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
NO_ENDORSEMENT = """
[[3]] Neither the name of {{12}} nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        """Licensed under the Apache License, Version 2.0 [[(the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0]]""",
    ),
    "bsd-2-clause": (REDISTRIBUTION,),
    "bsd-3-clause": (REDISTRIBUTION + NO_ENDORSEMENT,),
    "cc-by-4.0": ("Licensed under [[a]] CC BY 4.0", "Licensed under [[a]] Creative Commons Attribution 4.0"),
    "cc-by-nc-4.0": (
        "Licensed under [[a]] CC BY NC 4.0",
        "Licensed under [[a]] Creative Commons Attribution NonCommercial 4.0",
    ),
    "cc-by-sa-4.0": ("Licensed under [[a]] CC BY SA 4.0",),
    "gpl-2.0": (
        "licensed under the [[terms of the]] GNU General Public License [[as published by the Free"
        " Software Foundation;]] [[either]] version 2",
    ),
    "gpl-3.0": (
        "licensed under the [[terms of the]] GNU General Public License [[as published by the Free"
        " Software Foundation;]] [[either]] version 3",
        """redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License""",
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies""",
    ),
    "mit-notice": (
        "released under the [[terms of the]] MIT License",
        "licensed under the [[terms of the]] MIT License",
    ),
    "mit-text": (PERMISSION,),
}
SEPARATORS = punctuation_table()
MARKUP = re.compile(r"(\[\[|\]\]|\{\{\d+\}\})")


def word_hashes(text: str) -> list[int]:
    (chunk,) = chunks(pa.array([text]))
    return split_words(chunk, SEPARATORS).hashes.tolist()


class Automaton:
    """A template as sets of states, kept as the bits of integers.

    State i is left by reading a word: the one that leads out of it, or any word
    inside a replaceable region; ``free`` has the states reached without reading.
    """

    def __init__(self, template: str):
        self.reads: dict[int, int] = {}  # word -> states that read it
        self.any_word = 0
        jumps: dict[int, list[int]] = {}
        state, open_at = 0, None
        self.prefix: list[int] = []
        plain = True
        for part in MARKUP.split(template):
            if part == "[[":
                if open_at is not None:
                    raise ValueError("optional regions are not nested")
                open_at, plain = state, False
            elif part == "]]":
                if open_at is None:
                    raise ValueError("an optional region ends that was not begun")
                jumps.setdefault(open_at, []).append(state)
                open_at = None
            elif part.startswith("{{"):
                size, plain = int(part[2:-2]), False
                for i in range(size):
                    self.any_word |= 1 << state + i
                    jumps.setdefault(state + i, []).append(state + size)
                state += size
            elif part.strip():
                for word in word_hashes(part):
                    self.reads[word] = self.reads.get(word, 0) | 1 << state
                    state += 1
                    if plain:
                        self.prefix.append(word)
        if open_at is not None:
            raise ValueError("an optional region is not closed")
        if len(self.prefix) < 2:
            raise ValueError("a template begins with two mandatory words at least")
        self.final = 1 << state
        self.free = {}
        for start in sorted(jumps, reverse=True):
            reached = 0
            for to in jumps[start]:
                reached |= 1 << to | self.free.get(to, 0)
            self.free[start] = reached
        self.jumping = sum(1 << s for s in self.free)

    def closed(self, states: int) -> int:
        jumping = states & self.jumping
        while jumping:
            low = jumping & -jumping
            states |= self.free[low.bit_length() - 1]
            jumping ^= low
        return states

    def match(self, words: Sequence[int]) -> int:
        """Words of the longest match at the start of ``words``; 0 for none."""
        states, best = self.closed(1), 0
        for n, word in enumerate(words, 1):
            states = self.closed((states & (self.reads.get(word, 0) | self.any_word)) << 1)
            if not states:
                break
            if states & self.final:
                best = n
        return best


def _places(hashes: np.ndarray, words: Sequence[int]) -> np.ndarray:
    """Where these words stand one after the other."""
    n = len(hashes) - len(words) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ok = hashes[:n] == np.uint64(words[0])
    for i, word in enumerate(words[1:], 1):
        ok &= hashes[i : i + n] == np.uint64(word)
    return np.flatnonzero(ok)


def _scan(phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]]):
    base = [(word_hashes(phrase), label) for phrase, label in phrases.items()]
    automata = [(Automaton(t), label) for label, texts in templates.items() for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                words = split_words(chunk, SEPARATORS)
                found: dict[int, list[tuple[str, int, int, bool]]] = {}

                def add(at: int, size: int, label: str, is_base: bool) -> None:
                    row = int(np.searchsorted(words.offsets, at, side="right")) - 1
                    if at + size <= words.offsets[row + 1]:
                        start = at - int(words.offsets[row])
                        found.setdefault(row, []).append((label, start, size, is_base))

                for phrase, label in base:
                    for at in _places(words.hashes, phrase):
                        add(int(at), len(phrase), label, True)
                for automaton, label in automata:
                    for at in _places(words.hashes, automaton.prefix[:4]):
                        row = int(np.searchsorted(words.offsets, at, side="right")) - 1
                        # Read on demand: most runs end after a few words.
                        until = int(words.offsets[row + 1])
                        rest = (int(h) for h in words.hashes[at:until])
                        if size := automaton.match(rest):
                            add(int(at), size, label, False)
                n = len(chunk)
                sizes = np.diff(words.offsets)
                rows = [sorted(set(found.get(i, []))) for i in range(n)]
                starts = [[m[1] for m in row if m[3]] for row in rows]
                join = lambda labels: ",".join(sorted(set(labels)))
                covered = [len({w for _, a, s, _ in row for w in range(a, a + s)}) for row in rows]
                matches = [
                    [{"label": label, "start": a, "words": s} for label, a, s, is_base in row if not is_base]
                    for row in rows
                ]
                kind = pa.list_(
                    pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, n),
                        pa.array(sizes, pa.int64()),
                        pa.array([len(s) for s in starts], pa.int64()),
                        pa.array([min(s) if s else None for s in starts], pa.int64()),
                        pa.array([max(s) if s else None for s in starts], pa.int64()),
                        pa.array([join(m[0] for m in row if m[3]) for row in rows], pa.string()),
                        pa.array([join(m[0] for m in row) for row in rows], pa.string()),
                        pa.array([c / s if s else 0.0 for c, s in zip(covered, sizes.tolist())], pa.float64()),
                        pa.array(matches, kind),
                    ],
                    names=[
                        "id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                        "score", "matches",
                    ],
                )

    return run


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
) -> DataFrame:
    """License mentions of every row, found in the whole text.

    Returns ``id_col``, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of one, else null), base_labels, labels (of
    templates too; distinct, sorted, joined by commas, empty if none), score (share of
    the words inside any match) and matches (label, start, words of each template
    match). Words are runs of digits, letters and non-ASCII characters with A-Z
    lower-cased.

    A null or empty text has no words, no labels and score 0. Repeated rows are all
    scanned; an empty table gives an empty result; other columns are not read. Each
    document is worked on alone, without a shuffle.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double, matches array<struct<label:string,start:long,words:long>>"
    )
    return docs.mapInArrow(_scan(phrases, templates), schema).withColumnRenamed("id", id_col)
