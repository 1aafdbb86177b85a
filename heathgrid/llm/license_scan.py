"""License phrases and license notices in texts.

Phrases are found at every place where their words stand one after another. Notices are found by an
exact set-similarity join of text blocks with templates, of which a label may have several. A block is
any run of a template's length in words and a quarter more (rounded down, so that names of up to three
words must stand unbroken), whatever the line ends in it. It matches the template if it holds

- at least THRESHOLD of the template's distinct words,
- in order: the longest common subsequence of its words with the template's is at least THRESHOLD of
  the template's length,
- every word that tells the template from another label's, and none that tells that one from it
  (`apart`, from the blocks of the other labels' templates that would match it).

The text's words as a whole are joined with the templates first, and the blocks of a text are only
looked at for templates that this leaves. Words are ordered by their frequency in the whole corpus,
rarest first, which is counted for the templates' words in a pass of its own.

- Prefix filter: a match must hold one of a template's first (n - needed + 1) words in that order.
- Length filter: a block needs at least as many distinct words as the template needs matches.
- Positional filter: a match first seen at place i of the template's order, and at place j among the
  block's template words in the same order, can reach at most 1 + min(words left in either).

All three only drop pairs that can't reach the threshold, and a text holds all words of its blocks, so
no block is missed. Templates are a
constant of the program, and so are the word counts that travel to the driver.

Defined cases: null and empty texts have no words, no places and score 0; repeated rows are scanned
alike; an empty table gives no rows; further columns stay unused. A text may carry several labels; its
score is 1 with a phrase, else the greatest share of a template's words that a block holds in order.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.common import ASCII_LOWER, slices, texts_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.8
#: Notices by label (fixed values: the wording of the licenses).
TEMPLATES = {
    "agpl-3.0": "GNU Affero General Public License version 3",
    "apache-2.0": "Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-nc-4.0": "CC BY-NC 4.0",
    "cc-by-nc-nd-4.0": "CC BY-NC-ND 4.0",
    "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0",
    "cc-by-nd-4.0": "CC BY-ND 4.0",
    "cc-by-sa-4.0": "CC BY-SA 4.0",
    "cc0-1.0": "CC0 1.0 Universal",
    "gpl-2.0": "GNU General Public License version 2",
    "gpl-3.0": "GNU General Public License version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "GNU Lesser General Public License",
    "mit": "MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Header of the GNU licenses, by name and version.
HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Further notices of the labels: headers, full names and identifiers.
FURTHER = {
    "agpl-3.0": [HEADER.format("Affero General Public License", "3"), "SPDX-License-Identifier: AGPL-3.0", "AGPLv3"],
    "apache-2.0": ["SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["SPDX-License-Identifier: BSD-2-Clause", "BSD 2-Clause License"],
    "bsd-3-clause": ["SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "cc-by-nc-nd-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"],
    "cc-by-nc-sa-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "cc-by-nd-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "cc0-1.0": ["Dedicated to the public domain under the CC0 1.0 Universal dedication", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": [HEADER.format("General Public License", "2"), "SPDX-License-Identifier: GPL-2.0", "GPLv2"],
    "gpl-3.0": [HEADER.format("General Public License", "3"), "SPDX-License-Identifier: GPL-3.0", "GPLv3"],
    "isc": ["SPDX-License-Identifier: ISC", "ISC License"],
    "lgpl": [*(HEADER.format("Lesser General Public License", x) for x in ("2.1", "3")), "GNU Lesser General Public License version 3", "SPDX-License-Identifier: LGPL-3.0", "LGPLv3"],
    "mit": ["SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["SPDX-License-Identifier: Unlicense"],
}
#: A block's words beyond its template's, as a share of those.
ROOM = 0.25


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(ASCII_LOWER))


def places(joined: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(word, label) of every place of a phrase in words joined and enclosed by single spaces."""
    found = []
    for phrase, label in phrases.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            found.append((joined.count(" ", 0, at), label))
            at = joined.find(f" {phrase} ", at + 1)
    return found


class Join:
    """Templates indexed under a global order of their words."""

    def __init__(self, templates: dict, counts: dict[str, int], threshold: float = THRESHOLD, apart: dict[object, tuple[set[str], set[str]]] | None = None, ordered: bool = False):
        words = {k: words_of(v) for k, v in templates.items()}
        sets = {k: set(x) for k, x in words.items()}
        self.rank = {w: i for i, w in enumerate(sorted(set().union(*sets.values()), key=lambda w: (counts.get(w, 0), w)))}
        self.sets = sets
        self.order = {k: sorted(x, key=self.rank.__getitem__) for k, x in sets.items()}
        self.needed = {k: ceil(threshold * len(x) - 1e-9) for k, x in sets.items()}
        self.room = {k: len(x) + floor(ROOM * len(x)) for k, x in words.items()}
        self.apart = {k: (apart or {}).get(k, (set(), set())) for k in templates}
        self.ordered = ordered
        #: by template, the words that shares are of, and how many of them a block needs
        self.size = {k: len(x) if ordered else len(sets[k]) for k, x in words.items()}
        self.least = {k: ceil(threshold * n - 1e-9) for k, n in self.size.items()}
        #: by template and word, a bit for each place of the word
        self.bits = {k: {w: sum(1 << i for i, x in enumerate(own) if x == w) for w in sets[k]} for k, own in words.items()}
        self.index: dict[str, list[tuple[object, int]]] = {}
        for k, x in self.order.items():
            for i, w in enumerate(x[: len(x) - self.needed[k] + 1]):
                self.index.setdefault(w, []).append((k, i))
        self.rare = frozenset(self.index)

    def matches(self, block: set[str]) -> dict[object, float]:
        """Containment by template of those that the block of words matches."""
        own = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        seen, found = set(), {}
        for j, w in enumerate(own):
            for k, i in self.index.get(w, ()):
                if k in seen or len(block) < self.needed[k]:
                    continue
                seen.add(k)
                if 1 + min(len(self.order[k]) - i - 1, len(own) - j - 1) < self.needed[k]:
                    continue
                same = len(self.sets[k] & block)
                if same >= self.needed[k]:
                    found[k] = same / len(self.sets[k])
        return found

    def block_matches(self, words: list[str]) -> dict[object, float]:
        """The greatest share by template of those that some block of a text's words matches."""
        found = {k: self.best(k, words)[0] for k in self.matches(set(words))}
        return {k: n / self.size[k] for k, n in found.items() if n}

    def in_order(self, k: object, block: Iterable[tuple[int, str]]) -> int:
        """Length of the longest common subsequence of a block's words and the template's, bit-parallel: a 0 in `row` is one more word."""
        bits, full = self.bits[k], (1 << self.size[k]) - 1
        row = full
        for _, w in block:
            hit = row & bits[w]
            row = ((row + hit) | (row - hit)) & full
        return self.size[k] - row.bit_count()

    def best(self, k: object, words: list[str]) -> tuple[int, int, int]:
        """The most words of template k in a block that matches it, and where that block starts and ends, from one word of k to another; 0 if none does."""
        own, (needed, barred) = self.sets[k], self.apart[k]
        block: deque[tuple[int, str]] = deque()
        held: Counter[str] = Counter()
        best = (0, 0, 0)
        for at, w in enumerate(words):
            if w in barred:
                block.clear()
                held.clear()
            elif w in own:
                block.append((at, w))
                held[w] += 1
                while at - block[0][0] >= self.room[k]:
                    old = block.popleft()[1]
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                if len(held) >= self.needed[k] and needed <= held.keys() and best[0] < self.size[k]:
                    n = self.in_order(k, block) if self.ordered else len(held)
                    if n >= self.least[k] and n > best[0]:
                        best = n, block[0][0], at + 1
        return best


def apart(templates: dict[tuple[str, int], str], threshold: float = THRESHOLD) -> dict[tuple[str, int], tuple[set[str], set[str]]]:
    """By template, the words that a block must hold and those that it must not, to be no block of another label's template.

    That one's block is looked at from its first word in the template on, for the template's length at least,
    and what is left of that one is looked at again, until it has no block or one of just the template's words.
    """
    join = Join(templates, {}, threshold, {k: (set(), set()) for k in templates}, ordered=True)
    for k in templates:
        needed, barred = join.apart[k]
        for other, text in templates.items():
            words = words_of(text) if other[0] != k[0] else []
            while (found := join.best(k, words))[0]:
                block = set(words[found[1] : max(found[2], found[1] + join.size[k])])
                if block == join.sets[k]:
                    break
                needed |= join.sets[k] - block
                barred |= block - join.sets[k]
    return join.apart


def word_counts(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """How often each of a fixed set of words stands in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                counts.update(filter(words.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return dict(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, further: dict[str, list[str]] = FURTHER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    texts = {(k, i): x for k, v in templates.items() for i, x in enumerate([v, *further.get(k, [])])}
    join = Join(texts, word_counts(docs, {w for x in texts.values() for w in words_of(x)}), threshold, apart(texts, threshold), ordered=True)

    def look(text: str) -> tuple:
        words = words_of(text)
        found = places(f" {' '.join(words)} ", phrases)
        base, best, more = {x for _, x in found}, 1.0 if found else 0.0, set()
        if not join.rare.isdisjoint(words):
            for (label, _), share in join.block_matches(words).items():
                more.add(label)
                best = max(best, share)
        starts = [x for x, _ in found]
        return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), best

    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(zip(*map(look, texts_of(batch)), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, arrow[k]) for x, k in zip(rows, kinds.values(), strict=True))], names=["doc_id", *kinds])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
