"""License scan: phrase places, and an exact set-similarity join with templates.

A text block meets a template when it holds at least ``threshold`` of the
template's distinct words. Blocks are lines, or with ``passages`` the windows of as
many words as the longest template has, across line breaks, and lines and paragraphs
of at most two windows: wrapped templates are met, and words strewn over a long line
are no template. Template words are ordered by how many blocks of
the whole table hold them, rarest first. A block that meets a template misses at
most ``n - need`` of its ``n`` words, so it holds one of the first
``n - need + 1`` (prefix filter); it has ``need`` words at least (length filter);
and when its first prefix word stands at place ``i`` of the template and at place ``j``
of the block's ``m`` template words in the same order, the two can share at most
``min(n - i, m - j)`` (positional filter). Blocks left are compared in full. The templates are
a parameter of a few hundred words; nothing that grows with the table leaves the
tasks but one histogram over the templates' words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import fresh_name, histogram_sum, pieces

# Bytes that separate words become a space and A-Z become a-z; UTF-8 bytes beyond
# ASCII stay, so words are the runs of [0-9a-z] and non-ASCII characters.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "cc-by-4.0": ["Licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "epl-2.0": ["made available under the terms of the Eclipse Public License 2.0"],
    "gpl-3.0": ["licensed under the GNU General Public License, version 3"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty"],
}


def fold(text: str) -> bytes:
    """The text's UTF-8 with A-Z lower-cased and separators as spaces; ``split()`` gives its words."""
    return text.encode().translate(_FOLD)


@dataclass
class TemplateIndex:
    """Templates over words in global frequency order, with their prefixes."""

    need: list[int] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    prefix: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    rank: dict[bytes, int] = field(default_factory=dict)  # place of every template word in the global order

    @classmethod
    def build(cls, templates: dict[str, list[str]], frequency: dict[bytes, int], threshold: float) -> TemplateIndex:
        index = cls()
        every = {w for texts in templates.values() for text in texts for w in fold(text).split()}
        index.rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
        for label in sorted(templates):
            for text in templates[label]:
                words = sorted(set(fold(text).split()), key=index.rank.__getitem__)
                if not words:
                    continue
                need = max(1, int(np.ceil(threshold * len(words) - 1e-9)))
                for place, w in enumerate(words[: len(words) - need + 1]):
                    index.prefix.setdefault(w, []).append((len(index.words), place))
                index.need.append(need)
                index.words.append(words)
                index.labels.append(label)
        return index

    def met(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of the templates that the block's words meet.

        A template whose words all stand in another one that is met says less than that one and is left out.
        """
        first: dict[int, int] = {}
        for w in block & self.prefix.keys():
            for t, place in self.prefix[w]:
                first[t] = min(place, first.get(t, place))
        met: dict[int, int] = {}
        ranks = sorted(map(self.rank.__getitem__, block & self.rank.keys())) if first else []
        for t, place in first.items():
            if len(block) < self.need[t] or self.most_shared(t, place, ranks) < self.need[t]:
                continue
            shared = sum(w in block for w in self.words[t])
            if shared >= self.need[t]:
                met[t] = shared
        for t, shared in met.items():
            own = set(self.words[t])
            if not any(own < set(self.words[o]) for o in met):
                yield self.labels[t], shared / len(own)


    def most_shared(self, t: int, place: int, ranks: list[int]) -> int:
        """What a template and a block can share, whose first common word stands at ``place`` of the template."""
        return min(len(self.words[t]) - place, len(ranks) - bisect_left(ranks, self.rank[self.words[t][place]]))


def block_frequency(texts: DataFrame, column: str, templates: dict[str, list[str]]) -> dict[bytes, int]:
    """How many blocks of all texts hold each word of the templates."""
    vocabulary = sorted({w for ts in templates.values() for t in ts for w in fold(t).split()})
    place = {w: i for i, w in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        totals = dict.fromkeys(vocabulary, 0)
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                for line in text.split("\n") if text else ():
                    for w in place.keys() & fold(line).split():
                        totals[w] += 1
        return np.array(list(totals.values()), np.int64)

    if not vocabulary:
        return {}
    sums = histogram_sum(texts.select(column), count, len(vocabulary))
    return dict(zip(vocabulary, sums.tolist(), strict=True))


def passage_blocks(
    words: list[bytes], lines: list[list[bytes]], index: TemplateIndex, known: set[bytes], width: int
) -> Iterator[set[bytes]]:
    """Blocks of a text: its lines and paragraphs of at most ``2 * width`` words and its windows of ``width`` words.

    A window that starts elsewhere holds no more ``known`` words (the templates') than the one at its first
    known word, so only these are built, and of them those with a word of a prefix.
    """
    part: list[bytes] = []  # lines up to one without words
    for line in [*lines, []]:
        if len(line) <= 2 * width:
            yield set(line)
        if not line:
            if len(part) <= 2 * width:
                yield set(part)
            part = []
        part += line
    hits = [i for i, w in enumerate(words) if w in index.prefix]
    done = 0
    for i in hits:
        for start in range(max(done, i - width + 1), i + 1):
            if words[start] in known:
                yield set(words[start : start + width])
        done = i + 1


def _places(words: list[bytes], joined: bytes, phrase: list[bytes]) -> list[int]:
    """Word places where the phrase's words stand consecutively."""
    needle, found = b" " + b" ".join(phrase) + b" ", []
    at, counted, place = joined.find(needle), 0, 0
    while at >= 0:
        place += joined.count(b" ", counted, at)
        counted = at
        found.append(place)
        at = joined.find(needle, at + 1)
    return found


OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def scan_licenses(
    docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None,
    templates: dict[str, list[str]] | None = None, threshold: float = 0.9, passages: bool = False,
) -> DataFrame:
    """Adds the columns of ``OUTPUT`` to every row of ``docs``.

    ``n_base`` counts all places of all phrases, ``first_word``/``last_word`` are the
    smallest and largest start. ``labels`` holds the phrases' labels and those of the
    templates that some block (a line; with ``passages`` see above) meets; ``score`` is the largest containment found, 1.0
    where only a phrase was found, else 0.0. A null text is an empty one: no words,
    no labels, score 0.0. Repeated rows are scanned one by one, texts of any length
    whole; labels met equally well are all named. An empty table gives an empty result. Input columns named like an output are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    index = TemplateIndex.build(templates, block_frequency(docs, text, templates), threshold)
    known = {w for ws in index.words for w in ws}
    width = max((len(fold(t).split()) for ts in templates.values() for t in ts), default=0)
    wanted = [(fold(p).split(), label) for p, label in phrases.items()]

    @F.arrow_udf(OUTPUT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            rows = []
            for t in batch.to_pylist():
                folded = fold(t or "")
                words = folded.split()
                joined = b" " + b" ".join(words) + b" "
                starts, base = [], set()
                for phrase, label in wanted:
                    if got := _places(words, joined, phrase):
                        starts += got
                        base.add(label)
                best, labels = 1.0 if base else 0.0, set(base)
                found = []
                if not index.prefix.keys().isdisjoint(words):
                    # a newline is one byte and folding keeps lengths, so lines can be cut after folding
                    raw, at, lines = (t or "").encode(), 0, []
                    for line in raw.split(b"\n"):
                        lines.append(folded[at : at + len(line)].split())
                        at += len(line) + 1
                    blocks = passage_blocks(words, lines, index, known, width) if passages else map(set, lines)
                    for block in blocks:
                        found += index.met(block)
                if found:
                    labels.update(label for label, _ in found)
                    best = max(c for _, c in found)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(labels)), best))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(OUTPUT)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], OUTPUT.names)

    kept = [c for c in docs.columns if c.lower() not in OUTPUT.names]
    held = fresh_name(docs, "license")
    return docs.select(*kept, scan(F.col(text)).alias(held)).select(
        *kept, *(F.col(held)[n].alias(n) for n in OUTPUT.names)
    )
