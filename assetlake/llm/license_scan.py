"""License scans: an exact set-similarity join of text blocks with license templates.

Words are lower-cased runs of ASCII letters and digits and of all other non-ASCII characters. A template of n words, with m the next power of
two, meets the blocks of 2 m words that start at every m-th word of a text, so any stretch of up to m + 1 words lies whole
in some block. A block matches when it holds at least ``percent`` of the template's distinct words.

The join runs over words in one global order, the rarest of the whole corpus first (ties by the word). A template of t words
that needs a common ones shares one of its first t - a + 1 words with any matching block (prefix filter), a block needs at
least a words (length filter), and the places of the first common word in both sets bound what can follow (positional
filter). What passes is confirmed on the full sets. Words that no template holds cannot match and take no part.
Counting the words is one pass over all texts, the join a second one; neither moves a text.
"""
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import row_key, whole
from assetlake.llm.decontaminate import WORD, words_of

# Phrases whose words must stand together.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# The customary notices of license families.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
               "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
MAX_WORDS = 5_000_000  # of all templates together: they are held by every task
RESULT = ("doc_id long, row_key long, n_words long, base array<struct<label:string,word:long>>, "
          "blocks array<struct<label:string,template:int,first_word:long,last_word:long,start:long,end:long,containment:double>>")
PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
BLOCK = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                            ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


class Template(NamedTuple):
    number: int
    label: str
    step: int  # blocks start at every step-th word and hold two steps
    words: frozenset
    need: int  # words that a matching block holds


def templates_of(pairs, percent: int) -> list[Template]:
    """pairs (label, text); those without words are left out."""
    out = []
    for number, (label, text) in enumerate(pairs):
        words = words_of((text or "").encode())
        if words:
            kinds = frozenset(words)
            out.append(Template(number, label, 1 << (len(words) - 1).bit_length(), kinds, max(1, -(-percent * len(kinds) // 100))))
    return out


def places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(word number, label) of every place where a phrase's words stand together."""
    flat, out = b" %b " % b" ".join(words), []
    for label, phrase in phrases:
        at = flat.find(phrase)
        while at >= 0:
            out.append((flat.count(b" ", 0, at), label))
            at = flat.find(phrase, at + 1)
    return sorted(out)


class Join:
    """The templates, indexed by the prefixes of their words in the order of ``rank`` (word to place, the rarest first)."""

    def __init__(self, templates: list[Template], rank: dict[bytes, int]):
        self.rank, self.by_step = rank, {}
        for t in templates:
            ordered = sorted(rank[w] for w in t.words)
            starts = self.by_step.setdefault(t.step, {})
            for i, r in enumerate(ordered[:len(ordered) - t.need + 1]):
                starts.setdefault(r, []).append((t, i, frozenset(ordered)))
        self.early = {}
        for step, starts in self.by_step.items():
            self.early[step] = np.zeros(len(rank) + 1, bool)  # the last place stands for words outside
            self.early[step][list(starts)] = True

    def blocks(self, words: list[bytes]):
        """(template, first word, end, containment) of every matching block."""
        outside = len(self.rank)
        ids = np.fromiter((self.rank.get(w, outside) for w in words), np.int64, len(words))
        for step, starts in self.by_step.items():
            at = np.flatnonzero(self.early[step][ids]) // step
            for b in np.unique(np.concatenate([at, at[at > 0] - 1])).tolist():
                kinds = np.unique(ids[b * step:(b + 2) * step])
                kinds = kinds[kinds < outside].tolist()
                here, met = set(kinds), set()
                for j, r in enumerate(kinds):
                    for t, i, own in starts.get(r, ()):
                        if t.number in met:
                            continue
                        met.add(t.number)  # r is the first word that both hold
                        if min(len(own) - i, len(kinds) - j) < t.need:
                            continue
                        common = len(here & own)
                        if common >= t.need:
                            yield t, b * step, min((b + 2) * step, len(words)), common / len(own)


def _count(vocabulary):
    def run(batches):
        known = {w: i for i, w in enumerate(vocabulary)}
        n = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text.encode())
                n += np.bincount(np.fromiter((known.get(w, len(known)) for w in words), np.int64, len(words)), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary, pa.binary()), pa.array(n[:-1])], names=["word", "n"])
    return run


def _scan(templates, rank, phrases):
    def run(batches):
        join = Join(templates, rank)
        for batch in batches:
            sizes, base, blocks = [], [], []
            for text in batch.column(2).to_pylist():
                raw = text.encode()
                words = words_of(raw)
                found = list(join.blocks(words)) if words else []
                spans = [m.span() for m in WORD.finditer(raw)] if found else []
                chars = lambda b: len(raw[:b].decode())  # noqa: B023, E731
                sizes.append(len(words))
                base.append([{"label": x, "word": n} for n, x in places(words, phrases)])
                blocks.append([{"label": t.label, "template": t.number, "first_word": a, "last_word": e - 1, "start": chars(spans[a][0]),
                                "end": chars(spans[e - 1][1]), "containment": c} for t, a, e, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(base, PLACE),
                                              pa.array(blocks, BLOCK)], names=["doc_id", "row_key", "n_words", "base", "blocks"])
    return run


def word_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` (bounded by the templates) stands in all texts."""
    n = docs.select(whole().alias("text")).mapInArrow(_count(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {w: 0 for w in vocabulary} | {bytes(r.word): r.n for r in n.collect()}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, percent: int = 80, phrases=PHRASES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, n_words, base (label and word number, from 0, of every place of a
    phrase) and blocks (label, number of the template, first and last word, offsets in the text, containment) of every block
    that meets the threshold with a template.

    ``templates`` are (label, text) pairs of ``MAX_WORDS`` words at most, which is checked; without words a template matches
    nothing. Null and empty texts have no words; repeated rows and a null doc_id are scanned like others; an empty table gives
    an empty result. Extra columns are ignored.
    """
    known = templates_of(templates, percent)
    if sum(len(t.words) for t in known) > MAX_WORDS:
        raise ValueError(f"templates hold more than {MAX_WORDS} words; scan with parts of them")
    vocabulary = sorted(frozenset().union(*(t.words for t in known)))
    n = word_counts(docs, vocabulary) if vocabulary else {}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n[w], w)))}
    flat = [(label, b" %b " % b" ".join(words_of(p.encode()))) for label, p in phrases if words_of(p.encode())]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    return d.mapInArrow(_scan(known, rank, flat), RESULT)
