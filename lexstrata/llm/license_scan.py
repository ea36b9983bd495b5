"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of the text, or any run of consecutive words across line ends
that is at most ``SPAN`` times as long as the template (hard-wrapped notices). It
meets a template if it contains at least ``threshold`` of the template's distinct
words. Words are ordered by how many documents hold them, rarest first. Exactness
comes from three filters that never lose a pair: a block which meets a template of
``n`` words, ``need`` of them in common, holds one of its ``n - need + 1`` rarest
words (prefix), has at least ``need`` template words (length), and from the first
common word on both sides have enough words left (position). Pairs that pass are
counted in full. Runs across lines are searched only for templates that the words
of the whole text meet, as a run holds no others.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed texts: public license notices, each with its label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "All rights reserved."),
)

#: A run of words across lines may be so many times as long as the template: room for comment marks and a few added words.
SPAN = 2

#: Separators become spaces and A-Z lower case; bytes of other letters stay.
_MAP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()


@dataclass(frozen=True)
class Index:
    """Templates as sets of ranks of their words, in global frequency order; sent to the tasks (bounded by the templates)."""

    rank: dict[bytes, int]
    sets: tuple[tuple[str, tuple[int, ...], int], ...]
    spans: tuple[int, ...]
    prefix: dict[int, tuple[tuple[int, int], ...]]

    @classmethod
    def build(cls, templates, frequency: dict[bytes, int], threshold: float) -> Index:
        vocabulary = sorted({w for _, t in templates for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: i for i, w in enumerate(vocabulary)}
        sets, spans, prefix = [], [], {}
        for label, text in templates:
            ranks = tuple(sorted({rank[w] for w in words_of(text)}))
            if ranks:
                need = max(1, math.ceil(round(threshold * len(ranks), 9)))
                for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                    prefix.setdefault(r, []).append((len(sets), i))
                sets.append((label, ranks, need))
                spans.append(SPAN * len(words_of(text)))
        return cls(rank, tuple(sets), tuple(spans), {r: tuple(v) for r, v in prefix.items()})

    def matches(self, block: set[bytes]) -> list[tuple[int, int]]:
        """(template, words in common) of every template that the block meets."""
        ranks = sorted(self.rank[w] for w in block if w in self.rank)
        found, judged = [], set()
        for j, r in enumerate(ranks):
            for t, i in self.prefix.get(r, ()):
                if t in judged:
                    continue
                judged.add(t)  # this is the first common word: earlier ones of the prefix would have come up
                _, own, need = self.sets[t]
                if len(ranks) < need or min(len(own) - i, len(ranks) - j) < need:
                    continue
                common = sum(1 for x in own if (k := bisect_left(ranks, x)) < len(ranks) and ranks[k] == x)
                if common >= need:
                    found.append((t, common))
        return found

    def runs(self, lines: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
        """(template, words in common, first line, last line) of the best run of words across lines, for each stretch of runs that share words."""
        met = self.matches({w for line in lines for w in line})
        if not met:
            return []
        ranks = [(at, no, self.rank[w]) for at, (no, w) in enumerate((no, w) for no, line in enumerate(lines) for w in line) if w in self.rank]
        found = []
        for t, _ in met:
            _, own, need = self.sets[t]
            held, stretch, left = Counter(), None, 0
            places = [p for p in ranks if p[2] in own]
            for at, no, r in places:
                held[r] += 1
                while at - places[left][0] >= self.spans[t] or held[places[left][2]] > 1:  # too far, or held again later
                    held[places[left][2]] -= 1
                    left += 1
                first, common = places[left], sum(1 for n in held.values() if n)
                if common < need or first[1] == no:
                    continue
                if stretch and first[0] <= stretch[1]:
                    stretch[1] = at
                    if common > stretch[0][1]:
                        stretch[0] = (t, common, first[1], no)
                else:
                    if stretch:
                        found.append(stretch[0])
                    stretch = [(t, common, first[1], no), at]
            if stretch:
                found.append(stretch[0])
        return found


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each template word; partial counts come from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(i, 256).to_pylist():
                    if text:
                        seen.update(vocabulary.intersection(text.encode("utf-8", "surrogatepass").translate(_MAP).split()))
        words = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], names=["w", "n"])

    found = docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in found}


def templates_of(table: DataFrame, label_col: str = "label", text_col: str = "text", most: int = 10_000) -> tuple[tuple[str, str], ...]:
    """Templates of a table of license texts (full texts too), for ``license_scan``; an error beyond ``most`` rows, as the index is sent to every task."""
    found = table.select(F.col(label_col).alias("l"), F.col(text_col).alias("t")).filter("l IS NOT NULL AND t IS NOT NULL").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} templates")
    return tuple(sorted((r["l"], r["t"]) for r in found))


SCHEMA = (
    "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<line:long, label:string, score:double>>"
)


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per input row with its license labels and the blocks that meet a template.

    ``n_base`` counts all places where a phrase's words stand consecutively,
    ``first_word`` and ``last_word`` are the smallest and largest start (words
    from 0; null without any), ``base_labels`` their distinct labels;
    ``labels`` adds those of the templates met by a block; ``score`` is 1 with a
    base label, else the largest share of a template that a block contains (of
    those met), else 0. ``blocks`` lists line number, label and share: every line
    that meets a template, then for each place where words across lines do, the
    best run by its first line, unless one of its lines has as large a share.

    Edge cases: a null or empty text has no words, no labels and score 0; null
    ids stay null; repeated rows are scanned each; long texts are scanned whole;
    an empty table gives an empty result. Other columns of ``df`` are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = {w for _, t in templates for w in words_of(t)}
    index = Index.build(templates, word_frequencies(docs, vocabulary), threshold)
    base = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items() if words_of(p)]
    rarest = frozenset(w for w, r in index.rank.items() if r in index.prefix)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan_one(text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass").translate(_MAP)
        words = data.split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        places, labels = [], set()
        line = b" " + b" ".join(words) + b" "
        for phrase, label in base:
            at, before, word = line.find(phrase), 0, -1
            while at >= 0:
                word += line.count(b" ", before, at + 1)  # from the last place on, so that a text is counted once
                places.append(word)
                labels.add(label)
                before, at = at + 1, line.find(phrase, at + 1)
        blocks = []
        if not rarest.isdisjoint(words):  # by the prefix filter no block of another text can meet a template
            lines = [raw.encode("utf-8", "surrogatepass").translate(_MAP).split() for raw in (text or "").split("\n")]
            met = [(no, t, common) for no, words_in in enumerate(lines) for t, common in index.matches(set(words_in))]
            if len(lines) > 1:
                best = {(no, t): common for no, t, common in met}
                met += [(no, t, common) for t, common, no, last in index.runs(lines) if all(best.get((k, t), 0) < common for k in range(no, last + 1))]
            for no, t, common in met:
                label, own, _ = index.sets[t]
                blocks.append({"line": no, "label": label, "score": common / len(own)})
        every = labels | {b["label"] for b in blocks}
        score = 1.0 if labels else max((b["score"] for b in blocks), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, blocks

    block_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block_type]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [scan_one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=names)

    return docs.mapInArrow(scan, SCHEMA.format(id=id_type))
