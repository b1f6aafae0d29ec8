"""License scans by a positional index of rare tokens over licence templates.

A template is the wording of a notice, with key phrases that it can't go without.  Its
words weigh as much as they are rare in the corpus (inverse document frequency over
all documents).  A template stands in a file if words of at least ``threshold`` of its
weight stand in place, so at least one of its rarest words, those that hold more than
the rest of the weight, must be there: the index holds the places of these words
alone.  A file's words that are in the index are looked up, every posting proposes
where the template would begin, proposals that lie near each other are one region, and
there the words that stand in order are summed (some may be put in or left out) and the
key phrases looked for.  Short phrases are templates of their own that must stand whole.

Two passes read the texts: one counts in how many documents each word of a template
is, which leaves a task as one row a word, the other scans.  Templates are a parameter
and small; nothing else is broadcast, and nothing is shuffled but the counts.

Defined cases: null or empty text has no words and no label; rows that share a doc_id
are files each, a null doc_id stays null; repeated phrases count each; a text of one
repeated word costs its length times that of the templates; other columns are ignored;
no documents, no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import batched

from ._columns import quoted
from ._memory import tidy
from ._words import pieces


class Template(NamedTuple):
    """Wording of a licence notice; every key phrase must stand in the region that it is found in."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()


#: Phrases that name a licence, each a template that must stand whole.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Wording of public licences and of their notices.
TEMPLATES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ("permission is hereby granted free of charge", "sublicense")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution and use in source and binary forms",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "in compliance with the license")),
    Template("gpl-2.0", "GNU General Public License, version 2", ("general public license version 2",)),
    Template("gpl-3.0", "GNU General Public License, version 3", ("general public license version 3",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("free software", "general public license")),
    Template("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl", "GNU Affero General Public License", ("affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software",)),
    Template("bsl-1.0", "Boost Software License, Version 1.0", ("boost software license",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications", ("permission is granted to anyone",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
)

#: Share of a template's weight that must stand in place; words that may be put in between.
THRESHOLD, SLACK = 0.8, 12
#: Regions that are summed together.
REGIONS = 4096


def _words(text: str) -> list[bytes]:
    return [w for part in pieces(text.encode()) for w in part]


def frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of rows, and of those that hold each word of a vocabulary of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, have = 0, Counter()
        for batch in batches:
            for raw in batch.column(0).cast(pa.large_binary()).to_pylist():
                n += 1
                found: set[bytes] = set()
                for part in pieces(raw or b""):
                    found |= vocabulary.intersection(part)
                have.update(found)
        rows = [(None, n), *((w.decode(), k) for w, k in have.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    rows = batched(docs).select(quoted(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "word string, n long")
    count = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return count.pop(None, 0), {w.encode(): k for w, k in count.items()}


class Index:
    """Rare words of the templates with their places in them."""

    def __init__(self, templates: tuple[Template, ...], phrases: tuple[tuple[str, str], ...], n: int, df: dict[bytes, int], threshold: float):
        idf = lambda w: math.log(1 + (n + 1) / (df.get(w, 0) + 1))
        self.number: dict[bytes, int] = {}
        self.threshold, self.n_phrases = threshold, len(phrases)
        #: Of each phrase and then each template: its words' numbers, their weights, its key phrases, the share it needs.
        self.wording, self.weight, self.keys, self.need = [], [], [], []
        self.labels = [x for x, _ in phrases] + [t.label for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for i, (text, keys, need) in enumerate([(p, (), 1.0) for _, p in phrases] + [(t.text, t.phrases, threshold) for t in templates]):
            ws = _words(text)
            weight = np.array([idf(w) for w in ws])
            self.wording.append(np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int32))
            self.weight.append(weight / weight.sum())
            self.keys.append([np.array([self.number.setdefault(w, len(self.number)) for w in _words(k)], np.int32) for k in keys])
            self.need.append(need)
            left = 1 - need + 1e-9  # so much may be missing; one of words of more weight stands there
            for w in sorted(set(ws), key=lambda w: (-idf(w), w)):
                self.postings.setdefault(w, []).extend((i, q) for q, x in enumerate(ws) if x == w)
                left -= sum(self.weight[i][q] for q, x in enumerate(ws) if x == w)
                if left < 0:
                    break

    def scan(self, raw: bytes, slack: int = SLACK) -> tuple[int, list[tuple[int, int, int, float, bool]]]:
        """A text's number of words, and what may stand in it: (template, first word, end, share of its weight in place, whether it is that licence)."""
        n, hits, parts = 0, {}, []
        rare = self.postings.keys()
        for part in pieces(raw):
            if not self._none_of(part):
                for p, w in enumerate(part, n):
                    if w in rare:
                        hits.setdefault(w, []).append(p)
            parts.append(np.fromiter((self.number.get(w, -1) for w in part), np.int32, len(part)) if hits or len(raw) > 1 << 20 else part)
            n += len(part)
        if not hits:
            return n, []
        words = np.concatenate([p if isinstance(p, np.ndarray) else np.array([self.number.get(w, -1) for w in p], np.int32) for p in parts])
        starts: dict[int, list[np.ndarray]] = {}
        for w, at in hits.items():
            for i, q in self.postings[w]:
                starts.setdefault(i, []).append(np.array(at) - q)
        return n, [(i, *found) for i in sorted(starts) for found in self._regions(words, i, np.unique(np.concatenate(starts[i])), slack)]

    def _none_of(self, part: list[bytes]) -> bool:
        return self.postings.keys().isdisjoint(part)

    def _regions(self, words: np.ndarray, i: int, starts: np.ndarray, slack: int) -> Iterator[tuple[int, int, float, bool]]:
        """Proposed beginnings of a template, those near each other together, with the weight of its words that stand there in order.

        What is summed is the heaviest common subsequence within a band of shifts around
        the beginning, for many regions at once: words may be put in or left out.
        """
        wording, weight, whole = self.wording[i], self.weight[i], self.need[i] >= 1
        if whole:
            slack = 0
            starts = starts[(starts >= 0) & (starts + len(wording) <= len(words))]
        heads, at = [], 0
        while at < len(starts):
            heads.append(int(starts[at]))
            at = int(np.searchsorted(starts, starts[at] + slack, "right"))
        margin = len(wording) + 2 * slack
        padded = np.concatenate((np.full(margin, -2, np.int32), words, np.full(margin + slack, -2, np.int32)))
        for k in range(0, len(heads), REGIONS):
            some = np.array(heads[k : k + REGIONS], np.int64)
            at = some[:, None] + np.arange(-slack, 2 * slack + 1) + margin
            best = np.zeros(at.shape)
            for q, w in enumerate(wording):
                more = best + weight[q] * (padded[at + q] == w)
                more[:, :-1] = np.maximum(more[:, :-1], best[:, 1:])  # a word of the template left out
                best = np.maximum.accumulate(more, axis=1)  # words put in
            for head, share in zip(some.tolist(), best.max(axis=1).tolist()):
                if whole and share < 1 - 1e-9:
                    continue
                low, high = max(0, head - slack), min(len(words), head + 2 * slack + len(wording))
                good = share >= self.need[i] - 1e-9 and all(_holds(words[low:high], key) for key in self.keys[i])
                yield low, high, min(1.0, share), good


def _holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return False
    found = np.ones(n, bool)
    for q, w in enumerate(phrase):
        found &= words[q : q + n] == w
    return bool(found.any())


#: What ``scan`` returns of a file: places of phrases and of templates, first word and end, and the share in place.
REGION = "array<struct<label: string, first_word: long, end_word: long, share: double, verified: boolean>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (places of the phrases), found (regions of templates, also those not verified) of every row."""
    vocabulary = {w for t in templates for w in _words(t.text)} | {w for _, p in phrases for w in _words(p)}
    index = Index(templates, phrases, *frequencies(docs, vocabulary, text_col), threshold)
    region = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64()), ("verified", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, base, found = [], [], []
            for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
                size, regions = index.scan(raw or b"")
                n.append(size)
                for out, mine in ((base, True), (found, False)):
                    out.append([{"label": index.labels[i], "first_word": a, "end_word": b, "share": s, "verified": ok} for i, a, b, s, ok in regions if (i < index.n_phrases) == mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, region), pa.array(found, region)], names=["doc_id", "n_words", "base", "found"])

    rows = batched(docs).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id long, n_words long, base {REGION}, found {REGION}")


def report(docs: DataFrame, **more) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the highest share of a template that stands in place, 1 where a phrase does.
    """
    at = F.transform("base", lambda x: x.first_word)
    labels = lambda x: F.array_sort(F.array_distinct(x))
    of = lambda c: F.transform(c, lambda x: x.label)
    verified = F.filter("found", lambda x: x.verified)
    shares = F.transform(F.concat("base", "found"), lambda x: x.share)
    return scan(docs, **more).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(labels(of("base")), ",").alias("base_labels"),
        F.array_join(labels(F.concat(of("base"), of(verified))), ",").alias("labels"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
