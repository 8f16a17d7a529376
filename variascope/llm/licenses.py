"""Licence scan with a positional index of rare licence words.

1. Document frequency of every word of the templates is counted over all documents (a few hundred counts).
2. Each template is indexed by its ``rare`` words of highest inverse document frequency: word -> (template, position).
3. A document's occurrences of indexed words are looked up and their postings intersected by relative position:
   occurrences that agree on document position minus template position support one placement of that template.
4. A placement that holds at least ``share`` of the template's indexed weight is a candidate; it is a match when all
   of the template's mandatory key phrases stand inside the placement (with ``slack`` words on both sides).

Fixed phrases (``BASE``) are found everywhere and label a document by themselves. The words counted and the templates
are fixed and small; documents pass through two maps and nothing but the counts shuffles.

Defined cases: null and empty texts have no words, no labels and score 0; an empty table gives an empty result and an
index with equal weights; repeated rows are scanned like any other. Columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm.words import ALNUM, lower, map_columns, ngrams, pack, ragged, slices, word_hashes, words

# Phrases and the labels they give.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, notice text, mandatory key phrases.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("free of charge", "without restriction", "sublicense"),
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("in compliance with the license", "apache org licenses"),
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        ("free software", "redistribute it"),
    ),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "GNU Affero General Public License", ("affero general public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution", "international license"),
    ),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("source and binary forms", "with or without modification"),
    ),
    ("bsd", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee",),
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


def tokens(text: str) -> list[str]:
    data, offsets = pack(pa.array([text], pa.string()))
    data = lower(data)
    starts, ends, _ = words(data, offsets, ALNUM)
    raw = data.tobytes()
    return [raw[s:e].decode() for s, e in zip(starts, ends)]


def hashes_of(vocabulary: list[str]) -> np.ndarray:
    raw = [w.encode() for w in vocabulary]
    ends = np.cumsum([len(w) for w in raw])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(w) for w in raw]), ends)


class Lookup:
    """Positions of a fixed set of words in an array of word hashes: a table of 2 ** 16 flags first, then a search."""

    def __init__(self, vocabulary: list[str]):
        known = hashes_of(vocabulary)
        self.order = np.argsort(known)
        self.sorted = known[self.order]
        self.flag = np.zeros(1 << 16, bool)
        self.flag[(known >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, word numbers)."""
        at = np.flatnonzero(self.flag[(hashes >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        same = self.sorted[k] == hashes[at]
        return at[same], self.order[k[same]]


def document_frequency(docs: DataFrame, *, text: str, vocabulary: list[str]) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word of ``vocabulary``), counted over all rows."""
    lookup = Lookup(vocabulary)

    def run(batches):
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            data, offsets = pack(batch.column(0))
            rows += batch.num_rows
            for i, j in slices(offsets):
                part = lower(data[offsets[i] : offsets[j]])
                starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], ALNUM)
                at, k = lookup.find(word_hashes(part, starts, ends))
                row = np.searchsorted(first, at, side="right") - 1
                total += np.bincount(np.unique(row * len(vocabulary) + k) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.append(rows, total))], ["word", "n"])

    counts = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counts.collect()}  # one row per template word
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(vocabulary))])


class Index:
    """Everything a task needs: postings of rare words, weights, key phrases."""

    def __init__(self, vocabulary: list[str], frequency: np.ndarray, rows: int, rare: int, share: float, slack: int):
        self.vocabulary, self.share, self.slack = vocabulary, share, slack
        self.lookup = Lookup(vocabulary)
        number = {w: k for k, w in enumerate(vocabulary)}
        weight = np.log((1 + rows) / (1 + frequency)) + 1e-9
        self.label, self.length, self.total, self.keys = [], [], [], []
        postings: list[tuple[int, int, int, float]] = []
        for t, (label, notice, keys) in enumerate(TEMPLATES):
            spelled = tokens(notice)
            best = sorted(set(spelled), key=lambda w: (-weight[number[w]], w))[:rare]
            places = [(number[w], p) for p, w in enumerate(spelled) if w in best]
            postings += [(w, t, p, weight[w]) for w, p in places]
            self.label.append(label)
            self.length.append(len(spelled))
            self.total.append(sum(weight[w] for w, _ in places))
            self.keys.append([tuple(number[w] for w in tokens(k)) for k in keys])
        postings.sort()
        self.word, self.template, self.place = (np.array([p[k] for p in postings]) for k in range(3))
        self.weight = np.array([p[3] for p in postings])
        self.base = [(tuple(number[w] for w in tokens(phrase)), label) for phrase, label in BASE.items()]

    def phrases(self, at: np.ndarray, word: np.ndarray, row: np.ndarray, phrase: tuple[int, ...]) -> np.ndarray:
        """Positions where the words of ``phrase`` stand consecutively in one row; ``at`` holds all known words in order."""
        keep = np.flatnonzero(word[: len(word) - len(phrase) + 1] == phrase[0]) if len(word) >= len(phrase) else np.zeros(0, np.int64)
        for k in range(1, len(phrase)):
            keep = keep[(word[keep + k] == phrase[k]) & (at[keep + k] == at[keep] + k) & (row[keep + k] == row[keep])]
        return at[keep]

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        data = lower(data)
        starts, ends, first = words(data, offsets, ALNUM)
        rows = len(offsets) - 1
        at, word = self.lookup.find(word_hashes(data, starts, ends))
        spelled = [w.encode() for w in self.vocabulary]
        true = [data[starts[p] : ends[p]].tobytes() == spelled[w] for p, w in zip(at.tolist(), word.tolist())] if len(at) else []
        at, word = at[np.array(true, bool)], word[np.array(true, bool)]
        row = np.searchsorted(first, at, side="right") - 1
        n_base, low, high = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
        base: list[set[str]] = [set() for _ in range(rows)]
        for phrase, label in self.base:
            places = self.phrases(at, word, row, phrase)
            for p in places.tolist():
                r = int(np.searchsorted(first, p, side="right")) - 1
                n_base[r] += 1
                own = p - int(first[r])
                low[r] = own if low[r] < 0 else min(low[r], own)
                high[r] = max(high[r], own)
                base[r].add(label)
        labels = [set(x) for x in base]
        score = np.array([1.0 if x else 0.0 for x in base])
        known = {key: self.phrases(at, word, row, key) for keys in self.keys for key in keys}
        a = np.searchsorted(self.word, word, side="left")
        many = np.searchsorted(self.word, word, side="right") - a
        posting = ragged(a, many)
        owner, shift = np.repeat(row, many), np.repeat(at, many) - self.place[posting]
        keys = np.stack([owner, self.template[posting], shift]) if len(posting) else np.zeros((3, 0), np.int64)
        placed, inverse = np.unique(keys, axis=1, return_inverse=True)
        support = np.bincount(inverse.ravel(), self.weight[posting], minlength=placed.shape[1])
        for (r, t, s), got in zip(placed.T.tolist(), support.tolist()):
            ratio = min(1.0, got / self.total[t])
            if ratio < self.share:
                continue
            lo, hi = max(s - self.slack, int(first[r])), min(s + self.length[t] + self.slack, int(first[r + 1]))
            if all((p := known[key]).size and np.searchsorted(p, lo) < np.searchsorted(p, hi - len(key) + 1) for key in self.keys[t]):
                labels[r].add(self.label[t])
                score[r] = max(score[r], ratio)
        return np.diff(first), n_base, low, high, base, labels, score


def scan(
    docs: DataFrame, *, text: str = "text", rare: int = 6, share: float = 0.6, slack: int = 2, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (or ``keep``) plus n_words, n_base, first_word, last_word, base_labels, labels and score."""
    vocabulary = sorted({w for _, notice, keys in TEMPLATES for t in (notice, *keys) for w in tokens(t)} | {w for p in BASE for w in p.split()})
    rows, frequency = document_frequency(docs, text=text, vocabulary=vocabulary)
    index = Index(vocabulary, frequency, rows, rare, share, slack)

    def make(column):
        data, offsets = pack(column)
        parts = [index.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1, 2, 3, 6)]
        names = [[sorted(x) for p in parts for x in p[k]] for k in (4, 5)]
        n_words, n_base, low, high, score = columns
        return [
            pa.array(n_words, pa.int64()),
            pa.array(n_base, pa.int64()),
            pa.array(low, pa.int64(), mask=low < 0),
            pa.array(high, pa.int64(), mask=high < 0),
            *(pa.array(n, pa.list_(pa.string())) for n in names),
            pa.array(score, pa.float64()),
        ]

    return map_columns(docs, text, make, ADDED, keep)
