"""License scans by a positional index of rare words.

The index holds, of every template (a licence notice), the rarest words and their positions; how rare a word is
says its inverse document frequency over the whole table, counted for the templates' own words only, which are
few whatever the table's size. A text's words that the index holds are looked up, rarest first; each posting gives the place
where its template would begin, and postings that agree on it, to within SLACK words, are summed up. The words
in the index weigh INDEXED of each template, so a text that holds ACCEPTED of a template's weight at its
relative positions has at least ACCEPTED + INDEXED - 1 of it among them: no such place is missed. Every place left is
verified: all of the template's words count towards the share, and its mandatory key phrases must stand in
it word for word.

The base phrases are templates of which each word must stand: their rarest word is looked up, and every place of
it is verified. They are found whatever else a text holds.

Texts are read twice, once for the frequencies and once for the scan, each in one go through Arrow batches
without any shuffle of texts.

Defined results: null and empty texts have no words and no labels, and a score of 0. Copies and repeated rows get equal rows.
Equally rare words are ranked bytewise. Words of any length and texts of any number of words are scanned
whole. A template counts once a text, however often it stands there. An empty table gives an empty table. Other
columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPTED = 0.7
INDEXED = 0.8
SLACK = 2

# Phrases, the labels they stand for, and public licence notices with their key phrases.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["general public license version 3"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ["general public license version 2"]),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "free software foundation", "version 3"]),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "free software foundation", "version 2"]),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", ["to the public domain"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in _SEPARATORS else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: runs of digits, letters and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Index:
    """Postings of the templates' rarest words. weights: word -> inverse document frequency."""

    def __init__(self, notices: list, base: dict, weights: dict):
        self.templates, self.postings, self.anchors = [], defaultdict(list), defaultdict(list)
        self.weights = weights
        for label, text, keys in notices:
            words = words_of(text)
            own = [weights[w] for w in words]
            rarest, held = sorted(range(len(words)), key=lambda i: (-own[i], words[i], i)), 0.0
            total, n = sum(own), len(self.templates)
            for i in rarest:
                if held >= INDEXED * total:
                    break
                held += own[i]
                self.postings[words[i]].append((n, i))
            self.templates.append((label, words, own, total, [words_of(k) for k in keys], ACCEPTED * total - (total - held)))
        for phrase, label in base.items():
            words = words_of(phrase)
            i = min(range(len(words)), key=lambda i: (-weights[words[i]], words[i], i))
            self.anchors[words[i]].append((label, words, i))

    def scan(self, words: list[bytes]) -> tuple[list, set, set, float]:
        """Base places (sorted starts), base labels, labels, score."""
        postings, anchors = self.postings, self.anchors
        hits = [(i, w) for i, w in enumerate(words) if w in postings or w in anchors]
        if not hits:
            return [], set(), set(), 0.0
        places, base, labels, score = [], set(), set(), 0.0
        starts = defaultdict(dict)
        for at, w in sorted(hits, key=lambda h: (-self.weights[h[1]], h)):
            for label, phrase, i in anchors.get(w, ()):
                if at >= i and words[at - i : at - i + len(phrase)] == phrase:
                    places.append(at - i)
                    base.add(label)
                    score = 1.0
            for n, i in postings.get(w, ()):
                starts[n].setdefault(at - i, []).append(i)
        for n, found in starts.items():
            label, template, own, total, keys, least = self.templates[n]
            for start in self._agreed(found, own, least):
                share = sum(x for i, (w, x) in enumerate(zip(template, own, strict=True)) if w in words[max(0, start + i) : max(0, start + i + SLACK + 1)]) / total
                if share >= ACCEPTED - 1e-9 and self._verified(words, start, len(template), keys):
                    labels.add(label)
                    score = max(score, min(share, 1.0))
        return sorted(places), base, labels | base, score

    @staticmethod
    def _agreed(found: dict, own: list, least: float) -> list[int]:
        """Starts s such that the postings that begin in s .. s + SLACK weigh enough."""
        tried, out = set(), []
        for a in found:
            for s in range(a - SLACK, a + 1):
                if s not in tried:
                    tried.add(s)
                    met = {i for d in range(SLACK + 1) for i in found.get(s + d, ())}
                    if sum(own[i] for i in met) >= least - 1e-9:
                        out.append(s)
        return sorted(out)

    @staticmethod
    def _verified(words: list[bytes], start: int, n: int, keys: list) -> bool:
        """Whether each key phrase stands within the template's place."""
        part = words[max(0, start) : start + n + SLACK]
        return all(any(part[i : i + len(k)] == k for i in range(len(part) - len(k) + 1)) for k in keys)


def vocabulary(notices: list = NOTICES, base: dict = BASE) -> list[bytes]:
    """All words of the templates."""
    return sorted({w for _, text, _ in notices for w in words_of(text)} | {w for phrase in base for w in words_of(phrase)})


def word_weights(docs: DataFrame, text: str = "text", notices: list = NOTICES, base: dict = BASE) -> dict[bytes, float]:
    """The inverse document frequencies of the templates' words over all rows: one count a word from each task."""
    known = vocabulary(notices, base)

    def count(batches):
        place = {w: i for i, w in enumerate(known)}
        found = [0] * (len(known) + 1)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found[-1] += 1
                for w in place.keys() & set(words_of(t)):
                    found[place[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.int64())], names=["word", "n"])

    counts = {r["word"]: r["n"] for r in docs.select(text).mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(len(known), 0)
    return {w: math.log((n + 1.0) / (counts.get(i, 0) + 0.5)) for i, w in enumerate(known)}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: list = NOTICES, base: dict = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, base_places of every row."""
    weights = word_weights(docs, text, notices, base)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("base_places", pa.list_(pa.int64()))])

    def run(batches):
        index = Index(notices, base, weights)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                places, own, labels, score = index.scan(words)
                first, last = (places[0], places[-1]) if places else (None, None)
                rows.append((i, len(words), len(places), first, last, ",".join(sorted(own)), ",".join(sorted(labels)), score, places))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, base_places array<bigint>"
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, ddl)
