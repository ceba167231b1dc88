"""License scans: a positional index of rare licence words, look-up by relative position, alignment, key phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded_words import CodedWords, slices


@dataclass(frozen=True)
class Template:
    """A licence text or notice, and phrases without which it does not count."""

    label: str
    text: str
    keys: tuple[str, ...] = ()


# Phrases of the base scan with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT License.", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ("free of charge", "without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license", "except in compliance")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("general public license", "version 2")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("general public license", "version 3")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("general public license", "free software foundation")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3", ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("source and binary forms", "retain the above copyright notice")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
)


def words_of(text: str) -> list[str]:
    w = CodedWords(pa.array([text]))
    return pc.take(w.words, pa.array(w.codes)).to_pylist()


def _numbers(w: CodedWords, vocabulary: pa.Array) -> np.ndarray:
    """Each word's number in the vocabulary, -1 for others; the dictionary is looked up, not each word."""
    table = pc.fill_null(pc.index_in(w.words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return table[w.codes] if len(table) else np.zeros(0, np.int64)


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], *, text_col: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and for each word in how many it stands; tasks send one row a word they met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, found = pa.array(vocabulary, pa.string()), 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch):
                n += part.num_rows
                w = CodedWords(part.column("text"))
                number = _numbers(w, known)
                at = np.flatnonzero(number >= 0)
                pairs = np.unique(w.owners()[at] * len(vocabulary) + number[at])
                found += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"word": np.append(met, -1), "n": np.append(found[met], n)})

    out, total = np.zeros(len(vocabulary), np.int64), 0
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # one row a word of the templates
        if r["word"] < 0:
            total = r["n"]
        else:
            out[r["word"]] = r["n"]
    return total, out


class LicenseIndex:
    """Postings of each template's words of highest IDF, and what verifies a hit.

    A template of n words counts where at least ``need`` = ceil(cover * n) of them stand in order, with
    relative positions in one band of ``2 * step`` neighbouring values. Of the n - need + votes words
    with the highest IDF at least ``votes`` are then among them, so these alone are indexed and no
    match is lost: a band with fewer of them cannot hold one.
    """

    def __init__(self, templates: Sequence[Template], vocabulary: Sequence[str], idf: np.ndarray, cover: float = 0.8, step: int = 4):
        number = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [t.label for t in templates]
        self.words = [np.array([number[w] for w in words_of(t.text)], np.int64) for t in templates]
        self.keys = [[np.array([number[w] for w in words_of(k)], np.int64) for k in t.keys] for t in templates]
        self.need = [math.ceil(cover * len(w) - 1e-9) for w in self.words]
        self.votes = [min(2, n) for n in self.need]
        self.step = step
        rows = []
        for t, w in enumerate(self.words):
            rarest = sorted(range(len(w)), key=lambda i: (-idf[w[i]], w[i], i))[: len(w) - self.need[t] + self.votes[t]]
            rows += [(w[i], t, i) for i in rarest]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.template, self.position = table[:, 1], table[:, 2]
        self.first = np.searchsorted(table[:, 0], np.arange(len(vocabulary) + 1))

    def candidates(self, number: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, templates and first places (in the slice) of the bands with enough votes; bands count from each document's start."""
        at = np.flatnonzero(number >= 0)
        n = self.first[number[at] + 1] - self.first[number[at]]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[number[at]], n)
        place = np.repeat(at, n)
        template, position = self.template[entry], self.position[entry]
        band = (place - bounds[owner[place]] - position) // self.step
        rows = np.column_stack([np.tile(owner[place], 2), np.tile(template, 2), np.concatenate([band, band - 1]), np.tile(position, 2)])
        rows = np.unique(rows, axis=0)  # a template's word votes once in a band
        keys, votes = np.unique(rows[:, :3], axis=0, return_counts=True)
        keys = keys[votes >= np.array(self.votes)[keys[:, 1]]]
        return keys[:, 0], keys[:, 1], bounds[keys[:, 0]] + keys[:, 2] * self.step

    def coverage(self, number: np.ndarray, template: int, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Longest common subsequence of a template with the words ``low`` to ``high``, inside each band from ``start``."""
        width, out = 2 * self.step, []
        words = self.words[template]
        for c in range(0, len(start), 4096):
            s, lo, hi = start[c : c + 4096, None], low[c : c + 4096, None], high[c : c + 4096, None]
            best = np.zeros((len(s), width), np.int64)
            for i, word in enumerate(words):
                place = s + i + np.arange(width)
                inside = (place >= lo) & (place < hi)
                hit = inside & (number[np.where(inside, place, 0)] == word)
                skip = np.column_stack([best[:, 1:], best[:, -1]])
                best = np.maximum.accumulate(np.maximum(skip, best + hit), axis=1)
            out.append(best[:, -1])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def regions(self, number: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(document, template, first word, end, share of the template) of all verified matches."""
        doc, template, start = self.candidates(number, bounds, owner)
        found = []
        for t in np.unique(template).tolist():
            pick = template == t
            d, s = doc[pick], start[pick]
            low, high = bounds[d], bounds[d + 1]
            common = self.coverage(number, t, s, low, high)
            fine = common >= self.need[t]
            first = np.maximum(s, low)
            end = np.minimum(s + len(self.words[t]) + 2 * self.step - 1, high)
            for key in self.keys[t]:
                places = phrase_places(number, owner, key)
                fine &= np.searchsorted(places, end - len(key), side="right") > np.searchsorted(places, first)
            for i in np.flatnonzero(fine).tolist():
                found.append((int(d[i]), t, int(first[i] - low[i]), int(end[i] - low[i]), common[i] / len(self.words[t])))
        return found


def phrase_places(number: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after the other inside one text."""
    m = len(number) - len(phrase) + 1
    if m <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:m] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[number[at + k] == phrase[k]]
    return at[owner[at] == owner[at + len(phrase) - 1]]


def distinct_regions(found: list[tuple[int, int, int, int, float]], labels: Sequence[str]) -> dict[int, list[dict]]:
    """The matches of each document, the best of those that overlap and have one label."""
    out: dict[int, list[dict]] = {}
    for d, t, first, end, share in sorted(found, key=lambda r: (r[0], labels[r[1]], -r[4], r[2], r[3], r[1])):
        rows = out.setdefault(d, [])
        if not any(r["label"] == labels[t] and first < r["end_word"] and r["first_word"] < end for r in rows):
            rows.append({"label": labels[t], "first_word": first, "end_word": end, "coverage": share})
    return {d: sorted(rows, key=lambda r: (r["first_word"], r["label"])) for d, rows in out.items()}


def license_scan(docs: DataFrame, *, templates: Sequence[Template] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text", cover: float = 0.8, step: int = 4) -> DataFrame:
    """Licence labels of each text, with the places they rest on.

    A base label holds where all words of its phrase stand one after the other. A template's label holds
    where at least ``cover`` of its words stand in order, not shifted against one another by more than
    ``step`` words, and all its key phrases stand in that stretch. Candidates come from an index of each
    template's words of highest IDF, counted over all documents (see ``LicenseIndex``).

    Returns the id, n_words, n_base, first_word, last_word (of base phrases; null without one), base_labels
    and labels (distinct, sorted, joined by commas; empty if there are none), score (the greatest share of
    a template that was matched; a base phrase halves what is missing to 1), and regions, an array of
    (label, first_word, end_word, coverage). One row a document, null ids and repeated rows included; a
    null text counts as empty and scores 0; an empty table gives no rows; other columns play no part.
    Nothing but the templates is sent to tasks, and nothing but counts of their words to the driver.
    """
    if any("," in x for x in [*phrases.values(), *(t.label for t in templates)]):
        raise ValueError("labels hold no commas")
    vocabulary = sorted({w for text in [*phrases, *(t.text for t in templates), *(k for t in templates for k in t.keys)] for w in words_of(text)})
    total, found = document_frequencies(docs, vocabulary, text_col=text_col)
    index = LicenseIndex(templates, vocabulary, np.log((total + 1) / (found + 1)), cover, step)
    number_of = {w: i for i, w in enumerate(vocabulary)}
    base = [(np.array([number_of[w] for w in words_of(p)], np.int64), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            for part in slices(batch):
                yield _scan_slice(part, known, base, index)

    region = "array<struct<label:string,first_word:long,end_word:long,coverage:double>>"
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, regions {region}")
    return out.withColumnRenamed("id", id_col)


_REGION = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))


def _scan_slice(part: pa.RecordBatch, known: pa.Array, base: Sequence[tuple[np.ndarray, str]], index: LicenseIndex) -> pa.RecordBatch:
    w = CodedWords(part.column("text"))
    rows, number, owner = part.num_rows, _numbers(w, known), w.owners()
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, len(number)), np.full(rows, -1)
    names: list[set] = [set() for _ in range(rows)]
    for phrase, label in base:
        places = phrase_places(number, owner, phrase)
        docs = owner[places]
        n_base += np.bincount(docs, minlength=rows)
        np.minimum.at(first, docs, places - w.bounds[docs])
        np.maximum.at(last, docs, places - w.bounds[docs])
        for d in np.unique(docs).tolist():
            names[d].add(label)
    regions = distinct_regions(index.regions(number, w.bounds, owner), index.labels)
    none = n_base == 0
    score = np.zeros(rows)
    for d, found in regions.items():
        score[d] = max(r["coverage"] for r in found)
    score = np.where(none, score, 1 - (1 - score) / 2)
    labels = [",".join(sorted(names[d] | {r["label"] for r in regions.get(d, ())})) for d in range(rows)]
    arrays = [part.column("id"), pa.array(w.counts()), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in names]), pa.array(labels), pa.array(score), pa.array([regions.get(d, []) for d in range(rows)], _REGION)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "regions"])
