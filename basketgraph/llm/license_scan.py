"""Operator 7: license scans by patience alignment.

Every whole text is compared with every template, word by word (A-Z lower-cased, ASCII
punctuation dropped). Words unique to both sides are anchors, of which the longest increasing
run is kept; the gaps between them are aligned the same way (``alignment.align``). Coverage is
the share of the template's words that are matched within the span of the match, provided the
span is at most ``SPREAD`` times as long as the template.

Two exact shortcuts save work without losing matches. Words outside the templates cannot
match, so only positions of template words are aligned. The template words present in a text
bound the coverage from above, and texts below the wanted coverage by that bound are done.
A text may hold a notice more than once, and then has no unique words; besides the whole text,
the surroundings of the template's rarest words are therefore aligned: of a match that covers
enough, at least one of the (missing words allowed + 1) rarest words must be part.

The scan is a map over documents, without a shuffle; templates are a small argument.

Defined cases: null and empty texts match nothing; repeated rows and null ids are scanned like
any other; of equal coverage the longer template, then the smaller name wins; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import align
from .text import PUNCT, slices, text_buffer, word_hashes

COVERAGE = 0.8
SPREAD = 2
# Public notices, fixed wording.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "all-rights-reserved": "All rights reserved.",
}


def _hashed(text: str) -> list[int]:
    return word_hashes(*text_buffer(pa.array([text])), PUNCT)[0].tolist()


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, _hashed(templates[name])) for name in sorted(templates)]
        self.vocabulary = np.unique(np.array([w for _, t in self.templates for w in t], np.uint64))
        place = {int(w): i for i, w in enumerate(self.vocabulary)}
        self.coded = [(name, [place[w] for w in t]) for name, t in self.templates]
        self.uses = np.zeros((len(self.vocabulary), len(self.coded)))
        for k, (_, t) in enumerate(self.coded):
            np.add.at(self.uses[:, k], t, 1)

    def best(self, template: list[int], words: list[int], places: list[int]) -> tuple[int, int, int] | None:
        """(matched words, first place, last place) of the best match that covers enough.
        ``words``: codes of the template words in the text, at ``places``."""
        need = -(-self.coverage * len(template) // 1)
        inside = set(template)
        keep = [i for i, w in enumerate(words) if w in inside]
        words, places = [words[i] for i in keep], [places[i] for i in keep]
        reach = SPREAD * len(template)
        at: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        spare = len(template) - int(need)
        rarest = sorted(((len(at.get(w, ())), w) for w in template))[: spare + 1]
        windows = [(0, len(words))]
        seen = set()
        for i in sorted({i for _, w in rarest for i in at.get(w, ())}):
            low, high = i, i + 1
            while low and places[low - 1] > places[i] - reach:
                low -= 1
            while high < len(words) and places[high] < places[i] + reach:
                high += 1
            if (low, high) not in seen:
                seen.add((low, high))
                windows.append((low, high))
        found = None
        for low, high in windows:
            if high - low < need:
                continue
            pairs = align(words[low:high], template, repeats=False)
            hit = self._span([places[low + i] for i, _ in pairs], need, reach)
            if hit and (found is None or (hit[0], -hit[1]) > (found[0], -found[1])):
                found = hit
        return found

    @staticmethod
    def _span(matched: list[int], need: float, reach: int) -> tuple[int, int, int] | None:
        """The most matched places within ``reach`` words, if at least ``need``."""
        best, low = None, 0
        for high, place in enumerate(matched):
            while place - matched[low] >= reach:
                low += 1
            n = high - low + 1
            if n >= need and (best is None or n > best[0]):
                best = (n, matched[low], place)
        return best

    def scan(self, column: pa.Array) -> list[list[tuple]]:
        """For each text its matches: (license, coverage, first word, last word)."""
        words, pointer, _, _ = word_hashes(*text_buffer(column), PUNCT)
        code = np.searchsorted(self.vocabulary, words)
        code[code == len(self.vocabulary)] = 0
        hits = np.flatnonzero(self.vocabulary[code] == words)
        owner = np.searchsorted(pointer, hits, "right") - 1
        present = np.zeros((len(column), len(self.vocabulary)), bool)
        present[owner, code[hits]] = True
        sizes = np.array([len(t) for _, t in self.coded])
        possible = present @ self.uses >= self.coverage * sizes - 1e-9
        ends = np.searchsorted(owner, np.arange(len(column) + 1))
        out: list[list[tuple]] = [[] for _ in range(len(column))]
        for i, k in zip(*np.nonzero(possible), strict=True):
            own = hits[ends[i]: ends[i + 1]]
            name, template = self.coded[k]
            found = self.best(template, code[own].tolist(), (own - pointer[i]).tolist())
            if found:
                out[i].append((name, found[0] / len(template), found[1], found[2], len(template)))
        return [[m[:4] for m in sorted(ms, key=lambda m: (-m[1], -m[4], m[0]))] for ms in out]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE) -> DataFrame:
    """doc_id and matches: array of (license, coverage, first_word, last_word), best first."""
    templates = dict(TEMPLATES if templates is None else templates)
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()),
                       ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[dict(zip(("license", "coverage", "first_word", "last_word"), m, strict=True)) for m in ms]
                         for ms in scanner.scan(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(match))], names=["doc_id", "matches"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
             "matches array<struct<license: string, coverage: double, first_word: bigint, last_word: bigint>>")


def op7_license_scan(spark, sf_dir):
    """One row a document: its best license (else null), coverage and span, and how many."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.try_element_at("matches", F.lit(1))
    return found.select("doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"),
                        best["first_word"].alias("first_word"), best["last_word"].alias("last_word"),
                        F.size("matches").cast("long").alias("n_licenses"))
