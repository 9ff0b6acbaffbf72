"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are lower-cased words. The hashes of all ``GRAM``-word strings are winnowed: of each ``WINDOW`` consecutive ones the least is a
fingerprint, so a shared passage of GRAM + WINDOW - 1 words shares at least one. An inverted index of the templates' fingerprints gives, for
each that a document holds, the template and the diagonal (place in the document less place in the template). Diagonals within ``BAND`` words
are one candidate, and a local alignment in a band of that width around it gives the words that match, hence the coverage of the template and the span in the document.
Of overlapping spans of one template the better counts. Where no single alignment covers enough, the words that the alignments and the exact matches
around shared grams pair up are chained in order, whatever lies between them, and the chain is measured. A template whose covered words may lie in runs
too short for that is looked for by all its grams, in shorter ones if need be.

Templates are a bounded list (its words are counted against ``MOST_WORDS``) and go to all tasks; documents are read once without a shuffle. A very common line costs its alignment
once a task, as equal stretches are remembered.

Null and empty texts hold no license; templates without words are never found; templates shorter than a gram are one gram. Repeated rows are scanned one by one.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm._text import ALNUM, LOWER, U64, Block, blocks, hash_ranges, mix
from graphloom.llm.suffix_dedup import sliding_min

GRAM, WINDOW, BAND = 3, 2, 8
COVERAGE = 0.8
MOST_WORDS = 1_000_000
MATCH, MISS, GAP = 2, -1, -1

#: Notices of public licenses, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    value = np.zeros(max(len(words) - n + 1, 0), U64)
    for i in range(n if len(value) else 0):
        value = value * U64(0x9E6C63D0676A9A99) + words[i : i + len(value)]
    return mix(value)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints; the first of equals is taken."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.zeros(0, np.int64)
    least = sliding_min(hashes, window)
    place = np.arange(len(least))
    for i in reversed(range(window)):
        place = np.where(hashes[i : i + len(least)] == least, np.arange(len(least)) + i, place)
    return np.unique(place)


def align(template: tuple[bytes, ...], words: tuple[bytes, ...], shift: int, band: int = BAND) -> tuple[int, int, int, tuple[tuple[int, int], ...]]:
    """Best local alignment with place in words - place in template within band of shift: template words that match, the
    first and past-the-end place in words, and the places in both of what matches."""
    best = zero = (0, 0, 0, 0, None)
    above: dict[int, tuple] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple] = {}
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            score, count, first, _, path = above.get(j - 1, zero)
            if word == words[j]:
                cell = (score + MATCH, count + 1, first if score else j, j + 1, (i, j, path))
            else:
                cell = (score + MISS, count, first, j + 1, path)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, *other[1:])
            if cell[0] > 0:
                row[j] = cell
                best = max(best, cell, key=lambda c: (c[0], c[1]))
        above = row
    pairs, path = [], best[4]
    while path:
        pairs.append(path[:2])
        path = path[2]
    return best[1], best[2], best[3], tuple(reversed(pairs))


def chain(pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest list of pairs (place in template, place in text) that ascends in both, of equally long ones one that spans least of the text."""
    order = sorted(pairs, key=lambda x: (x[0], -x[1]))
    rank = {j: r for r, j in enumerate(sorted({j for _, j in order}), 1)}
    #: Fenwick tree over the places in the text: the best (length, first place, pair) that ends at or before each.
    tree: list[tuple] = [(0, 0, -1)] * (len(rank) + 1)
    before, best = [], (0, 0, -1)
    for at, (_, j) in enumerate(order):
        top, r = (0, 0, -1), rank[j] - 1
        while r:
            top, r = max(top, tree[r]), r & (r - 1)
        before.append(top[2])
        here = (top[0] + 1, top[1] if top[0] else j, at)
        best = max(best, here, key=lambda x: (x[0], x[1] - order[x[2]][1] if x[0] else 0))
        r = rank[j]
        while r < len(tree):
            tree[r], r = max(tree[r], here), r + (r & -r)
    out, at = [], best[2]
    while at >= 0:
        out.append(order[at])
        at = before[at]
    return out[::-1]


class Index:
    def __init__(self, templates: dict[str, str]):
        block = Block(pa.RecordBatch.from_pylist([]), [t.encode() for t in templates.values()])
        buf, (starts, ends, first) = LOWER[block.buf], block.words(ALNUM)
        if len(starts) > MOST_WORDS:
            raise ValueError(f"the templates have {len(starts)} words; at most {MOST_WORDS} are sent to all tasks")
        hashes = hash_ranges(buf, starts, ends)
        self.names, self.words, keys = list(templates), [], []
        always: list[int] = []
        short: set[int] = set()
        for t, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            self.words.append(tuple(buf[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)))
            need = math.ceil(COVERAGE * (b - a) - 1e-9)
            #: Words that are left out part those that match into runs; the longest run has at least so many words.
            run = -(-need // (b - a - need + 1))
            g = grams(hashes[a:b], min(GRAM, max(1, run)))
            sure = run >= GRAM + WINDOW - 1
            keys += [(g[i], t, i) for i in (winnow(g) if sure else range(len(g)))]
            always += [] if sure or run < GRAM else g.tolist()
            short |= {run} if 0 < run < GRAM else set()
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        self.keys = np.array([keys[i][0] for i in order], U64)
        self.template, self.place = (np.array([keys[i][c] for i in order], np.int64) for c in (1, 2))
        #: Grams of templates that winnowing may leave without one in common: these are looked for everywhere.
        self.always = np.array(sorted(set(always)), U64)
        self.short = sorted(short)

    def scan(self, block: Block) -> list[list[dict]]:
        """The licenses of each text, with the words that match and where they lie (in words and in bytes)."""
        align_ = lru_cache(100_000)(align)
        buf, (starts, ends, first) = LOWER[block.buf], block.words(ALNUM)
        hashes, out = hash_ranges(buf, starts, ends), [[] for _ in block.texts]
        text = np.repeat(np.arange(len(block)), np.diff(first))
        hits, places = [], []
        for n in [*self.short, GRAM]:
            g = grams(hashes, n)
            at = winnow(g) if n == GRAM else np.arange(len(g))
            # A text's first and last grams are fingerprints too, as their windows are cut by the text's ends.
            edge = np.concatenate([first[:-1] + i for i in range(WINDOW)] + [first[1:] - n - i for i in range(WINDOW)])
            at = np.union1d(at, edge[(edge >= 0) & (edge < len(g))]) if n == GRAM else at
            at = np.union1d(at, np.flatnonzero(np.isin(g, self.always))) if n == GRAM else at
            at = at[text[at] == text[at + n - 1]] if len(at) else at
            lo, hi = np.searchsorted(self.keys, g[at]), np.searchsorted(self.keys, g[at], "right")
            for i in np.flatnonzero(hi > lo):
                for k in range(lo[i], hi[i]):
                    t, template, shift = int(text[at[i]]), int(self.template[k]), int(at[i] - self.place[k])
                    hits.append((t, template, shift))
                    places.append((t, template, shift, int(self.place[k])))

        def span(t: int, template: int, count: int, low: int, stop: int) -> dict:
            base, begin = int(block.first[t]), int(first[t])
            return {"license": self.names[template], "coverage": count / len(self.words[template]), "start": low - begin, "stop": stop - begin, "from_byte": int(starts[low]) - base, "to_byte": int(ends[stop - 1]) - base}

        last, paired, seeds = None, {}, {}
        for t, template, shift in sorted(set(hits)):
            if last and last[:2] == (t, template) and shift - last[2] <= BAND:
                continue
            last = (t, template, shift)
            words = self.words[template]
            low, high = max(int(first[t]), shift - BAND), min(int(first[t + 1]), shift + len(words) + 2 * BAND)
            held = tuple(buf[s:e].tobytes() for s, e in zip(starts[low:high], ends[low:high], strict=True))
            count, a, b, pairs = align_(words, held, shift - low, 2 * BAND)
            paired.setdefault((t, template), set()).update((i, low + j) for i, j in pairs)
            if count >= COVERAGE * len(words):
                out[t].append(span(t, template, count, low + a, low + b))
        for t, template, shift, place in places:
            words, (a, b) = self.words[template], (place, place)
            same = lambda i: 0 <= i < len(words) and first[t] <= i + shift < first[t + 1] and buf[starts[i + shift] : ends[i + shift]].tobytes() == words[i]  # noqa: B023, E731
            if (shift, place) in seeds.setdefault((t, template), set()):
                continue
            while same(a - 1):
                a -= 1
            while same(b):
                b += 1
            seeds[t, template] |= {(shift, i) for i in range(a, b)}
            paired[t, template] |= {(i, i + shift) for i in range(a, b)}
        for (t, template), pairs in paired.items():
            need = COVERAGE * len(self.words[template])
            taken = [(x["start"] + int(first[t]), x["stop"] + int(first[t])) for x in self._best(out[t]) if x["license"] == self.names[template]]
            pairs = {(i, j) for i, j in pairs if not any(a <= j < b for a, b in taken)}
            while len({i for i, _ in pairs}) >= need and len(found := chain(pairs)) >= need:
                out[t].append(span(t, template, len(found), found[0][1], found[-1][1] + 1))
                pairs = {(i, j) for i, j in pairs if not found[0][1] <= j <= found[-1][1]}
        return [self._best(x) for x in out]

    @staticmethod
    def _best(found: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for x in sorted(found, key=lambda x: (-x["coverage"], x["license"], x["start"], x["stop"])):
            if not any(y["license"] == x["license"] and x["start"] < y["stop"] and y["start"] < x["stop"] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x["start"], x["stop"], x["license"]))


FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licenses: for each license found its coverage and its span in words and bytes (ends past the last)."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(sent.value.scan(block), FOUND)], ["doc_id", "licenses"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, licenses array<struct<license: string, coverage: double, start: long, stop: long, from_byte: long, to_byte: long>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each license found in a document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "inline(licenses)")
