"""License scans: which license texts a document holds, how much, and where.

Method: templates are read as words and fingerprinted by winnowing (the least
hash of every ``WINDOW`` successive k-grams), so any run of ``GRAM + WINDOW - 1``
words in common has a fingerprint in the inverted index.  A document looks up
all its k-grams; hits of a template near one diagonal are a candidate, and a
banded alignment of the template with the words there reports the share of the
template that is matched and the span of the match.  Candidates that hold successive
parts of a template, at most its length apart, are also aligned as one, in a band
over all their diagonals: an insertion or omission of any length up to that.

The index holds the templates only (a constant of the query), so documents are
scanned in one map stage, without a shuffle, whatever their number.

Defined results: matches of at least ``min_coverage`` are rows (id, license,
coverage, start, end in code points, end exclusive); a match inside a better one
is left out; documents without matches, null and empty texts give no rows;
repeated rows and null ids are scanned each; empty tables give empty results.
Only the id and text columns are read.
"""

from __future__ import annotations

import pkgutil
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

GRAM, WINDOW, BAND = 3, 2, 8
_WORD = re.compile(r"[^\W_]+")

# Notices and opening texts of common licenses; the whole texts of the
# short ones (NAME-text) are files beside this module.  Apache and GPL are openings only.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                  "in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without permission.",
}
for _name in ("mit", "bsd-2-clause", "bsd-3-clause", "isc"):
    TEMPLATES[f"{_name}-text"] = pkgutil.get_data("factloom.llm", f"licenses/{_name}-text.txt").decode()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _winnowed(ids: list[int]) -> list[int]:
    """Positions of the k-grams whose hash is the least of a window."""
    hashes = [zlib.crc32(np.array(ids[i:i + GRAM], np.int32).tobytes()) for i in range(len(ids) - GRAM + 1)]
    chosen = {min(range(i, min(i + WINDOW, len(hashes))), key=lambda j: (hashes[j], -j))
              for i in range(max(1, len(hashes) - WINDOW + 1))} if hashes else set()
    return sorted(chosen)


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words(text) for name, text in templates.items()}
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in self.templates.values() for w in t}))}
        self.size = len(self.number) + 1
        self.postings: dict[int, list[tuple[str, int]]] = {}
        for name, text in self.templates.items():
            ids = [self.number[w] for w in text]
            for at in _winnowed(ids):
                self.postings.setdefault(self._code(ids[at:at + GRAM]), []).append((name, at))
        self.codes = np.array(sorted(self.postings), np.int64)
        self.counts = {name: np.unique([self.number[w] for w in text], return_counts=True)
                       for name, text in self.templates.items() if text}

    def within(self, name: str, ids: np.ndarray, least: float) -> bool:
        """Whether the words of a stretch, in any order, may match so much."""
        number, count = self.counts[name]
        there = np.bincount(ids, minlength=self.size)[number]
        return int(np.minimum(there, count).sum()) / len(self.templates[name]) >= least

    def _code(self, gram) -> int:
        code = 0
        for i in gram:
            code = code * self.size + i
        return code

    def candidates(self, ids: np.ndarray, least: float = 0.0) -> list[tuple[str, int, int, int, int]]:
        """(template, place in the document where it would begin, how far that moves,
        first and last place that may count): hits within a band of each other, then
        chains of them, which move.  Stretches without the words for a coverage of
        ``least`` are none."""
        if len(ids) < GRAM or not len(self.codes):
            return []
        codes = np.zeros(len(ids) - GRAM + 1, np.int64)
        known = np.ones(len(codes), bool)
        for i in range(GRAM):
            part = ids[i:i + len(codes)]
            codes = codes * self.size + part
            known &= part > 0
        near = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hits = np.flatnonzero(known & (self.codes[near] == codes))
        postings = [(int(p), self.postings[int(codes[p])]) for p in hits]
        may = {name for name in {name for _, of in postings for name, _ in of} if self.within(name, ids, least)}
        begins = sorted({(name, p - at, at) for p, of in postings for name, at in of if name in may})
        groups: dict[str, list[list[tuple[int, int]]]] = {}
        for name, begin, at in begins:
            of = groups.setdefault(name, [])
            if not of or begin - of[-1][0][0] > BAND:
                of.append([])
            of[-1].append((begin, at))
        out = [(name, group[0][0], 0, 0, len(ids)) for name, of in groups.items() for group in of]
        out += [c for name, of in groups.items() if len(of) > 1 for c in self._chains(name, of, len(ids))]

        def stretch(name: str, begin: int, moves: int, low: int, high: int) -> np.ndarray:
            return ids[max(low, begin - BAND):max(0, min(high, begin + moves + BAND + len(self.templates[name])))]

        return [c for c in out if self.within(c[0], stretch(*c), least)]

    def _chains(self, name: str, groups: list[list[tuple[int, int]]], end: int) -> list[tuple[str, int, int, int, int]]:
        """Candidates of parts of two groups or more: each next one holds a later part
        of the template, found at most the template's length further on.  A part is a
        group's hits without a gap, as phrases that a template repeats hit elsewhere."""
        length = len(self.templates[name])
        runs: list[list[tuple[int, int]]] = []
        for group in groups:
            ordered = sorted(group, key=lambda h: (h[0] + h[1], h))
            for n, hit in enumerate(ordered):
                if n and sum(hit) - sum(ordered[n - 1]) <= BAND:
                    runs[-1].append(hit)
                else:
                    runs.append([hit])
        parts = sorted(_Part(sum(g[0]), sum(g[-1]) + GRAM, min(a for _, a in g), max(a for _, a in g) + GRAM,
                             min(b for b, _ in g), max(b for b, _ in g), len({a for _, a in g})) for g in runs)
        weight, back = [p.hits for p in parts], [-1] * len(parts)
        for j, b in enumerate(parts):
            for i in range(j - 1, -1, -1):
                a = parts[i]
                if b.first - a.first > 2 * length + BAND + GRAM:
                    break
                if (b.first - a.last <= length and _after(a.first, a.last, b.first, b.last)
                        and _after(a.begin, a.end, b.begin, b.end) and weight[i] + b.hits > weight[j]):
                    weight[j], back[j] = weight[i] + b.hits, i
        out, used = [], set()
        for j in sorted(range(len(parts)), key=lambda j: (-weight[j], j)):
            chain = []
            while j >= 0 and j not in used:
                used.add(j)
                chain.append(parts[j])
                j = back[j]
            low, high = min((p.low for p in chain), default=0), max((p.high for p in chain), default=0)
            if high - low > BAND:
                head, tail = chain[-1], chain[0]
                out.append((name, low, high - low, max(0, head.first - head.begin - BAND),
                            min(end, tail.last + length - tail.end + BAND)))
        return out


class _Part(NamedTuple):
    """A part of a group of hits: its places in the document and in the template, the places
    where the template would begin, and the number of its fingerprints."""

    first: int
    last: int
    begin: int
    end: int
    low: int
    high: int
    hits: int


def _after(a: int, a_end: int, b: int, b_end: int) -> bool:
    """Whether the second stretch goes on where the first ends, sharing less than
    half of the shorter one."""
    return a < b and a_end < b_end and 2 * (a_end - b) < min(a_end - a, b_end - b)


def align(template: list[str], text: list[str], begin: int, moves: int = 0, low: int = 0,
          high: int | None = None) -> tuple[int, int, int]:
    """Most words in common, in order, of the template and ``text`` from ``low`` to
    ``high`` within ``BAND`` of the diagonals from ``begin`` to ``moves`` further on:
    their number and the first and last place in the text; of equal alignments the
    shortest stretch."""
    width = 2 * BAND + 1 + moves
    high = len(text) if high is None else high
    # A cell is (matches, -first place, last place); -1 is before any match.
    row = [(0, 1, -1)] * width
    for i, word in enumerate(template):
        new: list[tuple[int, int, int]] = []
        for o in range(width):
            place = begin + i + o - BAND
            options = [row[o + 1] if o + 1 < width else (0, 1, -1), new[-1] if new else (0, 1, -1)]
            if low <= place < high and text[place] == word:
                n, first, _ = row[o]
                options.append((n + 1, -place if n == 0 else first, place))
            new.append(max(options, key=lambda c: (c[0], c[1], -c[2])))
        row = new
    n, first, last = max(row, key=lambda c: (c[0], c[1], -c[2]))
    return n, -first, last


def matches(text: str, index: Index, min_coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of a text, by start."""
    number, found = index.number, text.lower()
    ids = np.array([number.get(w, 0) for w in _WORD.findall(found)], np.int64)
    candidates = index.candidates(ids, min_coverage)
    if not candidates:
        return []
    places = [m.span() for m in _WORD.finditer(found)]
    if len(found) != len(text):
        # Lower case has another length here; places are those of the text itself.
        owner = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
        places = [(owner[start], owner[end - 1] + 1) for start, end in places]
    own = words(text)
    aligned = []
    for name, begin, moves, low, high in candidates:
        n, first, last = align(index.templates[name], own, begin, moves, low, high)
        if n and n / len(index.templates[name]) >= min_coverage:
            aligned.append((n, n / len(index.templates[name]), name, places[first][0], places[last][1], moves > 0))
    kept: list[tuple] = []
    for a in sorted(aligned, key=lambda a: (-a[1] * a[0], a[2], a[5], a[3])):
        if not any(a[3] < k[4] and k[3] < a[4] for k in kept):
            kept.append(a)
    return [(name, cover, start, end) for _, cover, name, start, end, _ in sorted(kept, key=lambda k: k[3])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: id, ``license``, ``coverage``, ``start``, ``end``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, id_type = src.schema["id"].dataType.simpleString(), to_arrow_type(src.schema["id"].dataType)
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in batches:
            found = [(i, m) for i, t in enumerate(batch.column(1)) for m in matches(t.as_py() or "", index, min_coverage)]
            columns = list(zip(*[m for _, m in found])) or [()] * 4
            yield pa.record_batch(
                [batch.column(0).take(pa.array([i for i, _ in found], pa.int64())).cast(id_type)]
                + [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.int32()))],
                names=["id", "license", "coverage", "start", "end"])

    out = src.mapInArrow(run, f"id {kind}, license string, coverage double, start int, end int")
    return out.withColumnRenamed("id", id_col)
