"""License scans by patience alignment (operator 9).

A stretch of a text holds a template if the patience alignment of the two covers
``COVERAGE`` of the template's words. Words unique to both are anchors, their longest
increasing subsequence is kept, and the gaps between anchors are aligned in the same
way; a gap without unique common words is aligned by its longest common subsequence.
Stretches begin at words that may be the first ones covered and have at most
``2 * len(template)`` words. Each is aligned twice: in its first ``len(template)``
words, where an undisturbed notice has its words to itself, and whole, which leaves
room for inserted words; the alignment that covers more counts. Only stretches that
can't reach the coverage are passed over unaligned: those with too few of the
template's words, each counted at most as often as in the template. ``matched`` and
``coverage`` are what the alignment covers, ``first_word`` and ``last_word`` its ends.
Words are compared lower-cased, without punctuation.

Patience may cover less than a longest common subsequence where words are moved or
repeated; README has figures.

Defined results: null, empty and wordless texts match nothing; every template that a
text holds gives one row, with the best of its stretches (ties: the first, as narrow as
it can be) and how many it has that don't overlap; rows that share a doc_id are scanned
one by one.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

#: Notices as their licences ask for them, and short forms in common use (fixed values).
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                  "See the License for the specific language governing permissions and limitations under the License.",
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
               "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                    "in the documentation and/or other materials provided with the distribution.",
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by first) whose seconds increase."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[k], ends[k] = y, i
        before[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as index pairs; of ``a`` its pairs begin as late as they can."""
    best = [[0] * (len(b) + 1)]
    for x in a:
        row, up = [0], best[-1]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(up[j + 1], row[j]))
        best.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words of ``a`` and ``b``, increasing in both, by patience."""
    if not a or not b:
        return []
    mine, theirs = _unique(a), _unique(b)
    anchors = increasing(sorted((mine[w], theirs[w]) for w in mine.keys() & theirs.keys()))
    if not anchors:
        return common(a, b)
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in align(a[i:x], b[j:y])]
        if x < len(a) or y < len(b):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def _unique(s: list[str]) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i, w in enumerate(s):
        seen[w] = -1 if w in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def stretches(at: list[int], length: int, need: int) -> list[tuple[int, int]]:
    """Ranges of the vocabulary hits ``at`` (word positions) that may hold a match of ``need`` words in ``2 * length``.

    Overlapping ranges are one.
    """
    out: list[tuple[int, int]] = []
    for i in range(len(at) - need + 1):
        if at[i + need - 1] - at[i] < 2 * length:
            if out and i < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], i + need))
            else:
                out.append((i, i + need))
    return out


def windows(run: list[tuple[int, str]], template: list[str], need: int):
    """(start, reach, matched, end) of the stretches from each hit of ``run`` whose alignment covers ``need`` words of the template.

    ``run``: hits (word position, word). All but ``matched`` are indices into it: the
    first word covered, the one with which ``need`` are covered, and the last.
    """
    length = len(template)
    limit = Counter(template)
    place: dict[str, int] = {}
    for i, w in enumerate(template):
        place.setdefault(w, i)
    held, inside, stop, near = dict.fromkeys(limit, 0), 0, 0, 0
    for start, (low, first) in enumerate(run):
        while stop < len(run) and run[stop][0] < low + 2 * length:
            w = run[stop][1]
            held[w] += 1
            inside += held[w] <= limit[w]
            stop += 1
        if inside >= need and place[first] <= length - need:
            near = max(near, start)
            while near < stop and run[near][0] < low + length:
                near += 1
            words = [w for _, w in run[start:stop]]
            pairs = align(words[:near - start], template) if near - start >= need else []
            if len(pairs) < length and near < stop:
                pairs = max(pairs, align(words, template), key=len)
            if len(pairs) >= need:
                yield start + pairs[0][0], start + pairs[need - 1][0], len(pairs), start + pairs[-1][0]
        inside -= held[first] <= limit[first]
        held[first] -= 1


def matches(text_words: list[str], templates: dict[str, list[str]], coverage: float = COVERAGE):
    """(name, coverage, matched, first word, last word, stretches) of the templates found."""
    vocabulary = {w for t in templates.values() for w in t}
    hits = [(i, w) for i, w in enumerate(text_words) if w in vocabulary]
    for name, template in templates.items():
        own = set(template)
        mine = [(i, w) for i, w in hits if w in own]
        need = -(-int(round(coverage * 1000)) * len(template) // 1000)
        best, count = None, 0
        for a, b in stretches([i for i, _ in mine], len(template), need):
            run = mine[a:b]
            found = list(windows(run, template, need))
            free = 0                                         # disjoint stretches: always the one that ends first
            for start, reach, _, _ in sorted(found, key=lambda f: f[1]):
                if start >= free:
                    count, free = count + 1, reach + 1
            top, upto = None, -1                             # of the first best stretch and those that overlap it the narrowest
            for start, _, matched, end in found:
                if top is None or matched > top[1] or (matched == top[1] and start <= upto and run[end][0] - run[start][0] < run[top[2]][0] - run[top[0]][0]):
                    if top is None or matched > top[1]:
                        upto = end
                    top = (start, matched, end)
            if top and (best is None or top[1] > best[0]):
                best = (top[1], run[top[0]][0], run[top[2]][0])
        if best:
            yield name, best[0] / len(template), *best, count


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and template it holds: doc_id, license, coverage, matched, first_word, last_word, stretches."""
    known = {name: words_of(t) for name, t in (templates or TEMPLATES).items()}
    schema = "doc_id long, license string, coverage double, matched int, first_word int, last_word int, stretches int"

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in matches(words_of(text), known, coverage)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
