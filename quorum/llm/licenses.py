"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports what matches.

Templates are whole license texts, the notices by which works are put under a license, license names and identifiers.
Longer ones are cut into segments; each is aligned by itself with the words around its fingerprints' diagonal, and aligned
segments in order make up a match of the whole. Of templates that match at one place that with the most words matched less
words unmatched is reported.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .words import _SHINGLE, CHUNK, WORD, mixed, text_bytes, words_at

# Notices by which works are put under well-known licenses. One row per notice.
NOTICES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Names of licenses and, in the second list, identifiers as they follow "SPDX-License-Identifier:".
NAMES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("ISC", "ISC License"), ("Unlicense", "The Unlicense"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0", "GNU General Public License version 2"), ("GPL-3.0", "GNU General Public License version 3"), ("LGPL-2.1", "GNU Lesser General Public License version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
)
IDENTIFIERS = "MIT Apache-2.0 ISC Unlicense CC0-1.0 BSD-2-Clause BSD-3-Clause MPL-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
SUFFIXES = "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()  # those that "-only" and "-or-later" may follow

#: Words of a fingerprinted gram; grams of a winnowing window; words up to which a template has all its grams as
#: fingerprints; words of a segment; the band on each side of a diagonal; the least share of a template's words that
#: must match, in hundredths; the share of a segment's fingerprints that must be met for it to be aligned.
GRAM, WINDOW, ALL_GRAMS, SEGMENT, BAND, LEAST_PERCENT, LEAST_MET = 3, 3, 24, 32, 8, 80, 0.2

#: Words are runs of letters and digits; A-Z are lower-cased, all other ASCII separates.
_LETTERS = np.where(np.array([b >= 128 or chr(b).isalnum() for b in range(256)]), WORD, 0).astype(np.uint8)


@dataclass(frozen=True)
class Template:
    license: str
    kind: str  # text, notice, name or identifier; of the last two all words must match
    text: str


def templates() -> list[Template]:
    """The license texts beside this module, and the notices, names and identifiers."""
    texts = [Template(f.name.removesuffix(".txt"), "text", f.read_text("utf-8")) for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]
    ids = [(x, f"{x}{end}") for x in IDENTIFIERS for end in (("", "-only", "-or-later") if x in SUFFIXES else ("",))]
    return texts + [Template(n, "notice", t) for n, t in NOTICES] + [Template(n, "name", t) for n, t in NAMES] + [Template(n, "identifier", f"SPDX-License-Identifier: {t}") for n, t in ids]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        g += h[j : len(h) - k + 1 + j] * _SHINGLE[j]
    return mixed(g + np.uint64(k))


def winnowed(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of each window, the last of equal ones; of a shorter run the least of all."""
    if not len(g):
        return np.zeros(0, np.int64)
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    w = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(w)) + window - 1 - np.argmin(w[:, ::-1], axis=1))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_at(data, np.array([0, len(data)]), _LETTERS)[1]


def aligned(a: list, b: list, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched, first, end): the longest common subsequence of template a and text b within a band around j - i = diagonal, and b's words from its first to its last."""
    if diagonal >= 0 and a == b[diagonal : diagonal + len(a)]:
        return len(a), diagonal, diagonal + len(a)
    row: list[tuple[int, int, int]] = [(0, -1, -1)] * (2 * band + 3)  # cells j - i - diagonal + band + 1
    best = (0, -1, -1)
    for i, x in enumerate(a):
        new = [(0, -1, -1)] * (2 * band + 3)
        for c in range(1, 2 * band + 2):
            j = i + diagonal + c - band - 1
            cell = max(row[c + 1], new[c - 1], key=lambda t: t[0])
            if 0 <= j < len(b) and x == b[j]:
                n, first, _ = row[c]
                if n + 1 > cell[0]:
                    cell = (n + 1, first if n else j, j + 1)
            new[c] = cell
            if cell[0] > best[0]:
                best = cell
        row = new
    return best


def in_order(a: list, b: list) -> int:
    """The length of the longest common subsequence: bit i of v is 0 where a's first i + 1 words gain a match from the last."""
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    every = v = (1 << len(a)) - 1
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


class Index:
    """The templates in segments, and an inverted index from fingerprints to (segment, place)."""

    def __init__(self, known: list[Template], gram: int = GRAM, window: int = WINDOW, segment: int = SEGMENT):
        self.names, self.words, self.sizes, self.segments, self.need = [(t.license, t.kind) for t in known], [], [], [], []
        self.gram = gram
        places = defaultdict(list)
        for t, template in enumerate(known):
            h = word_hashes(template.text)
            self.words.append(h.tolist())
            self.sizes.append(len(h))
            cuts = [*range(0, max(1, len(h) - segment // 2), segment), len(h)]
            for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                # of n words in order u may be missing: a run of (n - u) / (u + 1) is left, of five words two
                u = (j - i) * (100 - LEAST_PERCENT) // 100
                grams = _grams(h[i:j], min(gram, max(2, -(-(j - i - u) // (u + 1)))))
                at = np.arange(len(grams)) if len(h) <= ALL_GRAMS else winnowed(grams, window)
                for p in at.tolist():
                    places[int(grams[p])].append((len(self.segments), p))
                # a word that doesn't match takes up to gram fingerprints with it: of short templates any one met is enough
                self.need.append(1 if len(h) <= ALL_GRAMS else max(1, int(LEAST_MET * len(at))))
                self.segments.append((t, s, h[i:j].tolist()))
        self.keys = np.array(sorted(places), np.uint64)
        lists = [places[int(k)] for k in self.keys]
        self.starts = np.cumsum([0, *map(len, lists)])
        self.of, self.place = (np.array([x[k] for v in lists for x in v], np.int64) for k in (0, 1))
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams of h that are fingerprints, and their numbers."""
        ats, keys = [], []
        for k in {self.gram, 2}:
            g = _grams(h, k)
            at = np.flatnonzero(self.may[(g & np.uint64(0xFFFFF)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            same = self.keys[i] == g[at]
            ats.append(at[same])
            keys.append(i[same])
        return np.concatenate(ats), np.concatenate(keys)


def matches(ix: Index, words: np.ndarray, at: np.ndarray, keys: np.ndarray, band: int, least_percent: int) -> list[tuple]:
    """(template, matched, first, end) of a text's words from its hits: what is best at each place, in order."""
    if not len(at):
        return []
    n = ix.starts[keys + 1] - ix.starts[keys]
    i = np.repeat(ix.starts[keys] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    of, diagonal = ix.of[i], np.repeat(at, n) - ix.place[i]
    order = np.lexsort((diagonal, of))
    of, diagonal = of[order], diagonal[order]
    parts = defaultdict(list)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        t, s, segment = ix.segments[of[lo]]
        width = min(band, max(1, len(segment) // 4))  # less than what lies between adjacent copies
        whole = ix.sizes[t] == len(segment)
        least = (100 if ix.names[t][1] in ("name", "identifier") else least_percent) if whole else 50
        d, c = np.unique(diagonal[lo:hi], return_counts=True)
        k, ends, upto = 0, np.searchsorted(d, d + width, "right"), np.r_[0, np.cumsum(c)]
        while k < len(d):
            e = int(ends[k])
            if upto[e] - upto[k] < ix.need[of[lo]]:
                k += 1
                continue
            main = int(d[k + int(np.argmax(c[k:e]))])
            start = max(0, main - width)
            m, first, end = aligned(segment, words[start : main + len(segment) + width + 1].tolist(), main - start, width)
            if 100 * m >= least * len(segment):
                parts[t].append((start + first, start + end, s, m))
            k = e
    found = [x for t, v in parts.items() if ix.sizes[t] <= SEGMENT for x in chained(t, ix.sizes[t], sorted(v), least_percent)]
    for t, v in parts.items():  # where segments are aligned in order the whole is counted
        if ix.sizes[t] > SEGMENT:
            for _, _, first, end in chained(t, ix.sizes[t], sorted(v), least_percent - 15):
                m = in_order(ix.words[t], words[first:end].tolist())
                if 100 * m >= least_percent * ix.sizes[t]:
                    found.append((t, m, first, end))
    worth = lambda x: x[1] - (ix.sizes[x[0]] - x[1]) - (x[3] - x[2] - x[1])  # noqa: E731  matched less unmatched words, of template and text
    kept: list[tuple[int, int, int, int]] = []  # by place
    for t, m, first, end in sorted(found, key=lambda x: (-worth(x), x[2], x[0])):
        k = bisect_left(kept, (first,))
        if (k == len(kept) or kept[k][0] >= end) and (k == 0 or kept[k - 1][1] <= first):
            insort(kept, (first, end, t, m))
    return [(t, m, first, end) for first, end, t, m in kept]


def chained(t: int, size: int, parts: list[tuple[int, int, int, int]], least_percent: int) -> list[tuple[int, int, int, int]]:
    """(t, matched, first, end): aligned segments (first, end, number, matched) of a template put together in order while enough of its words match.

    parts are in order. The chain with the most words is taken out with all parts that it overlaps, again and again. What
    is best for a part is found anew only where the part before it has gone or has become worse, so many copies in one text
    cost time in proportion to their number.
    """
    best, back, after, gone = [0] * len(parts), [-1] * len(parts), defaultdict(set), [False] * len(parts)

    def solve(j):
        first, _, s, m = parts[j]
        most, before = m, -1
        for i in range(j - 1, -1, -1):
            if first - parts[i][0] > 2 * size + SEGMENT:
                break
            both = max(0, parts[i][1] - first)  # words that ends of neighbours may share, which count once
            if not gone[i] and parts[i][2] < s and both <= BAND and first - parts[i][1] <= (s - parts[i][2]) * 4 * SEGMENT and best[i] + m - both > most:
                most, before = best[i] + m - both, i
        after[back[j]].discard(j)
        after[before].add(j)
        best[j], back[j] = most, before

    for j in range(len(parts)):
        solve(j)
    out, tops = [], [(-n, j) for j, n in enumerate(best)]
    heapify(tops)
    longest = max((p[1] - p[0] for p in parts), default=0)
    while tops:
        most, top = heappop(tops)
        if gone[top] or -most != best[top]:
            continue
        if 100 * best[top] < least_percent * size:
            break
        start = top
        while back[start] >= 0:
            start = back[start]
        first, end = parts[start][0], parts[top][1]
        out.append((t, best[top], first, end))
        if size <= SEGMENT:  # each part is a match by itself
            out += [(t, p[3], p[0], p[1]) for k, p in enumerate(parts) if k != top and 100 * p[3] >= least_percent * size]
            break
        worse: set[int] = set()
        for k in range(bisect_left(parts, (first - longest,)), bisect_left(parts, (end,))):
            if not gone[k] and parts[k][1] > first:
                gone[k] = True
                worse |= after[k]
        left = sorted(worse)  # a sorted list is a heap
        while left:
            j = heappop(left)
            if gone[j]:
                continue
            was = best[j]
            solve(j)
            if best[j] < was:
                heappush(tops, (-best[j], j))
                for k in after[j] - worse:
                    worse.add(k)
                    heappush(left, k)
    return out


def scan(docs: DataFrame, known: list[Template] | None = None, band: int = BAND, least_percent: int = LEAST_PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, license, kind, template, coverage, matched, words, start, end): one row per match: a place of a text where a template's words occur in order.

    known: the templates, by default templates(). Words are runs of letters and digits without case. coverage is the matched
    hundredths of the template's words; start and end are code points. Matches in one text don't overlap: of overlapping
    ones that with the most words matched less words unmatched (of template and text) stays, then the earlier. Null and
    empty texts match nothing; repeated rows are reported as often as they occur; extra columns aren't read. The index of
    the templates goes to each task: its size doesn't depend on the documents.
    """
    index = Index(templates() if known is None else known)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = ["doc", "license", "kind", "template", "coverage", "matched", "words", "start", "end"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def find(batches):
        ix = shared.value
        for b in batches:
            data, off = text_bytes(b.column(1))
            out, r = [], 0
            while r < b.num_rows:
                e = max(r + 1, int(np.searchsorted(off, off[r] + CHUNK, "right")) - 1)
                part, rows = data[off[r] : off[e]], off[r : e + 1] - off[r]
                starts, h, words = words_at(part, rows, _LETTERS)
                at, keys = ix.hits(h)
                row = np.searchsorted(words, at, "right") - 1
                for x in np.unique(row).tolist():
                    mine = row == x
                    lo, hi, began = int(words[x]), int(words[x + 1]), int(rows[x])
                    raw = part[began : int(rows[x + 1])]
                    for t, m, first, end in matches(ix, h[lo:hi], at[mine] - lo, keys[mine], band, least_percent):
                        s, last = int(starts[lo + first]) - began, int(starts[lo + end - 1]) - began
                        stop = last + 1
                        while stop < len(raw) and _LETTERS[raw[stop]]:
                            stop += 1
                        chars = len(raw[:s].tobytes().decode())
                        out.append((b.column(0)[r + x].as_py(), *ix.names[t], t, 100 * m // ix.sizes[t], m, ix.sizes[t], chars, chars + len(raw[s:stop].tobytes().decode())))
                r = e
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t"))
    return rows.mapInArrow(find, "doc long, license string, kind string, template int, coverage int, matched long, words long, start long, end long")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(documents(spark, sf_dir))
    return df.select(F.col("doc").alias("doc_id"), "license", "kind", "template", "coverage", "matched", "words", F.col("start").alias("start_char"), F.col("end").alias("end_char"))
