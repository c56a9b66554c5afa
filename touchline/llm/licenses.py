"""License scans: MinHash bands over overlapping text windows retrieve license templates.

A template of n five-word shingles is sought in windows of n shingles that
start every ``max(1, n // STRIDE)`` shingles, so some window lies within half
a stride of any occurrence: an occurrence that holds at least ``CONTAINMENT``
of the template's shingles has a window of similarity ``SIMILARITY`` or more.
Signatures have ``BANDS`` bands of ``ROWS`` minima; such a window shares a band
with its template with a chance of at least 1 - (1 - SIMILARITY**ROWS)**BANDS
(``collision_probability``, over 0.999 by the default settings; certain for
an exact occurrence of a template that the stride meets, and for templates of a few shingles).
Window minima come from block minima, so a text is hashed once for each hash
function and template, however much its windows overlap. Only texts that hold ``CONTAINMENT`` of
a template's shingles anywhere, which every match needs, are searched for it. Every retrieved window, widened by a
stride on both sides, is verified: the exact share of the template's distinct shingles
that it contains must reach ``CONTAINMENT``. Overlapping matches of one
template are merged to one span.

Words are compared without the punctuation at their edges, and words of punctuation alone are passed over, so
a notice is found with another mark behind it, in quotes or in a comment. ``matched`` is the share found so;
``containment`` is the share of the template's shingles that the span holds as they are written.

``TEMPLATES`` holds notices in several forms and opening passages, ``WHOLE`` the whole texts in ``license_texts``; each whole text
also in parts of about ``PART_WORDS`` words (``<name>-part<i>``), so that a text with a piece of a license is found too.

Templates are a parameter of known size, carried in the task; the scan is one
``mapInArrow`` without a shuffle, whatever text all documents share.

Defined cases: null and empty texts, and texts or templates of fewer than
five words, match nothing (a template that short is an error); repeated rows are scanned each; null ids pass
through; a span holding several templates gives a row for each; further columns are passed over.
"""

from __future__ import annotations

import string
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.common import binary_texts, map_arrow, text_slices
from touchline.llm.textops import LOWER, joined, mix, shingle_hashes, word_hashes, word_spans

BANDS, ROWS = 20, 2
SIMILARITY = 0.6
CONTAINMENT = 0.75
STRIDE = 8
PART_WORDS = 200

# Notices and texts of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
           "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-notice-2": "Licensed under the MIT License",
    "MIT-notice-3": "This project is licensed under the terms of the MIT license",
    "Apache-2.0-notice-2": "Licensed under the Apache License 2.0",
    "Apache-2.0-notice-3": "Licensed under the Apache 2.0 License",
    "GPL-notice-2": "Licensed under the GNU General Public License",
    "GPL-notice-3": "Released under the GNU General Public License",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "Licensed under the GNU Lesser General Public License",
    "LGPL-notice-2": "Released under the GNU Lesser General Public License",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
            "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice-2": "Licensed under the Mozilla Public License",
    "BSD-notice": "Licensed under the BSD License",
    "BSD-notice-2": "Released under the BSD License",
    "BSD-notice-3": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License",
    "ISC-notice": "Licensed under the ISC License",
    "ISC-notice-2": "Released under the ISC License",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-4.0-notice-2": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0-notice-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}


def whole_texts() -> dict[str, str]:
    """The texts in ``license_texts`` (``<name>-whole``), and their parts of about ``PART_WORDS`` words."""
    out = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        words = path.read_text("utf-8").split()
        out[f"{path.stem}-whole"] = " ".join(words)
        n = max(1, round(len(words) / PART_WORDS))
        edges = [len(words) * i // n for i in range(n + 1)]
        if n > 1:
            out |= {f"{path.stem}-part{i + 1}": " ".join(words[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    return out


WHOLE = whole_texts()
_EDGE = np.zeros(256, bool)
_EDGE[list(string.punctuation.encode())] = True
_MARKS = np.zeros(256, bool)
_MARKS[[0x93, 0x94, 0x98, 0x99, 0x9C, 0x9D, 0xA2, 0xA6]] = True      # dashes, quotes, bullet and ellipsis, behind E2 80

_RNG = np.random.default_rng(104729)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - (1 - similarity**rows) ** bands


def _minima(values: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Minima of ``values`` over windows of about ``size`` that start every ``stride`` (the last may be shorter)."""
    blocks = values if stride == 1 else np.minimum.reduceat(values, np.arange(0, len(values), stride))
    span = max(1, -(-size // stride))
    out = blocks.copy()
    for j in range(1, span):
        out[:len(blocks) - j] = np.minimum(out[:len(blocks) - j], blocks[j:])
    return out


def _bare_shingles(texts: list[bytes]):
    """Five-word shingles of the words without punctuation at their edges: flat hashes, each text's start (and the end), and the
    first and end word of each shingle among all words of its text."""
    buf, starts = joined(texts)
    buf = LOWER[buf]
    begin, end = word_spans(buf)
    owner = np.searchsorted(starts, begin, "right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, starts)[owner]
    edge = _EDGE[buf]
    marks = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) & _MARKS[buf[2:]])
    for j in range(3):
        edge[marks + j] = True
    solid = np.flatnonzero(~edge)                     # blanks too, but none lies in a word
    lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, end) - 1
    kept = np.flatnonzero(lo <= hi)
    words = word_hashes(buf, solid[lo[kept]], solid[hi[kept]] + 1)
    owner, number = owner[kept], number[kept]
    n = max(0, len(words) - 4)
    h = words[:n].copy()
    for j in range(1, 5):
        h = h * _STEP + words[j:j + n]
    whole = np.flatnonzero(owner[:n] == owner[4:4 + n]) if n else np.zeros(0, np.int64)
    return mix(h[whole]), np.searchsorted(owner[whole], np.arange(len(texts) + 1)), number[whole], number[whole + 4] + 1


_STEP = np.uint64(0xD6E8FEB86659FD93)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        texts = [t.encode() for t in templates.values()]
        flat, offsets, _, _ = _bare_shingles(texts)
        if any(len(t.split()) < 5 for t in templates.values()) or (np.diff(offsets) < 1).any():
            raise ValueError("a license template needs five words")
        self.sets = [np.unique(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        self.sizes = [int(b - a) for a, b in zip(offsets[:-1], offsets[1:])]
        flat, offsets = shingle_hashes(texts)
        self.written = [np.unique(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        # all templates' shingles in order, and the templates that hold each
        held, of = np.concatenate(self.sets or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        order = np.argsort(held, kind="stable")
        self.held, self.of = held[order], of[order]

    def _hopeful(self, flat, offsets):
        """(template, texts) of each template with the texts that hold enough of its shingles for a match."""
        lo = np.searchsorted(self.held, flat)
        at = np.flatnonzero(self.held[np.minimum(lo, len(self.held) - 1)] == flat) if len(self.held) else np.zeros(0, np.int64)
        text = np.searchsorted(offsets, at, "right") - 1
        # each of a text's shared shingles once
        pairs = np.unique(np.stack([text, lo[at]], axis=1), axis=0)
        text, lo = pairs[:, 0], pairs[:, 1]
        count = np.searchsorted(self.held, self.held[lo], "right") - lo
        which = self.of[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        keys, n = np.unique(which * len(offsets) + np.repeat(text, count), return_counts=True)
        template, text = keys // len(offsets), keys % len(offsets)
        enough = n >= CONTAINMENT * np.array([len(x) for x in self.sets])[template]
        template, text = template[enough], text[enough]
        return [(int(t), text[template == t]) for t in np.unique(template)]

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int, float, float]]:
        """(text, template, first word, end word, containment, matched) of each match."""
        every, edges, first, end = _bare_shingles(texts)
        found = []
        for t, some in self._hopeful(every, edges):
            wanted, size = self.sets[t], self.sizes[t]
            place = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in some])
            offsets = np.concatenate(([0], np.cumsum(edges[some + 1] - edges[some])))
            flat = every[place]
            stride = max(1, size // STRIDE)
            match = np.zeros(-(-len(flat) // stride), np.int32)
            for band in range(BANDS):
                same = np.ones(len(match), bool)
                for j in range(band * ROWS, (band + 1) * ROWS):
                    same &= _minima((flat * _A[j] + _B[j]) >> np.uint64(32), size, stride) == ((wanted * _A[j] + _B[j]) >> np.uint64(32)).min()
                match += same
            # each retrieved window, widened by a stride, within its text(s)
            for at in np.flatnonzero(match) * stride:
                lo, hi = max(0, at - stride), min(len(flat), at + size + stride)
                for d in range(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")):
                    a, b = max(lo, offsets[d]), min(hi, offsets[d + 1])
                    inside = np.flatnonzero(np.isin(flat[a:b], wanted))
                    share = len(np.unique(flat[a:b][inside])) / len(wanted) if len(inside) else 0
                    if share >= CONTAINMENT:
                        found.append((int(some[d]), t, int(first[place[a + inside[0]]]), int(end[place[a + inside[-1]]]), share))
        out, written, of = [], None, None
        for d, t, a, b, share in _merged(found):
            if d != of:
                written, of = shingle_hashes([texts[d]])[0], d
            inside = np.unique(written[a:b - 4])
            out.append((d, t, a, b, len(np.intersect1d(inside, self.written[t], assume_unique=True)) / len(self.written[t]), share))
        return out


def _merged(found):
    out = []
    for m in sorted(set(found)):
        if out and out[-1][:2] == m[:2] and m[2] < out[-1][3]:
            out[-1] = (*m[:2], out[-1][2], max(out[-1][3], m[3]), max(out[-1][4], m[4]))
        else:
            out.append(m)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, end_word (end exclusive), containment, matched: one row for each span."""
    scanner = Scanner(TEMPLATES | WHOLE if templates is None else templates)

    def run(batch):
        texts, ids = binary_texts(batch), batch.column("doc_id")
        for part in text_slices(texts, 1 << 19):
            hits = scanner.scan(texts[part])
            if hits:
                d, t, a, b, c, m = zip(*hits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([x + part.start for x in d])), pa.array([scanner.names[x] for x in t]),
                                                  pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64()), pa.array(m, pa.float64())],
                                                 names=["doc_id", "license", "first_word", "end_word", "containment", "matched"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, license string, first_word long, end_word long, containment double, matched double")
