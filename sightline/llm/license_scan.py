"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template of m words is looked for in windows a little longer than 1.25 m words that overlap so far that any stretch
of 1.25 m words lies in one. A window is signed by the minima of its five-word shingles under several hash functions;
each band is one or more of these. Where at least 0.8 of a template's shingles are in a window, the two share about a
quarter of all their shingles or more, so 32 bands of one row meet with a chance over 0.999. A window that meets a
template is compared by its words: the share of the template's distinct shingles that it holds must reach 0.8.

Windows are placed from the start of each text, so a result depends on nothing but the text and the templates; texts
are signed together only for speed, in sections of bounded size.

Words are runs of letters, digits and underscores of the lower-cased text. A template needs five words at least.

Defined cases: null and empty texts match nothing and still get a row; ties go to the first template by name; rows
that repeat are scanned one by one; very long texts are read whole, a section at a time; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 32, 1, 11
_WORDS = re.compile(r"\w+")
#: Words that are signed at once.
SECTION = 1 << 16

#: Public license notices to look for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(found[i:] for i in range(SHINGLE)), strict=False))


def shingle_hashes(found: list[str]) -> np.ndarray:
    """32-bit hashes of the shingles, in order."""
    codes = np.fromiter(map(zlib.crc32, map(str.encode, found)), np.uint64, len(found))
    mixed = np.zeros(max(0, len(codes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        mixed = (mixed + codes[i : len(mixed) + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(16)).astype(np.uint32)


class Scanner:
    def __init__(self, templates: dict[str, str], bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.bands, self.rows, self.similarity = bands, rows, similarity
        self.templates = {name: shingles(words(text)) for name, text in templates.items()}
        self.classes: dict[tuple[int, int], list[str]] = {}  # (words of a window, step) to its templates
        for name, text in templates.items():
            m = len(words(text))
            if m < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            span = -(-5 * m // 4)
            step = max(1, span // 4)
            self.classes.setdefault((span + step, step), []).append(name)
        self.signatures = {name: self.signature(shingle_hashes(words(text))) for name, text in templates.items()}

    def permuted(self, hashes: np.ndarray, k: int) -> np.ndarray:
        x = hashes * self.factors[k] + self.offsets[k]
        return x ^ x >> np.uint32(15)

    def signature(self, hashes: np.ndarray) -> list[int]:
        return [int(self.permuted(hashes, k).min()) for k in range(self.bands * self.rows)]

    def windows(self, pieces: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
        """For each class, the windows that begin in pieces, as shingles of the section: (piece, first, past the last),
        whole windows first, and how many these are. A piece is (place in the section, place in its text, shingles that
        windows may begin at, shingles from its place to the text's end). Windows begin at multiples of the class's
        step from the start of their own text; the last one ends with the text."""
        at, base, room, left = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        out = {}
        for span, step in self.classes:
            n = span - SHINGLE + 1
            last = -(-np.maximum(base + left - n, 0) // step)  # number of the text's last window
            first = -(-base // step)
            whole = np.maximum(np.minimum(last, -(-(base + room) // step)) - first, 0)
            piece = np.repeat(np.arange(len(at)), whole)
            number = np.arange(len(piece)) - np.repeat(whole.cumsum() - whole, whole) + first[piece]
            starts = at[piece] + number * step - base[piece]
            ends = np.flatnonzero((last >= first) & (last * step < base + room))
            tail = at[ends] + last[ends] * step - base[ends]
            out[span, step] = np.concatenate((piece, ends)), np.concatenate((starts, tail)), np.concatenate((starts + n, at[ends] + left[ends])), len(piece)
        return out

    def candidates(self, hashes: np.ndarray, windows: dict[tuple[int, int], tuple[np.ndarray, ...]]) -> Iterator[tuple[str, int, int, int]]:
        """(template, piece, first shingle, past the last) of windows that share a band with a template."""
        met: dict[tuple[int, int], dict[str, np.ndarray]] = {c: {} for c in self.classes}
        for band in range(self.bands):
            same = {c: {name: True for name in names} for c, names in self.classes.items()}
            for k in range(band * self.rows, (band + 1) * self.rows):
                levels = [self.permuted(hashes, k)]
                for c, names in self.classes.items():
                    _, first, past, whole = windows[c]
                    n = c[0] - SHINGLE + 1
                    lv = n.bit_length() - 1
                    while whole and len(levels) <= lv:
                        half = 1 << len(levels) - 1
                        shorter = levels[-1]
                        levels.append(np.minimum(shorter, np.concatenate((shorter[half:], np.full(min(half, len(shorter)), 0xFFFFFFFF, np.uint32)))))
                    at = first[:whole]
                    low = np.minimum(levels[lv][at], levels[lv][at + n - (1 << lv)]) if whole else np.zeros(0, np.uint32)
                    if whole < len(first):  # of one text one window at most: they lie apart
                        bounds = np.stack((first[whole:], past[whole:]), axis=1).ravel()
                        low = np.concatenate((low, np.minimum.reduceat(np.append(levels[0], np.uint32(0xFFFFFFFF)), bounds)[::2]))
                    for name in names:
                        same[c][name] = same[c][name] & (low == self.signatures[name][k])
            for c, names in self.classes.items():
                for name in names:
                    hit = np.flatnonzero(same[c][name])
                    if len(hit):
                        met[c][name] = np.union1d(met[c][name], hit) if name in met[c] else hit
        for c, found in met.items():
            piece, first, past, _ = windows[c]
            for name, hits in found.items():
                yield from zip([name] * len(hits), piece[hits].tolist(), first[hits].tolist(), past[hits].tolist(), strict=True)

    def sections(self, tokens: list[list[str]]) -> Iterator[tuple[list[str], list[tuple[int, int]], list[tuple[int, int, int, int]]]]:
        """Words to be signed together, and their pieces: (text, its word at the section's start) and what windows() takes.
        Texts follow one another; of a long one each section takes what begins in it, with the words that windows need."""
        reach = max(c[0] for c in self.classes)
        words, of, pieces = [], [], []
        for d, found in enumerate(tokens):
            n = len(found) - SHINGLE + 1
            for base in range(0, max(0, n), SECTION):
                part = found[base : base + SECTION + reach + SHINGLE] if n > SECTION else found
                of.append((d, base - len(words)))
                pieces.append((len(words), base, min(SECTION, n - base), n - base))
                words += part
                if len(words) >= SECTION:
                    yield words, of, pieces
                    words, of, pieces = [], [], []
        if pieces:
            yield words, of, pieces

    def scan(self, texts: list[str | None]) -> list[tuple[str | None, float, int, str]]:
        """For each text: the template held best, its containment, the windows that hold it, all templates held."""
        tokens = [words(t) for t in texts]
        best: list[dict[str, float]] = [{} for _ in texts]
        windows: list[dict[str, int]] = [{} for _ in texts]
        for part, of, pieces in self.sections(tokens):
            for name, piece, a, b in self.candidates(shingle_hashes(part), self.windows(pieces)):
                d, shift = of[piece]
                template = self.templates[name]
                share = len(template & shingles(tokens[d][a + shift : b + shift + SHINGLE - 1])) / len(template)
                if share >= self.similarity:
                    best[d][name] = max(share, best[d].get(name, 0.0))
                    windows[d][name] = windows[d].get(name, 0) + 1
        out: list[tuple[str | None, float, int, str]] = []
        for b, w in zip(best, windows, strict=True):
            top = min(b, key=lambda name: (-b[name], name), default=None)
            out.append((top, b.get(top, 0.0), w.get(top, 0), ",".join(sorted(b))))
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: doc_id, license (held best), containment, n_windows, licenses (all, by commas).
    templates: name to text, whole licence texts or notices of five words at least."""
    looked_for = templates or TEMPLATES

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(looked_for, **how)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = scanner.scan(batch.column(1).to_pylist())
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], names=["doc_id", "license", "containment", "n_windows", "licenses"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, containment double, n_windows long, licenses string")
