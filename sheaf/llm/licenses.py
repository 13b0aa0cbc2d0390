"""Licence scans: parts of a text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import coded, pieces, ranges, texts

#: Least Dice coefficient of a match.
LEAST = 0.8

#: Wording by which texts declare a licence.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "All-rights-reserved": "All rights reserved.",
    "All-rights-reserved-notice": "All rights reserved. No part of this publication may be reproduced without permission.",
}

#: Cells of one step of the search for parts; bounds its memory.
CELLS = 1 << 18


def templates() -> dict[str, str]:
    """TEMPLATES, and the whole texts of licences (fixed values, in license_texts beside this module), each under its name and -text."""
    texts = {f"{f.stem}-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return TEMPLATES | texts


_WORDS = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")


def normalised(text: str) -> list[str]:
    """Lower-case runs of letters or digits; punctuation and layout don't count, `licence` is `license`."""
    return [w.replace("licence", "license") for w in _WORDS.findall(text.lower())]


def size_bounds(bigrams: int, least: float) -> tuple[int, int]:
    """Sizes outside of which no part can reach the coefficient: it shares at most the smaller size."""
    return math.ceil(bigrams * least / (2 - least) - 1e-9), math.floor(bigrams * (2 - least) / least + 1e-9)


class Scanner:
    def __init__(self, templates: Mapping[str, str], least: float):
        self.least, self.words, self.templates = least, {}, []
        own = {name: normalised(text) for name, text in templates.items()}
        for words in own.values():
            for w in words:
                self.words.setdefault(w, len(self.words))
        self.size = len(self.words)
        for name, words in own.items():
            pairs = Counter(self.words[a] * (self.size + 1) + self.words[b] for a, b in zip(words, words[1:], strict=False))
            if pairs:
                codes = np.array(sorted(pairs), np.int64)
                total = sum(pairs.values())
                self.templates.append((name, codes, np.array([pairs[c] for c in codes.tolist()], np.int64), total, *size_bounds(total, least)))
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in self.templates)]))
        self.any = np.zeros((self.size + 1) ** 2, bool)
        self.any[self.codes] = True
        self.has = np.array([np.isin(self.codes, x[1]) for x in self.templates], bool).reshape(len(self.templates), len(self.codes))
        self.lows = np.array([x[4] for x in self.templates], np.int64)

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, int, int]]:
        """Row, template, coefficient, first word and number of words of each part that matches."""
        counts, codes, runs = coded(column)
        split = [[self.words.get(w, self.size) for w in normalised(x)] for x in runs]
        lengths = np.array([len(x) for x in split], np.int64)
        out: list[tuple[int, str, float, int, int]] = []
        hopeful = np.array([any(w < self.size for w in x) for x in split], bool)
        ends = np.cumsum(counts)
        touched = np.add.reduceat(np.append(hopeful[codes], False), np.minimum(ends - counts, len(codes))) if len(counts) else np.zeros(0)
        fewest = int(self.lows.min()) if len(self.lows) else 0
        flat = np.array([w for x in split for w in x], np.int64)
        firsts = np.cumsum(lengths) - lengths
        for d in np.flatnonzero((touched > 0) & (counts > 0)):
            own = codes[ends[d] - counts[d] : ends[d]]
            if lengths[own].sum() <= fewest:
                continue
            words = flat[ranges(firsts[own], lengths[own])]
            pairs = words[:-1] * (self.size + 1) + words[1:]
            at = np.flatnonzero(self.any[pairs])
            if len(at) < fewest:
                continue
            code = np.searchsorted(self.codes, pairs[at])
            times = np.bincount(code, minlength=len(self.codes))
            found = []
            for n in np.flatnonzero(self.has @ times >= self.lows):
                if np.minimum(times[self.has[n]], self.templates[n][2]).sum() < self.lows[n]:  # no more of a bigram than the template has
                    continue
                own_at = np.flatnonzero(self.has[n][code])
                found += self._parts(n, at[own_at], pairs[at[own_at]])
            starts, stops = [], []
            for shared, dice, start, size, name in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
                k = bisect_left(starts, start)
                if (k == 0 or stops[k - 1] <= start) and (k == len(starts) or start + size <= starts[k]):
                    starts.insert(k, start)
                    stops.insert(k, start + size)
                    out.append((int(d), name, dice, start, size + 1))
        return out

    def _parts(self, n: int, at: np.ndarray, keys: np.ndarray) -> list[tuple[int, float, int, int, str]]:
        """From each bigram of the template on, the part of best coefficient that ends at one, within the size bounds: shared
        bigrams, coefficient, first bigram, size, template.

        A bigram that the template has k times counts in a part if the k-th occurrence before it lies before the part.
        """
        name, codes, wanted, total, low, high = self.templates[n]
        kinds = np.searchsorted(codes, keys)
        order = np.argsort(kinds, kind="stable")
        back = np.arange(len(at)) - wanted[kinds[order]]  # in order of kind, then place
        before = np.full(len(at), -1, np.int64)
        same = (back >= 0) & (kinds[order][np.maximum(back, 0)] == kinds[order])
        before[order[same]] = order[back[same]]
        last = np.searchsorted(at, at + high)  # end of the bigrams within the largest size
        likely = np.flatnonzero(last - np.arange(len(at)) >= low)
        out: list[tuple[int, float, int, int, str]] = []
        width = int((last - np.arange(len(at)))[likely].max()) if len(likely) else 1
        for a in range(0, len(likely), max(1, CELLS // width)):
            i = likely[a : a + max(1, CELLS // width)]
            j = np.minimum(i[:, None] + np.arange(width), len(at) - 1)
            inside = np.arange(width) < (last[i] - i)[:, None]
            shared = np.cumsum(inside & (before[j] < i[:, None]), axis=1)
            size = at[j] - at[i][:, None] + 1
            dice = np.where(inside & (size >= low) & (size <= high), 2 * shared / (total + size), 0.0)
            best = dice.argmax(1)
            value = dice[np.arange(len(i)), best]
            for k in np.flatnonzero(value >= self.least).tolist():
                out.append((int(shared[k, best[k]]), float(value[k]), int(at[i[k]]), int(size[k, best[k]]), name))
        return out


def licenses(docs: DataFrame, *, wording: Mapping[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, first_word, n_words: parts of whole texts that match a template (of `wording`, templates() if none is given); of those that overlap the one that shares most bigrams.

    Every part of a text whose size in bigrams is within a template's bounds is considered: those that begin and end at a
    bigram of the template hold the best coefficient. A text with fewer of the template's bigrams than its least size is
    passed by. Null texts are empty and match nothing; of parts that share as many bigrams the one of the higher coefficient, then the earlier counts;
    repeated rows are reported each; an empty table gives no rows; other columns are not read. No shuffle.
    """
    wording = dict(templates() if wording is None else wording)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wording, least)
        for batch in pieces(batches):
            rows = scanner.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ], ["doc_id", "license", "dice", "first_word", "n_words"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, license string, dice double, first_word long, n_words long")
