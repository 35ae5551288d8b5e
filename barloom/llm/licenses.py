"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are white-space runs, A-Z lower-cased; shingles are five words (a shorter template would be one shingle). For templates of S
shingles, windows of S + g shingles (g = S // 4) start at every (g + 1)-th shingle, so every run of S shingles lies whole in one
window. A window whose shingles hold 80 % of a template has Jaccard similarity of at least 0.55 to it, and ``BANDS`` = 32 bands
of 2 of the 64 MinHash values retrieve it with probability 1 - (1 - 0.55^2)^32 > 0.99998 (1 - 1e-7 for a full copy). Windows without
any shingle of any template have containment 0 and are not looked at. Retrieved pairs are verified by the exact share of the template's
distinct shingles that the window holds.

The plan is narrow: one pass, no shuffle. Null and empty texts match nothing; of windows of equal containment the earliest counts;
repeated rows repeat their matches; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textvec import U64, Words, mix, shingles, slices

HASHES, ROWS = 64, 2
BANDS = HASHES // ROWS
CONTAINMENT = 0.8

#: License name -> wording of its notice or grant.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "bsd-2-clause-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
}


def _minhash(windows: np.ndarray) -> np.ndarray:
    """(rows x HASHES) minima of the hashes in each row; padding is all ones."""
    out = np.empty((len(windows), HASHES), U64)
    pad = windows == U64(2**64 - 1)
    for k in range(HASHES):
        h = mix(windows + U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        h[pad] = U64(2**64 - 1)
        out[:, k] = h.min(axis=1)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(signature), BANDS), U64)
    for k in range(ROWS):
        acc = mix(acc * U64(0xD6E8FEB86659FD93) + signature[:, k::ROWS] + U64(1))
    return acc


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.names = sorted(templates)
        self.containment = containment
        _, _, data, offsets = next(slices(pa.array([templates[n] for n in self.names]), 1 << 30))
        h, doc, _ = shingles(Words(data, offsets))
        self.sets = [np.unique(h[doc == i]) for i in range(len(self.names))]
        self.every = np.unique(h)
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(int((doc == i).sum()), []).append(i)
        self.keys = {}
        for size, own in self.classes.items():
            width = max(len(self.sets[i]) for i in own)
            grid = np.full((len(own), width), 2**64 - 1, U64)
            for row, i in enumerate(own):
                grid[row, : len(self.sets[i])] = self.sets[i]
            self.keys[size] = _bands(_minhash(grid))

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of the best window of every template found in a text."""
        h, doc, at = shingles(Words(data, offsets))
        hit = np.isin(h, self.every)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        if not hit.any():
            return []
        begin = np.searchsorted(doc, np.arange(len(offsets)))
        where = np.flatnonzero(hit)
        for size, own in self.classes.items():
            slack = size // 4
            width, stride = size + slack, slack + 1
            local = where - begin[doc[where]]
            starts = set()
            # windows [s, s + width) on the stride that hold the hit
            high = local // stride
            low = np.maximum(0, -((width - 1 - local) // stride))
            for d, a, b in {*zip(doc[where].tolist(), low.tolist(), high.tolist())}:
                starts.update((d, k * stride) for k in range(a, b + 1))
            if not starts:
                continue
            picked = np.array(sorted(starts), np.int64)
            first = begin[picked[:, 0]] + picked[:, 1]
            last = begin[picked[:, 0] + 1]
            for part in range(0, len(first), 4096):
                f, e, d = first[part : part + 4096], last[part : part + 4096], picked[part : part + 4096, 0]
                grid = f[:, None] + np.arange(width)
                windows = np.where(grid < e[:, None], h[np.minimum(grid, len(h) - 1)], U64(2**64 - 1))
                bands = _bands(_minhash(windows))
                for row, i in enumerate(own):
                    for w in np.flatnonzero((bands == self.keys[size][row]).any(axis=1)):
                        share = float(np.isin(self.sets[i], windows[w]).mean())
                        if share >= self.containment:
                            key, got = (int(d[w]), i), (share, int(at[f[w]] - at[begin[d[w]]]))
                            old = found.get(key)
                            if old is None or (-got[0], got[1]) < (-old[0], old[1]):
                                found[key] = got
        return [(d, i, share, start) for (d, i), (share, start) in sorted(found.items())]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, start_word): the best window of every template that a document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, containment)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                got = scanner.slice(data, offsets)
                ids = batch.column(0)[first:end].take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([scanner.names[g[1]] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64())], ["doc_id", "license", "containment", "start_word"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, license string, containment double, start_word long")
