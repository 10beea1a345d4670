"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are notices of common licenses.  Those of similar length share
windows of twice that length which overlap by half, so an occurrence lies
whole in one window.  A template of ``n`` shingles and a window of ``w`` that
has ``k`` of them have a Jaccard similarity ``J`` of at least
``k / (w + n - k)``.  Templates of a length class have as many bands of one row
each as bring the chance that no band collides, ``(1 - J) ** bands``, to at most
``MISS`` for each of them, ``BANDS`` at least.  Templates of up to ``DIRECT``
shingles, of which a window is nearly all something else, need no bands: they
are verified in each window that has a shingle of a template.

A window's MinHash can equal a template's only if the window has a shingle of a
template, so windows without one are passed over before any hash is made; that
changes no result.  Retrieved templates are then verified by counting which of
their shingles the window has.

Of templates that match in overlapping places only the best contained stay
(of those, the longest), so that a version isn't taken for another.

Defined results
---------------
* null, empty or short texts match nothing;
* a template that occurs several times is listed once for each place; windows
  of one place are merged;
* templates of fewer words than a shingle can't be matched: they have no shingles;
* very long texts are scanned whole, window by window;
* rows are judged one by one, so ties, repeated rows and null ids do no harm; an
  empty table gives an empty result;
* extra columns pass through, but for one named as the new column, which is replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import append_columns, raw_texts, table
from .decontamination import words

#: Notices by which common licenses are granted.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-short": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}

SIZE = 5  # words of a shingle
BANDS = 64
MISS = 1e-6
DIRECT = 2
CONTAINED = 0.8


@dataclass(frozen=True)
class Match:
    license: str
    start: int  # words
    end: int
    contained: float


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, seed=23)
        return h


def shingle_hashes(text: bytes, known: WordHash) -> np.ndarray:
    """A hash of each ``SIZE`` consecutive words, in order."""
    w = words(text)
    if len(w) < SIZE:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    out = np.zeros(len(w) - SIZE + 1, np.uint64)
    for k in range(SIZE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return _mix(out)


class LicenseIndex:
    def __init__(self, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED):
        self.known, self.contained = WordHash(), contained
        self.sets = {n: np.unique(shingle_hashes(t.encode(), self.known)) for n, t in templates.items()}
        self.sets = {n: s for n, s in self.sets.items() if len(s)}
        self.all = np.unique(np.concatenate(list(self.sets.values()))) if self.sets else np.empty(0, np.uint64)
        #: by half a window's length in shingles: the templates, those among them without bands, and the bands' seeds
        self.classes: dict[int, list[str]] = defaultdict(list)
        for name, s in self.sets.items():
            self.classes[1 << int(len(s) + SIZE - 2).bit_length()].append(name)
        self.direct = {half: {n for n in names if len(self.sets[n]) <= DIRECT} for half, names in self.classes.items()}
        self.seeds: dict[int, np.ndarray] = {}
        #: by class: band and value to the templates
        self.bands: dict[int, dict[tuple[int, int], list[str]]] = {}
        for half, names in self.classes.items():
            banded = [n for n in names if n not in self.direct[half]]
            count = max((self.bands_needed(len(self.sets[n]), half) for n in banded), default=0)
            self.seeds[half] = _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
            self.bands[half] = defaultdict(list)
            for name in banded:
                for band, value in enumerate(self.signature(self.sets[name], half).tolist()):
                    self.bands[half][band, value].append(name)

    def bands_needed(self, n: int, half: int) -> int:
        """Bands by which a template of ``n`` shingles is missed in a window with a chance of at most ``MISS``."""
        least = max(1, math.ceil(self.contained * n - 1e-9))
        similarity = least / (2 * half + n - least)
        return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-similarity)))

    def signature(self, shingles: np.ndarray, half: int) -> np.ndarray:
        return _mix(shingles[None, :] ^ self.seeds[half][:, None]).min(axis=1)

    def matches(self, text: bytes, banded: bool = True) -> list[Match]:
        """The licenses found; without ``banded`` every template is verified in every window."""
        h = shingle_hashes(text, self.known)
        if not len(h) or not len(self.all):
            return []
        there = np.flatnonzero(self.all[np.searchsorted(self.all, h).clip(max=len(self.all) - 1)] == h)
        if not len(there):
            return []
        places: dict[str, list[Match]] = defaultdict(list)
        for half, every in self.classes.items():
            bands = self.bands[half]
            starts = np.unique(np.concatenate([there // half, there // half - 1]).clip(min=0)) * half
            for start in starts.tolist():
                window = h[start : start + 2 * half]
                if banded:
                    names = self.direct[half] | {n for key in enumerate(self.signature(window, half).tolist()) for n in bands.get(key, ())}
                else:
                    names = every
                for name in names:
                    at = np.flatnonzero(np.isin(window, self.sets[name]))
                    share = len(np.unique(window[at])) / len(self.sets[name])
                    if share >= self.contained:
                        places[name].append(Match(name, start + int(at[0]), start + int(at[-1]) + SIZE, share))
        found: list[Match] = []
        for name, own in places.items():
            own.sort(key=lambda m: (m.start, m.end))
            merged = [own[0]]
            for m in own[1:]:
                last = merged[-1]
                if m.start < last.end:
                    merged[-1] = Match(name, last.start, max(last.end, m.end), max(last.contained, m.contained))
                else:
                    merged.append(m)
            found += merged
        rank = {m: (m.contained, len(self.sets[m.license])) for m in found}
        best = [m for m in found if not any(o.start < m.end and m.start < o.end and rank[o] > rank[m] for o in found)]
        return sorted(best, key=lambda m: (m.start, m.end, m.license))


def scan_licenses(df: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``df`` with ``licenses``, an array of (license, start, end, contained)."""

    def make():
        index = LicenseIndex(templates, contained)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            return {"licenses": [[vars(m) for m in index.matches(t)] for t in raw_texts(batch, text_col)]}

        return work

    return append_columns(df, make, {"licenses": "array<struct<license:string,start:long,end:long,contained:double>>"})


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",").alias("license_ids"),
        F.array_join(each, ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["contained"])), F.lit(0.0)).alias("best_contained"),
    )
