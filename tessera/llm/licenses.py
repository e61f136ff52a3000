"""License scans: MinHash bands over overlapping windows of text retrieve license templates, exact containment of their
shingles verifies them.

Shingles are runs of three words. Windows of four lengths slide over a document: the short ones, for one-line notices,
word by word; the long one, for whole license texts, by steps of eight from a document's first word. A template is cut into windows of the greatest of
these lengths that it fills, at every word, so that for each step of a document one of them lies alike. Two windows with
Jaccard similarity s share one of 12 bands of 2 minima with probability 1 - (1 - s^2)^12: 0.99 at 0.57. A window that
meets a template is verified exactly, on the document's words around it: the share of the shingles of the template (of
its window, for the long ones) that they contain must reach `containment`.

Words are runs of letters and digits, with A-Z as a-z (a run of over 4,096 bytes counts as several). Null and empty
texts, and those without three words, match nothing. Rows with a null id take no part; repeated rows are reported once.
What is found in a document does not depend on its neighbours. Texts are read whole: long ones in pieces that overlap by
more than a template. Of places that contain as much the first is reported; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, gram_keys, hashed_words, mix

U = np.uint64
SHINGLE = 3
LENGTHS = (5, 8, 12, 32)
STEPS = (1, 1, 1, 8)
BANDS, ROWS = 12, 2

#: Public license texts, or the parts of them by which they are declared. Fixed values.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.)", "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    # both have the same two clauses; what follows them tells which it is
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": (
        "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", "Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": (
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
}


def minima(shingles: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, minima) for windows of each length in words that fit: 24 rows of hashes, a column for each window."""
    hashed = shingles[None, :] ^ mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None]
    hashed *= U(0xD6E8FEB86659FD93)
    hashed ^= hashed >> U(32)
    span = 1
    for length in lengths:
        want = length - SHINGLE + 1
        if shingles.size < want:
            return
        while span < want:  # the minimum of two overlapping or adjoining spans
            more = min(span, want - span)
            hashed = np.minimum(hashed[:, :-more], hashed[:, more:])
            span += more
        yield length, hashed


def bands(least: np.ndarray, length: int) -> np.ndarray:
    """12 rows of band keys."""
    a, b = least[0::2], least[1::2]
    return (a * U(0x9E3779B97F4A7C15) + b + U(length)) * U(0xD6E8FEB86659FD93) ^ mix(np.arange(BANDS, dtype=np.uint64))[:, None]


@dataclass(frozen=True)
class Library:
    """Band keys of all template windows, sorted, and what each belongs to. Its size is that of the templates given."""

    names: list[str]
    shingles: list[np.ndarray]
    words: list[int]
    keys: np.ndarray
    owner: np.ndarray
    window: np.ndarray
    bits: np.ndarray = field(repr=False)


def library(templates: dict[str, tuple[str, ...]]) -> Library:
    names, shingles, words, keys, owner, window = [], [], [], [], [], []
    for name, texts in templates.items():
        for text in texts:
            data, offsets = as_bytes(pa.array([text]))
            w = np.concatenate([h for _, _, _, h, _, _ in hashed_words(data, offsets)])
            s = gram_keys(w, SHINGLE)
            fits = [x for x in LENGTHS if x <= len(w)]
            if not fits:
                raise ValueError(f"a template of {name} has fewer than {LENGTHS[0]} words")
            for length, least in minima(s, LENGTHS):
                if length == fits[-1]:
                    k = bands(least, length)
                    keys.append(k.ravel())
                    owner.append(np.full(k.size, len(names)))
                    window.append(np.tile(np.arange(k.shape[1]), BANDS))
            names.append(name)
            shingles.append(s)
            words.append(len(w))
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(k, kind="stable")
    bits = np.zeros(1 << 16, bool)
    bits[(k >> U(48)).astype(np.int64)] = True
    empty = np.zeros(0, np.int64)
    return Library(names, shingles, words, k[order], np.concatenate([empty, *owner])[order], np.concatenate([empty, *window])[order], bits)


def candidates(w: np.ndarray, first: np.ndarray, lib: Library) -> np.ndarray:
    """(template, its window or -1, word) of all windows of a block of rows that share a band with a template, each once."""
    s = gram_keys(w, SHINGLE)
    found = [np.zeros((0, 3), np.int64)]
    for length, least in minima(s, LENGTHS):
        step = STEPS[LENGTHS.index(length)]
        at = np.arange(least.shape[1])
        if step > 1:  # counted from the first word of the row
            at = at[(at - first[np.searchsorted(first, at, "right") - 1]) % step == 0]
        k = bands(least[:, at], length)
        band, c = np.nonzero(lib.bits[(k >> U(48)).astype(np.int64)])
        keys = k[band, c]
        lo, hi = np.searchsorted(lib.keys, keys, "left"), np.searchsorted(lib.keys, keys, "right")
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = lib.owner[which]
        # a long template's window stands for the part of the text that it covers
        part = np.where(np.array(lib.words)[owner] > LENGTHS[-1], lib.window[which], -1)
        found.append(np.stack([owner, part, np.repeat(at[c], n)], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def find(w: np.ndarray, first: np.ndarray, lib: Library, containment: float) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first word, word after the last, containment) of the verified places of a block of rows."""
    s = gram_keys(w, SHINGLE)
    out: dict[tuple[int, int, int], tuple] = {}
    for t, part, at in candidates(w, first, lib).tolist():
        row = int(np.searchsorted(first, at, "right")) - 1
        if part < 0:
            want, n = lib.shingles[t], lib.words[t]
        else:
            want, n = lib.shingles[t][part : part + LENGTHS[-1] - SHINGLE + 1], LENGTHS[-1]
        lo, hi = max(int(first[row]), at - 2), min(int(first[row + 1]), at + n + 2)
        have = s[lo : max(lo, hi - SHINGLE + 1)]
        hit = np.flatnonzero(np.isin(have, want))
        share = len(np.intersect1d(have, want)) / len(np.unique(want))
        if len(hit) and share >= containment:
            place = (row, t, int((lo + hit[0] - first[row]) // n))
            found = (row, t, int(lo + hit[0] - first[row]), int(lo + hit[-1] + SHINGLE - first[row]), share)
            out[place] = max(out.get(place, found), found, key=lambda x: (x[4], -x[2]))
    # where places overlap, the license that fits best stands for the others (the first listed, if tied)
    kept: list[tuple] = []
    own: list[tuple] = []
    for place in sorted(out.values(), key=lambda x: (x[0], -x[4], -(x[3] - x[2]), x[1], x[2])):
        if own and own[0][0] != place[0]:
            own = []
        if all(lib.names[k[1]] == lib.names[place[1]] or k[3] <= place[2] or k[2] >= place[3] for k in own):
            own.append(place)
            kept.append(place)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, containment: float = 0.8, most_words: int = 500_000) -> DataFrame:
    """doc_id, license, start, stop (words), containment, places: for each document and license its best place (the
    earliest, if tied) and how many places were verified. templates: texts by license; they go to all executors,
    so they may hold `most_words` words at most."""
    lib = library(TEMPLATES if templates is None else templates)
    if sum(lib.words) > most_words:
        raise ValueError(f"the templates hold {sum(lib.words)} words, which is more than {most_words}")
    shared = docs.sparkSession.sparkContext.broadcast(lib)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            ids, out = b.column(0), []
            for i, _, first, w, _, _ in hashed_words(data, offsets, 1 << 17):
                for a in range(0, max(1, len(w)), 1 << 16):  # a long row in pieces; their windows overlap
                    piece = w[a : a + (1 << 16) + 2 * LENGTHS[-1] + max(lib.words)]
                    for row, t, s, e, share in find(piece, np.clip(first - a, 0, len(piece)), shared.value, containment):
                        out.append((ids[i + row].as_py(), lib.names[t], s + max(0, a - int(first[row])), e + max(0, a - int(first[row])), share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "license", "start", "stop", "containment"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    places = rows.mapInArrow(look, "doc_id long, license string, start long, stop long, containment double")
    best = F.min_by(F.struct("start", "stop", "containment"), F.struct(-F.col("containment"), "start", "stop"))
    return places.groupBy("doc_id", "license").agg(best.alias("b"), F.count_distinct("start").alias("places")).select("doc_id", "license", "b.start", "b.stop", "b.containment", "places")
