"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates of like size share windows of four times their least size (in five-word shingles), half a window apart, so
one of the windows holds all of any place where a template stands. Such a window has a Jaccard similarity to
the template of at least a sixth; with 48 bands of one row each the two collide in some band with a probability above 99.98 % for
the least similar case, and more for any other. A retrieved pair counts if the window holds at least ``containment`` of
the template's shingles.

Words are lower-cased and lose punctuation at their ends; those of punctuation only, such as comment marks, are left out
of the shingles but count in the places reported. Texts are scanned whole; null and empty texts and those of
fewer words than a notice have no findings. Repeated rows are scanned one by one. Templates of fewer than five words
have no shingle and are refused; such notices are given as ``short``, each one shingle of its own length.

The scan knows the texts of ``TEMPLATES`` and ``SHORT`` only. Where templates are alike (a header of the LGPL holds most
of the GPL's), a place has a row for each that it contains enough of; ``containment`` tells them apart.
"""

from __future__ import annotations

import pkgutil
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches
from cellarline.llm.wordhash import NormalHasher, joined, mix

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 48
#: Most shingles of all templates together; the index is broadcast.
TEMPLATE_SHINGLES = 1 << 20

# Texts of public licenses and of notices that name them.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 short notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
}
# Whole texts, by the names of their files.
for _file in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0"):
    TEMPLATES[f"{_file} text"] = pkgutil.get_data(__package__, f"license_texts/{_file}.txt").decode()

#: Notices of fewer words than a shingle.
SHORT = {"All rights reserved notice": "All rights reserved."}


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


@dataclass(frozen=True)
class SizeClass:
    """Templates of ``least`` to 2 x ``least`` - 1 shingles; ``minima`` has a row for each band."""

    least: int
    names: tuple[str, ...]
    sets: tuple[np.ndarray, ...]
    minima: np.ndarray


def index_templates(templates: dict[str, str], bands: int) -> list[SizeClass]:
    hasher, by_least = NormalHasher(marks_zero=True), {}
    for name, text in templates.items():
        own = np.unique(shingles(spoken(hasher(text))))
        if not len(own):
            raise ValueError(f"a template needs {SHINGLE} words: {name}")
        by_least.setdefault(1 << len(own).bit_length() - 1, []).append((name, own))
    if sum(len(own) for found in by_least.values() for _, own in found) > TEMPLATE_SHINGLES:
        raise ValueError("the templates are too many for one index: scan with parts of them")
    out = []
    for least, found in sorted(by_least.items()):
        minima = np.array([[mix(own, band).min() for _, own in found] for band in range(bands)], np.uint64)
        out.append(SizeClass(least, tuple(n for n, _ in found), tuple(own for _, own in found), minima))
    return out


def spoken(words: np.ndarray) -> np.ndarray:
    return words[words != 0]


def index_short(short: dict[str, str]) -> list[tuple[str, int, np.uint64]]:
    """(name, words, the one shingle) of each short notice."""
    hasher, out = NormalHasher(marks_zero=True), []
    for name, text in short.items():
        words = spoken(hasher(text))
        if not 0 < len(words) < SHINGLE:
            raise ValueError(f"a short notice has 1 to {SHINGLE - 1} words: {name}")
        out.append((name, len(words), shingles(words, len(words))[0]))
    return out


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFF)).astype(np.int64)


def retrieved(values: np.ndarray, index: list[SizeClass], bands: int) -> list[np.ndarray]:
    """For each size class the rows (window, template) that agree in a band; windows are numbered by their half."""
    found: list[list[np.ndarray]] = [[] for _ in index]
    filters = [np.zeros((bands, 1 << 16), bool) for _ in index]
    for seen, size in zip(filters, index, strict=True):
        for band in range(bands):
            seen[band, place(size.minima[band])] = True
    for band in range(bands):
        # Minima over halves of windows, doubled from class to class.
        halves, span = mix(values, band), 1
        for k, size in enumerate(index):
            while span < 2 * size.least:
                if len(halves) % 2:
                    halves = np.append(halves, np.uint64(0xFFFFFFFFFFFFFFFF))
                halves, span = np.minimum(halves[::2], halves[1::2]), 2 * span
            windows = np.minimum(halves, np.append(halves[1:], np.uint64(0xFFFFFFFFFFFFFFFF)))
            at = np.flatnonzero(filters[k][band, place(windows)])
            window, template = np.nonzero(windows[at][:, None] == size.minima[band][None, :])
            found[k].append(np.column_stack([at[window], template]))
    return [np.unique(np.concatenate(rows), axis=0) for rows in found]


def find_notices(
    texts: list[str | None], index: list[SizeClass], bands: int, containment: float, short: list[tuple[str, int, np.uint64]] = ()
) -> list[tuple[int, str, int, int, float]]:
    """(text, template, first word, end, containment) of every place, overlapping ones of a template as one."""
    found: dict[tuple[int, str], list[list]] = {}
    for first, whole, whole_starts, whole_ends in joined(texts, SHINGLE, marks_zero=True):
        # Marks go, the zeros between texts stay; ``kept`` has the place each word had.
        gap = np.ones(len(whole), bool)
        for start, end in zip(whole_starts.tolist(), whole_ends.tolist(), strict=True):
            gap[start:end] = False
        kept = np.flatnonzero(gap | (whole != 0))
        words, starts, ends = whole[kept], np.searchsorted(kept, whole_starts), np.searchsorted(kept, whole_ends)
        values = shingles(words)
        for size, rows in zip(index, retrieved(values, index, bands), strict=True):
            for window, template in rows.tolist():
                begin = window * 2 * size.least
                inside = np.flatnonzero(np.isin(values[begin : begin + 4 * size.least], size.sets[template])) + begin
                # A window may span two texts: each is looked at alone.
                owner = np.searchsorted(starts, inside, "right") - 1
                for text in np.unique(owner).tolist():
                    own = inside[(owner == text) & (inside + SHINGLE <= ends[text])]
                    share = len(np.unique(values[own])) / len(size.sets[template])
                    if len(own) and share >= containment:
                        last = kept[own[-1] + SHINGLE - 1] + 1
                        place_of = [int(kept[own[0]] - whole_starts[text]), int(last - whole_starts[text]), share]
                        found.setdefault((first + text, size.names[template]), []).append(place_of)
        for name, width, value in short:
            begins = np.flatnonzero(shingles(words, width) == value)
            owner = np.searchsorted(starts, begins, "right") - 1
            for begin, text in zip(begins.tolist(), owner.tolist(), strict=True):
                if begin + width <= ends[text]:
                    place_of = [int(p - whole_starts[text]) for p in (kept[begin], kept[begin + width - 1] + 1)]
                    found.setdefault((first + text, name), []).append([*place_of, 1.0])
    out = []
    for (text, name), places in sorted(found.items()):
        last = None
        for start, end, share in sorted(places):
            if last and start < last[1]:
                last[1], last[2] = max(last[1], end), max(last[2], share)
                continue
            last = [start, end, share]
            out.append((text, name, last))
    return [(text, name, start, end, share) for text, name, (start, end, share) in out]


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    short: dict[str, str] | None = None,
    *,
    bands: int = BANDS,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``license``, ``start``, ``end`` (words), ``containment``: a row for each place a template stands at.

    ``short`` are notices of fewer than five words, looked for as they stand; with neither given all known ones are.
    """
    if templates is None and short is None:
        templates, short = TEMPLATES, SHORT
    shared = docs.sparkSession.sparkContext.broadcast((index_templates(templates or {}, bands), index_short(short or {})))
    texts = doc_texts(docs, id_col, text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index, brief = shared.value
        found = find_notices(batch.column("text").to_pylist(), index, bands, containment, brief)
        if not found:
            return None
        at, name, start, end, share = zip(*found, strict=True)
        columns = [batch.column("id").take(pa.array(at)), *map(pa.array, (name, start, end, share))]
        return pa.RecordBatch.from_arrays(columns, ["id", "license", "start", "end", "containment"])

    id_type = texts.schema["id"].dataType.simpleString()
    return map_batches(texts, step, f"id {id_type}, license string, start bigint, end bigint, containment double")


def license_notices(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        F.col("id").alias("doc_id"), "license", F.col("start").alias("first_word"), F.col("end").alias("end_word"), "containment"
    )
