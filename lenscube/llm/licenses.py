"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

A template of n five-word shingles belongs to the class of w shingles, the power of two from n on. A document's
shingles are taken in windows of 2 w at a stride of w, so that any run of w lies whole in a window. A window
that holds 0.8 of a template resembles it by 0.19 at least; with bands of one row each, 32 bands miss that
with a chance of 0.81 ** 32, about 0.1 %. A template whose shingles are spread over more of a document than a window
has no such promise. Band values are looked up in a sorted table of all templates of a class, and the windows of
a class are joined from those of the class below, so that a document's cost grows neither with the number of
templates nor with that of classes. What is retrieved is decided by exact containment alone; of the templates of a
family, which differ by a few words, only those of the highest containment count. The templates are a fixed, small set
(some 300 kB); documents are never shuffled.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import docs_of, map_rows, slices
from lenscube.llm.decontamination import words_of

SHINGLE, BANDS, LEAST = 5, 32, 0.8
REMEMBERED = 400_000
MATCHES = "doc_id long, matches array<struct<license:string,template:int,containment:double>>"
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

# Fixed values: (SPDX identifier, notice). Each is a family of its own. The one-sentence notices of GPL-3.0, Apache-2.0, MIT and CC-BY-NC-4.0 are
# worded as the synthetic documents word them; all others are from the published licenses.
NOTICES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Fixed values: (number of the notice whose family it is of, SPDX identifier, notice): licenses with like notices. The published
# notices of the GNU licenses; for the one-sentence template and MPL-2.0, the same sentence with the other name or version.
VARIANTS = (
    (0, "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (0, "AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (0, "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (0, "LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    (1, "GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (1, "AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (1, "LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (1, "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    (1, "LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (7, "MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
)


# Fixed values: (SPDX identifier, file of the whole text, family): the published texts, as Debian ships them.
TEXTS = (
    ("Apache-2.0", "Apache-2.0", "apache-2"), ("Artistic-1.0", "Artistic", "artistic"), ("BSD-3-Clause", "BSD", "bsd"), ("CC0-1.0", "CC0-1.0", "cc0"),
    ("GFDL-1.2", "GFDL-1.2", "gfdl"), ("GFDL-1.3", "GFDL-1.3", "gfdl"), ("GPL-1.0", "GPL-1", "gpl-1"), ("GPL-2.0", "GPL-2", "gpl-2"), ("GPL-3.0", "GPL-3", "gpl-3"),
    ("LGPL-2.0", "LGPL-2", "lgpl-2"), ("LGPL-2.1", "LGPL-2.1", "lgpl-2"), ("LGPL-3.0", "LGPL-3", "lgpl-3"), ("MPL-1.1", "MPL-1.1", "mpl-1"), ("MPL-2.0", "MPL-2.0", "mpl-2"),
)


def _whole(name: str) -> str:
    return (pkgutil.get_data("lenscube.llm", f"license_texts/{name}.txt") or b"").decode("utf-8", "replace")


#: (SPDX identifier, text, family)
TEMPLATES = (
    *((name, text, f"notice {k}") for k, (name, text) in enumerate(NOTICES)),
    *((name, text, f"notice {k}") for k, name, text in VARIANTS),
    *((name, _whole(file), family) for name, file, family in TEXTS),
)


class _Hashes(dict):
    """A 64-bit hash by word, for as many words as may be remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x165667B19E3779F9 % (1 << 64))) * _MIX
    return (x ^ (x >> np.uint64(31))) * _ODD


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the word shingles in order; none for fewer words than a shingle has."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    out = h[:n].copy()
    for k in range(1, SHINGLE):
        out = _mixed(out, 1) + h[k : k + n]
    return out


class Windows:
    """The windows of some documents' shingles, class by class: 2 w shingles at a stride of w, within one document."""

    def __init__(self, sizes: np.ndarray, widths: list[int]):
        self.widths, self.steps = widths, []
        blocks, begins, per = sizes, None, widths[0] if widths else 1
        for k, width in enumerate(widths):
            ratio = per if k == 0 else width // widths[k - 1]
            own = -(-blocks // ratio)  # blocks of each document at this class
            doc = np.repeat(np.arange(len(sizes)), own)
            inner = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            begins = (np.cumsum(blocks) - blocks)[doc] + inner * ratio
            self.steps.append((begins, doc, np.append(doc[1:] == doc[:-1], False)[: len(doc)]))
            blocks = own

    def minima(self, mixed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(class, document, least value) of every window of each class."""
        values = mixed
        for width, (begins, doc, follows) in zip(self.widths, self.steps, strict=True):
            values = np.minimum.reduceat(values, begins)
            both = values.copy()
            both[:-1] = np.where(follows[:-1], np.minimum(values[:-1], values[1:]), values[:-1])
            yield width, doc, both


class Index:
    """The templates' band values: for each class and band a sorted table of values with their templates."""

    def __init__(self, templates: Iterable[tuple], bands: int = BANDS):
        rows = [(*t, f"own {k}")[:3] for k, t in enumerate(templates)]
        self.names, self.families = [r[0] for r in rows], [r[2] for r in rows]
        self.sets = [np.unique(shingles(words_of(r[1]))) for r in rows]
        if short := [n for n, s in zip(self.names, self.sets, strict=True) if not len(s)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.bands = bands
        classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        self.widths = sorted(classes)
        self.tables = {}
        for width, own in classes.items():
            for band in range(bands):
                values = np.array([_mixed(self.sets[k], band + 2).min() for k in own], np.uint64)
                order = np.argsort(values, kind="stable")
                self.tables[width, band] = (values[order], np.array(own)[order])

    def retrieve(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, template) where a window of the document shares a band with the template."""
        held = [d for d in range(len(docs)) if len(docs[d])]
        if not held or not self.widths:
            return set()
        joined = np.concatenate([docs[d] for d in held])
        windows = Windows(np.array([len(docs[d]) for d in held]), self.widths)
        found: set[tuple[int, int]] = set()
        for band in range(self.bands):
            for width, doc, least in windows.minima(_mixed(joined, band + 2)):
                values, owners = self.tables[width, band]
                low = np.searchsorted(values, least)
                hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == least)
                high = np.searchsorted(values, least[hit], side="right")
                for w, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                    found.update((held[doc[w]], int(k)) for k in owners[a:b])
        return found

    def matches(self, docs: list[np.ndarray], least: float = LEAST) -> list[list[tuple[str, int, float]]]:
        """(license, template, containment) of each document's verified templates; of a family the highest, ties included."""
        found: list[dict[int, float]] = [{} for _ in docs]
        for d, k in self.retrieve(docs):
            share = float(np.isin(self.sets[k], docs[d]).mean())
            if share >= least:
                found[d][k] = share
        for f in found:
            best: dict[str, float] = {}
            for k, share in f.items():
                best[self.families[k]] = max(share, best.get(self.families[k], 0.0))
            for k in [k for k, share in f.items() if share < best[self.families[k]]]:
                del f[k]
        return [[(self.names[k], k, f[k]) for k in sorted(f)] for f in found]


def scan(docs: DataFrame, templates: Iterable[tuple] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, matches) of every row: the templates whose shingles a document holds by ``least`` or more.

    Of the templates of a family only the highest containment matches (several where they tie, as when a document
    holds both notices or breaks off before they differ). ``templates`` are (name, text, family), the family
    being their own where it is left out; one of fewer than SHINGLE words raises a ValueError.
    Null, empty and very short texts hold none; a text of any length is scanned whole; rows that repeat a doc_id
    are scanned each by itself; other columns, of whatever name, are not read; an empty table gives no rows.
    """
    index = Index(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        for b in slices(batches, 2 << 20):
            found = index.matches([shingles(words_of(t)) for t in b.column(1).to_pylist()], least)
            yield [b.column(0), [[{"license": n, "template": k, "containment": c} for n, k, c in f] for f in found]]

    return map_rows(docs_of(docs), run, MATCHES)


def report(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_templates"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("best_containment"),
    )
