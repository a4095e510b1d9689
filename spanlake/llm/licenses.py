"""License notices by MinHash bands over overlapping windows, then exact shingle containment.

Templates are grouped by length into classes of at most W words, W a power of two. A document is cut into windows of
2 W words every W words, so every passage as long as a template lies whole in one of them. A window and a template
collide if they agree in one of their class's bands of ``ROWS`` MinHash values. A template's values are fixed, so which
windows with ``CONTAINMENT`` of its shingles it misses depends on the window's other shingles alone, and the probability
follows exactly from those values: a class has as many bands, ``BANDS`` at least, as make it at most ``MISSED`` for each of
its templates, however few shingles they have. Windows without any template shingle cannot collide and are
skipped. Candidates are verified by the exact words of their shingles.

A shingle is 5 words (a shorter template is one shingle). Words are runs of letters and digits, in lower case. Null
texts have no window. The templates are the only broadcast; their number does not depend on the documents.

Null and empty texts hold no notice, a text shorter than a shingle neither. Repeated rows are judged row by row, equal finds of one
template that overlap are one, other columns are not read whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import Words, chunks, folded_words, form_hashes, mix

SHINGLE = 5
BANDS, ROWS = 64, 1
CONTAINMENT = 0.8
MISSED = 1e-6

#: License notices as their licensors publish them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                      "(the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each position where they fit."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return mix(out)


def seeds(bands: int) -> np.ndarray:
    return mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64))


def band_keys(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key per band: the MinHash values of its rows."""
    least = np.array([mix(shingles ^ s).min() for s in seeds(bands)]).reshape(bands, ROWS)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ least[:, r])
    return out


class Template:
    def __init__(self, name: str, text: str):
        words = folded_words(pa.array([text]))
        self.name, self.words = name, words.to_pylist()[0] or []
        self.size = min(SHINGLE, len(self.words))
        self.exact = {tuple(self.words[i:i + self.size]) for i in range(len(self.words) - self.size + 1)}
        self.hashes = shingle_hashes(form_hashes(pa.array(self.words, pa.string())), self.size)
        self.width = max(4, 1 << (len(self.words) - 1).bit_length())

    def missed(self, bands: int) -> float:
        """Probability that no band agrees with the longest window that holds CONTAINMENT of the shingles, for the worst
        choice of the shingles that it lacks."""
        n = len(self.exact)
        shared = next(k for k in range(1, n + 1) if k / n >= CONTAINMENT)
        values = np.array([mix(np.unique(self.hashes) ^ s) for s in seeds(bands)])
        # A band agrees if the template's least value is among the shared and no other shingle of the window is below it.
        above = (1 - values.min(1) / 2.0 ** 64) ** (2 * self.width - self.size + 1 - shared)
        fails = np.log1p(-np.minimum(above.reshape(bands, ROWS).prod(1), 1 - 1e-12))
        by_shingle = np.zeros(values.shape[1])
        np.add.at(by_shingle, values.argmin(1), np.repeat(fails, ROWS))
        return math.exp(min(0.0, fails.sum() - np.sort(by_shingle)[:n - shared].sum()))

    @property
    def bands(self) -> int:
        """Bands with which at most MISSED of the matches are missed."""
        bands = BANDS
        while self.missed(bands) > MISSED:
            bands += 16
        return bands


class Scanner:
    def __init__(self, templates: dict[str, str]):
        made = [Template(n, t) for n, t in sorted(templates.items())]
        self.classes: dict[tuple[int, int], list[Template]] = {}
        for t in made:
            if t.words:
                self.classes.setdefault((t.size, t.width), []).append(t)
        self.bands = {c: max(t.bands for t in ts) for c, ts in self.classes.items()}
        self.keys = {t.name: band_keys(t.hashes, self.bands[c]) for c, ts in self.classes.items() for t in ts}

    def matches(self, words: Words) -> list[list[dict]]:
        """Per text the verified notices: name, word range from the first to the last shared shingle, containment."""
        out: list[list[dict]] = [[] for _ in range(len(words.bounds) - 1)]
        hashed = words.hashes()
        forms, doc = None, words.doc
        for (size, width), templates in self.classes.items():
            hashes = shingle_hashes(hashed, size)
            known = np.sort(np.concatenate([t.hashes for t in templates]))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes) if len(hashes) else np.zeros(0, np.int64)
            hit = hit[doc[hit] == doc[hit + size - 1]]
            if not len(hit):
                continue
            # Windows are counted within the text; a hit lies in the one that begins before it and in the one before.
            start = words.bounds[doc[hit]] + (hit - words.bounds[doc[hit]]) // width * width
            starts = np.unique(np.concatenate([start, np.maximum(start - width, words.bounds[doc[hit]])]))
            for lo in starts.tolist():
                end = min(lo + 2 * width, int(words.bounds[doc[lo] + 1]))
                own = hashes[lo:end - size + 1]
                if not len(own):
                    continue
                keys = band_keys(own, self.bands[size, width])
                for t in templates:
                    if not (keys == self.keys[t.name]).any():
                        continue
                    forms = words.forms if forms is None else forms
                    text = forms.take(pa.array(words.codes[lo:end])).to_pylist()
                    places = [(i, s) for i in range(len(text) - size + 1) if (s := tuple(text[i:i + size])) in t.exact]
                    share = len({s for _, s in places}) / len(t.exact)
                    if share >= CONTAINMENT:
                        base = lo - int(words.bounds[doc[lo]])
                        out[doc[lo]].append({"name": t.name, "start": base + places[0][0], "end": base + places[-1][0] + size, "containment": share})
        return [self.merged(x) for x in out]

    @staticmethod
    def merged(found: list[dict]) -> list[dict]:
        """Overlapping finds of one template, from neighbouring windows, are one."""
        out: list[dict] = []
        for f in sorted(found, key=lambda x: (x["name"], x["start"], x["end"])):
            if out and out[-1]["name"] == f["name"] and f["start"] < out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], f["end"])
                out[-1]["containment"] = max(out[-1]["containment"], f["containment"])
            else:
                out.append(f)
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and notices (name, start, end in words, containment) of every document."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for lo, hi in chunks(batch.column("text")):
                found = scanner.matches(Words(folded_words(batch.column("text").slice(lo, hi - lo))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(found, kind)], ["doc_id", "notices"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, notices array<struct<name: string, start: long, end: long, containment: double>>")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices, licenses (names, sorted, comma-joined) of every document."""
    names = F.array_sort(F.array_distinct("notices.name"))
    return scan(docs).select("doc_id", F.size("notices").alias("n_notices"), F.array_join(names, ",").alias("licenses"))
