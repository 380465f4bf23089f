"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of ASCII letters and digits (inner ``.``, ``-`` and ``+`` included) in small letters; shingles have
five words (a template with fewer words is one shingle of all of them, and is compared with runs of that many). A
template of m shingles belongs to the size class c, the least power of two that is not below m. Windows of a class
begin every max(1, c / 4) shingles and are c + c / 4 long, so every run of m shingles lies inside a window. With
containment t, the Jaccard similarity of that window and the template is at least
``t * m / (c + c / 4 + (1 - t) * m)``; a class has as many one-row bands as make the chance of a miss at that
similarity at most ``MISS``. A window that holds no template shingle cannot collide and is left out beforehand.

A retrieved window is a match when at least ``containment`` of the template's shingles occur in it, and one phrase of
each of its ``need`` groups (the words that tell it from its neighbours: version, Lesser, Affero) does from ``N`` words
before the first of these shingles to ``N`` after the last. A name may have several wordings; of overlapping matches of
one name the fullest (in matched words) stays, then the first. With ``exclusive``, a match also yields to a fuller one of
another name that holds half of its matched words or more. The default table is ``pairshift.llm.licenses``.

Edge cases: null and empty texts, and texts shorter than every template, have no match; repeated rows are scanned
one by one; an empty table gives an empty table; other columns do not matter; very long texts cost time, not memory
beyond their own words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import whole_text
from pairshift.llm.licenses import Wording, licenses

N = 5
CONTAINMENT = 0.75
MISS = 1e-6
MAX_TEMPLATES = 10_000
ROWS = 256
_WORD = re.compile(rb"[0-9a-z]+(?:[.+-]+[0-9a-z]+)*")
_FILTER_BITS = 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]

#: Names and opening statements of well-known public licences, one wording each; `licenses` has the whole table.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, _WORD.findall(raw.lower())), dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int, mixed: list[np.ndarray] | None = None) -> np.ndarray:
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += _mix(words[i : i + n] * _M[i]) if mixed is None else mixed[i][i : i + n]
    return _mix(total)


def default_templates() -> dict[str, list[Wording]]:
    """The licences' wordings, and those of ``TEMPLATES`` whose name is that of a licence."""
    out = {name: list(wordings) for name, wordings in licenses().items()}
    for name, text in TEMPLATES.items():
        if name in out:
            out[name] += [w._replace(text=text) for w in out[name] if w.need and _holds(word_hashes(text.encode()), _phrases(w.need))][:1] or [Wording(text)]
    out["Apache-2.0"].append(Wording(TEMPLATES["Apache-2.0-header"], ("version 2.0",)))
    return out


def _phrases(need: Sequence[str]) -> list[list[np.ndarray]]:
    return [[word_hashes(p.encode()) for p in group.split("|")] for group in need]


def _holds(words: np.ndarray, need: list[list[np.ndarray]]) -> bool:
    """Whether one phrase of every group occurs in the words."""
    def held(p: np.ndarray) -> bool:
        at = np.flatnonzero(words[: max(0, len(words) - len(p) + 1)] == p[0])
        return any((words[i : i + len(p)] == p).all() for i in at.tolist())

    return all(any(map(held, group)) for group in need)


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens occur in a sorted array."""
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


class Templates:
    """Shingle sets and, per size class, band tables of the templates."""

    def __init__(self, texts: Mapping[str, str | Sequence[Wording]], containment: float, exclusive: bool = False) -> None:
        wordings = [(name, w) for name in sorted(texts) for w in ([Wording(texts[name])] if isinstance(texts[name], str) else texts[name])]
        if len(wordings) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.containment, self.exclusive = containment, exclusive
        self.names: list[str] = []
        self.needs: list[list[list[np.ndarray]]] = []
        self.classes: dict[tuple[int, int], dict] = {}
        self.known: dict[int, np.ndarray] = {}
        self.sets: list[np.ndarray] = []
        for name, wording in wordings:
            words = word_hashes(wording.text.encode())
            if not len(words):
                raise ValueError(f"template {name} has no words")
            k = min(N, len(words))
            tokens = np.unique(shingle_hashes(words, k))
            c = 1 << (len(tokens) - 1).bit_length()
            self.classes.setdefault((k, c), {"members": []})["members"].append(len(self.sets))
            self.names.append(name)
            self.needs.append(_phrases(wording.need))
            self.sets.append(tokens)
        for (_, c), group in self.classes.items():
            sizes = [len(self.sets[t]) for t in group["members"]]
            least = min(containment * m / (c + c // 4 + (1 - containment) * m) for m in sizes)
            bands = 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))
            group["odd"] = _mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
            group["step"], group["size"] = max(1, c // 4), c + c // 4
            group["signatures"] = np.array([(self.sets[t][:, None] * group["odd"]).min(axis=0) for t in group["members"]])
            group["known"] = np.unique(np.concatenate([self.sets[t] for t in group["members"]]))
            group["least"] = max(1, math.ceil(containment * min(sizes) - 1e-9))
        for k in {k for k, _ in self.classes}:
            self.known[k] = np.unique(np.concatenate([g["known"] for (size, _), g in self.classes.items() if size == k]))

    @cached_property
    def filters(self) -> dict[int, np.ndarray]:
        """Per shingle length, which leading bits a template's shingle has."""
        out = {k: np.zeros(1 << _FILTER_BITS, dtype=bool) for k in self.known}
        for k, known in self.known.items():
            out[k][(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(name, start, end, containment) of the matches, by start and name; offsets in code points."""
        raw = text.encode()
        words = word_hashes(raw)
        mixed = [_mix(words * m) for m in _M[: max(self.known)]]
        found = []
        for k, held in self.filters.items():
            tokens = shingle_hashes(words, k, mixed)
            near = np.flatnonzero(held[(tokens >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            near = near[_among(tokens[near], self.known[k])]
            if len(near):
                for (size, _), group in self.classes.items():
                    if size == k:
                        found += self._windows(words, tokens, near, group, k)
        if not found:
            return []
        best: dict[str, list[tuple]] = {}
        for match in sorted(found, key=lambda f: (self.names[f[0]], -len(f[4]), -f[3], f[1])):
            held = best.setdefault(self.names[match[0]], [])
            if all(match[2] < m[1] or match[1] > m[2] for m in held):
                held.append(match)
        kept = [m for held in best.values() for m in held]
        if self.exclusive:
            taken, fuller = np.zeros(len(words), dtype=bool), sorted(kept, key=lambda m: (-len(m[4]), -m[3], m[1], self.names[m[0]]))
            kept = []
            for match in fuller:
                if 2 * taken[match[4]].sum() < len(match[4]):
                    taken[match[4]] = True
                    kept.append(match)
        spots = [m.span() for m in _WORD.finditer(raw.lower())]
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])  # code points before each byte
        return sorted([(self.names[t], int(before[spots[a][0]]), int(before[spots[b][1]]), share) for t, a, b, share, _ in kept], key=lambda m: (m[1], m[0]))

    def _windows(self, words: np.ndarray, tokens: np.ndarray, near: np.ndarray, group: dict, k: int) -> list[tuple[int, int, int, float, np.ndarray]]:
        """(template, first word, last word, containment, matched words) of the windows that bands retrieve and sets confirm."""
        step, size = group["step"], group["size"]
        near = near[_among(tokens[near], group["known"])]
        starts = np.unique(np.concatenate([np.maximum(0, (near // step - d) * step) for d in range(-(-size // step) + 1)]))
        starts = starts[np.searchsorted(near, starts + size) - np.searchsorted(near, starts) >= group["least"]]
        out = []
        for start in starts.tolist():
            window = tokens[start : start + size]
            signature = (window[:, None] * group["odd"]).min(axis=0)
            for at in np.flatnonzero((group["signatures"] == signature).any(axis=1)).tolist():
                t = group["members"][at]
                inside = np.flatnonzero(_among(window, self.sets[t]))
                share = len(np.unique(window[inside])) / len(self.sets[t])
                if share >= self.containment:
                    inside = start + _shortest(window, inside)
                    first, last = int(inside[0]), int(inside[-1]) + k - 1
                    if _holds(words[max(0, first - N) : last + 1 + N], self.needs[t]):
                        out.append((t, first, last, share, np.unique(inside[:, None] + np.arange(k))))
        return out


def _shortest(window: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Without the shingles at either end that occur again inside: a neighbour's shingles do not widen a match."""
    left = Counter(window[inside].tolist())
    a, b = 0, len(inside)
    while left[window[inside[a]].item()] > 1:
        left[window[inside[a]].item()] -= 1
        a += 1
    while left[window[inside[b - 1]].item()] > 1:
        left[window[inside[b - 1]].item()] -= 1
        b -= 1
    return inside[a:b]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str | Sequence[Wording]] | None = None,
                 containment: float = CONTAINMENT, exclusive: bool = True) -> DataFrame:
    """Per row: the id column, ``n_matches``, ``licenses`` (sorted, comma-joined), ``max_containment``, ``spans``."""
    known = Templates(default_templates() if templates is None else templates, containment, exclusive)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_matches", T.LongType()), T.StructField("licenses", T.StringType()),
                        T.StructField("max_containment", T.DoubleType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                found = [known.scan(t) for t in b.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()),
                    pa.array([max((m[3] for m in f), default=0.0) for f in found], pa.float64()),
                    pa.array([",".join(f"{m[0]}:{m[1]}:{m[2]}" for m in f) for f in found], pa.string())], names=out.names)

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).mapInArrow(run, out)
