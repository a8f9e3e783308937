"""Licence scans: a trained paragraph classifier confirmed by templates.

Paragraphs (lines, and runs of lines without a blank one between, long ones in
overlapping windows) become hashed word n-grams. A
multinomial logistic regression with sparse weights, trained on the notices below under
random edits and on corpus paragraphs as the unknown class, gives a family; its
probabilities are calibrated on held-out paragraphs, with a threshold for unknown. A
prediction counts once the paragraph also resembles a template of that family.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_GAP, hashed_sample, prepared, rolling, texts_of, word_hashes, word_spans

#: The usual short notices of the licence families.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
             "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.",
                    "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)                     # class number of everything else

DIM = 1 << 16
WINDOW, STRIDE = 64, 32                     # words of a part of a long paragraph
SAMPLE_DOCS = 400                           # documents whose paragraphs train the unknown class, at most
SAMPLE_PARAGRAPHS = 3000                    # and their paragraphs
VARIANTS = 40                               # edited copies of each template
MIN_VARIANTS = 10                           # of them that must show an n-gram for it to be a feature
STEPS = 200
SPARSITY = 2e-4
MIN_RESEMBLANCE = 0.6                       # share of a template's word pairs that a paragraph must have
PRECISION = 0.99                            # wanted on held-out paragraphs when the threshold is set
FOUND = "doc_id long, family string, probability double, resemblance double, start long, end long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEWLINE = 10


def _windows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each part of the stretches: whole ones or overlapping windows."""
    long = last - first > WINDOW
    if long.any():
        parts = [(f, t) for f, t in zip(first[~long], last[~long])]
        for f, t in zip(first[long], last[long]):
            parts += [(s, min(s + WINDOW, t)) for s in range(f, max(f + 1, t - WINDOW + STRIDE), STRIDE)]
        parts.sort()
        first, last = (np.array(x, np.int64) for x in zip(*parts))
    return first.astype(np.int64), last.astype(np.int64)


def paragraphs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends of a text, and the first and end word of each line part."""
    starts, ends = word_spans(data, PLAIN_GAP)
    h = word_hashes(_LOWER[data], starts, ends)
    breaks = np.searchsorted(starts, np.flatnonzero(data == _NEWLINE))
    cut = np.unique(np.concatenate(([0], breaks, [len(starts)])))
    return h, starts, ends, *_windows(cut[:-1], cut[1:])


def joined(data: np.ndarray, starts: np.ndarray, also: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each part that goes over a line break: runs of lines between
    lines without words (blank or comment marks only), also cut at the words ``also``."""
    breaks, times = np.unique(np.searchsorted(starts, np.flatnonzero(data == _NEWLINE)), return_counts=True)
    cut = np.unique(np.concatenate(([0], breaks[times > 1], also, [len(starts)]))).astype(np.int64)
    first, last = _windows(cut[:-1], cut[1:])
    over = np.searchsorted(breaks, first, side="right") < np.searchsorted(breaks, last)
    return first[over], last[over]


def features(h: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, feature) pairs of the hashed words, pairs and triples inside each part, once
    each and only those with a ``row`` above 0, and the number of n-grams of each part."""
    part, feat = [], []
    total = np.zeros(len(first), np.int64)
    for k in (1, 2, 3):
        g = (rolling(h, k, k) % np.uint64(DIM)).astype(np.int64)
        total += np.maximum(last - first - k + 1, 0)
        at = np.flatnonzero(row[g])
        # parts overlap in long paragraphs only: the parts that hold position `at` are consecutive
        lo, hi = np.searchsorted(last, at + k, side="left"), np.searchsorted(first, at, side="right")
        n = np.maximum(hi - lo, 0)
        part.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        feat.append(np.repeat(g[at], n))
    key = np.unique(np.concatenate(part) * DIM + np.concatenate(feat))
    return key // DIM, key % DIM, total


def _pairs(text: str) -> np.ndarray:
    """Sorted distinct word pairs of a template."""
    data = np.frombuffer(text.encode(), np.uint8)
    h = paragraphs(data)[0]
    return np.unique(rolling(h, min(2, len(h)), 2))


@dataclass
class Scanner:
    """A sparse model: ``row[f]`` is the weight row of feature f, 0 (all zero) for most."""
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        part, feat, total = features(h, first, last, self.row)
        n, rows = len(first), self.row[feat]
        z = np.zeros((n, UNKNOWN + 1))
        for c in range(UNKNOWN + 1):
            z[:, c] = np.bincount(part, weights=self.weights[rows, c], minlength=n)
        return _softmax((z / np.sqrt(np.maximum(total, 1))[:, None] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _edited(words: list[str], rng: np.random.Generator, noise: list[str]) -> str:
    """A template as documents show it: words lost or replaced, text before or after."""
    out = []
    for w in words:
        x = rng.random()
        if x < 0.04 and len(words) > 3:
            continue
        out.append(str(rng.choice(noise)) if x < 0.07 and len(words) > 4 and noise else w)
    if noise and rng.random() < 0.4:
        out = [str(w) for w in rng.choice(noise, rng.integers(1, 8))] + out
    if noise and rng.random() < 0.4:
        out += [str(w) for w in rng.choice(noise, rng.integers(1, 8))]
    return " ".join(out)


def fit(unknown: list[str], seed: int = 5) -> Scanner:
    """Train on edited templates and ``unknown`` paragraphs, every fourth one held out
    for temperature and threshold."""
    rng = np.random.default_rng(seed)
    noise = sorted({w for t in unknown[:300] for w in t.split()})[:5000]
    templates = [_pairs(t) for f in FAMILIES for t in TEMPLATES[f]]
    rows = []
    for t in unknown:
        have = _pairs(t)
        if all(np.isin(p, have).mean() < MIN_RESEMBLANCE for p in templates):
            rows.append((t, UNKNOWN))
    for c, f in enumerate(FAMILIES):
        for t in TEMPLATES[f]:
            rows += [(t, c)] * 8 + [(_edited(t.split(), rng, noise), c) for _ in range(VARIANTS)]
    rng.shuffle(rows)
    y = np.array([c for _, c in rows], np.int64)
    hashes = [paragraphs(np.frombuffer(t.replace("\n", " ").encode(), np.uint8))[0] for t, _ in rows]
    # only n-grams that templates keep through edits can speak for a family
    seen = np.zeros(DIM, np.int64)
    every = np.ones(DIM, np.int32)
    for h, (_, c) in zip(hashes, rows):
        if c != UNKNOWN:
            seen[features(h, np.array([0]), np.array([len(h)]), every)[1]] += 1
    usable = (seen >= MIN_VARIANTS).astype(np.int32)
    part, feat, size = [], [], []
    for i, h in enumerate(hashes):
        _, f, total = features(h, np.array([0]), np.array([len(h)]), usable)
        part.append(np.full(len(f), i))
        feat.append(f)
        size.append(max(int(total[0]), 1))
    part, feat = np.concatenate(part).astype(np.int64), np.concatenate(feat).astype(np.int64)
    used, local = np.unique(feat, return_inverse=True)
    n, k = len(rows), UNKNOWN + 1
    value = 1.0 / np.sqrt(np.array(size))[part]
    held = np.arange(n) % 4 == 0
    w, bias = np.zeros((len(used), k)), np.zeros(k)
    weight = np.where(held, 0.0, 1.0)
    share = np.bincount(y[~held], minlength=k).clip(1)
    weight *= (1.0 / share ** 0.5)[y]
    weight /= weight.sum()
    onehot = np.eye(k)[y]

    def scores(w: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = np.zeros((n, k))
        for c in range(k):
            z[:, c] = np.bincount(part, weights=value * w[local, c], minlength=n)
        return z + bias

    # proximal gradient with momentum: soft thresholds make most weights zero
    step, momentum, last = 4.0, 1.0, (w, bias)
    for _ in range(STEPS):
        nxt = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        b = (momentum - 1) / nxt
        wy, by = w + b * (w - last[0]), bias + b * (bias - last[1])
        g = weight[:, None] * (_softmax(scores(wy, by)) - onehot)
        grad = np.stack([np.bincount(local, weights=value * g[part, c], minlength=len(used)) for c in range(k)], axis=1)
        last = (w, bias)
        w = wy - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSITY, 0.0)
        bias = by - step * g.sum(axis=0)
        momentum = nxt
    z = scores(w, bias)[held]
    yh = y[held]
    temperatures = np.geomspace(0.1, 5, 40)
    loss = [-np.mean(np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12)) for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    top, prob = p[:, :UNKNOWN].argmax(axis=1), p[:, :UNKNOWN].max(axis=1)
    threshold = 0.99
    for t in np.linspace(0.2, 0.99, 80):
        said = prob >= t
        if said.any() and (top == yh)[said].mean() >= PRECISION:
            threshold = float(t)
            break
    keep = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    row = np.zeros(DIM, np.int32)
    row[used[keep]] = np.arange(1, len(keep) + 1)
    return Scanner(row, np.concatenate((np.zeros((1, k)), w[keep])), bias, temperature, threshold)


def sample_paragraphs(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """The unknown class: at most ``SAMPLE_PARAGRAPHS`` different lines (long ones in windows
    of words) of at most 2000 characters, the first ones by a hash of their text among all
    lines of the first ``SAMPLE_DOCS`` documents by a hash of their id."""
    rows = (hashed_sample(prepared(docs, id_col, text_col), "doc_id", SAMPLE_DOCS)
            .select(F.explode(F.split("text", "\n")).alias("p"))
            .select(F.split(F.trim("p"), " +").alias("w"))
            .select("w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(WINDOW))).alias("at"))
            .select(F.array_join(F.slice("w", F.col("at"), WINDOW), " ").alias("p"))
            .filter(F.length("p").between(1, 2000)).distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS))
    return [r["p"] for r in rows.collect()]


@dataclass
class _Finding:
    """A confirmed part: its words, the template it resembles most, and their common word pairs."""
    first: int
    last: int
    family: int
    probability: float
    alike: float
    template: np.ndarray
    common: np.ndarray

    def meets(self, other: _Finding) -> bool:
        return self.first < other.last and other.first < self.last

    def within(self, other: _Finding) -> bool:
        """Whether ``other`` shows this part to be a piece of another family's notice."""
        return (self.family != other.family and self.meets(other) and other.alike > self.alike
                and bool(np.isin(self.common, other.template).all()))


def _confirmed(model: Scanner, known: dict[int, list[np.ndarray]], h: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[_Finding]:
    """The parts whose predicted family is sure and confirmed by a template."""
    out = []
    for a in range(0, len(first), 4096):
        f, t = first[a:a + 4096], last[a:a + 4096]
        p = model.probabilities(h, f, t)
        top = p[:, :UNKNOWN].argmax(axis=1)
        sure = p[np.arange(len(f)), top]
        for i in np.flatnonzero((sure >= model.threshold) & (top != UNKNOWN)).tolist():
            have = rolling(h[f[i]:t[i]], 2, 2)
            shown = [np.isin(pairs, have) for pairs in known[int(top[i])]]
            k = max(range(len(shown)), key=lambda k: shown[k].mean())
            if shown[k].mean() >= MIN_RESEMBLANCE:
                template = known[int(top[i])][k]
                out.append(_Finding(int(f[i]), int(t[i]), int(top[i]), float(sure[i]), float(shown[k].mean()), template, template[shown[k]]))
    return out


def _settled(lines: list[_Finding], runs: list[_Finding]) -> list[_Finding]:
    """Lines and runs of lines without those that are pieces of another family's notice,
    and without runs whose family a line in them already has."""
    kept = [x for x in lines if not any(x.within(y) for y in runs)]
    over = [x for x in runs if not any(x.within(y) for y in lines + runs)]
    return kept + [x for x in over if not any(x.family == y.family and x.meets(y) for y in kept)]


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  scanner: Scanner | None = None) -> DataFrame:
    """Licence paragraphs: ``doc_id, family, probability, resemblance, start, end`` (bytes),
    one row for each part that is confirmed: lines, and notices wrapped over lines that
    no line of theirs already shows.

    Whole texts are scanned. Null and empty texts have no paragraphs; ids pass through,
    null ones too; repeated rows give repeated results; an empty table gives no rows.
    Without a ``scanner`` one is trained on the templates and a bounded sample of ``docs``.
    """
    scanner = scanner or fit(sample_paragraphs(docs, id_col, text_col))
    texts = prepared(docs, id_col, text_col)
    templates = {c: [_pairs(t) for t in TEMPLATES[f]] for c, f in enumerate(FAMILIES)}
    shared = docs.sparkSession.sparkContext.broadcast((scanner, templates))      # a few MB, fixed

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for b in batches:
            out: list[tuple] = []
            for doc, data in zip(b.column(0).to_pylist(), texts_of(b)):
                h, starts, ends, first, last = paragraphs(data)
                lines = _confirmed(model, known, h, first, last)
                runs = _confirmed(model, known, h, *joined(data, starts, []))
                if lines:                                    # what stands between the confirmed lines, by itself
                    between = _confirmed(model, known, h, *joined(data, starts, [w for x in lines for w in (x.first, x.last)]))
                    runs += [x for x in between if not any(x.family == y.family and x.meets(y) for y in runs)]
                for x in _settled(lines, runs) if runs else lines:
                    out.append((doc, FAMILIES[x.family], x.probability, x.alike, int(starts[x.first]), int(ends[x.last - 1])))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))],
                ["doc_id", "family", "probability", "resemblance", "start", "end"])
    return texts.mapInArrow(scan, FOUND)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id with a confirmed licence: ``doc_id, n_paragraphs, families``
    (sorted, comma-joined), ``probability`` and ``resemblance`` of its surest paragraph."""
    return (find_licenses(docs, id_col, text_col).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_paragraphs"),
                 F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
                 F.max("probability").alias("probability"), F.max("resemblance").alias("resemblance")))
