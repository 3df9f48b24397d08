"""Licence scans: a trained paragraph classifier confirmed by template comparison.

Paragraphs (lines; a long one by overlapping windows of words) are classified
into licence families by multinomial logistic regression over hashed word
n-grams. One more class is unknown; the probabilities are calibrated by a
temperature and a bias of that class fitted on held-out examples. It learns
licences from names and sentences of public licences in many frames, and unknown
from snippets of the scanned texts themselves that hold no word of licensing. A
prediction is confirmed if the paragraph contains enough of the pairs of
neighbouring words of one of its family's templates.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, run_hashes, slices

BUCKETS, GRAMS = 1 << 16, (1, 2, 3)
#: Words of a window in a long paragraph, and words from one window to the next.
WINDOW, HOP = 20, 8
#: Least probability of a prediction and least share of a template's n-grams that confirms it.
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6

# Names by which public licence notices call each family.
NAMES = {
    "agpl": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "GNU Affero General Public License version 3 or later"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License, Version 2.0"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "New BSD License", "Simplified BSD License"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License", "CC BY 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"),
    "cc0": ("CC0 1.0", "CC0-1.0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"),
    "epl": ("Eclipse Public License 2.0", "EPL-2.0", "Eclipse Public License v1.0"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License version 2", "GPL-3.0", "GPL-2.0-only", "GPLv3", "GPLv2", "GNU GPL version 3 or later"),
    "isc": ("ISC License", "ISC license", "ISC"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "LGPL-3.0", "LGPL-2.1", "GNU Lesser General Public License version 3", "GNU LGPL"),
    "mit": ("MIT License", "MIT license", "MIT", "The MIT License", "Expat License"),
    "mpl": ("Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0"),
    "unlicense": ("The Unlicense", "Unlicense"),
}
# Sentences of public licence texts.
SENTENCES = {
    "apache": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# How notices name a licence, and lines that are no notice.
FRAMES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}", "This work is licensed under the {}.", "This work is licensed under a {}",
    "Distributed under the terms of the {}", "This software is released under the {}.", "SPDX-License-Identifier: {}", "License: {}", "Available under the {}.", "This project is licensed under the {}",
)
NOT_LICENCES = (
    "The driver showed his license to the officer.", "They studied at MIT for four years.", "The Apache people lived in the southwest.", "A general public meeting was released to the press.",
    "The public version of the work is under review.", "All of this was under the general terms.", "Her fishing license expired in version 3 of the story.", "The restaurant lost its liquor license under the new law.",
    "Creative people share common ground.", "The lesser of the two evils, in general.", "Permission to enter was granted at noon.", "The software was free of bugs.", "Mozilla was the name of the lizard.",
    "This work is hard, and the work under the bridge is harder.", "Released from prison under the terms of the court.", "An eclipse was seen by the public in 2017.", "by the way", "under the table", "of the and to in version",
)

# Words of licensing; a snippet that holds none of them is no notice.
LICENSING = r"(?i)licen[cs]|spdx|copyright|warrant|permission|permitted|redistribut|creative commons|public domain|cc[ -]by|cc0|gpl|\bmit\b|\bbsd\b|apache|mozilla|eclipse"
#: Texts of which snippets are taken to learn from at most, snippets of each, and their words.
PROSE_TEXTS, SNIPPETS, SNIPPET_WORDS = 250, 6, 30

FAMILIES = (*sorted(NAMES), "unknown")

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Units:
    """Paragraphs and windows of a run of rows: words a:b and the row and paragraph of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        feeds = np.flatnonzero(buf == 10)
        edges = np.unique(np.concatenate([offs, feeds + 1]))
        edges = edges[edges <= len(buf)]
        folded = _FOLD[buf]
        self.words = Words(folded, edges)
        self.hashes = self.words.hashes()
        first = self.words.bounds[:-1]
        size = np.diff(self.words.bounds)
        counts = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - HOP)) // HOP)), 0)
        para = np.repeat(np.arange(len(size)), counts)
        nth = np.arange(len(para)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.a = first[para] + nth * HOP
        self.b = np.minimum(self.a + WINDOW, self.words.bounds[1:][para])
        start_row = np.searchsorted(offs, edges[:-1], side="right") - 1
        self.row = start_row[para]
        self.paragraph = para - np.searchsorted(edges, offs)[self.row]
        self.in_row = np.bincount(start_row[size > 0], minlength=len(offs) - 1) if len(size) else np.zeros(len(offs) - 1, np.int64)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and unit of every word n-gram inside each unit."""
        buckets, units = [], []
        for k in GRAMS:
            grams = (run_hashes(self.hashes, k) % np.uint64(BUCKETS)).astype(np.int64)
            size = np.maximum(self.b - self.a - k + 1, 0)
            unit = np.repeat(np.arange(len(self.a)), size)
            place = np.repeat(self.a - (np.cumsum(size) - size), size) + np.arange(len(unit))
            buckets.append(grams[place])
            units.append(unit)
        return np.concatenate(buckets), np.concatenate(units)


def _units_of(texts: list[str]) -> Units:
    _, _, buf, offs = next(slices(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), 1 << 40))
    return Units(buf, offs)


def prose(docs: DataFrame, text_col: str = "text", texts: int = PROSE_TEXTS) -> list[str]:
    """Snippets without words of licensing, spread evenly over each of a bounded number of distinct texts, those with the smallest hashes."""
    good = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    chosen = good.groupBy("h").agg(F.lit(1).alias("one")).orderBy("h").limit(texts).select("h")
    one = good.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("t").alias("t"))
    words = one.select("h", F.filter(F.split("t", r"\s+"), lambda w: w != "").alias("w"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(SNIPPETS - 1)), lambda i: F.substring(F.array_join(F.slice(F.col("w"), (F.floor(i * F.size("w") / SNIPPETS) + 1).cast("int"), F.lit(SNIPPET_WORDS)), " "), 1, 20 * SNIPPET_WORDS))
    lines = words.select("h", F.explode(F.array_distinct(spread)).alias("s")).where((F.length("s") > 0) & ~F.col("s").rlike(LICENSING))
    return [r.s for r in sorted(lines.collect())]


def _examples(seed: int, corpus: list[str] = ()) -> tuple[list[str], np.ndarray]:
    """Notices of every family in many wordings, bare and inside snippets of the corpus, as many lines that are none, and the snippets."""
    rng = np.random.Generator(np.random.PCG64(seed))
    salad = " ".join(NOT_LICENCES).split()
    texts, y = [], []
    noise = lambda: " ".join("".join(rng.choice(list("aeinorstdlhu"), rng.integers(1, 9))) for _ in range(rng.integers(1, 7)))
    for c, family in enumerate(FAMILIES[:-1]):
        for name in NAMES[family]:
            for frame in FRAMES:
                line = frame.format(name)
                around = [" ".join(noise() for _ in range(rng.integers(1, 4))) for _ in range(2)]
                texts += [line, f"{noise()} {line}", f"{line} {noise()}", line.upper() if rng.random() < 0.5 else line.lower(), f"{around[0]} {line} {around[1]}"]
                y += [c] * 5
        for sentence in SENTENCES.get(family, ()):
            for _ in range(12):
                words = sentence.split()
                cut = rng.integers(0, max(1, len(words) // 4))
                texts.append(" ".join(words[cut:]) + " " + noise())
                y.append(c)
    unknown = len(FAMILIES) - 1
    for _ in range(len(texts)):
        kind = rng.random()
        if kind < 0.3:
            line = NOT_LICENCES[rng.integers(len(NOT_LICENCES))]
        elif kind < 0.6:
            line = " ".join(rng.choice(salad, rng.integers(2, 20)))
        elif kind < 0.7:
            line = " ".join([noise()] * int(rng.integers(5, 40)))
        else:
            line = " ".join(noise() for _ in range(rng.integers(1, 12)))
        texts.append(line)
        y.append(unknown)
    for i, line in enumerate(corpus):
        texts.append(line)
        y.append(unknown)
        if i % 3 == 0:  # a notice between words of the corpus
            c, words = int(rng.integers(unknown)), line.split()
            cut = int(rng.integers(len(words) + 1))
            name = NAMES[FAMILIES[c]][rng.integers(len(NAMES[FAMILIES[c]]))]
            texts.append(" ".join([*words[max(cut - 5, 0) : cut], FRAMES[rng.integers(len(FRAMES))].format(name), *words[cut : cut + 3]]))
            y.append(c)
    return texts, np.array(y)


def _logits(weights: np.ndarray, bias: np.ndarray, units: Units) -> np.ndarray:
    bucket, unit = units.features()
    n = len(units.a)
    scale = 1 / np.sqrt(np.maximum(np.bincount(unit, minlength=n), 1))
    return np.stack([np.bincount(unit, weights=weights[c][bucket], minlength=n) for c in range(len(weights))], axis=1) * scale[:, None] + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(corpus: list[str] = (), seed: int = 5, rounds: int = 120) -> dict:
    """The classifier: weights, bias, temperature, unknown's bias, and the pairs of words of each family's templates.

    corpus: snippets that are no notices (`prose`).
    """
    texts, y = _examples(seed, corpus)
    held = np.arange(len(texts)) % 5 == 0
    k = len(FAMILIES)
    units = _units_of([t for t, h in zip(texts, held, strict=True) if not h])
    target = np.eye(k)[y[~held][units.row]]
    bucket, unit = units.features()
    n = len(units.a)
    scale = 1 / np.sqrt(np.maximum(np.bincount(unit, minlength=n), 1))
    used, slot = np.unique(bucket, return_inverse=True)
    w, bias = np.zeros((k, len(used))), np.zeros(k)
    grow = np.zeros_like(w)
    for _ in range(rounds):  # adaptive full-batch gradient
        z = np.stack([np.bincount(unit, weights=w[c][slot], minlength=n) for c in range(k)], axis=1) * scale[:, None] + bias
        d = (_softmax(z) - target) / n
        g = np.stack([np.bincount(slot, weights=(d[:, c] * scale)[unit], minlength=len(used)) for c in range(k)]) + 1e-6 * w
        grow += g * g
        w -= 0.5 * g / (np.sqrt(grow) + 1e-8)
        bias -= 2.0 * d.sum(axis=0)
    weights = np.zeros((k, BUCKETS))
    weights[:, used] = w
    probe = _units_of([t for t, h in zip(texts, held, strict=True) if h])
    z, truth = _logits(weights, bias, probe), y[held][probe.row]
    best = min(((-np.log(_softmax(z / t + np.eye(k)[-1] * u)[np.arange(len(z)), truth] + 1e-12).mean(), t, u) for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0) for u in (0.0, 0.5, 1.0, 1.5, 2.0)), key=lambda x: x)
    templates = {}
    for family in FAMILIES[:-1]:
        one_word = [x for x in NAMES[family] if len(_units_of([x]).hashes) == 1]  # proves nothing by itself
        lines = [x for x in (*NAMES[family], *SENTENCES.get(family, ())) if x not in one_word]
        lines += [f"{before} {x}" for x in one_word for before in ("license", "under", "identifier")]
        made = _units_of(lines)
        templates[family] = [np.unique(run_hashes(made.hashes[made.words.bounds[i] : made.words.bounds[i + 1]], 2)) for i in range(len(lines))]
    return {"weights": weights.astype(np.float32), "bias": bias, "temperature": best[1], "unknown": best[2], "templates": templates}


def _similarity(words: np.ndarray, templates: list[np.ndarray]) -> float:
    """The largest share of a template's pairs of neighbouring words that these words have."""
    pairs = run_hashes(words, 2)
    return max(float(np.isin(t, pairs).mean()) for t in templates)


HIT = "struct<paragraph:int,start:long,end:long,family:string,probability:double,similarity:double,confirmed:boolean>"


def scan(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """docs with n_paragraphs (those with words) and hits, the licence notices of the whole text.

    A hit has its paragraph (from 0), the byte span of its words in the UTF-8
    text, the family, its calibrated probability, the share of the nearest
    template found in it, and whether that confirms it. Windows of one paragraph
    that name the same family and overlap or touch give one hit, the most
    probable of those confirmed, if any (of equals the first); windows apart give
    a hit each. Of families of equal probability the first by name is taken.
    model: as `fit` makes it; None fits one with snippets of docs. Texts are
    scanned whole, a run of rows at a time. Null and empty texts have no paragraphs; repeated rows are scanned each.
    Columns of docs with the names of the new ones are replaced.
    """
    docs = docs.drop("n_paragraphs", "hits")
    packed = pickle.dumps(model or fit(prose(docs, text_col)))
    schema = docs.select("*", F.lit(0).cast("int").alias("n_paragraphs"), F.lit(None).cast(f"array<{HIT}>").alias("hits")).schema
    hit_type = pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        none = len(FAMILIES) - 1
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int32)
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b, buf, offs in slices(batch.column(text_col)):
                units = Units(buf, offs)
                counts[a:b] = units.in_row
                if not len(units.a):
                    continue
                z = _logits(m["weights"], m["bias"], units) / m["temperature"]
                z[:, none] += m["unknown"]
                p = _softmax(z)
                family = p.argmax(axis=1)
                found: dict[tuple[int, int, int, int], dict] = {}
                runs: dict[tuple[int, int, int], tuple[int, int]] = {}  # first window and last word of the latest run
                for i in np.flatnonzero((family != none) & (p.max(axis=1) >= LEAST_PROBABILITY)).tolist():
                    name = FAMILIES[family[i]]
                    share = _similarity(units.hashes[units.a[i] : units.b[i]], m["templates"][name])
                    row = int(units.row[i])
                    hit = {
                        "paragraph": int(units.paragraph[i]), "start": int(units.words.starts[units.a[i]] - offs[row]), "end": int(units.words.ends[units.b[i] - 1] - offs[row]),
                        "family": name, "probability": float(p[i, family[i]]), "similarity": share, "confirmed": share >= LEAST_SIMILARITY,
                    }
                    line = (a + row, hit["paragraph"], int(family[i]))
                    first, end = runs.get(line, (i, -1))
                    if units.a[i] > end:
                        first = i
                    runs[line] = (first, int(units.b[i]))
                    key = (*line, first)
                    if key not in found or (hit["confirmed"], hit["probability"]) > (found[key]["confirmed"], found[key]["probability"]):
                        found[key] = hit
                for (row, *_), hit in sorted(found.items(), key=lambda x: x[0]):
                    hits[row].append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts), pa.array(hits, pa.list_(hit_type))], [*batch.schema.names, "n_paragraphs", "hits"])

    return docs.mapInArrow(run, schema)
