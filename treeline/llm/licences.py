"""Licence scans by a trained paragraph classifier.

Lines (long ones in overlapping windows) and windows across line ends become sparse counts of
the word n-grams that occur in licence notices, so that notices are seen on one line, wrapped
and behind comment signs. A logistic regression names the licence family, or none; its
temperature and threshold are calibrated on paragraphs it was not fitted on. A prediction
counts as confirmed when the words of a notice of that family are there in order.

One task fits it on the notices below, changed and embedded at random, and on a
bounded sample of the corpus's own paragraphs as the class of none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.fitting import bounded_sample, fitted, whole_within
from treeline.llm.tokens import named

#: Documents, and bytes of their whole texts, that the class of none is learned from at most.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1 << 20
EXAMPLES = 60  # changed copies of each notice
EPOCHS = 120
HALF = 32  # a window is two halves of so many words
LINES = (2, 3, 4, 6)  # windows across line ends hold so many lines, or two halves
CONFIRMED = 0.7
NONE = "none"

# Notices by which texts are put under a licence, by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, Version 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    "Unlicense": (
        "Released under the Unlicense.", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 3.0.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 3.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
}
# Sentences that sound alike and put nothing under a licence.
LIKE_NOTICES = (
    "A driving license is required to use this car.", "Our terms of service and privacy policy apply.", "All rights reserved.",
    "The public may obtain a copy of the general report at the office.", "The software version 2.0 was released in 2019.",
    "You may not use this file.", "The license plate has three digits and four letters.", "Version 3 of the program is free.",
    "He was granted permission to publish the list of conditions.", "The foundation published the third version of its work.",
)

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@dataclass
class Model:
    families: tuple[str, ...]  # the last is none
    grams: dict[tuple[str, ...], int]
    weights: np.ndarray  # gram by family
    shift: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def logits(self, words: list[str], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows (first word, end; in order) that have a known n-gram of two words: their
        places and logits. All others are none by far."""
        rows: tuple[list[int], ...] = ([], [], [])  # by length of n-gram
        at: tuple[list[int], ...] = ([], [], [])
        before = -1  # the place of the last known word
        grams = self.grams
        for i, w in enumerate(words):
            one = grams.get((w,))
            if one is None:
                continue
            rows[0].append(one)
            at[0].append(i)
            if before == i - 1 >= 0:
                two = grams.get((words[i - 1], w))
                if two is not None:
                    rows[1].append(two)
                    at[1].append(i - 1)
                    three = grams.get((words[i - 2], words[i - 1], w)) if i > 1 else None
                    if three is not None:
                        rows[2].append(three)
                        at[2].append(i - 2)
            before = i
        starts, ends = windows.T
        bounds = [(np.searchsorted(at[n], starts), np.searchsorted(at[n], np.maximum(ends - n, starts))) for n in range(3)]
        some = np.flatnonzero(bounds[1][1] > bounds[1][0])
        out = np.zeros((len(some), len(self.families)))
        for first in range(0, len(some), 2048):  # a long text is not summed at once
            part = some[first : first + 2048]
            for n, (low, high) in enumerate(bounds):
                low, high = low[part], high[part]
                base = int(low.min())
                sums = np.zeros((int(high.max()) - base + 1, len(self.families)))
                np.cumsum(self.weights[rows[n][base : int(high.max())]], axis=0, out=sums[1:], dtype=np.float64)
                out[first : first + 2048] += sums[high - base] - sums[low - base]
        return some, out / np.sqrt(ends[some] - starts[some] + 4.0)[:, None] + self.shift


def _scale(words: int) -> float:
    return float(np.sqrt(words + 4))


def _dense(model: Model, examples: list[list[str]]) -> np.ndarray:
    x = np.zeros((len(examples), len(model.grams)), dtype=np.float32)
    for i, words in enumerate(examples):
        for g in _grams(words):
            at = model.grams.get(g)
            if at is not None:
                x[i, at] += 1 / _scale(len(words))
    return x


def _changed(rng: np.random.Generator, words: list[str], around: list[list[str]]) -> list[str]:
    """A notice as it may stand in a text: cut, a word lost, other words before and behind."""
    words = list(words)
    if len(words) > 12 and rng.random() < 0.5:
        size = int(rng.integers(max(10, len(words) // 2), len(words) + 1))
        start = int(rng.integers(0, len(words) - size + 1))
        words = words[start : start + size]
    if len(words) > 8 and rng.random() < 0.3:
        del words[int(rng.integers(len(words)))]
    if around and rng.random() < 0.5:
        other = around[int(rng.integers(len(around)))]
        at = int(rng.integers(0, min(len(other), 30) + 1))
        words = other[:at] + words + other[at : at + int(rng.integers(0, 20))]
    return words


def fit(corpus: list[str], examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """The classifier, its temperature and its threshold, from the notices and from
    paragraphs of the corpus, which count as none unless a notice is in them."""
    rng = np.random.default_rng(seed)
    families = (*NOTICES, NONE)
    grams: dict[tuple[str, ...], int] = {}
    for notices in NOTICES.values():
        for notice in notices:
            for g in _grams(words_of(notice)):
                grams.setdefault(g, len(grams))
    model = Model(families, grams, np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32))
    plain = [w[:64] for w in map(words_of, corpus) if w]
    plain = [w for w in plain if max(similarity(w, f)[0] for f in NOTICES) < 0.5]
    half = len(plain) // 2
    parts = []
    for around in (plain[:half], plain[half:]):  # fitted on, calibrated on
        x = [(words, len(NOTICES)) for words in around]
        for words in map(words_of, LIKE_NOTICES):
            x += [(_changed(rng, words, around), len(NOTICES)) for _ in range(examples // 3)]
        known = [g[0] for g in grams if len(g) == 1]
        for words in around[: 20 * examples]:
            mixed = list(words)
            for _ in range(int(rng.integers(1, 5))):
                mixed.insert(int(rng.integers(len(mixed) + 1)), known[int(rng.integers(len(known)))])
            x.append((mixed, len(NOTICES)))
        for label, notices in enumerate(NOTICES.values()):
            for notice in notices:
                words = words_of(notice)
                x += [(words, label)] + [(_changed(rng, words, around), label) for _ in range(examples)]
        parts.append((_dense(model, [w for w, _ in x]), np.array([y for _, y in x])))
    (x, y), (held, truth) = parts
    weight = (1 / np.bincount(y, minlength=len(families)).clip(1))[y]
    weight[y == len(NOTICES)] *= len(NOTICES) / 2
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    aim = np.eye(len(families), dtype=np.float32)[y]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.shift)]
    for step in range(1, epochs + 1):
        error = (model.probabilities(x @ model.weights + model.shift) - aim) * weight
        for p, g, (m, v) in zip((model.weights, model.shift), (x.T @ error + 1e-5 * model.weights, error.sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits = held @ model.weights + model.shift
    rows = np.arange(len(truth))

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(model.probabilities(logits)[rows, truth] + 1e-12).mean())

    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    p = model.probabilities(logits)
    best = p[:, :-1].max(axis=1)[truth == len(NOTICES)]
    # the least threshold that at most one in a thousand held-out paragraphs of none passes
    model.threshold = float(np.clip(np.quantile(best, 0.999) if len(best) else 0.5, 0.3, 0.95))
    return model


@cache
def _pairs_of(family: str) -> tuple[frozenset[tuple[str, str]], ...]:
    return tuple(frozenset(zip(w, w[1:])) for w in map(words_of, NOTICES.get(family, ())))


def _likest(words: list[str], family: str) -> tuple[float, list[int], list[tuple[str, str]]]:
    """Similarity to the best notice of a family, the places of its pairs, and all pairs."""
    best: tuple[float, list[int]] = (0.0, [])
    have = list(zip(words, words[1:]))
    for pairs in _pairs_of(family):
        hits = [i for i, p in enumerate(have) if p in pairs]
        if not hits:
            continue
        share = len({have[i] for i in hits}) / len(pairs)
        if len(have) >= 8:
            share = max(share, len(hits) / len(have))
        if not best[1] or (share, hits[0], hits[-1]) > (best[0], best[1][0], best[1][-1]):
            best = (share, hits)
    return *best, have


def similarity(words: list[str], family: str) -> tuple[float, int, int]:
    """How much of the best notice of a family is in the words (or, of a long notice, how
    much of the words is in it), by pairs of words; and the place of the first and last."""
    share, hits, _ = _likest(words, family)
    return (share, hits[0], hits[-1] + 1) if hits else (0.0, 0, 0)


def _dense_part(words: list[str], family: str) -> tuple[float, int, int, int]:
    """Similarity, the first and last word of the part in which the notice's pairs are dense,
    and how many different ones are in that part."""
    share, hits, have = _likest(words, family)
    best, total, start, last, seen = (0.0, 0, 0, 0), 0.0, 0, 0, set()
    for i in hits:
        total -= 0.5 * (i - last - 1)
        if total <= 0 or not seen:
            total, start, seen = 0.0, i, set()
        if have[i] not in seen:
            seen.add(have[i])
            total += 1
            best = max(best, (total, -start, i + 1, len(seen)))
        last = i
    return share, -best[1], best[2], best[3]


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (first word, end) in order, and which of them are inside a line, of lines with
    so many words each. A notice may begin anywhere in a line and go on in the next ones."""
    end = np.cumsum(counts)
    first = end - counts
    each = np.maximum(1, -(-(counts - HALF) // HALF))
    start = np.repeat(first, each) + HALF * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    inside = np.stack([start, np.minimum(start + 2 * HALF, np.repeat(end, each))], 1)
    here, codes, size = np.arange(len(counts) - 1), [], 2 * HALF + 1
    for start in (first[:-1], np.maximum(first[:-1], end[:-1] - HALF)):
        for lines in (*LINES, None):
            stop = end[-1] if lines is None else end[np.minimum(here + lines - 1, len(end) - 1)]
            stop = np.minimum(stop, start + 2 * HALF)
            codes.append((start * size + stop - start)[stop > end[:-1]])
    codes = np.unique(np.concatenate(codes))
    across = np.stack([codes // size, codes // size + codes % size], 1)
    both = np.concatenate([inside, across])
    order = np.argsort(both[:, 0], kind="stable")
    return both[order], order < len(inside)


def _overlap(a: dict, b: dict) -> bool:
    """Whether two findings share over half of the shorter one."""
    shared = min(a["end"], b["end"]) - max(a["start"], b["start"])
    return 2 * shared > min(a["end"] - a["start"], b["end"] - b["start"])


def _joined(lines: list[dict], across: list[dict]) -> list[dict]:
    """Findings inside lines, but for places where one across line ends holds more of a notice."""
    def rank(x: dict) -> tuple:
        return x["confirmed"], x["pairs"]

    chosen: list[dict] = []
    for x in sorted(across, key=lambda x: (*rank(x), x["similarity"], x["probability"]), reverse=True):
        other = next((c for c in chosen if x["start"] < c["end"] and c["start"] < x["end"]), None)
        if other is None:
            if not any(rank(y) >= rank(x) and _overlap(x, y) for y in lines):
                chosen.append(x)
        elif x["family"] == other["family"] and x["confirmed"] and other["confirmed"]:
            # the next window of a long notice
            if not any(c is not other and x["start"] < c["end"] and c["start"] < x["end"] for c in chosen):
                if x["start"] < other["start"]:
                    other["start"], other["paragraph"] = x["start"], x["paragraph"]
                other["end"] = max(other["end"], x["end"])
                other["probability"] = max(other["probability"], x["probability"])
                other["similarity"] = max(other["similarity"], x["similarity"])
    stay = [y for y in lines if not any(_overlap(x, y) and rank(x) > rank(y) for x in chosen)]
    return sorted(stay + chosen, key=lambda x: (x["start"], x["end"]))


def scan(model: Model, text: str) -> list[dict]:
    """Findings of one text: paragraph (the line it begins in), start and end in characters,
    family, probability, similarity, confirmed."""
    lower = text.replace("İ", "I").lower()  # the only character that gets longer
    held = [_WORD.findall(line) for line in lower.split("\n")]
    numbers = [i for i, words in enumerate(held) if words]
    if not numbers:
        return []
    counts = np.array([len(held[i]) for i in numbers])
    words = [w for line in held for w in line]
    windows, inside = _windows(counts)
    some, logits = model.logits(words, windows)
    p = model.probabilities(logits)
    best = p.argmax(axis=1)
    sure = (best < len(model.families) - 1) & (p[np.arange(len(p)), best] >= model.threshold)
    if not sure.any():
        return []
    line_of = np.repeat(numbers, counts)
    places = [m.span() for m in _WORD.finditer(lower)]
    lines: list[dict] = []
    across: list[dict] = []
    for i in np.flatnonzero(sure):
        (first, end), family = windows[some[i]].tolist(), model.families[best[i]]
        part = words[first:end]
        if inside[some[i]]:
            near, a, b = similarity(part, family)
            _, hits, have = _likest(part, family)
            pairs = len({have[h] for h in hits})
        else:
            near, a, b, pairs = _dense_part(part, family)
        found = {
            "paragraph": int(line_of[first + a]), "start": places[first + a][0], "end": places[min(first + b, end - 1)][1],
            "family": family, "probability": float(p[i, best[i]]), "similarity": float(near),
            "confirmed": near >= CONFIRMED, "pairs": pairs,
        }
        last = lines[-1] if lines else None
        if not inside[some[i]]:
            if line_of[first + a] != line_of[min(first + b, end - 1)]:
                across.append(found)
        elif last and last["family"] == family and last["paragraph"] == found["paragraph"] and found["start"] <= last["end"]:
            last["end"] = max(last["end"], found["end"])
            for name in ("probability", "similarity", "confirmed", "pairs"):
                last[name] = max(last[name], found[name])
        else:
            lines.append(found)
    out = _joined(lines, across)
    for found in out:
        del found["pairs"]
    return out


def paragraphs(text: str) -> list[str]:
    """The lines of a text, and where there are several, all its words in windows across them."""
    words = words_of(text)
    return text.split("\n") + [" ".join(words[i : i + 2 * HALF]) for i in range(0, len(words), 2 * HALF) if "\n" in text.strip()]


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> Model:
    """A model whose class of none comes from the paragraphs of at most ``sample`` documents,
    chosen by a hash of key and text, as far as their whole texts have ``most`` bytes in all."""
    rows = docs.select(named(key).alias("k"), named(text).alias("t")).filter("length(t) > 0")
    found = whole_within(bounded_sample(rows, sample, "k", "t"), most, F.octet_length("t"), "k", "t")
    return fitted(found.select("t"), lambda some: fit([p for (t,) in some for p in paragraphs(t)]))


FINDING = T.StructType([
    T.StructField("paragraph", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()),
    T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType()),
])


def licences(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``findings``: the licence notices of each whole text, in order.

    One row per input row, in one pass without a shuffle. Null counts as empty and has no
    findings. Only key and text are read. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("findings", T.ArrayType(FINDING))])
    kind = pa.list_(pa.struct([
        ("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()),
        ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [scan(m, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=[key, "findings"])

    return docs.select(named(key), named(text)).mapInArrow(run, schema)
