"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

A sparse logistic regression over word n-grams (one to three words) tells licence families apart. It is trained on the templates below,
cut, mixed with other words and damaged at random, and on texts of kind "unknown" (licence wording of no family) and "none".
A temperature, set on examples kept aside, calibrates the probabilities; a family that is not probable enough counts as unknown.
What the classifier predicts is confirmed by comparison: the share of a template's word triples that the passage holds.

A passage without any triple of a template or of the unknown wordings is not looked at, so most texts cost a hash lookup a word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querncore.llm.hashing import Texts, mix, slices

# Short notices of public licences, and their key sentences.
TEMPLATES = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
UNKNOWN_TEXTS = ["All rights reserved.", "This document is licensed under the terms agreed with the publisher.", "Licensed under the terms of the vendor agreement.", "Released under the house license of the author.", "Permission is granted to members only.", "You may not use this file without written consent.", "This work is licensed under a proprietary license, version 7.", "No part of this text may be copied or distributed in any form."]
NONE_TEXTS = ["The city granted the permit to use the hall without conditions.", "This work is under way and the public can see it.", "Version 3 of the plan was released under pressure from the public.", "The general met the public in the hall.", "A copy of the letter was included in the book.", "He has a driving license and works for a creative house.", "The source of the river is subject to change.", "They may use the names of the following places."]
UNKNOWN, NONE = "unknown", "none"
FAMILIES = [*TEMPLATES, UNKNOWN, NONE]
#: A family counts from this probability on; from this share of a template's triples on it is confirmed.
SURE, HELD = 0.6, 0.6
#: Words between hits that still belong together, and words looked at around them.
GAP, AROUND = 12, 4
#: Punctuation parts words.
_plain = np.arange(256, dtype=np.uint8)
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _plain[_c] = 0x20


def grams(w: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of one, two and three words, by their first word."""
    one = mix(w)
    two = mix(w[:-1] * np.uint64(3) + w[1:] * np.uint64(0x9E3779B97F4A7C15)) if len(w) > 1 else one[:0]
    three = mix(w[:-2] * np.uint64(5) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)) if len(w) > 2 else one[:0]
    return [one, two, three]


def plain(t: Texts) -> Texts:
    return Texts(_plain[t.raw], t.offsets, fold=True)


def words_of(text: str) -> np.ndarray:
    _, t = next(slices(pa.array([text]), fold=True))
    return plain(t).words()


@dataclass
class Licences:
    """vocabulary: known n-grams, ascending; weights over it for each of FAMILIES; triples: (triple, family, template), ascending."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    triples: np.ndarray
    of_template: list[list[int]]
    template_size: np.ndarray
    template_family: np.ndarray

    def features(self, w: np.ndarray) -> np.ndarray:
        g = np.unique(np.concatenate(grams(w)))
        at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == g]

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        f = self.features(w)
        z = (self.weights[f].sum(axis=0) / max(1.0, len(f) ** 0.5) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def shares(self, w: np.ndarray, family: str) -> float:
        three = np.unique(grams(w)[2])
        at = np.minimum(np.searchsorted(self.triples, three), len(self.triples) - 1)
        count = np.zeros(len(self.template_size))
        for k in at[self.triples[at] == three]:
            count[self.of_template[k]] += 1
        own = np.array([FAMILIES[f] == family for f in self.template_family])
        return float((count / self.template_size)[own].max(initial=0.0))


def _examples(rng: np.random.Generator, each: int) -> tuple[list[np.ndarray], np.ndarray]:
    xs, ys = [], []
    pool = words_of(" ".join(NONE_TEXTS))
    for k, family in enumerate(FAMILIES):
        texts = TEMPLATES.get(family) or (UNKNOWN_TEXTS if family == UNKNOWN else NONE_TEXTS)
        for n in range(each):
            w = words_of(texts[n % len(texts)])
            if len(w) > 12 and rng.random() < 0.6:
                size = int(rng.integers(8, len(w) + 1))
                lo = int(rng.integers(0, len(w) - size + 1))
                w = w[lo : lo + size]
            if family == NONE and rng.random() < 0.7:
                w = rng.choice(np.r_[pool, rng.integers(1, 1 << 63, 60, dtype=np.uint64)], int(rng.integers(3, 30)))
            w = w.copy()
            damaged = rng.random(len(w)) < (0.06 if rng.random() < 0.4 else 0.0)
            w[damaged] = rng.integers(1, 1 << 63, int(damaged.sum()), dtype=np.uint64)
            noise = lambda: rng.integers(1, 1 << 63, int(rng.integers(0, AROUND + 2)), dtype=np.uint64)
            xs.append(np.r_[noise(), w, noise()])
            ys.append(k)
    return xs, np.array(ys)


@lru_cache(1)
def trained(seed: int = 5, each: int = 120, steps: int = 300) -> Licences:
    """Trains on examples from the templates; the same seed gives the same classifier."""
    texts = [(k, t) for k, f in enumerate(FAMILIES) for t in (TEMPLATES.get(f) or (UNKNOWN_TEXTS if f == UNKNOWN else NONE_TEXTS))]
    vocabulary = np.unique(np.concatenate([np.concatenate(grams(words_of(t))) for _, t in texts]))
    of: dict[int, list[int]] = {}
    sizes, families = [], []
    for k, t in texts:
        if FAMILIES[k] != NONE:
            three = np.unique(grams(words_of(t))[2])
            for g in three.tolist():
                of.setdefault(g, []).append(len(sizes))
            sizes.append(len(three))
            families.append(k)
    triples = np.array(sorted(of), np.uint64)
    n, m = len(vocabulary), len(FAMILIES)
    model = Licences(vocabulary, np.zeros((n, m)), np.zeros(m), 1.0, triples, [of[g] for g in triples.tolist()], np.array(sizes, float), np.array(families))
    rng = np.random.default_rng(seed)

    def dense(xs):
        x = np.zeros((len(xs), n))
        for i, w in enumerate(xs):
            f = model.features(w)
            x[i, f] = 1 / max(1.0, len(f) ** 0.5)
        return x

    xs, y = _examples(rng, each)
    x, target = dense(xs), np.eye(m)[y]
    w, b = np.zeros((n, m)), np.zeros(m)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) / len(y)
        w -= 8.0 * (x.T @ d + 2e-5 * w)
        b -= 8.0 * d.sum(axis=0)
    model.weights, model.bias = w, b
    xs, y = _examples(rng, each // 3)
    z = dense(xs) @ w + b
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 41))

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return -(s - np.log(np.exp(s).sum(axis=1, keepdims=True)))[np.arange(len(y)), y].mean()

    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def cuts(model: Licences, at: np.ndarray, keys: np.ndarray) -> list[int]:
    """Numbers of the hits at which another family's notice begins. at: places of a passage's hits, keys: their triples' numbers.

    A notice is a stretch about as long as a template that holds HELD of its triples; of those that overlap the one with the most triples counts."""
    spots: dict[int, list[int]] = {}
    for i, k in enumerate(keys.tolist()):
        for j in model.of_template[k]:
            if FAMILIES[model.template_family[j]] != UNKNOWN:
                spots.setdefault(j, []).append(i)
    found = []
    for j, own in spots.items():
        size = model.template_size[j]
        for x, i in enumerate(own):
            held, last = set(), i
            for e in own[x:]:
                if at[e] - at[i] >= size + AROUND:
                    break
                if keys[e] not in held:
                    held.add(int(keys[e]))
                    last = e
            if len(held) >= HELD * size:
                found.append((-len(held), int(at[last] - at[i]), i, last, int(model.template_family[j])))
    taken: list[tuple[int, int, int]] = []
    for _, _, i, last, family in sorted(found):
        if all(last < a or i > b for a, b, _ in taken):
            taken.append((i, last, family))
    taken.sort()
    return [y[0] for x, y in zip(taken, taken[1:]) if x[2] != y[2]]


def passages(model: Licences, t: Texts):
    """(text, paragraph, words) around the places of a text that hold triples of templates."""
    p = plain(t)
    w = p.words()
    if len(w) < 3:
        return
    three = grams(w)[2]
    at = np.minimum(np.searchsorted(model.triples, three), len(model.triples) - 1)
    doc = np.repeat(np.arange(len(p.offsets) - 1), np.diff(p.bounds))
    base = np.cumsum(t.raw == 10)
    line = base[p.starts]
    # words run over line feeds; lines without a word part them
    part = np.cumsum(np.r_[0, np.diff(line) > 1])
    hits = np.flatnonzero((model.triples[at] == three) & (doc[2:] == doc[:-2]) & (part[2:] == part[:-2]))
    if not len(hits):
        return
    new = np.r_[True, (np.diff(hits) > GAP) | (part[hits[1:]] != part[hits[:-1]]) | (doc[hits[1:]] != doc[hits[:-1]])]
    bounds = np.r_[np.flatnonzero(new), len(hits)]
    pieces = []  # first and last hit, and the words to stay between
    for i, j in zip(bounds[:-1], bounds[1:]):
        own = [i, *(i + c for c in cuts(model, hits[i:j], at[hits[i:j]])), j]
        edges = [0, *(int(hits[c]) for c in own[1:-1]), len(w)]
        pieces += [(hits[x], hits[y - 1], low, high) for x, y, low, high in zip(own, own[1:], edges, edges[1:])]
    for a, b, low, high in pieces:
        lo, hi = a, min(b + 3, high)
        while lo > a - AROUND and lo > low and doc[lo - 1] == doc[a] and part[lo - 1] == part[a]:
            lo -= 1
        while hi < b + 3 + AROUND and hi < high and doc[hi] == doc[a] and part[hi] == part[a]:
            hi += 1
        start = t.offsets[doc[a]]
        yield int(doc[a]), int(line[a] - (base[start - 1] if start else 0)), w[lo:hi]


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, and found, an array with an entry for each licence passage in the order of the text: paragraph int (line of
    the text where it begins, from 0), family string ("unknown" where no family is probable enough or the template comparison does not confirm it), probability
    double (of the family predicted), held double (share of a template's triples of that family).

    Null and empty texts have no passages; texts of any length are searched whole; repeated rows each get their row; an empty table gives none; other columns are not read. Passages run over
    line feeds, but not over lines without words; licences of different families side by side are passages of their own. One narrow pass.
    """
    entry = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("held", pa.float64())])

    def run(batches):
        model = trained()
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for first, t in slices(b.column(1), fold=True):
                for doc, line, w in passages(model, t):
                    p = model.probabilities(w)
                    best = int(p.argmax())
                    family = FAMILIES[best]
                    if family == NONE:
                        continue
                    held = model.shares(w, family)
                    if family != UNKNOWN and (p[best] < SURE or held < HELD):
                        family = UNKNOWN
                    found[first + doc].append({"paragraph": line, "family": family, "probability": float(p[best]), "held": held})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(entry))], names=["doc_id", "found"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, found array<struct<paragraph: int, family: string, probability: double, held: double>>")
