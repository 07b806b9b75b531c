"""Licence scan by a trained paragraph classifier.

A paragraph is a run of lines up to one without a word (blank, or signs only); a notice that goes
on after such a line is two. Features are the word pairs and triples that occur in the templates.
Units are stretches of a paragraph: windows of ``WINDOW`` words, half overlapping, so that a
notice is seen whole wherever it begins and however it is wrapped, parted where more than ``GAP``
words begin no feature. Every paragraph of every text is covered. A multinomial logistic
regression (Spark ML, on sparse rows) learns the families and an "unknown" class:

* known: every template, whole and in parts, alone and between words of the corpus;
* unknown: stretches of the corpus that hold features but too little of every template, templates
  with their words shuffled, pieces of them too small to confirm, and the unit without features.

The corpus units come from about ``sample_docs`` documents in hash order (equal ones count once),
cut into stretches by the tasks; ``sample_units`` of the different ones, in hash order, teach.
Both are documented parameters: they bound what training reads, not what is scanned.

A part of the training units is kept aside to calibrate the unknown class: a temperature is
fitted to the log-loss, and the least probability of being known is set so that no more than
``false_rate`` of the unknown units kept aside pass, but never so high that more than
``miss_rate`` of the known ones are lost.

In a unit the classifier names a family: the most probable one, if being known is probable
enough. The comparison with that family's templates confirms it: some span of words must hold
enough of one (share of its pairs and triples). Confirmed, the span is a notice and its features
are taken away; refused, the family and the features that only it has are put aside. Either way
the rest of the unit is classified again, until it is unknown or has no features, so that one
unit may hold several licences, cut ones beside whole ones too. A notice's line is that of its
first word.

Null and empty texts hold no licence. Repeated rows give repeated results. With no documents at
all the model still has the templates. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.common import hash_sample, stage, text_bytes

#: Notices by family, in the usual wording of their publishers.
TEMPLATES = {
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "artistic-2.0": ("This is free software, licensed under The Artistic License 2.0.",),
    "bsd": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0-1.0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "cddl-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License",),
    "epl-2.0": ("are made available under the terms of the Eclipse Public License v. 2.0", "Licensed under the Eclipse Public License 2.0."),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    ),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("This work is licensed under the GNU Lesser General Public License.",),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "zlib": (
        "Licensed under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
}
UNKNOWN = "unknown"
#: place of the first word, and the pair or triple
Hit = tuple[int, bytes]
WINDOW = 64
GAP = 6
#: share of a template's pairs and triples that confirms it
COVERAGE = 0.75
_PLAIN = bytes(b if chr(b).isalnum() or b in b"\n" or b > 127 else 32 for b in range(256))


def words_of(line: bytes) -> list[bytes]:
    return line.translate(_PLAIN).lower().split()


def paragraphs(text: bytes) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Words of every run of lines up to one without words; and per line the place after its last word, and its number."""
    words: list[bytes] = []
    ends: list[tuple[int, int]] = []
    for number, line in enumerate(text.translate(_PLAIN).lower().split(b"\n")):
        own = line.split()
        if own:
            words += own
            ends.append((len(words), number))
        elif words:
            yield words, ends
            words, ends = [], []
    if words:
        yield words, ends


def grams(words: list[bytes]) -> list[bytes]:
    """Word pairs and triples."""
    pairs = [b" ".join(p) for p in zip(words, words[1:], strict=False)]
    return pairs + [b" ".join(p) for p in zip(words, words[1:], words[2:], strict=False)]


@dataclass(frozen=True)
class Templates:
    """The features, and per template its family and own features."""

    names: list[str]
    vocabulary: dict[bytes, int]
    templates: list[tuple[int, frozenset[bytes]]]
    #: families that have a feature
    owners: dict[bytes, frozenset[int]]
    follow: dict[bytes, set[bytes]]

    @staticmethod
    def of(texts: dict[str, tuple[str, ...]]) -> Templates:
        names = sorted(texts)
        templates = [(k, frozenset(grams(words_of(t.encode())))) for k, name in enumerate(names) for t in texts[name]]
        owners: dict[bytes, set[int]] = {}
        follow: dict[bytes, set[bytes]] = {}
        for k, own in templates:
            for g in own:
                owners.setdefault(g, set()).add(k)
                if g.count(b" ") == 1:
                    follow.setdefault(g.split(b" ")[0], set()).add(g.split(b" ")[1])
        vocabulary = {g: i for i, g in enumerate(sorted(owners))}
        return Templates([*names, UNKNOWN], vocabulary, templates, {g: frozenset(f) for g, f in owners.items()}, follow)

    def units(self, words: list[bytes]) -> Iterator[tuple[int, list[Hit]]]:
        """Half of the paragraph that the unit starts in, and the features of the unit, in order.

        The stretches of a window are units; those that begin in its second half are left to the next window.
        """
        half = WINDOW // 2
        hits: dict[int, list[Hit]] = {}
        for k, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            if a in self.follow and b in self.follow[a]:
                block = hits.setdefault(k // half, [])
                both = (a + b" " + b, b" ".join(words[k : k + 3]))
                block += [(k, g) for g in dict.fromkeys(both) if g in self.vocabulary]
        for block in sorted(hits):
            unit: list[Hit] = []
            for hit in hits[block] + hits.get(block + 1, []):
                if unit and hit[0] - unit[-1][0] > GAP:
                    yield block, unit
                    unit = []
                if not unit and hit[0] // half > block:
                    break
                unit.append(hit)
            if unit:
                yield block, unit

    def confirm(self, family: int, hits: list[Hit]) -> list[Hit]:
        """The span that holds most of a template of the family; empty if none holds ``COVERAGE`` of one.

        Of a template's spans, those no longer than one and a half templates come before wider
        ones; of spans that hold as much, the shortest is taken.
        """
        best: tuple[bool, int, int] = (False, 0, 0)
        found: list[Hit] = []
        for _, template in (t for t in self.templates if t[0] == family):
            own = [h for h in hits if h[1] in template]
            if len({g for _, g in own}) < COVERAGE * len(template):
                continue
            for close in (True, False):
                reach = len(template) * 3 // 4 + 3 if close else WINDOW
                for at, (start, _) in enumerate(own):
                    inside: set[bytes] = set()
                    end = at
                    for k in range(at, len(own)):
                        if own[k][0] >= start + reach:
                            break
                        if own[k][1] not in inside:
                            inside.add(own[k][1])
                            end = k
                    rank = (close, len(inside), start - own[end][0])
                    if len(inside) >= COVERAGE * len(template) and (not found or rank > best):
                        best, found = rank, own[at : end + 1]
        return found

    def confirmed(self, hits: list[Hit]) -> bool:
        """Whether the features hold any template."""
        return any(self.confirm(family, hits) for family in range(len(self.names) - 1))


@dataclass
class LicenseModel:
    known: Templates
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def probabilities(self, features: Iterable[bytes], barred: Iterable[int] = ()) -> np.ndarray:
        """Of every class, the last being unknown; barred families have none."""
        columns = sorted({self.known.vocabulary[g] for g in features})
        z = (self.intercept + self.weights[:, columns].sum(axis=1)) / self.temperature
        z[list(barred)] = -np.inf
        e = np.exp(z - z.max())
        return e / e.sum()

    def name(self, features: Iterable[bytes], barred: Iterable[int] = ()) -> tuple[int | None, float]:
        """The most probable family and its probability; no family where the unit is unknown."""
        p = self.probabilities(features, barred)
        family = int(np.argmax(p[:-1]))
        return (family if 1.0 - p[-1] >= self.least else None), float(p[family])

    def notices(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """Place of the first word, family and probability of every confirmed notice.

        A window owns the notices that begin in its first half.
        """
        out: list[tuple[int, str, float]] = []
        claimed: set[Hit] = set()
        for block, unit in self.known.units(words):
            rest = [h for h in unit if h not in claimed]
            barred: set[int] = set()
            while shown := {g for _, g in rest if not self.known.owners[g] <= barred}:
                family, p = self.name(shown, barred)
                if family is None:
                    break
                span = self.known.confirm(family, rest)
                if not span:
                    barred.add(family)
                    continue
                taken = set(span)
                rest = [h for h in rest if h not in taken]
                if span[0][0] // (WINDOW // 2) == block:
                    claimed |= taken
                    out.append((span[0][0], self.known.names[family], p))
        return sorted(out)


def corpus_units(docs: DataFrame, known: Templates, id_col: str, text_col: str, sample_docs: int, sample_units: int) -> tuple[list[list[bytes]], list[bytes]]:
    """Features of stretches that hold features and no template, and words of the corpus, from a bounded sample.

    Both are made by the tasks and made distinct before a bounded number comes to the driver. A word
    of the sample has at most 40 bytes; longer ones are no filler.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    place = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 32))
    near = texts.filter(place <= int(min(1.0, sample_docs / max(1, texts.count())) * (1 << 32)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                rows = []
                for words, _ in paragraphs(text):
                    rows += [(True, b" ".join(w for w in words[at : at + 12] if len(w) <= 40)) for at in range(0, len(words), 12)]
                    for _, unit in known.units(words):
                        if not known.confirmed(unit):
                            rows.append((False, b"\n".join(sorted({g for _, g in unit}))))
                kinds, units = zip(*dict.fromkeys(rows), strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.bool_()), pa.array(units, pa.binary())], ["filler", "unit"])

    units = stage(near.select("t").mapInArrow(cut, "filler boolean, unit binary").distinct(), "units")
    taught = hash_sample(units.filter("NOT filler").select("unit"), sample_units, "unit").collect()
    filler = hash_sample(units.filter("filler").select("unit"), sample_units // 4, "unit").collect()
    return [bytes(r["unit"]).split(b"\n") for r in taught], [bytes(r["unit"]) for r in filler]


def training_units(known: Templates, taught: list[list[bytes]], filler: list[bytes], times: int = 24, seed: int = 7) -> list[tuple[int, list[bytes]]]:
    """Class and features of every training unit."""
    rng = np.random.default_rng(seed)
    unknown = len(known.names) - 1

    def around() -> list[bytes]:
        return filler[int(rng.integers(0, len(filler)))].split()[: int(rng.integers(0, 13))] if filler else []

    out = [(unknown, unit) for unit in taught] + [(unknown, [])]
    for family, name in enumerate(known.names[:-1]):
        for text in TEMPLATES[name]:
            words = words_of(text.encode())
            out.append((family, grams(words)))
            for k in range(times):
                n = int(rng.integers(-(-3 * len(words) // 4), len(words) + 1))
                at = int(rng.integers(0, len(words) - n + 1))
                out.append((family, grams(around() + words[at : at + n] + around())))
                if k % 2:
                    continue
                mixed = [words[j] for j in rng.permutation(len(words))]
                if mixed != words:
                    out.append((unknown, grams(around() + mixed + around())))
                n = int(rng.integers(2, max(3, len(words) // 3 + 1)))
                at = int(rng.integers(0, len(words) - n + 1))
                piece = words[at : at + n]
                if not any(known.confirmed(unit) for _, unit in known.units(piece)):
                    out.append((unknown, grams(around() + piece + around())))
    return [(k, [g for g in unit if g in known.vocabulary]) for k, unit in out]


def train(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 3000,
    sample_units: int = 2000,
    false_rate: float = 0.01,
    miss_rate: float = 0.001,
) -> LicenseModel:
    """Fit and calibrate on the templates and at most ``sample_units`` stretches of the corpus."""
    known = Templates.of(TEMPLATES)
    units = training_units(known, *corpus_units(docs, known, id_col, text_col, sample_docs, sample_units))
    aside = np.random.default_rng(11).random(len(units)) < 0.25
    size = len(known.vocabulary)
    data = []
    for (k, unit), a in zip(units, aside, strict=True):
        if not a:
            columns = sorted({known.vocabulary[g] for g in unit})
            data.append((float(k), Vectors.sparse(size, columns, [1.0] * len(columns))))
    frame = spark.createDataFrame(data, ["label", "features"]).repartition(4)
    fitted = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60, standardization=False).fit(frame)
    model = LicenseModel(known, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray())
    # calibration on the units kept aside
    held = [unit for unit, a in zip(units, aside, strict=True) if a]
    truth = np.array([k for k, _ in held])

    def scored(temperature: float) -> np.ndarray:
        model.temperature = temperature
        return np.array([model.probabilities(unit) for _, unit in held])

    def loss(temperature: float) -> float:
        return float(-np.log(np.maximum(scored(temperature)[np.arange(len(held)), truth], 1e-12)).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    sure = 1.0 - scored(model.temperature)[:, -1]
    strange = truth == len(known.names) - 1
    model.least = float(np.clip(np.quantile(sure[strange], 1 - false_rate), 0.05, np.quantile(sure[~strange], miss_rate)))
    return model


def find(text: bytes, model: LicenseModel) -> list[tuple[int, str, float]]:
    """(line of the first word, family, probability) of every confirmed notice of a text, once per line and family."""
    out: list[tuple[int, str, float]] = []
    for words, ends in paragraphs(text):
        seen: set[tuple[int, str]] = set()
        for place, name, p in model.notices(words):
            number = ends[bisect_right(ends, (place, math.inf))][1]
            if (number, name) not in seen:
                seen.add((number, name))
                out.append((number, name, p))
    return out


FOUND = "array<struct<line: int, license: string, probability: double>>"
FOUND_TYPE = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("probability", pa.float64())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training: float) -> DataFrame:
    """Per row: id and ``found``, the notices of the whole text with line number, family and probability."""
    model = train(docs.sparkSession, docs, id_col, text_col, **training)

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        keys = ("line", "license", "probability")
        return pa.array([[dict(zip(keys, f, strict=True)) for f in find(t, model)] for t in text_bytes(texts)], FOUND_TYPE)

    return docs.select(F.col(id_col), scan(F.col(text_col).cast("string")).alias("found"))
