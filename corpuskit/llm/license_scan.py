"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are lower-cased runs of ASCII letters and digits or other characters above ASCII; shingles are five
words. Templates of K shingles belong to the class of the next power of 1.5 above K, ``span``. Texts are
read in windows of ``2 * span`` shingles at a step of ``span``, so wherever a template stands, one
window holds it whole. A copy with 80 % of a template's shingles then has a Jaccard similarity with its
window of at least ``0.8 K / (2 span + 0.2 K)``; a class uses as many bands (of one MinHash sample each) as
bring the probability that none collides below ``MISS``. Candidates are verified on the whole text:
the share of the template's distinct shingles that the document holds is at least ``PERCENT``.

Templates go to the tasks with the code; their words are counted first and must not exceed
``MAX_TEMPLATE_WORDS``. The rest is row-local: no shuffle, and nothing grows with the documents.

Defined results: null, empty and short texts match nothing; repeated rows are scanned one by one; extra
columns play no part; an empty table gives an empty result; a template of fewer than five words is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpuskit.llm.textvec import Words, pieces, seeds, shingle_places, shingles
from corpuskit.session import ship_package

SHINGLE = 5
PERCENT = 80
MISS = 1e-6
MAX_TEMPLATE_WORDS = 200_000

IS_GAP = np.ones(256, bool)
IS_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

# Declarations and notices as the licenses' publishers word them.
TEMPLATES = {
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "MIT/statement": "Released under the MIT License",
    "MIT/notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3",
    "GPL/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "LGPL/notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"),
    "BSD/notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."),
    "ISC/notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0/statement": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0/statement": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain",
}


def _grams(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    (piece,) = pieces(pa.array(texts), max_bytes=1 << 62)
    words = Words(piece, lower=True, is_gap=IS_GAP)
    places, docs = shingle_places(words.of, SHINGLE)
    return words, shingles(words.hashes, SHINGLE)[places] if len(places) else np.zeros(0, np.uint64), docs


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one sample each, so that sets of this similarity share none with probability ``miss``."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


class TemplateClass:
    """Templates of about one size: window span, bands, and the MinHash samples of each template."""

    def __init__(self, span: int, members: list[int], sets: list[np.ndarray]):
        self.span, self.members = span, members
        least = min(len(sets[m]) for m in members)
        self.bands = 1 if span == 1 else bands_for(0.01 * PERCENT * least / (2 * span + (1 - 0.01 * PERCENT) * least))
        times, plus = seeds(self.bands, 11)
        self.samples = np.array([[(_low(sets[m]) * times[i] + plus[i]).min() for i in range(self.bands)] for m in members])

    def windows(self, low: np.ndarray):
        """(window, member) of each window that shares a band with a template."""
        times, plus = seeds(self.bands, 11)
        n = len(low)
        begins = np.arange(0, n, self.span)
        for i in range(self.bands):
            hashed = low * times[i] + plus[i]
            block = hashed if self.span == 1 else np.minimum.reduceat(hashed, begins)
            least = block if self.span == 1 else np.minimum(block, np.append(block[1:], block[-1]))
            for j, member in enumerate(self.members):
                hit = np.flatnonzero(least == self.samples[j, i])
                if len(hit):
                    yield hit, member


def _low(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(32)).astype(np.uint32)


class TemplateIndex:
    """Templates by name, their shingle sets and their classes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words, grams, of = _grams([templates[n] for n in self.names])
        if len(words) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold {len(words)} words; at most {MAX_TEMPLATE_WORDS} go to every task")
        self.sets = [np.unique(grams[of == i]) for i in range(len(self.names))]
        if short := [n for n, s in zip(self.names, self.sets, strict=True) if not len(s)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        by_span: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            span = math.ceil(1.5 ** math.ceil(math.log(len(s), 1.5) - 1e-9))
            by_span.setdefault(span, []).append(i)
        self.classes = [TemplateClass(span, members, self.sets) for span, members in sorted(by_span.items())]

    def candidates(self, grams: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Distinct (document, template) pairs, as ``document * len(names) + template``."""
        low, found = _low(grams), []
        for group in self.classes:
            for window, member in group.windows(low):
                # the documents that the window's shingles belong to
                first = docs[window * group.span]
                last = docs[np.minimum((window + 2) * group.span, len(docs)) - 1]
                for _ in range(int((last - first).max()) + 1):
                    found.append(np.minimum(first, last) * len(self.names) + member)
                    first = first + 1
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def verify(self, grams: np.ndarray, docs: np.ndarray, pairs: np.ndarray):
        """(document, template, matched, total) of the pairs that hold enough of the template."""
        for pair in pairs.tolist():
            doc, member = divmod(pair, len(self.names))
            lo, hi = np.searchsorted(docs, [doc, doc + 1])
            wanted = self.sets[member]
            matched = int(np.isin(wanted, grams[lo:hi]).sum())
            if 100 * matched >= PERCENT * len(wanted):
                yield doc, self.names[member], matched, len(wanted)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(id_col, license, template, matched, total) of each document and template found in it.

    Template names are ``license/form``; ``matched`` of its ``total`` distinct shingles stand in the text.
    """
    ship_package(docs.sparkSession)
    index = TemplateIndex(templates or TEMPLATES)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = StructType([StructField(id_col, source.schema["id"].dataType), StructField("template", StringType()),
                         StructField("matched", LongType()), StructField("total", LongType())])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                words = Words(p, lower=True, is_gap=IS_GAP)
                places, of = shingle_places(words.of, SHINGLE)
                if not len(places):
                    continue
                grams = shingles(words.hashes, SHINGLE)[places]
                rows = list(index.verify(grams, of, index.candidates(grams, of)))
                if rows:
                    doc, name, matched, total = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.array(doc) + p.first)), pa.array(name), pa.array(matched),
                         pa.array(total)], names=schema.fieldNames())

    found = source.mapInArrow(run, schema)
    return found.select(id_col, F.split("template", "/")[0].alias("license"), "template", "matched", "total")
