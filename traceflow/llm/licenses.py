"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts are read as shingles of five words. For every size class of templates a
text is cut into blocks of half the class, and three blocks in a row are a
window, so a template is inside some window wherever it stands. A window with
80 % of a template's shingles has a Jaccard similarity of at least
``0.8 * shingles / (window + shingles)`` with it; the number of one-row bands is
chosen so that such a window shares a band with probability ``HIT`` or more.
Retrieved templates are verified by the exact share of their shingles.
"""

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traceflow.llm.common import utf8
from traceflow.llm.contamination import NORMALISE
from traceflow.llm.passages import _mix, _range_hash

SHINGLE = 5
CONTAINMENT = 0.8
HIT = 0.9999
_SLAB = 4_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

# Notices as their licenses publish them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _shingles(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word starts, word ends and the hash of the five words from each word (fewer at the end)."""
    inside = data != 32
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    word = _range_hash(data.astype(np.uint64) + np.uint64(1), begin, end)
    at = np.arange(len(word))
    return begin, end, _range_hash(word, at, np.minimum(at + SHINGLE, len(word)))


def bands_for(similarity: float, hit: float = HIT) -> int:
    """One-row bands that let a pair of this Jaccard similarity meet with probability ``hit``."""
    return max(1, math.ceil(math.log(1 - hit) / math.log(1 - min(similarity, 0.999))))


class Library:
    """Templates by size class: their exact shingles and their band values."""

    def __init__(self, templates: Mapping[str, str], containment: float = CONTAINMENT):
        self.names = sorted(templates)
        self.containment = containment
        self.shingles: list[np.ndarray] = []
        by_block: dict[int, list[int]] = defaultdict(list)
        for k, name in enumerate(self.names):
            text = np.frombuffer(templates[name].encode().translate(NORMALISE), np.uint8)
            begin, _, hashes = _shingles(text)
            whole = hashes[: max(1, len(begin) - SHINGLE + 1)] if len(begin) else hashes
            self.shingles.append(np.unique(whole))
            if len(whole):
                by_block[1 << max(0, math.ceil(math.log2(len(whole))) - 1)].append(k)
        # block length -> (bands, per band: sorted (value, template))
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for block, members in by_block.items():
            low = min(
                containment * len(self.shingles[k]) / (3 * block + (1 - containment) * len(self.shingles[k]))
                for k in members
            )
            bands = []
            for band in range(bands_for(low)):
                values = np.array([self._permute(self.shingles[k], band).min() for k in members])
                order = np.argsort(values, kind="stable")
                bands.append((values[order], np.array(members)[order]))
            self.classes[block] = bands
        self.unit = max(self.classes, default=1)

    @staticmethod
    def _permute(hashes: np.ndarray, band: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * band + 1)) % (1 << 64) | 1)
        x = (hashes ^ (hashes >> np.uint64(31))) * odd
        return x ^ (x >> np.uint64(29))

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Per text its number of words and matches (template, first word, end word)."""
        data = np.frombuffer(b" ".join(texts).translate(NORMALISE), np.uint8)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        begin, _, hashes = _shingles(data)
        owner = np.searchsorted(starts, begin, side="right") - 1
        words = np.bincount(owner, minlength=len(texts))
        first_word = np.cumsum(words) - words
        # A shingle must not run into the next text; a text of fewer words has one shingle.
        own = np.bincount(owner, minlength=len(texts))
        room = (first_word + own)[owner] - np.arange(len(owner))
        hashes = hashes.copy()
        hashes[room < SHINGLE] = _NONE
        # Lay texts out at multiples of the largest block, so blocks belong to one text.
        units = -(-words // self.unit)
        base = (np.cumsum(units) - units) * self.unit
        laid = np.full(int(units.sum()) * self.unit, _NONE)
        laid[base[owner] + np.arange(len(owner)) - first_word[owner]] = hashes
        text_of_unit = np.repeat(np.arange(len(texts)), units)
        retrieved: dict[tuple[int, int], set[int]] = defaultdict(set)
        widest = max((len(b) for b in self.classes.values()), default=0)
        for band in range(widest):
            permuted = np.where(laid == _NONE, _NONE, self._permute(laid, band))
            length, blocks = 1, permuted
            for block in sorted(self.classes):
                while length < block:
                    blocks = np.minimum(blocks[::2], blocks[1::2])
                    length *= 2
                if band >= len(self.classes[block]):
                    continue
                self._retrieve(blocks, block, band, text_of_unit, retrieved)
        out: list[tuple[int, list[tuple[int, int, int]]]] = [(int(n), []) for n in words]
        for (text, template), places in retrieved.items():
            own_hashes = hashes[first_word[text] : first_word[text] + words[text]]
            out[text][1].extend(self._verify(own_hashes, template, places))
        for _, matches in out:
            matches.sort()
        return out

    def _retrieve(self, blocks, block, band, text_of_unit, retrieved) -> None:
        values, members = self.classes[block][band]
        text = np.repeat(text_of_unit, self.unit // block)
        window = blocks
        for shift in (1, 2):
            if len(blocks) > shift:
                same = text[shift:] == text[:-shift]
                later = np.where(same, blocks[shift:], _NONE)
                window = np.minimum(window, np.r_[later, np.full(shift, _NONE)])
        at = np.searchsorted(values, window)
        hit = np.flatnonzero((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == window))
        if not len(hit):
            return
        start_of = np.searchsorted(text, np.arange(len(text_of_unit) and text[-1] + 1))
        for h in hit.tolist():
            for m in range(at[h], len(values)):
                if values[m] != window[h]:
                    break
                owner = int(text[h])
                retrieved[owner, int(members[m])].add((h - int(start_of[owner])) * block)

    def _verify(self, hashes: np.ndarray, template: int, places: set[int]) -> list[tuple[int, int, int]]:
        """Spans around retrieved windows that hold enough of the template's shingles."""
        wanted = self.shingles[template]
        size = len(wanted)
        block = 1 << max(0, math.ceil(math.log2(size)) - 1) if size else 1
        found: list[tuple[int, int, int]] = []
        for place in sorted(places):
            if found and place < found[-1][2] - SHINGLE + 1 and place + size <= found[-1][2]:
                continue
            piece = hashes[place : place + 4 * block]
            at = np.flatnonzero(np.isin(piece, wanted))
            if len(at) and len(np.unique(piece[at])) >= self.containment * size:
                span = (template, place + int(at[0]), place + int(at[-1]) + SHINGLE)
                if found and span[1] < found[-1][2]:
                    found[-1] = (template, found[-1][1], max(span[2], found[-1][2]))
                else:
                    found.append(span)
        return found


_built: dict[int, Library] = {}


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, matches.

    ``matches`` are (license, first_word, end_word) for each place where at
    least 80 % of a template's five-word shingles stand close together; words
    are those of the contamination check, so case and punctuation do not count.
    Templates of fewer than five words are matched by their whole sequence only as part of
    a shingle and are not useful. A null or empty text has no words and no
    matches. Texts are scanned whole, row by row, without a shuffle; other
    columns are ignored. The templates are a fixed small table.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(dict(templates))
    number = shared._jbroadcast.id()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _built:
            _built.clear()
            _built[number] = Library(shared.value)
        library = _built[number]
        match = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            held, size, counts, matches = [], 0, [], []
            for i, scalar in enumerate(batch.column(1)):
                held.append(scalar.as_py() or b"")
                size += len(held[-1])
                if size >= _SLAB or i + 1 == batch.num_rows:
                    for n, found in library.scan(held):
                        counts.append(n)
                        matches.append(
                            [
                                {"license": library.names[t], "first_word": a, "end_word": b}
                                for t, a, b in found
                            ]
                        )
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(matches, match)],
                names=["doc_id", "n_words", "matches"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8("text").alias("text"))
    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, matches array<struct<license:string,first_word:bigint,end_word:bigint>>",
    )
