"""License notices by conditional compression.

A notice that repeats a template's wording costs few bytes once the template is known. Each candidate block
is compressed with every template as a zstandard raw dictionary; templates are ranked by how much smaller the
block gets than without one, and the best ones are confirmed or turned down by the exact words in which the
block differs from the template's closest passage.

Candidate blocks are sentences with a licensing word, and passages: stretches of any lines in which
``WIDTH``-word windows of the licenses' whole texts recur, whether or not they hold such a word. A block of at
least ``SHORT`` words is held against the whole texts too, so it may be all of a license or a part of it. Each
difference spoils at most ``WIDTH`` windows, so that of n words with at most a fifth of differences
0.2 n - (WIDTH - 1) windows stay: stretches with fewer, or shorter than ``SHORT - WIDTH`` words, are not judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from lorespan.llm import text as T

FIELDS = (
    ("first", pa.int64()),
    ("length", pa.int64()),
    ("license_id", pa.string()),
    ("reduction", pa.float64()),
    ("n_words", pa.int32()),
    ("n_differences", pa.int32()),
    ("differences", pa.list_(pa.string())),
    ("confirmed", pa.bool_()),
    ("ranking", pa.list_(pa.struct([("license_id", pa.string()), ("reduction", pa.float64())]))),
)
#: Words of which a candidate block holds at least one.
MARKERS = ("license", "licence", "copyright", "all rights reserved", "public domain", "spdx-")
#: Wordings of common licenses' notices.
TEMPLATES = {
    "MIT": "Released under the MIT License. Licensed under the MIT License. SPDX-License-Identifier: MIT. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. SPDX-License-Identifier: Apache-2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-3.0-or-later.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License. SPDX-License-Identifier: GPL-2.0-only.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3. SPDX-License-Identifier: LGPL-3.0-or-later.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. Licensed under the Mozilla Public License, version 2.0. SPDX-License-Identifier: MPL-2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. SPDX-License-Identifier: BSD-3-Clause.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved. Copyright. All rights reserved.",
}
#: Words of an anchor window, words from which whole texts count, and unknown words within a passage.
WIDTH, SHORT, GAP = 4, 16, 16
_WORD = re.compile(r"[^\s,;:()\"']+")
_DECORATION = re.compile(r"(?m)^[\s#*/;!%>|-]+|[\s*/|]+$")
_VERSION = re.compile(r"v(?:ersions?|er)?\.?\s*(\d+(?:\.\d+)*)", re.IGNORECASE)
_END = re.compile(rb"(?<=[.!?])[ \t]+|\n")
_OPEN, _NEXT = re.compile(rb"(?i)\b(version|v)$"), re.compile(rb"\s[\s#*/;!%>|-]*\d[\d.]*")
_RAW = {"write_checksum": 0, "write_content_size": 0, "write_dict_id": 0}


@cache
def _texts() -> dict[str, str]:
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


@dataclass(frozen=True)
class Scan:
    """``finalists`` best templates are compared word by word if they save ``least`` of a block's compressed size.

    A block is confirmed if it differs from a notice in at most ``tolerance`` of its words and in none with a
    digit, or from a passage of a whole text in at most ``tolerance`` and names no version that the text does not.
    """

    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    texts: dict[str, str] = field(default_factory=lambda: dict(_texts()))
    finalists: int = 3
    least: float = 0.25
    tolerance: float = 0.2
    level: int = 9


def words_of(text: str) -> list[str]:
    """Lower-cased words without the full stops at their ends; both spellings of license are one."""
    return [w for w in (x.rstrip(".!?").lower().replace("licenc", "licens") for x in _WORD.findall(text)) if any(map(str.isalnum, w))]


def undecorated(text: str) -> str:
    """One line, without the comment marks and bullets at the ends of lines."""
    return " ".join(_DECORATION.sub(" ", text).split())


def versions(text: str) -> set[str]:
    return {re.sub(r"(\.0)+$", "", v) for v in _VERSION.findall(text)}


def differences(block: list[str], template: list[str]) -> list[str]:
    """The fewest words to insert (+) or drop (-) to make the block a passage of the template, in order.

    An edit distance of insertions and deletions in which the template's words before and after the
    passage are free.
    """
    n, m = len(block), len(template)
    cost = np.zeros((n + 1, m + 1), np.int32)
    code = {w: i for i, w in enumerate(dict.fromkeys(template))}
    own = np.array([code[w] for w in template], np.int32)
    step = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = cost[i - 1] + 1  # drop block[i - 1]
        row[1:] = np.where(own == code.get(block[i - 1], -1), np.minimum(row[1:], cost[i - 1][:-1]), row[1:])
        cost[i] = np.minimum.accumulate(row - step) + step  # insert template words
    out, i, j = [], n, int(cost[n].argmin())
    while i:
        if j and block[i - 1] == template[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append("-" + block[i])
        else:
            j -= 1
            out.append("+" + template[j])
    return out[::-1]


class Scanner:
    def __init__(self, scan: Scan):
        self.scan = scan
        params = zstandard.ZstdCompressionParameters.from_level(scan.level, **_RAW)
        self._plain = zstandard.ZstdCompressor(compression_params=params)
        self._with, self._words = ({}, {}), ({}, {})
        for kind, templates in enumerate((scan.templates, scan.texts)):
            for name, text in sorted(templates.items()):
                known = zstandard.ZstdCompressionDict((undecorated(text) if kind else text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                if kind:
                    known.precompute_compress(compression_params=params)
                self._with[kind][name] = zstandard.ZstdCompressor(compression_params=params, dict_data=known)
                self._words[kind][name] = words_of(undecorated(text) if kind else text)
        self._versions = {name: versions(text) for name, text in scan.texts.items()}
        #: window hashes of the whole texts in order, and which texts have each
        found = {name: np.unique(np.concatenate([_anchors(t) for t in (text, text.replace("icense", "icence"))])) for name, text in sorted(scan.texts.items())}
        self.anchors = np.unique(np.concatenate([*found.values(), np.zeros(0, np.uint64)]))
        self.owners = np.array([np.isin(self.anchors, x) for x in found.values()]).reshape(len(found), len(self.anchors))
        self.judge = lru_cache(maxsize=4096)(self._judge)

    def _judge(self, block: bytes) -> dict:
        """Ranking and verdict of one block; the same block is judged once while it stays in the cache."""
        text = undecorated(block.decode())
        words, raw = words_of(text), text.encode()
        size = len(self._plain.compress(raw))
        gains, tried = {}, []
        for kind in (0, 1) if len(words) >= SHORT else (0,):
            ranked = sorted(((1 - len(c.compress(raw)) / size, name) for name, c in self._with[kind].items()), key=lambda x: (-x[0], x[1]))
            for gain, name in ranked:
                gains[name] = max(gain, gains.get(name, gain))
            # a block so much longer than a template that it cannot be confirmed is not compared with it
            near = [(gain, name) for gain, name in ranked[: self.scan.finalists] if gain >= self.scan.least and len(words) - len(self._words[kind][name]) <= self.scan.tolerance * len(words)]
            for gain, name in near:
                off = differences(words, self._words[kind][name])
                same = versions(text) <= self._versions[name] if kind else not any(c.isdigit() for w in off for c in w)
                tried.append((not (same and len(off) <= self.scan.tolerance * len(words)), len(off), -gain, name, off))
        ranking = [{"license_id": name, "reduction": gain} for name, gain in sorted(gains.items(), key=lambda x: (-x[1], x[0]))]
        if not tried:
            return {"license_id": None, "reduction": ranking[0]["reduction"] if ranking else 0.0, "n_words": len(words), "n_differences": None, "differences": None, "confirmed": False, "ranking": ranking}
        bad, n, gain, name, off = min(tried)
        return {"license_id": name, "reduction": -gain, "n_words": len(words), "n_differences": n, "differences": off, "confirmed": not bad, "ranking": ranking}

    def hits(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray, np.ndarray]:
        """The words of a slice; the first words of windows that recur, and each one's place in ``anchors``."""
        words = T.Words(raw, offsets, T.ALNUM_LOWERED, lower=True)
        found = T.windows(words.hashes(), WIDTH)
        place = np.searchsorted(self.anchors, found).clip(max=max(0, len(self.anchors) - 1))
        at = np.flatnonzero((self.anchors[place] == found) & T.whole_window(words, WIDTH)) if len(self.anchors) else np.zeros(0, np.int64)
        return words, at, place[at]

    def passages(self, text: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(first, end) bytes of the passages of one text, whose words are at ``starts`` and ``ends``.

        A stretch of windows of any license is one block if it is confirmed as such. Each license's own stretches
        among the windows that this does not explain are tried too, as where one license follows another.
        Unconfirmed ones that save too little to resemble a license are left out.
        """
        out = []
        for a, b in self._stretches(at):
            whole = _widened(text, starts, ends, int(at[a]), int(at[b - 1]) + WIDTH)
            verdict = self.judge(text[slice(*whole)])
            left = np.ones(b - a, bool)
            if verdict["confirmed"]:
                out.append(whole)
                left = ~self.owners[sorted(self.scan.texts).index(verdict["license_id"])][place[a:b]] if verdict["license_id"] in self.scan.texts else ~left
            own = set()
            for has in self.owners:
                mine = at[a:b][left & has[place[a:b]]]
                own |= {_widened(text, starts, ends, int(mine[c]), int(mine[d - 1]) + WIDTH) for c, d in self._stretches(mine)}
            chosen: list[tuple[int, int]] = []
            for x in sorted(own - {whole}, key=lambda x: (x[0] - x[1], x)):
                if all(2 * (min(x[1], y[1]) - max(x[0], y[0])) <= x[1] - x[0] for y in chosen) and self.judge(text[slice(*x)])["confirmed"]:
                    chosen.append(x)
            out += chosen
            if not chosen and not verdict["confirmed"] and verdict["license_id"] is not None:
                out.append(whole)
        return out

    def _stretches(self, at: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of windows with no more than GAP unknown words between them, that are long and dense enough."""
        edges = np.flatnonzero(np.diff(at) > GAP + WIDTH) + 1
        out = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
            if a < b and (n := int(at[b - 1] - at[a]) + WIDTH) >= SHORT - WIDTH and b - a >= (1 - WIDTH * self.scan.tolerance) * n - WIDTH + 1:
                out.append((a, b))
        return out


def _anchors(text: str) -> np.ndarray:
    raw = np.frombuffer(undecorated(text).encode(), np.uint8)
    return T.windows(T.Words(raw, np.array([0, len(raw)]), T.ALNUM_LOWERED, lower=True).hashes(), WIDTH)


def _widened(text: bytes, starts: np.ndarray, ends: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """(first, end) bytes of words i to j, with up to WIDTH more on either side that their sentence or line has.

    A number that follows the word version belongs to it even on the next line.
    """
    first, end = int(starts[i]), int(ends[j - 1])
    for k in range(i - 1, max(-1, i - 1 - WIDTH), -1):
        if _END.search(text, int(ends[k]) - 1, first):
            break
        first = int(starts[k])
    for k in range(j, min(len(starts), j + WIDTH)):
        if _END.search(text, end - 1, int(starts[k])) and not _OPEN.search(text, max(first, end - 8), end):
            break
        end = int(ends[k])
    return first, end


def marked(raw: bytes) -> list[int]:
    """Where markers are, in order."""
    low, found = raw.lower(), set()
    for marker in MARKERS:
        at = low.find(marker.encode())
        while at >= 0:
            found.add(at)
            at = low.find(marker.encode(), at + 1)
    return sorted(found)


def candidate_blocks(raw: bytes) -> list[tuple[int, int]]:
    """(first, end) bytes of the sentences that hold a marker; a line's end ends a sentence, but not before a version's number."""
    out, end = [], -1
    for at in marked(raw):
        if at < end:
            continue
        first = raw.rfind(b"\n", 0, at) + 1
        stop = raw.find(b"\n", at)
        stop = len(raw) if stop < 0 else stop
        for cut in _END.finditer(raw, first, at):
            first = cut.end()
        following = _END.search(raw, at, stop)
        end = following.start() if following else stop
        if _OPEN.search(raw, first, end) and (number := _NEXT.match(raw, end)):
            end = number.end()
        out.append((first, end))
    return out


def _find(scan: Scan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(scan)
        names, kinds = zip(*FIELDS, strict=True)
        for part, raw, offsets in T.slices(batches, "t"):
            data, rows, of = raw.tobytes(), [], []
            words, at, place = scanner.hits(raw, offsets)
            known = np.searchsorted(at, words.first)
            holders = np.searchsorted(offsets, np.array(marked(data), np.int64), "right") - 1
            for d in np.union1d(holders, np.flatnonzero(np.diff(known))).tolist():
                text = data[offsets[d] : offsets[d + 1]]
                own, seen = slice(words.first[d], words.first[d + 1]), slice(known[d], known[d + 1])
                blocks = candidate_blocks(text)
                blocks += [x for x in scanner.passages(text, words.starts[own] - offsets[d], words.ends[own] - offsets[d], at[seen] - words.first[d], place[seen]) if not any(a <= x[0] and x[1] <= b for a, b in blocks)]
                for first, end in sorted(blocks):
                    rows.append({"first": first, "length": end - first} | scanner.judge(text[first:end]))
                    of.append(d)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], names=["k", *names])

    return run


def license_notices(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate block: where it is (first byte and length in UTF-8), and what it was matched with.

    license_id is the closest template (fewest differing words, then the larger reduction, then the name), null
    if none saves ``scan.least`` or the block is too long to be any's notice; confirmed says whether the wording agrees.
    A sentence with a marker keeps its row also where a passage of several sentences holds it. Null and empty texts,
    and texts without a marker or passage, have no rows; repeated rows give their blocks again; null ids stay null.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = StructType([StructField("k", rows.schema["k"].dataType), *(StructField(n, from_arrow_type(k)) for n, k in FIELDS)])
    out = T.mapped(rows, _find(scan), schema)
    return out.withColumnRenamed("k", id_col)
