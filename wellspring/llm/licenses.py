"""Licence notices found by conditional compression: the template that makes a block smallest, confirmed by its wording."""

from __future__ import annotations

import difflib
import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "(?i)licen[sc]e|copyright|permission|redistribut|warrant|all[\\W_]+rights[\\W_]+reserved|public[\\W_]+domain"
MARKED_WORD = re.compile("[a-z]*(?:licen[sc]e|copyright|permission|redistribut|warrant)|(?:rights|public)$")  # the words of a block that make its marks
CLOSING = re.compile(r"[.!?;:)\]\"']*")
LONG_WORD = 40  # of longer words only the beginning is compressed
JOIN_LINES = 6  # lines with a mark that are no further apart belong to one block
LEVEL = 9
RANKED = 3
LEAST_GAIN = 0.25
LEAST_WORDING = 0.9
SHORT_WORDS = 25  # a wording below this must be met exactly

# Wordings of public licence notices. {0} stands for words that differ from notice to notice.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "All-Rights-Reserved": ["All rights reserved."],
}

FOUND = "block int, start bigint, end bigint, license string, gain double, wording double, differences array<string>"


WORD = re.compile("[A-Za-z]+|[0-9]+")


def _words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@functools.cache
def _prepared() -> list[tuple[str, list[str], object, object, int]]:
    """(licence, words, compressor with the wording as raw dictionary, plain compressor, plain size) of every wording."""
    import zstandard

    plain = zstandard.ZstdCompressor(level=LEVEL)
    out = []
    for name, wordings in TEMPLATES.items():
        for text in wordings:
            data = " ".join(_words(text)).encode()
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, _words(text), zstandard.ZstdCompressor(level=LEVEL, dict_data=raw), plain, len(plain.compress(data))))
    return out


@functools.cache
def _reach() -> int:
    """Words on either side of a mark within which every wording with that mark lies, with a fifth for words put in."""
    return max(len(template) for _, template, *_ in _prepared()) * 6 // 5


def wording(template: list[str], block: list[str]) -> tuple[float, list[str], int, int]:
    """How much of the template's words the best place of the block has, the differences there ("-word", "+word") and its first and last word."""
    matcher = difflib.SequenceMatcher(None, template, block, autojunk=False)
    same = [m for m in matcher.get_matching_blocks() if m.size]
    if not same:
        return 0.0, ["-" + w for w in template], 0, len(block) - 1
    longest = max(same, key=lambda m: m.size)
    begin = max(0, longest.b - longest.a)
    window = block[begin:longest.b + longest.size + len(template) - longest.a - longest.size]
    matcher = difflib.SequenceMatcher(None, template, window, autojunk=False)
    lost, differences = 0, []
    steps = matcher.get_opcodes()
    for kind, a, b, c, d in steps:
        if kind != "equal":
            lost += b - a
            differences += ["-" + w for w in template[a:b]]
            if b < len(template):  # what follows the template is not a difference
                differences += ["+" + w for w in window[c:d]]
    equal = [s for s in steps if s[0] == "equal"]
    return 1 - lost / len(template), differences, begin + equal[0][3], begin + equal[-1][4] - 1


def _gain(words: list[str], squeeze, plain, size: int) -> float:
    data = " ".join(w[:LONG_WORD] for w in words).encode()
    return round((len(plain.compress(data)) - len(squeeze.compress(data))) / size, 6)


def _windows(words: list[str], marks: list[int]) -> Iterator[tuple[int, int]]:
    """Overlapping windows of four reaches that cover the reach of every marked word; each wording there lies within one of them."""
    reach, spans = _reach(), []
    for k in marks:
        low, high = max(0, k - reach), min(len(words), k + reach + 1)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        yield low, min(high, low + 4 * reach)
        for begin in range(low + 3 * reach, high - reach, 3 * reach):
            yield begin, min(high, begin + 4 * reach)


@functools.lru_cache(20_000)
def identify(block: str, begin: int = 0, end: int | None = None) -> tuple[tuple[str | None, float, float, tuple[str, ...], int, int], ...]:
    """(licence, gain, wording, differences, start, end) of each licence confirmed in a block, or one row without a licence.

    The block is ``block[begin:end]``; what stands around it completes a wording that reaches into it. start and end are those of the
    wording, with the signs that close it, or of the block in a row without a licence.

    Gain: bytes that the template saves when it is the dictionary, as a share of what it takes by itself, in a window of words around
    its place, so that it does not depend on the length of the block. A wording that stands in the block without any difference is
    confirmed. Of the long ones, the ``RANKED`` best-ranked of each window and those that gain enough are compared
    word by word; they never pass with a number that differs.
    """
    end = len(block) if end is None else end
    places = [m.span() for m in WORD.finditer(block)]
    words = [block[a:b].lower() for a, b in places]
    marks = [k for k, word in enumerate(words) if places[k][0] < end and places[k][1] > begin and MARKED_WORD.match(word)]
    text = f" {' '.join(words)} "
    best: dict[str, tuple[float, float, tuple[str, ...], int, int]] = {}

    def confirm(name: str, used: list, share: float, differences: list[str], first: int, last: int) -> bool:
        start, stop = places[first][0], places[last][1]
        if (start >= end or stop <= begin) and any(MARKED_WORD.match(w) for w in words[first:last + 1]):  # it is of another block
            return False
        if name not in best or share > best[name][1]:
            near = words[max(0, first - last + first - 1):2 * last - first + 2]
            best[name] = (_gain(near, *used), share, tuple(differences), start, CLOSING.match(block, stop).end())
        return True

    for name, template, *used in _prepared():
        sought = f" {' '.join(template)} "
        at = text.find(sought)
        while at >= 0:
            first = text.count(" ", 0, at)
            if confirm(name, used, 1.0, [], first, first + len(template) - 1):
                break
            at = text.find(sought, at + 1)
    top = (-math.inf, "", [], 0, 0)
    for low, high in _windows(words, marks or [0]):
        near = words[low:high]
        ranked = [(_gain(near, *used), name, template, used) for name, template, *used in _prepared()]
        ranked.sort(key=lambda r: (-r[0], r[1], len(r[2])))
        top = max(top, (*ranked[0][:3], low, high), key=lambda r: r[0])
        held, rank = Counter(near), 0
        for gain, name, template, used in ranked:
            if len(template) < SHORT_WORDS:
                continue
            rank += 1
            if gain < LEAST_GAIN and rank > RANKED:
                break
            if sum((held & Counter(template)).values()) < LEAST_WORDING * len(template):  # no place can have enough of its words
                continue
            share, differences, first, last = wording(template, near)
            if share >= LEAST_WORDING and not any(d[1:].isdigit() for d in differences):
                confirm(name, used, share, differences, low + first, low + last)
    if best:
        return tuple((name, *best[name]) for name in sorted(best))
    gain, _, template, low, high = top
    return ((None, gain, wording(template, words[low:high])[0], (), begin, end),)


def _around(text: str, start: int, end: int) -> tuple[str, int]:
    """The block with as many words on both sides as a wording can reach, however the lines are wrapped, and its offset in that text."""
    reach = _reach()
    before = [m.start() for m in WORD.finditer(text, max(0, start - reach * LONG_WORD), start)][-reach:]
    after = [m.end() for m in itertools.islice(WORD.finditer(text, end, min(len(text), end + reach * LONG_WORD)), reach)]
    low = before[0] if before else start
    high = CLOSING.match(text, after[-1]).end() if after else end
    return text[low:high], start - low


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of licence-like lines and licence confirmed in it (license null: none confirmed).

    A built-in pattern over whole texts picks the documents; in them, lines with a mark that are at most ``JOIN_LINES`` apart form
    a block. It is compared together with the words around it, as a notice may be wrapped into lines without a mark; a notice that touches
    two blocks is in the rows of both. start and end, of the wording or else of the block, are offsets in code points. Equal blocks are compared once per task. Null and empty
    texts have no blocks; repeated rows give repeated rows; further columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).where(F.col("_text").rlike(MARK))
    kind = rows.schema["_id"].dataType.simpleString()
    marked = re.compile(MARK)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                at, blocks, last = 0, [], None
                marks = [*(m.span() for m in marked.finditer(text)), (math.inf, math.inf)][::-1]  # the next one last
                for k, line in enumerate(text.split("\n")):
                    while marks[-1][1] <= at:
                        marks.pop()
                    if marks[-1][0] < at + len(line):
                        if last is not None and k - last <= JOIN_LINES:
                            blocks[-1][1] = at + len(line)
                        else:
                            blocks.append([at, at + len(line)])
                        last = k
                    at += len(line) + 1
                for number, (start, end) in enumerate(blocks):
                    block, begin = _around(text, start, end)
                    for name, gain, share, differences, first, stop in identify(block, begin, begin + end - start):
                        owner.append(row)
                        out.append((number, start - begin + first, start - begin + stop, name, gain, share, list(differences)))
            columns = list(zip(*out)) or [()] * 7
            types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())]
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                  names=["_id", "block", "start", "end", "license", "gain", "wording", "differences"])

    return rows.mapInArrow(scan, f"_id {kind}, {FOUND}").withColumnRenamed("_id", id_col)
