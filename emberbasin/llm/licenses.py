"""License scans by conditional compression.

A document is read as one row of words: line breaks, comment marks at the start of lines and words without a letter or digit are blanks,
so a notice may be wrapped over any number of lines. Each word stem of license notices makes a block of the words around it, twice
the longest template to either side; blocks that overlap are one, so a notice with a stem lies in one block whole.

A block is compressed alone and with each template as a raw zstandard dictionary, and templates are ranked by how much smaller it gets.
In that order they are aligned with the block's words: a place where at most ``MOST_WRONG`` of the template's words are missing or strange is
confirmed, its differences are listed, and its words are taken. A license name that differs (a version number, say) is a difference in
a word the template marks as its own, and is never forgiven. The ranking decides who takes words that several fit, and drops none: what
is left of the block between the notices is ranked and aligned again, until nothing is confirmed.

Null and empty texts have no blocks. A row names the lines and the place of the notice itself. Repeated rows are scanned
each. Equal texts are compressed once a task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as licenses and their users write them. The first word list of each is what sets the license apart.
TEMPLATES = {
    "MIT": (["mit"], "Released under the MIT License."),
    "MIT-text": (
        ["permission", "deal", "sublicense"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (["apache", "2.0"], "Licensed under the Apache License, Version 2.0."),
    "Apache-2.0-text": (
        ["apache", "2.0", "compliance"],
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "GPL-3.0": (["gnu", "general", "public", "3"], "This work is licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": (["cc", "by-nc", "4.0"], "Licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": (["cc", "by", "4.0"], "Licensed under CC BY 4.0."),
    "BSD": (
        ["redistribution", "binary", "forms"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "GPL-3.0-or-later-text": (
        ["gnu", "general", "3", "later"],
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0-or-later-text": (
        ["gnu", "general", "2", "later"],
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1-or-later-text": (
        ["gnu", "lesser", "2.1", "later"],
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0-text": (
        ["mozilla", "2.0"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at",
    ),
    "ISC-text": (
        ["purpose", "fee", "granted"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (["unencumbered", "domain"], "This is free and unencumbered software released into the public domain."),
    "CC-BY-SA-4.0": (["cc", "by-sa", "4.0"], "Licensed under CC BY-SA 4.0."),
    "SPDX-MIT": (["spdx-license-identifier", "mit"], "SPDX-License-Identifier: MIT"),
    "SPDX-Apache-2.0": (["spdx-license-identifier", "apache-2.0"], "SPDX-License-Identifier: Apache-2.0"),
    "SPDX-BSD-3-Clause": (["spdx-license-identifier", "bsd-3-clause"], "SPDX-License-Identifier: BSD-3-Clause"),
    "SPDX-GPL-3.0-or-later": (["spdx-license-identifier", "gpl-3.0-or-later"], "SPDX-License-Identifier: GPL-3.0-or-later"),
}
STEMS = r"(?i)licen[cs]|copyright|permission|redistribut|public\W+domain|all\W+rights\W+reserved|\bcc\W{1,3}by|\bgpl\b"
#: Comment words that stand at the start of lines.
COMMENTS = {"rem", "@rem", "dnl"}
MARKS = "\"'.,;:()[]!?*#/<>|%{}=~`-"
MOST_WRONG = 0.25
LEVEL = 3

FOUND = (
    "doc_id long, line int, last_line int, start long, length int, license string, reduction double, rank int, exact boolean, "
    "n_missing int, n_strange int, differences string"
)
LEADING = re.compile(r"[^\w\s\"'(\[]+")
TOKEN = re.compile(r"\S+")
WORD = re.compile(r"\w")
DIGIT = re.compile(r"\d")


class Words(NamedTuple):
    """The words of a text as they stand there, without marks at their ends in lower case, and where they start."""

    raw: list[str]
    bare: list[str]
    at: list[int]


def words_of(text: str) -> Words:
    out, line_start = Words([], [], []), True
    before = 0
    for m in TOKEN.finditer(text):
        line_start = line_start or "\n" in text[before : m.start()]
        before, at, raw = m.end(), m.start(), m.group()
        if line_start:
            mark = LEADING.match(raw)
            if mark:
                at, raw = at + mark.end(), raw[mark.end() :]
        if not WORD.search(raw):
            continue  # a mark alone; what follows may still be the first word of its line
        first, line_start = line_start, False
        if first and raw.lower() in COMMENTS:
            continue
        bare = raw.strip(MARKS).lower()
        if bare:
            out.raw.append(raw)
            out.bare.append(bare)
            out.at.append(at)
    return out


class Place(NamedTuple):
    """Where a template stands in a block: its first word, the one after its last, words missing and strange, and the differences."""

    name: str
    first: int
    last: int
    missing: int
    strange: int
    listed: list[str]


class Template:
    """A template's words as numbers, aligned with blocks."""

    def __init__(self, name: str, own: list[str], text: str):
        words = words_of(text)
        self.name, self.own, self.words = name, own, words.bare
        self.text = " ".join(words.raw).rstrip(".").lower()
        self.most = int(MOST_WRONG * len(self.words))
        self.kinds = set(self.words)

    def possible(self, kinds: set[str]) -> bool:
        """Whether a block of these words can hold the template; words that occur nowhere are missing for certain."""
        return bool(self.words) and all(w in kinds for w in self.own) and sum(w not in kinds for w in self.words) <= self.most

    def rows(self, block: list[str]) -> Iterator[np.ndarray]:
        """For each number of template words, the least words missing and strange of a place that ends before each word of the block."""
        number = {w: i for i, w in enumerate(self.kinds)}
        have = np.array([number.get(w, -1) for w in block], np.int32)
        step = np.arange(len(block) + 1, dtype=np.int32)
        row = np.zeros(len(block) + 1, np.int32)
        yield row
        for w in self.words:
            best = row + 1
            np.minimum(best[1:], np.where(have == number[w], row[:-1], best[1:]), out=best[1:])
            row = np.minimum.accumulate(best - step) + step
            yield row

    def place(self, block: list[str], end: int) -> Place | None:
        """The best place that ends before word ``end``; None where its own words aren't in it."""
        low = max(0, end - len(self.words) - self.most)
        part = block[low:end]
        table = list(self.rows(part))
        i, j, pairs = len(self.words), len(part), []
        while i and j:
            if self.words[i - 1] == part[j - 1] and table[i][j] == table[i - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif table[i][j] == table[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        if not pairs:
            return None
        pairs.reverse()
        first, last = pairs[0][1], pairs[-1][1] + 1
        if not all(w in part[first:last] for w in self.own):
            return None
        listed, (a, b) = [], (0, first)
        for i, j in [*pairs, (len(self.words), last)]:
            listed += [f"-{w}" for w in self.words[a:i]] + [f"+{w}" for w in part[b:j]]
            # Another number before the number of the name: that of another version.
            if j > b and i < len(self.words) and self.words[i] in self.own and DIGIT.search(self.words[i]) and DIGIT.search(part[j - 1]):
                return None
            a, b = i + 1, j + 1
        return Place(self.name, low + first, low + last, len(self.words) - len(pairs), last - first - len(pairs), listed)

    def places(self, block: list[str]) -> list[Place]:
        """Places of the template in the block that don't overlap, those with the fewest differences first."""
        for row in self.rows(block):
            pass
        ends = np.flatnonzero((row[1:] <= self.most) & (row[1:] <= row[:-1])) + 1
        found: list[Place] = []
        inside = np.zeros(len(block) + 1, bool)
        for end in ends[np.argsort(row[ends], kind="stable")].tolist():
            if inside[end]:
                continue
            one = self.place(block, end)
            if one and not inside[one.first + 1 : one.last + 1].any():
                inside[one.first + 1 : one.last + 1] = True
                found.append(one)
        return found


class Scanner:
    def __init__(self, templates: dict[str, tuple[list[str], str]]):
        import zstandard

        self.templates = {name: Template(name, own, text) for name, (own, text) in templates.items()}
        self.longest = max((len(t.words) for t in self.templates.values()), default=0)
        # A dictionary has to be eight bytes at least.
        self.with_template = {
            name: zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(text.encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False,
            )
            for name, (_, text) in templates.items()
        }
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.reductions = lru_cache(maxsize=20_000)(self.reduced)

    def reduced(self, block: str) -> dict[str, tuple[int, float]]:
        """Rank and the share by which each template shrinks the block, the largest first."""
        data = block.encode("utf-8", "surrogatepass")
        plain = len(self.alone.compress(data))
        ranked = sorted((-(plain - len(c.compress(data))) / plain, name) for name, c in self.with_template.items())
        return {name: (rank, -less) for rank, (less, name) in enumerate(ranked, 1)}

    def blocks(self, words: Words, stems: list[int]) -> Iterator[tuple[int, int]]:
        """First word and the one after the last of each block around the characters where stems start."""
        reach, low, high = 2 * self.longest, 0, 0
        for at in stems:
            word = bisect_right(words.at, at) - 1
            if high and word - reach > high:
                yield low, high
                high = 0
            low = low if high else max(0, word - reach)
            high = min(len(words.at), word + reach + 1)
        if high:
            yield low, high

    def scanned(self, words: Words, low: int, high: int) -> Iterator[tuple]:
        """Confirmed licenses of a block: (first word, the one after the last, license, reduction, rank, exact, missing, strange, differences)."""
        parts = [(low, high)]
        while parts:
            low, high = parts.pop()
            block = words.bare[low:high]
            kinds = set(block)
            possible = [t for t in self.templates.values() if t.possible(kinds)]
            if not possible:
                continue
            # The block is compressed with each template; in the order of their reductions templates take the words they are confirmed on.
            ranks = self.reductions(self.text_of(words, low, high))
            taken: list[Place] = []
            for t in sorted(possible, key=lambda t: ranks[t.name][0]):
                taken += [p for p in t.places(block) if not any(p.first < x.last and x.first < p.last for x in taken)]
            for p in taken:
                yield self.row(words, low, p)
            # The words between those taken may hold what was aligned with some of them.
            if taken:
                edges = [0, *(x for p in sorted(taken, key=lambda p: p.first) for x in (p.first, p.last)), high - low]
                parts += [(low + a, low + b) for a, b in zip(edges[::2], edges[1::2]) if b > a]

    def text_of(self, words: Words, first: int, last: int) -> str:
        return " ".join(words.raw[first:last])

    def row(self, words: Words, low: int, p: Place) -> tuple:
        """The reduction and rank are those in the notice's own text."""
        a, b = low + p.first, low + p.last
        text = self.text_of(words, a, b)
        rank, less = self.reductions(text)[p.name]
        exact = not p.listed and self.templates[p.name].text in text.lower()
        return a, b, p.name, less, rank, exact, p.missing, p.strange, " ".join(p.listed)


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[list[str], str]] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each notice confirmed in a document; see ``FOUND`` for the columns."""
    templates = TEMPLATES if templates is None else templates
    stems = re.compile(STEMS)
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = body.as_py()
                at = [m.start() for m in stems.finditer(whole)]
                words = words_of(whole) if at else Words([], [], [])
                for low, high in scanner.blocks(words, at):
                    for a, b, *rest in scanner.scanned(words, low, high):
                        start, end = words.at[a], words.at[b - 1] + len(words.raw[b - 1])
                        line = whole.count("\n", 0, start)
                        rows.append((doc, line, line + whole.count("\n", start, end), start, end - start, *rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    candidates = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return candidates.filter(F.col("text").rlike(STEMS)).mapInArrow(scan, FOUND)
