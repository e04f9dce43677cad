from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, shard int, h long, s string, rep long, k1 long, copies int, row long, size long, `A B` string"


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text, source) tuples, with columns whose names the operators use themselves."""

    def make(rows, clashing=True):
        full = [(i, t, "en", s, len(t) if t is not None else None) + ((None,) * 10 if clashing else ()) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA + (f", {CLASHING}" if clashing else ""))

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, blank, short, long, repeated and similar texts, ties and repeated rows."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(70)
    near = base.split(" ")
    near[60] = "CHANGED"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "One", "b"), (6, "a b c d e", "b"), (7, "a b c d e a b c d e f", "b"),
        (10, base, "a"), (11, base, "a"), (12, " ".join(near), "a"), (13, base.upper(), None), (14, prose(40) + "\n" + passage, "c"),
        (15, passage + "\n" + prose(90), "c"), (16, prose(30) + " " + passage + " " + prose(30), "c"), (20, "é" * 700, "d"), (21, "ab" * 900, "d"),
        (22, prose(6000), "d"), (23, "x x x x x x x x", "d"), (24, "x x x x x x", "d"), (25, "日本語 テキスト ! # $", "e"), (30, prose(60), None), (30, prose(60), None),
        (31, base, "a"), (31, base, "a"), (None, base, "a"), (None, None, None), (None, prose(80), "f"),
    ]
    return rows
