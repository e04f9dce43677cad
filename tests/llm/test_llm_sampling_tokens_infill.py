"""Importance resampling, token counts and fill-in-middle against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from emberbasin.llm import infill, resampling, tokencounts
from emberbasin.llm.queries import QUERIES
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()


# -- importance resampling ---------------------------------------------------------------


def features(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(rows, target, percent=5):
    """(doc_id, n_features, weight, score, rank) of rows with ids, ranks by id among equal scores."""
    bucket = lambda f: zlib.crc32(f) % 10000
    found = [(i, *features(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, words, fs in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out)


def test_op11(spark, docs):
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()]
    rows = QUERIES["op11_importance_resampling"](spark, SF_DIR).collect()
    assert Counter(map(tuple, rows)) == plain_resampling(docs, target)
    assert sum(r["rank"] is not None for r in rows) > 0


def test_ngram_crcs_come_from_running_values():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abzAZ09é日\U0001f600") for _ in range(r.choice([1, 3, 8, 70, 700])))
    texts = ["", "..!", "One", "two, words", "x" * 9000 + " y"] + [r.choice([" ", "-", "\x7f\n"]).join(word() for _ in range(r.randint(1, 40))) for _ in range(60)]
    crcs, of, counts = resampling.ngram_crcs([t.encode() for t in texts], resampling.Shifts())
    by = defaultdict(Counter)
    for crc, i in zip(crcs.tolist(), of.tolist()):
        by[i][crc] += 1
    for i, t in enumerate(texts):
        n, fs = features(t)
        assert counts[i] == n and by[i] == Counter(map(zlib.crc32, fs))


def test_moves_past_zero_bytes():
    shifts, r = resampling.Shifts(), np.random.default_rng(1)
    for length in (0, 1, 63, 64, 65, 4096, 100_003):
        a, b = r.bytes(9), r.bytes(length)
        got = shifts.moved(np.array([zlib.crc32(a)], np.uint32), np.array([length]))[0]
        assert int(got) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_resampling_odd_rows(spark, documents, odd_rows, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 3)  # many ranges
    target = spark.createDataFrame([(1, "cabbage one two"), (2, None), (3, "")], "item_id long, text string")
    for percent in (5, 60, 100):
        got = resampling.resampled(documents(odd_rows), target, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        want = plain_resampling([(i, t) for i, t, _ in odd_rows], ["cabbage one two"], percent)
        # Rows of one score and id may change places.
        assert Counter((g.doc_id, g.n_features, g.weight, g.score) for g in got) == Counter(x[:4] for x in want.elements())
        ranks = lambda rows: sorted((x[4], x[3], x[0] or -1) for x in rows if x[4])
        assert ranks(map(tuple, got)) == ranks(want.elements())


def test_resampling_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(documents([]), none).count() == 0
    text = " ".join("word" + str(k) for k in range(30))
    got = resampling.resampled(documents([(i, text, "a") for i in range(40)]), none).collect()
    assert sorted(g["rank"] for g in got if g["rank"]) == [1, 2]


# -- token counts ------------------------------------------------------------------------

ODD_TEXTS = [
    "", " ", "\n\n", "a", " a", "a  b", "a \n b", "a  b", "a　  b c", "x\x1cy !\x1c! z", "it's don't we'll 'S", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>",
    "<|endof text|>", "\t tab\tbed\r\nline\r\n\r\n end  ", "日本語テキスト。これは、長い", "naïve İstanbul 12ab34 $5.00!!", "a   b", "​ ﻿ x", "\U0001f600 \U0001f600\U0001f600",
]


def library(texts, path=BYTE_BPE):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    t = Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_op12(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, SF_DIR).collect()}
    texts = [t or "" for _, t in docs]
    assert got == {i: (len(t.encode()), n, n > 1024) for (i, _), t, n in zip(docs, texts, library(texts))}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(name, monkeypatch):
    monkeypatch.setattr(tokencounts, "LONG", 30)
    monkeypatch.setattr(tokencounts, "BATCH", 100)
    monkeypatch.setattr(tokencounts, "CACHE_SEGMENTS", 500)
    r = random.Random(11)
    signs = "abeE s'tdlmr09. ,!  \n\t\r\x0b\x1c\x85    　。、，日本かナ한é́İ$<|endoftext|>ⅷ²"
    texts = ODD_TEXTS + ["".join(r.choice(signs) for _ in range(r.randint(1, 90))) for _ in range(3000)] + ["日本語。" * 300 + "a1" * 300]
    path = public_tokenizers.path(name)
    count = tokencounts.Counter(path)
    assert count.parted == (name == "byte_bpe_50k.json")
    got = [n for k in range(0, len(texts), 97) for n in count.counted(texts[k : k + 97])]
    wrong = [(t, a, b) for t, a, b in zip(texts, got, library(texts, path)) if a != b]
    assert not wrong, wrong[:3]


def test_token_counts_odd_rows(documents, odd_rows):
    rows = odd_rows + [(500, "word " * 400_000, "z"), (501, "abcdefgh" * 60_000, "z")]
    frame = documents(rows).withColumn("n_tokens", F.lit(7)).withColumn("N_Bytes", F.lit("x"))
    got = tokencounts.with_token_counts(frame, BYTE_BPE, limit=5).collect()
    assert {(g.n_tokens, g.N_Bytes) for g in got} == {(7, "x")}
    texts = [t or "" for _, t, _ in rows]
    want = Counter((i, len(t.encode()), n, n > 5) for (i, _, _), t, n in zip(rows, texts, library(texts)))
    assert Counter((g.doc_id, g._n_bytes, g._n_tokens, g.over_limit) for g in got) == want
    assert tokencounts.with_token_counts(documents([]), BYTE_BPE).count() == 0


# -- fill in middle ----------------------------------------------------------------------


def plain_infill(i, text):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return i, len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 50:
        return i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op13(spark, docs):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = {tuple(r) for r in QUERIES["op13_fill_in_middle"](spark, SF_DIR).collect()}
    assert got == {(*plain_infill(i, t)[:5], sha(plain_infill(i, t)[5]), sha(t)) for i, t in docs}


def test_infill_odd_rows(documents, odd_rows):
    texts = ["\n", "\n\n\n", "a\nb", "a\nb\n", "日本\né\n\U0001f600x", "keep <S> me\nso", "<P", "S>\nx<", "ends with <\n<", "\r\n\r", "line\n" * 90_000, "x\n\n" * 30_000 + "y"]
    rows = odd_rows + [(1000 + k, t, "a") for k, t in enumerate(texts)]
    frame = documents(rows).withColumn("N", F.lit(7)).withColumn("_cut", F.lit("x")).withColumn("output", F.lit(1.5))
    made = infill.transformed(frame)
    got = made.select("doc_id", "text", "_n", "form", "prefix_chars", "middle_chars", "_output", infill.restored(F.col("_output"), F.col("form")).alias("back"), "N", "_cut", "output").collect()
    assert all((g.N, g._cut, g.output) == (7, "x", 1.5) and g.back == (g.text or "") for g in got)
    assert Counter((g.doc_id, g._n, g.form, g.prefix_chars, g.middle_chars, g._output) for g in got) == Counter(plain_infill(i, t) for i, t, _ in rows)
    assert infill.transformed(documents([])).count() == 0
    assert {g.form for g in infill.transformed(documents(rows), rate=0).collect()} == {"plain"}


@pytest.mark.parametrize("seed", range(4))
def test_boundary_sets_select(seed):
    r = np.random.default_rng(seed)
    parts = [
        np.sort(r.choice(65_536, 300, replace=False)),  # array
        (1 << 16) + np.sort(r.choice(65_536, 20_000, replace=False)),  # bitmap
        (3 << 16) + np.concatenate([np.arange(0, 9000), np.arange(20_000, 65_536)]),  # runs
        (70_000 << 16) + np.array([0, 65_535]),
    ]
    places = np.concatenate(parts).astype(np.int64)
    held = infill.Boundaries(places)
    assert [type(c).__name__ for c in held.containers] == ["Array", "Bitmap", "Runs", "Array"] and len(held) == len(places)
    for k in [0, 299, 300, 20_299, 20_300, 29_299, 29_300, len(places) - 1, *r.integers(0, len(places), 300).tolist()]:
        assert held.select(k) == places[k]


def test_line_ends_of_a_slice():
    texts = pa.array(["skip", "é\nb", None, "", "\n", "a\n\nb"]).slice(1)
    assert [x.tolist() for x in infill.line_ends(texts)] == [[0, 2, 3], [0], [0], [0, 1], [0, 2, 3, 4]]
