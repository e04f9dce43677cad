"""The registered queries over the smallest tables, against plain versions of the whole result."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberbasin.llm.licenses import TEMPLATES
from emberbasin.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def test_thirteen_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def pieces_of(docs):
    t, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, text, *_ in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            out[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    return out


def packed_well(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= sum(r.length for r in rows) / 2048 * 1.02 + 2


def test_op1(spark, docs):
    rows = run(spark, "op1_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces_of(docs)
    packed_well(rows)


def test_op3(spark, docs):
    rows = run(spark, "op3_kd_tree_sharding")
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in docs}
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_op4(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op4_suffix_array_dedup")}
    cut = plain.repeats_cut([t for _, t, _ in docs], 200)
    assert got == {i: (len((t or "").encode()), n, spans, hashlib.sha256(kept).hexdigest()) for (i, t, _), (n, spans, kept) in zip(docs, cut)}


def test_op5(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op5_ngram_jaccard_join")}
    assert got == {i: x[:2] for i, x in plain.near_groups([(i, t) for i, t, _ in docs]).items()}


def test_op6(spark, docs):
    rows = run(spark, "op6_entropy_mixing")
    source, size = {i: s for i, _, s in docs}, {i: len(plain.words(t)) for i, t, _ in docs}
    taken, target, longest = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"]
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r["size"])
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)


def test_op7(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall())
    rows = run(spark, "op7_quality_classifier")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op8(spark, docs):
    got = {(r.doc_id, r.line, r.license) for r in run(spark, "op8_license_scans") if r.exact}
    lines = [(i, n, x) for i, t, _ in docs for n, x in enumerate((t or "").split("\n"))]
    assert got == {(i, n, name) for i, n, x in lines for name, (_, text) in TEMPLATES.items() if x == text}


def test_op10(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op10_closed_syncmers")}
    prints = defaultdict(set)
    for k, (i, text, _) in enumerate(docs):
        t, n = text or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        prints[t].add(rows[i].fingerprint)
        if len(t) > 400:
            assert rows[i].near_edited > 0.4
    assert all(len(p) == 1 for p in prints.values())
    assert sum(r.near_edited for r in rows.values()) > 10 * sum(r.near_next for r in rows.values())


def test_sql_is_given_where_it_can_be():
    assert set(ORACLES) == {"op2_quality_rules", "op5_ngram_jaccard_join", "op9_warc_segments", "op11_importance_resampling", "op13_fill_in_middle"}


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows
    packed_well(rows)
