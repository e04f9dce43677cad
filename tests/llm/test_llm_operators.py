from __future__ import annotations

import hashlib
import math
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberbasin.llm import classifier, graph, jaccard, licenses, mixing, packing, rules, sharding, substrings, syncmers, warc
from emberbasin.llm.common import text_key
from pyspark.sql import functions as F

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def unique(rows):
    """Rows with ids of their own."""
    return [(i, t, s) for i, (_, t, s) in enumerate(rows)]


# -- packing -----------------------------------------------------------------------------


def ids_of(text):
    return Tokenizer.from_file(TOKENS).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_are_the_tokenizers(documents, odd_rows):
    extra = [(99, "İstanbul ΣΑΣ it's <|endoftext|>x a\x1cb don't, STOP!! naïve é 12ab", "z")]
    rows = unique(odd_rows + extra)
    got = defaultdict(dict)
    for r in packing.cut_pieces(documents(rows), TOKENS, 100).collect():
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    for i, text, _ in rows:
        ids = ids_of(text)
        want = {k // 100: (k, len(ids[k : k + 100]), zlib.crc32(np.array(ids[k : k + 100], "<u4").tobytes())) for k in range(0, len(ids), 100)}
        assert got[i] == want


def test_packing_is_gapless_and_whole(documents, odd_rows):
    rows = packing.pack_documents(documents(odd_rows), TOKENS, 64).collect()
    assert len(rows) == packing.cut_pieces(documents(odd_rows), TOKENS, 64).count()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= math.ceil(total / 64) + 1


def test_packing_an_empty_table(documents):
    assert packing.pack_documents(documents([]), TOKENS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_and_fills_exactly_where_it_can(seed):
    r = np.random.default_rng(seed)
    counts = Counter(np.minimum(50, r.integers(1, 60, 400)).tolist())
    plan = packing.plan_sequences(counts, 50)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 50 and times > 0
        for part in pattern:
            used[part] += times
    assert used == counts
    bins = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= length]
        if fits:
            best = min(fits, key=bins.__getitem__)
            bins[best] -= length
        else:
            bins.append(50 - length)
    assert sum(t for _, t in plan) <= 1.01 * len(bins)


def test_plan_takes_exact_complements():
    assert sorted(packing.plan_sequences({7: 1, 3: 1, 6: 1, 2: 2, 5: 2}, 10)) == [([5, 5], 1), ([6, 2, 2], 1), ([7, 3], 1)]


# -- rules -------------------------------------------------------------------------------


def measures(text):
    t = text or ""
    w = [x.decode() for x in plain.words(t)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    lines = [x for x in t.split("\n") if plain.words(x)]
    covered = {j for i, k in enumerate(windows) if k in twice for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_whole_texts(documents, odd_rows):
    more = [(0, "a b c a b c\nx | y\n\nx | y\nx | y ###\n", "q"), (0, "a a a a a", "q"), (0, "a b\u0085c d", "q")]
    rows = unique(odd_rows + more)
    got = {r.doc_id: r for r in rules.ledger(documents(rows)).collect()}
    for i, text, _ in rows:
        assert tuple(got[i][m] for m in rules.MEASURES[:5]) == measures(text), text
        n, _, symbols, _, repeats = measures(text)
        assert bool(got[i].failed & 1) == (n < 50) and bool(got[i].failed & 2) == (100 * repeats > 50 * n)
        assert bool(got[i].failed & 4) == (10 * symbols > n)


def test_policies_and_ablations(spark):
    failed = [0, 0, 1, 2, 3, 4, 6, 8]
    rows = spark.createDataFrame([(x,) for x in failed], "failed long")
    assert rows.filter(rules.passes("base", 1)).count() == sum(not x & 3 for x in failed)
    every = rules.mask("prose", 1)
    for r in rules.ablation(rows, "prose", 1).collect():
        bit = 1 << rules.BITS[r.rule]
        assert (r.fails, r.fails_alone, r.kept_without, r.kept) == (
            sum(bool(x & bit) for x in failed), sum(x & every == bit for x in failed), sum(not x & every & ~bit for x in failed), 2,
        )
    assert rules.ledger(spark.createDataFrame([], "doc_id long, text string, n_words int")).count() == 0


# -- sharding ----------------------------------------------------------------------------


def test_shards_are_near_equal_and_slots_gapless(documents, odd_rows):
    for rows in (odd_rows, [(7, "same", "a")] * 50, [(i, "w " * (i % 17), f"s{i % 5}") for i in range(500)], []):
        got = sharding.shard_documents(documents(rows), 8).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
            (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows
        )
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        for shard in by.values():
            assert sorted(r.slot for r in shard) == list(range(len(shard)))
        if len(rows) == 500:
            sizes = [sum(r["size"] for r in x) for x in by.values()]
            assert len(by) == 8 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_a_hot_metadata_value_is_split(documents):
    got = sharding.shard_documents(documents([(i, "word", "hot") for i in range(640)]), 40).collect()
    assert Counter(r.shard for r in got) == {s: 16 for s in range(40)}


def test_coordinates_keep_the_order_of_values(spark):
    doubles = [float("-inf"), -1e308, -3.0, -1.5, -1.0, -5e-310, 0.0, 5e-310, 2.3e-308, 0.1, 0.3, 1.0, 1.0000001, 2.0, 3.0, 1024.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(doubles)), "i int, a double")
    df = df.selectExpr(
        "i", "a", "CAST((i - 9) * 1.37 AS FLOAT) f", "date_add(DATE'1969-12-20', i * 40) d", "timestamp_micros((i - 9) * 86399999999L) t",
        "CAST(timestamp_micros((i - 9) * 3599999999L) AS TIMESTAMP_NTZ) z", "CAST((i - 9) * 0.25 AS DECIMAL(9,2)) m", "CAST((i - 9) * 1.5 AS DECIMAL(30,10)) w",
        "CAST((i - 9) * 1000000000000BD AS DECIMAL(38,2)) v", "i > 9 AS b",
    )
    kinds = dict(df.dtypes)
    got = df.select("i", *[sharding.coordinate(F.col(c), kinds[c]).alias(c) for c in df.columns[1:]]).orderBy("i").collect()
    for c in df.columns[1:]:
        column = [r[c] for r in got]
        assert column == sorted(column) and column[0] >= 0, c
        assert len(set(column)) == (2 if c == "b" else len(column)), (c, column)
    none = df.limit(1).select(*[sharding.coordinate(F.lit(None).cast(kinds[c]), kinds[c]).alias(c) for c in df.columns[1:]]).first()
    assert set(none) == {-1}


def test_shards_follow_a_time(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "'word' AS text", "timestamp_micros((id * 7919 % 400) * 3000000000L) AS t")
    got = sharding.shard_documents(rows, 4, metadata=("t",), id_col="doc_id").select("doc_id", "shard").collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.doc_id * 7919 % 400)
    assert len(by) == 4 and all(len(x) == 100 and (max(x) < 200 or min(x) >= 200) for x in by.values())


# -- repeated strings --------------------------------------------------------------------


def cut(docs, length, seed):
    out = {}
    for r in substrings.without_repeated(docs, keep_text=True, length=length, seed=seed).collect():
        kept = bytes(r.cut.kept) if r.cut is not None else (r.text or "").encode()
        assert r.cut is None or hashlib.sha256(kept).hexdigest() == r.cut.kept_sha256
        out[r.doc_id] = (r.cut.n_removed, r.cut.n_spans, kept) if r.cut is not None else (0, 0, kept)
    return out


@pytest.mark.parametrize("length,seed", [(200, 64), (40, 8), (12, 3)])
def test_repeats_are_cut_as_by_brute_force(documents, odd_rows, length, seed):
    r = np.random.default_rng(length)
    low = [(0, "".join(r.choice(list("ab"), 300)), "z") for _ in range(4)]  # many chance repeats
    rows = unique(odd_rows + low)
    rows = [(i, t[:4000] if t else t, s) for i, t, s in rows]
    got = cut(documents(rows), length, seed)
    for (i, _, _), want in zip(rows, plain.repeats_cut([t for _, t, _ in rows], length)):
        assert got[i] == want


def test_hot_names_are_merged_across_shards(documents, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENTS", 3)
    monkeypatch.setattr(substrings, "SHARD", 500)
    r = np.random.default_rng(5)
    prose = lambda n: "".join(r.choice(list("abcdefgh "), n))
    passage = prose(60)
    rows = [(i, prose(30) + passage + prose(30), "a") for i in range(40)] + [(50 + i, passage[:45] + prose(50), "b") for i in range(9)]
    got = cut(documents(rows), 40, 8)
    for (i, _, _), want in zip(rows, plain.repeats_cut([t for _, t, _ in rows], 40)):
        assert got[i] == want


def test_long_texts_are_taken_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 300)
    monkeypatch.setattr(substrings, "MOST", 20)
    r = np.random.default_rng(6)
    one = "".join(r.choice(list("abcdefgh "), 2000))
    rows = [(1, one, "a"), (2, one[500:900] + "".join(r.choice(list("xyz"), 700)), "a"), (3, "q" * 1000, "a"), (4, "q" * 39 + "r" + "q" * 39, "a")]
    got = cut(documents(rows), 40, 8)
    for (i, _, _), want in zip(rows, plain.repeats_cut([t for _, t, _ in rows], 40)):
        assert got[i] == want


@pytest.mark.parametrize("symbols", [[1], [1, 1, 1, 1], [2, 1, 2, 1, 2, 1, 0], list(range(9, 0, -1)), [3, 3, 3]])
def test_suffix_arrays(symbols):
    s = np.array(symbols, np.int64)
    order, rank = substrings.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])
    assert rank[order].tolist() == list(range(len(s)))


def test_suffix_arrays_of_chance_strings():
    r = np.random.default_rng(1)
    for n, k in ((200, 2), (300, 1), (500, 4), (64, 200)):
        s = r.integers(1, k + 1, n)
        order, _ = substrings.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


# -- near duplicates ---------------------------------------------------------------------


def same_groups(docs, rows, links):
    want = plain.near_groups([(i, t) for i, t, _ in rows])
    for r in jaccard.near_duplicates(docs, links=links).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id][:2], r.doc_id
        assert not links or r.n_links == want[r.doc_id][2]


@pytest.mark.parametrize("links", [False, True])
def test_near_duplicates_as_by_brute_force(documents, odd_rows, links):
    rows = unique(odd_rows)
    same_groups(documents(rows), rows, links)


@pytest.mark.parametrize("links, index, kept", [(True, 900, 200_000), (False, 900, 200_000), (False, 900, 0), (False, 60, 20), (False, 400_000, 10)])
def test_near_duplicates_of_large_groups(documents, monkeypatch, links, index, kept):
    monkeypatch.setattr(jaccard, "INDEX", index)
    monkeypatch.setattr(jaccard, "RECURRING", kept)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    r = np.random.default_rng(2)
    word = [f"w{i}" for i in range(400)]
    base = r.choice(word, 60).tolist()
    rows = []
    for i in range(70):
        w = list(base)
        for at in r.choice(60, r.integers(0, 4), replace=False):
            w[at] = f"n{r.integers(0, 9)}"
        rows.append((i, " ".join(w[: 60 - int(r.integers(0, 8))]), "a"))
    rows += [(100 + i, " ".join(r.choice(word, 40)) + " " + " ".join(base[:15]), "b") for i in range(30)]
    # Chains: each is like the next but not like the one after.
    long = r.choice(word, 140).tolist()
    rows += [(200 + i, " ".join(long[4 * i : 4 * i + 40]), "c") for i in range(25)]
    same_groups(documents(rows), rows, links)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=3, max_size=14, unique=True), min_size=1, max_size=14))
def test_members_unite_as_by_brute_force(lists):
    sets = [np.array(sorted(x), np.uint64) for x in lists]
    index = jaccard.Index(list(range(len(sets))), [1] * len(sets), sets)
    index.unite_members(sets, 50)
    up = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(lists):
            for j, b in enumerate(lists):
                if 2 * len(set(a) & set(b)) >= len(set(a) | set(b)):
                    up[i] = up[j] = min(up[i], up[j])
    same = lambda f: [[f(i) == f(j) for j in range(len(sets))] for i in range(len(sets))]
    assert same(index.root) == same(up.__getitem__)


def test_texts_of_two_symbols_in_turn_are_told_apart(documents):
    turn = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(turn)
    texts = [word, word.translate(turn), " ".join(word), " ".join(word.translate(turn)), word.upper()]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    same_groups(documents(rows), rows, True)


def test_near_duplicates_without_and_with_repeated_ids(documents, odd_rows):
    got = jaccard.near_duplicates(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert jaccard.near_duplicates(documents([])).count() == 0
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[11] == by[12] == by[31] == by[13] == {10}
    assert by[2] == {2} and by[1] == {1}


@pytest.mark.parametrize("mu", [0.01, 0.4, 5.0])
def test_search_finds_what_reaches_the_bound(mu, monkeypatch):
    monkeypatch.setattr(jaccard, "MU", mu)
    r = np.random.default_rng(4)
    base = r.choice(300, 40, replace=False)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(20, 40), replace=False), r.choice(300, r.integers(0, 9))])).astype(np.uint64) for _ in range(80)]
    index = jaccard.Index(list(range(80)), [1] * 80, sets)
    for i, one in enumerate(sets):
        want = [j for j, s in enumerate(sets) if j != i and 100 * len(np.intersect1d(one, s)) >= 75 * len(np.union1d(one, s))]
        assert sorted(index.links(i, one, 75).tolist()) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (3, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), 5: 5, 7: 5, 9: 5}


# -- mixing ------------------------------------------------------------------------------


def water_filled(sizes, weights=(5, 2, 1), repeat=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > repeat * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(repeat * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_mixing_meets_its_targets(documents, odd_rows):
    r = np.random.default_rng(8)
    rows = unique(odd_rows) + [(1000 + i, "w " * int(r.integers(0, 90)), ["hot", "b", None, "tiny"][min(3, int(r.geometric(0.5)) - 1)]) for i in range(900)]
    got = mixing.mix_documents(documents(rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for i, t, s in rows:
        size[s] += len(plain.words(t))
    want = water_filled(size)
    taken = Counter()
    for g in got:
        assert g.target == pytest.approx(want[g.source]) and g.source_size == size[g.source] and 0 <= g.copies <= 3
        taken[g.source] += g.copies * g["size"]
    longest = defaultdict(int)
    for g in got:
        longest[g.source] = max(longest[g.source], g["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.mix_documents(documents(rows)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_rates_are_exponential_in_size_and_meet_the_constraint(documents):
    rows = [(i, "w " * (10 + i), "a") for i in range(200)] + [(500 + i, "w " * 40, "b") for i in range(200)]
    got = mixing.mix_documents(documents(rows)).collect()
    for source in "ab":
        of = [g for g in got if g.source == source]
        assert sum(g.rate * g["size"] for g in of) == pytest.approx(of[0].target, rel=1e-4)
        tilt = {round(math.log(g.rate) / g["size"], 6) for g in of if g.rate < 3}
        assert len(tilt) <= 1


def test_mixing_odd_tables(documents):
    assert mixing.mix_documents(documents([])).count() == 0
    got = mixing.mix_documents(documents([(1, None, None), (2, "", "a"), (2, "", "a")])).collect()
    assert [(g["size"], g.target, g.copies) for g in got] == [(0, 0.0, 1)] * 3


# -- classifier --------------------------------------------------------------------------


def test_classifier_on_rows_held_out(spark, documents, odd_rows):
    r = np.random.default_rng(9)
    prose = lambda: " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(80))
    rows = [(i, prose() if i % 3 else prose().upper().replace(" ", "!! "), "a") for i in range(300)]
    docs = documents(rows + [(i + 1000 if i is not None else None, t, s) for i, t, s in odd_rows])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = classifier.with_features(docs)
    ranking = classifier.learn(scored, labels)
    got = scored.select("doc_id", ranking.score(F.col("x")).alias("p")).collect()
    assert len(got) == docs.count() and all(0 <= g.p <= 1 for g in got)
    held = [g for g in got if g.doc_id is not None and g.doc_id < 300 and zlib.crc32(str(g.doc_id).encode()) % 3 == 1]
    assert held and all((g.p >= 0.5) == (g.doc_id % 3 > 0) for g in held)


def test_labels_held_out_teach_nothing(spark, documents):
    rows = [(i, "Some words of text. " * (i % 7 + 1) + "!" * (i % 2), "a") for i in range(60)]
    scored = classifier.with_features(documents(rows))
    honest = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in honest]
    schema = "doc_id long, quality int"
    assert classifier.learn(scored, spark.createDataFrame(honest, schema)) == classifier.learn(scored, spark.createDataFrame(turned, schema))


def test_classifier_without_labels(spark, documents):
    scored = classifier.with_features(documents([(1, "text", "a"), (2, None, "a")]))
    ranking = classifier.learn(scored, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.p for r in scored.select(ranking.score(F.col("x")).alias("p")).collect()] == [0.5, 0.5]
    assert classifier.with_features(documents([])).count() == 0


# -- licenses ----------------------------------------------------------------------------


def test_licenses_are_confirmed_by_their_words(documents, odd_rows):
    lines = {
        "Released under the MIT License.": ("MIT", True),
        "released  under the MIT license": ("MIT", True),
        "Released freely under the MIT License.": ("MIT", False),
        "Licensed under the Apache License, Version 2.0.": ("Apache-2.0", True),
        "Licensed under the Apache License, Version 1.1.": None,
        "This work is licensed under the GNU General Public License, version 3.": ("GPL-3.0", True),
        "This work is licensed under the GNU General Public License, version 2.": None,
        "Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0", True),
        "A licence to print money, said the bird.": None,
        "No notice at all.": None,
    }
    rows = [(i, f"first line\n{line}\nlast", "a") for i, line in enumerate(lines)]
    long_one = "word " * 900 + "Released under the MIT License." + " word" * 900
    got = licenses.scan_licenses(documents(rows + [(77, long_one, "a")] + [(None, t, s) for _, t, s in odd_rows])).collect()
    by = defaultdict(list)
    for g in got:
        by[g.doc_id].append((g.license, g.exact, g.line))
    for i, want in enumerate(lines.values()):
        assert by[i] == ([(*want, 1)] if want else []), (i, by[i])
    assert by[77] == [("MIT", True, 0)] and set(by) <= {*range(len(lines)), 77}
    assert licenses.scan_licenses(documents([])).count() == 0


def test_wrapped_notices_are_confirmed(documents):
    rows, want = [], set()
    for name in ("MIT-text", "BSD", "Apache-2.0-text"):
        for mark in ("", "# ", " * ", "// ", "REM "):
            notice = textwrap.fill(licenses.TEMPLATES[name][1], 75, initial_indent=mark, subsequent_indent=mark)
            rows.append((len(rows), f"first line\n{mark}\n{notice}\n{mark}\nlast line of a text", "a"))
            want.add((len(rows) - 1, name, True, 2, 2 + notice.count("\n")))
    # A notice far into a long text, across what were the edges of blocks, and a version on the line after another.
    rows.append((90, "word " * 1234 + rows[0][1] + " word" * 1234, "a"))
    rows.append((91, "This work is licensed under the GNU General Public License, version 2.\n3 apples", "a"))
    got = licenses.scan_licenses(documents(rows)).collect()
    assert {(g.doc_id, g.license, g.exact, g.line, g.last_line) for g in got if g.doc_id < 90} == want
    assert [(g.doc_id, g.license, g.exact) for g in got if g.doc_id >= 90] == [(90, "MIT-text", True)]
    assert len(got) == len(want) + 1
    text = dict((i, t) for i, t, _ in rows)
    assert all(text[g.doc_id][g.start : g.start + g.length].startswith(licenses.TEMPLATES[g.license][1][:15]) for g in got)


def test_each_notice_of_a_line_is_confirmed(documents):
    text = {name: t for name, (_, t) in licenses.TEMPLATES.items()}
    apart = " and some more of the words that stand between notices. "
    both = text["MIT-text"] + ". " + text["CC-BY-4.0"]
    many = apart.join([text["MIT"]] * 300)
    close = " ".join([text["MIT"], text["CC-BY-NC-4.0"], text["Apache-2.0-text"], text["MIT"], text["CC-BY-4.0"].upper(), text["GPL-3.0"], "Work is licensed under the GNU General Public License, version 3."])
    got = licenses.scan_licenses(documents([(1, both, "a"), (2, many, "a"), (3, close, "a")])).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: g.start):
        by[g.doc_id].append((g.license, g.start))
        assert g.line == g.last_line == 0
    assert by[1] == [("MIT-text", 0), ("CC-BY-4.0", len(text["MIT-text"]) + 2)]
    assert by[2] == [("MIT", i * len(text["MIT"] + apart)) for i in range(300)]
    assert [name for name, _ in by[3]] == ["MIT", "CC-BY-NC-4.0", "Apache-2.0-text", "MIT", "CC-BY-4.0", "GPL-3.0", "GPL-3.0"]


# -- archives ----------------------------------------------------------------------------


def test_archives_come_back_whole(spark, tmp_path):
    big = "<p>é日本</p>\r\n\r\nWARC/1.1\r\n" * 400
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (5, "u", big), (3, "u", None), (4, "u", ""), (6, "u", "s" * 999), (7, "u", "s" * 999), (8, "u", "t" * 1000),
            (9, "u", "t" * 1000), (9, "u", "t" * 1000), (None, "u", "z"), (None, "u", "y" * 1200), (10, "u", "x" * 70_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    warc.write_archives(pages, str(tmp_path / "warc"), segment=5_000, chunk=777)
    whole = warc.reassembled(warc.read_records(spark, str(tmp_path / "warc")))
    kept = {(r.page_id, r.record_type): bytes(r.payload) for r in whole.collect() if r.record_type == "response" and r.page_id is not None}
    assert kept[5, "response"] == big.encode() and kept[10, "response"] == b"x" * 70_000
    got = warc.resolved(whole).collect()
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000:
            first[h] = max(first.get(h, -1), -1 if i is None else i)
    assert all(r.whole for r in got) and len(got) == len(rows)
    want, seen = Counter(), set()
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "", None)
        again = len(data) >= 1000 and (to != (-1 if i is None else i) or h in seen)
        if len(data) >= 1000 and not again:
            seen.add(h)
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_broken_segments_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 3000), (2, "u", "y" * 3000), (3, "u", "z" * 3000)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), segment=900, chunk=500)
    read = warc.read_records(spark, str(tmp_path / "w"))
    origin = {r.page_id: r.record_id for r in read.filter("page_id IS NOT NULL").collect()}
    lost = read.filter((F.coalesce("origin_id", F.lit("")) != origin[1]) | (F.col("segment") != 2))
    lost = lost.withColumn("total_length", F.when(F.col("origin_id") == origin[2], F.col("total_length") + 1).otherwise(F.col("total_length")))
    got = {r.page_id: (r.whole, r.payload is not None) for r in warc.reassembled(lost).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, True)}


def test_empty_archive(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolved(warc.reassembled(warc.read_records(spark, str(tmp_path / "w")))).count() == 0


# -- fingerprints ------------------------------------------------------------------------


def test_fingerprints_of_edited_and_next(documents, odd_rows):
    rows = unique(odd_rows)
    got = {r.doc_id: r for r in syncmers.with_edited(documents(rows)).select(
        "*", syncmers.digest(F.col("anchors")).alias("f"), syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("next")).collect()}
    by = defaultdict(set)
    for k, (i, text, _) in enumerate(rows):
        t, n = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut_at = len(t) - len(t) // 4
        assert got[i].edited == t[:cut_at] + n[: len(t) // 4]
        assert 0 <= got[i].near <= 1 and 0 <= got[i].next <= 1
        by[t].add(got[i].f)
    assert all(len(x) == 1 for x in by.values())
    long_one = next(r for r in got.values() if len(r.text) > 20_000)
    assert 0.6 < long_one.near < 0.9 and long_one.next < 0.05


def test_anchors_are_closed_and_free_of_context(documents):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(1, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(20)), "a") for i in range(5)]
    got = syncmers.with_anchors(documents(rows, clashing=False), "text", places="at").collect()
    common = set.intersection(*(set(g.anchors) for g in got))
    assert len(common) >= 10
    pieces = [sum(-(-len(w) // 4) for w in g.text.split()) for g in got]
    assert all(len(g.at) == len(g.anchors) and g.at == sorted(g.at) and g.at[-1] <= p - syncmers.K for g, p in zip(got, pieces))
    # Positional matching: the passage stands at one shift of the anchors' places.
    for g in got[1:]:
        one, other = dict(zip(got[0].anchors, got[0].at)), dict(zip(g.anchors, g.at))
        assert len({other[a] - one[a] for a in common}) == 1


def test_fingerprints_of_odd_tables(documents, odd_rows):
    assert syncmers.with_edited(documents([])).count() == 0
    assert syncmers.with_edited(documents(odd_rows)).count() == len(odd_rows)
    one = syncmers.with_edited(documents([(5, "only text here", "a")])).first()
    assert one.edited == "only text h" + "onl"


def foreign(kind, block, digest=None, more=""):
    digest = f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{digest}{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others_and_damaged_ones(spark, tmp_path):
    import base64
    import gzip

    body = b"<html>some page</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha = hashlib.sha1(body)
    good = foreign("response", http, "sha1:" + base64.b32encode(sha.digest()).decode(), "WARC-Record-ID: <urn:a>\r\n")
    parts = [
        foreign("warcinfo", b"software: other\r\n"), good, foreign("response", http, "sha1:" + "0" * 40), foreign("response", http, "md5:abc"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"), b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: no\r\n\r\nrubbish\r\n\r\n",
        foreign("response", http).replace(b"Content-Length: ", b"Content-Length: 1"), good,
    ]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(parts))
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (folder / "c.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good * 50)[:-40])
    (folder / "d.warc").write_bytes(good + good[:-30])
    (folder / "e.warc").write_bytes(b"")
    (folder / "f.warc").write_bytes(b"nothing of the kind")
    rows = warc.reassembled(warc.read_records(spark, str(folder))).collect()
    sound = [r for r in rows if r.record_id == "<urn:a>" and r.whole]
    assert len(sound) >= 6 and all(bytes(r.payload) == body and r.payload_sha1 == sha.hexdigest() and r.damage is None for r in sound)
    info = [r for r in rows if r.record_type == "warcinfo"]
    assert len(info) == 2 and all(r.whole and bytes(r.payload) == b"software: other\r\n" for r in info)
    said = Counter((r.damage or "").split(" at byte")[0].split(":")[0] for r in rows if not r.whole)
    assert said["the digest differs"] == 2 and said["chunks"] == 2 and said["gzip"] == 1 and said["no record"] == 1 and all(said) and "" not in said
    assert warc.resolved(warc.reassembled(warc.read_records(spark, str(folder)))).count() == len(rows)


def test_ids_after_marks_and_of_other_files():
    r = np.random.default_rng(12)
    signs = list("abzE sS't.,;!%09 \n\x1c\x85\xa0éÉßİıſ日́ŉ²ΣςⅧ") + ["<|endoftext|>", "'re", "İ;"]
    texts = ["".join(r.choice(signs, r.integers(1, 30))) for _ in range(8000)] + ["İ;", "İstanbul,", "it's 12ab!!"]
    words = packing.WordIds(TOKENS)
    assert words.known and not packing.WordIds(public_tokenizers.path("byte_bpe_50k.json")).known
    for ids in (words, packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))):
        wrong = [t for t, found in zip(texts, ids.of(texts)) if found != ids.encoded(t)]
        assert not wrong, wrong[:3]


def test_words_remembered_are_few_and_the_frequent_ones():
    """400,000 words in twenty calls: a worker holds fewer than it has met, and what every call has is learnt once."""
    words, learnt, learn = packing.WordIds(TOKENS), Counter(), packing.WordIds.learn
    words.learn = lambda parts: (learnt.update(parts), learn(words, parts))
    letters = "abcdefghijklmnopqrst"
    usual = [f"usual{x}" for x in letters]
    rare = ["".join((letters[i % 20], letters[i // 20 % 20], letters[i // 400 % 20], letters[i // 8000 % 20], letters[i // 160_000])) for i in range(400_000)]
    for at in range(0, 400_000, 20_000):
        words.of([" ".join(usual + rare[at : at + 20_000])])
    assert len(words) <= 320_000
    assert all(learnt[x] == 1 for x in usual) and len(learnt) == 400_020
    assert words.of([]) == [] and words.of(["", " \n"]) == [b"", b""]
    assert words.of(["Usuala, USUALB's"]) == [words.encoded("Usuala, USUALB's")]


def test_counting_shingles_holds_little_at_a_time():
    """What the function of a task allocates for 12 MB of texts in one batch; recurring shingles have their counts."""
    import tracemalloc

    class Task:
        select = lambda self, *columns: self
        mapInArrow = lambda self, work, schema: work

    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 400)) for _ in range(3900)]
    texts += texts[:100] + texts[:50]
    none = pa.nulls(len(texts), pa.int64())
    batch = pa.RecordBatch.from_arrays([none, none, pa.array(texts)], ["doc_id", "mark", "text"])
    tracemalloc.start()
    found = [row for b in jaccard.scanned(Task())(iter([batch])) for row in b.select(["often"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert Counter(x["often"] for x in found) == {None: 4050, 2: 50 * 396, 3: 50 * 396}
    assert peak < 130e6, peak


def test_usual_notices_are_found(documents):
    """Notices as projects write them, none of them equal to a template."""
    notices = {
        "GPL-3.0-or-later-text": "/* This file is part of Foo.\n * Foo is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */",
        "GPL-2.0-or-later-text": "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n"
        "# of the License, or (at your option) any later version.",
        "LGPL-2.1-or-later-text": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        "MPL-2.0-text": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "ISC-text": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "SPDX-MIT": "// SPDX-License-Identifier: MIT\nint main() {}",
        "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy it.",
        "Apache-2.0-text": ' * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy',
    }
    got = licenses.scan_licenses(documents([(i, f"some words first\n{t}\nand more after", "a") for i, t in enumerate(notices.values())])).collect()
    assert {(g.doc_id, g.license) for g in got} == set(enumerate(notices))


WORK_NAMES = ["_words", "_Lines", "N_WORDS", "Failed", "_p", "_H", "_n", "_at", "_tie", "_Node", "_rank", "_Before", "_buckets", "_Bucket", "_row", "sequence_id", "Offset", "shard"]


def test_columns_of_the_caller_come_back(spark):
    extra = ", ".join(f"`{n}` long" for n in WORK_NAMES)
    values = [777 + i for i in range(len(WORK_NAMES))]
    docs = spark.createDataFrame([(i, f"some text of document {i}", 100 + i, *values) for i in range(40)], f"doc_id long, text string, length long, {extra}")

    def same(found, less=()):
        rows = found.collect()
        names = [n for n in WORK_NAMES if n.lower() not in less]
        at = {n: found.columns.index(n) for n in names}
        assert len(rows) == 40 and all(r[at[n]] == v for r in rows for n, v in zip(WORK_NAMES, values) if n in at)
        return rows

    # The ledger's own names replace those of the caller, as its text says.
    rows = same(rules.ledger(docs), ("n_words", "failed"))
    assert {r.n_words for r in rows} == {5}
    assert all(len(r.anchors) and len(r.anchors) == len(r.places) for r in same(syncmers.with_anchors(docs, "text", "anchors", places="places")))
    found = sharding.kd_shards(docs, "length", ["doc_id"], 4, ["doc_id"])
    assert {r["_shard"] for r in same(found)} == {0, 1, 2, 3}
    found = packing.pack(docs, 200)
    assert found.columns[-2:] == ["_sequence_id", "_offset"] and {r["_offset"] for r in same(found)} <= {0, *range(100, 200)}
    sizes = docs.select("*", F.lit("a").alias("source"), F.lit(5).cast("long").alias("size"), F.lit(1).alias("rate"), F.lit(2).alias("source_rows"), F.lit(3).alias("copies"))
    assert {r.copies for r in mixing.mix(sizes, ["doc_id"]).collect()} == {1}
