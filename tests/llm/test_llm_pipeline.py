from __future__ import annotations

import random
from collections import Counter

import plain
from pyspark.sql import functions as F

import corpus_pipeline


def stage(spark, tmp_path, name, rows_df, sf_dir=""):
    at = tmp_path / f"in-{name.__name__}"
    rows_df.write.parquet(str(at))
    docs = spark.read.parquet(str(at))
    out = name(spark, docs, sf_dir)
    return docs, out


def plain_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_the_columns(spark, tmp_path, documents, odd_rows):
    spark.createDataFrame([(10, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("full", odd_rows), ("empty", [])):
        docs = documents(rows)
        for i, (_, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{i}")
            out = f(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert [(x.name, x.dataType) for x in out.schema] == [(x.name, x.dataType) for x in docs.schema]
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "full")


def test_one_of_each_group_stays(spark, tmp_path, documents, odd_rows):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(odd_rows)]
    _, out = stage(spark, tmp_path, corpus_pipeline.one_of_each_group, documents(rows))
    groups = plain.near_groups([(i, t) for i, t, _ in rows])
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (n, group, _) in groups.items() if n == 0 or group == i)


def test_repeated_rows_are_copies(spark, tmp_path, documents):
    rows = [(1, "a b c d e f g h", "a")] * 5 + [(2, "a b c d e f g h", "a"), (3, None, "a"), (3, None, "a")]
    _, out = stage(spark, tmp_path, corpus_pipeline.one_of_each_group, documents(rows))
    assert Counter(r.doc_id for r in out.collect()) == {1: 1, 3: 2}


def test_ids_do_not_tell_rows_apart(spark, tmp_path, documents):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(5)]
    near = texts[0].replace(texts[0].split(" ")[40], "other")
    rows = [
        (None, texts[0], "a"), (None, near, "b"),  # near copies without ids
        (None, texts[1], "a"), (None, texts[1], "a"),  # exact copies without ids
        (7, texts[2], "a"), (7, texts[3], "a"),  # one id, unrelated texts
        (8, texts[4], "a"), (None, texts[4], "b"), (6, texts[4] + " more", "c"),
        (None, None, "a"), (None, "", "a"), (7, " ", "a"), (7, " ", "a"),
    ]
    _, out = stage(spark, tmp_path, corpus_pipeline.one_of_each_group, documents(rows).coalesce(1))
    got = Counter((x.doc_id, x.text) for x in out.collect())
    kept = [rows[i] for i in (0, 2, 4, 5, 8, 9, 10, 11, 12)]
    assert got == Counter((i, t) for i, t, _ in kept)


def test_repeats_are_cut_from_texts(spark, tmp_path, documents, odd_rows):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(odd_rows)]
    _, out = stage(spark, tmp_path, corpus_pipeline.without_repeats, documents(rows))
    got = {r.doc_id: r for r in out.collect()}
    for (i, t, _), (removed, _, kept) in zip(rows, plain.repeats_cut([t for _, t, _ in rows], 200)):
        assert got[i].text == (t if not removed else kept.decode("utf-8", "ignore"))
        assert got[i].n_chars == (None if t is None else len(got[i].text))


def test_mixing_repeats_rows(spark, tmp_path, documents):
    rows = [(i, "w " * 30, "a" if i < 40 else "b") for i in range(240)]
    docs, out = stage(spark, tmp_path, corpus_pipeline.mixed, documents(rows))
    n = Counter(r.source for r in out.collect())
    assert n == {"a": 120, "b": 120}
    assert plain_rows(out.distinct()).keys() <= plain_rows(docs).keys()


def test_mixing_keeps_its_numbers_when_files_are_split_anew(spark, tmp_path, documents, monkeypatch):
    splits, mix = "spark.sql.files.minPartitionNum", corpus_pipeline.mixing.mix

    def fewer(rows, keys):
        taken = mix(rows, keys)
        spark.conf.set(splits, "1")
        return taken

    monkeypatch.setattr(corpus_pipeline.mixing, "mix", fewer)
    rows = [(i, "w " * 30, "a" if i < 40 else "b") for i in range(240)]
    spark.conf.set(splits, "64")
    try:
        _, out = stage(spark, tmp_path, corpus_pipeline.mixed, documents(rows).repartition(8))
        assert Counter(r.source for r in out.collect()) == {"a": 120, "b": 120}
    finally:
        spark.conf.unset(splits)


def test_quality_rejects_by_its_own_score(spark, tmp_path, documents):
    rows = [(i, ("some plain words of a text. " if i % 2 else "SHOUTED!! WORDS!! ") * 9, "a") for i in range(120)]
    spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    _, out = stage(spark, tmp_path, corpus_pipeline.quality, documents(rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.select(F.col("doc_id")).collect()) == list(range(1, 120, 2))
