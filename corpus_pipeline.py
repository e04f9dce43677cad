"""A training corpus from raw documents: score, near-duplicate removal, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is a written table, and decides about all of it. All but the last
return the columns of docs: their names, order and types, whatever further columns there are. Rows are told apart by their place in
the written table, never by doc_id, so null and repeated ids and repeated rows are rows like any other. An empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.llm import classifier, jaccard, mixing, packing, substrings
from emberbasin.llm.common import scratch_folder, stored, table, word_count, written


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of docs has, case aside."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        names.append(name)
    return names


def own(docs: DataFrame) -> list[Column]:
    """The columns of docs by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """The rows with a number of their own, written once, so that all who read them see the same numbers."""
    return written(docs.select(*own(docs), F.monotonically_increasing_id().alias(row)), "numbered")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; labels of held-out ids teach nothing.

    The score is an expression over the row's own text, so rows stay where they are.
    """
    labels = table(spark, sf_dir, "labels")
    chosen = classifier.training_labels(labels).select("doc_id").distinct()  # classifier.MAX_LABELLED ids, so few enough to broadcast
    body = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    ranking = classifier.learn(classifier.with_features(body), labels)
    (t, w, lines, x, row) = fresh(docs, "_t", "_w", "_l", "_x", "_row")
    # A condition on a column that isn't deterministic stays above it, so features are worked out once a row, not once for each use.
    scored = classifier.staged(docs, t, w, lines, x).select("*", F.monotonically_increasing_id().alias(row))
    return scored.filter((F.col(row) >= 0) & (ranking.score(F.col(x)) >= 0.5)).select(*own(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, then the first of the table. Texts without words each stay."""
    (row, doc_id, group) = fresh(docs, "_row", "_id", "_group")
    rows = numbered(docs, row)
    # Ids don't tell rows apart, their numbers do. A text without words is a component of its own.
    groups = jaccard.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("_r"), F.col("component_id").alias(group))
    ids = rows.select(row, F.col("doc_id").cast("long").alias(doc_id)).join(groups, F.col(row) == F.col("_r"))
    kept = ids.groupBy(group).agg(F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(row)))[row].alias("_kept"))
    return rows.join(kept, F.col(row) == F.col("_kept"), "left_semi").select(*own(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere too; ``n_chars`` follows. A character that a cut divides goes as well."""
    rows = substrings.without_repeated(docs, keep_text=True)
    cut = rows.columns[-1]
    kept = F.col(cut)["kept"]
    text = F.when(kept.isNull(), F.col("text")).otherwise(valid_text(kept))
    columns = dict(zip(docs.columns, own(docs)))
    columns["text"] = text
    if "n_chars" in columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(kept.isNull(), columns["n_chars"]).otherwise(size)
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def valid_text(kept: Column) -> Column:
    """Bytes as text; bytes of a divided character are dropped."""
    return F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "�", "")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a row of no words once."""
    (row, copies, copy) = fresh(docs, "_row", "_copies", "_copy")
    marked = numbered(docs, row)
    sizes = marked.select(
        F.col(row).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    )
    taken = mixing.mix(stored(sizes), ["row"]).select(F.col("row").alias("_taken"), F.col("copies").alias(copies))
    joined = marked.join(taken, F.col(row) == F.col("_taken")).filter(F.col(copies) > 0)
    return joined.select(*own(docs), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)).select(*own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each row."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: Refinement, components, Newton steps and packing have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_folder(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
