"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.plans.lineage import cut_lineage
from emberbasin.session import shared_root

#: The six ASCII characters between words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def white() -> Column:
    return F.lit(WHITE)


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; null stays null."""
    return F.btrim(text, white())


def word_array(text: Column) -> Column:
    """The words of a text in order; no text and blank texts give an empty array."""
    bare = trimmed(text)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, WHITE_RUN)
    )


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared root of the session."""
    return f"{shared_root(spark)}/emberbasin/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as written to the shared checkpoint folder."""
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is large is compressed there, and read by columns."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that :func:`written` made, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of docs has, case aside, each of them once."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs named k1 and k2."""
    bare = F.coalesce(text, F.lit(""))
    return [F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2")]


# -- inside tasks ------------------------------------------------------------------------


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow. Workers outlive tasks, so what a task no longer uses goes back to the machine at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts (one more than rows); null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    starts = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` text bytes, or one row where that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(
            [0] if not batch.num_rows else pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ).astype(np.int64)
        start, held = 0, 0
        for row, length in enumerate(lengths):
            if held and held + length > size:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        yield batch.slice(start)


def several(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, end to end."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, counts)
