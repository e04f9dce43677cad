"""Importance resampling towards a target: hashed n-gram counts, log ratios of buckets, and a draw by Gumbel noise.

Each text is normalised to its words with one separator before each, and scanned once: the running CRC-32 at the end of every word is all
that is kept. CRC-32 is linear over GF(2): crc(A + B) = crc(A) moved past len(B) zero bytes, xor crc(B). So the CRC of
any run of words comes from two of the running values, by cancelling the moved first one; no n-gram is ever put together. Moving by
up to 63 bytes is one look-up for each byte of the CRC; longer moves are made of those of 64 bytes times powers of two.

Counts of buckets are combined in tasks and summed; a table of ``buckets`` gains goes back to the tasks, which work features out a second time
instead of storing them. Drawn are the highest scores: a quantile rules most rows out, the rest is written in ranges of score and id,
and ranges are numbered through by their counts, so no task sorts more than a range.

Null texts have no words. A row without an id draws its noise as the id '' would and comes after those with one among equal scores; repeated rows
each have a rank of their own. Without features on either side all gains follow from the smoothing alone; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberbasin.llm.common import slices, written

LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text scanned at a time, and rows that a range of the ranking has about.
SLICE = 2_000_000
RANGE_ROWS = 500_000
MOST_RANGES = 10_000
#: Of a quantile's rank, as a share of all rows.
ACCURACY = 20_000

#: Bytes of words as they are, A-Z in lower case, all else as the separator.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Moves by fewer bytes than this are looked up whole.
NEAR = 64
FAR_BITS = 34


class Shifts:
    """Moves CRC-32 values past zero bytes: linear maps over GF(2), each held as a table for every byte of the value."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
        self.step = step
        tables = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
        for _ in range(NEAR):
            tables.append(self.past_zero(tables[-1]))
        self.near = np.stack(tables[:NEAR])
        self.far = [tables[NEAR]]
        for _ in range(FAR_BITS - 1):
            self.far.append(self.moved_by(self.far[-1], self.far[-1]))

    def past_zero(self, crc: np.ndarray) -> np.ndarray:
        return self.step[crc & np.uint32(0xFF)] ^ (crc >> np.uint32(8))

    @staticmethod
    def moved_by(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        b = np.uint32(0xFF)
        return table[0][crc & b] ^ table[1][crc >> np.uint32(8) & b] ^ table[2][crc >> np.uint32(16) & b] ^ table[3][crc >> np.uint32(24)]

    def moved(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each value moved past its own number of zero bytes."""
        b, low = np.uint32(0xFF), length % NEAR
        t = self.near
        out = t[low, 0, crc & b] ^ t[low, 1, crc >> np.uint32(8) & b] ^ t[low, 2, crc >> np.uint32(16) & b] ^ t[low, 3, crc >> np.uint32(24)]
        high, bit = length // NEAR, 0
        while (rest := high >> bit).any():
            rows = np.flatnonzero(rest & 1)
            out[rows] = self.moved_by(self.far[bit], out[rows])
            bit += 1
        return out

    def past_separator(self, crc: np.ndarray) -> np.ndarray:
        state = crc ^ np.uint32(0xFFFFFFFF)
        return self.step[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def scanned(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running CRCs at the ends of all words, the words' lengths, and the number of words of each text.

    A text runs as a separator and a word, for each word."""
    crc, ends, lengths, counts = zlib.crc32, [], [], []
    for text in texts:
        words = text.translate(NORMAL).split()
        ends += accumulate(words, lambda c, w: crc(w, crc(b" ", c)), initial=0)
        lengths += map(len, words)
        counts.append(len(words))
    counts = np.array(counts, np.int64)
    ends = np.array(ends, np.uint32)
    return ends, np.array(lengths, np.int64), counts


def ngram_crcs(texts: list[bytes], shifts: Shifts, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRC-32 of every run of 1 to ``longest`` words joined by one space, the text each is of, and the texts' word counts."""
    ends, lengths, counts = scanned(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    # A text has one running value more than words: that before its first one, which is 0.
    place = np.arange(len(owner)) + owner
    start = shifts.past_separator(ends[place])
    upto = np.cumsum(lengths)
    found, of = [], []
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(owner) - n + 1))
        first = first[owner[first] == owner[first + n - 1]] if n > 1 else first
        last = first + n - 1
        length = upto[last] - upto[first] + lengths[first] + n - 1
        found.append(ends[place[last] + 1] ^ shifts.moved(start[first], length))
        of.append(owner[first])
    return np.concatenate(found), np.concatenate(of), counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> dict[int, int]:
    """How many features of the column ``text`` fall into each bucket: at most ``buckets`` numbers, whatever the table holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", SLICE):
            crcs, _, _ = ngram_crcs(batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist(), shifts, longest)
            total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the log of how much likelier a bucket is in the target than here, both smoothed by one, rounded down."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[list(own)], t[list(target)] = list(own.values()), list(target.values())
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel number drawn from seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of (doc_id, text)."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # a table of fixed size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, gain = Shifts(), held.value
        for batch in slices(batches, "text", SLICE):
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            crcs, of, counts = ngram_crcs(texts, shifts, longest)
            weight = np.bincount(of, gain[crcs % np.uint32(buckets)], len(texts)).astype(np.int64)  # whole numbers, exact to 2^53
            features = np.bincount(of, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows``, a written table with doc_id and score, with the rank of the ``drawn`` highest scores, smaller ids first; else null."""
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    total = rows.count()
    share = max(0.0, 1 - drawn / total - 2 / ACCURACY)
    cut = rows.agg(F.percentile_approx("score", share, ACCURACY)).first()[0]
    if rows.filter(F.col("score") >= cut).count() < drawn:
        cut = rows.agg(F.min("score")).first()[0]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_at")]
    ranges = min(MOST_RANGES, -(-drawn // RANGE_ROWS))
    # Rows get a number by their place in the table, so equal rows spread over ranges and a task done again deals them as before.
    high = rows.filter(F.col("score") >= cut).withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    high = written(high.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = high.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    top = high.join(F.broadcast(sums), "_range").select(*rows.columns, place.cast("long").alias("rank"))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.unionByName(rows.filter(F.col("score") < cut).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; ``percent`` of those with ``least_words`` words have a rank."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    rows = written(weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able, rest = rows.filter(F.col("n_words") >= least_words), rows.filter(F.col("n_words") < least_words)
    drawn = percent * able.count() // 100
    return ranked(able, drawn).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
