"""Join strategies: a checked broadcast, and a split of hot keys for everything larger."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.functions.columns import named
from emberbasin.plans.local import local_rows

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARE = 1000
SPLIT_ROWS = 250_000
NULL_SPLITS = 1 << 20
# Rows of a list, pairs of one share of a key, and pairs and rows of a task of listed_join.
LIST_ROWS = 4096
SHARE_PAIRS = 16_000_000
TASK_PAIRS = 64_000_000
TASK_ROWS = 1_000_000
# So many pairs are as much work as the shuffle of a row.
MANY_PAIRS = 5


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: text by its length, other values 16 bytes."""
    size = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(named(field.name)), F.lit(0)) + 16
        else:
            size = size + 16
    return size


def size_columns(df: DataFrame) -> list[Column]:
    """Rows and rough bytes, as aggregates."""
    return [F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))]


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, measured: tuple[int, int] | None = None
) -> bool:
    """Whether the rows are few and small enough to copy to every executor.

    Measured, not estimated: one aggregation that shuffles a row per input task, unless
    the caller has ``measured`` the rows and bytes along with something else.
    """
    rows, size = measured or df.agg(*size_columns(df)).first()
    return rows <= max_rows and size <= max_bytes


def fresh_name(wanted: str, *frames: DataFrame) -> str:
    """A column name like ``wanted`` that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def hot_keys(df: DataFrame, on: Sequence[str], splits: str = "splits") -> DataFrame:
    """Keys that hold more than one row in ``HOT_SHARE``, with the number of their splits.

    At most ``HOT_SHARE`` keys can qualify, so the result is always small. A key has as
    many splits as its share asks for, and more where one would pass ``SPLIT_ROWS``.
    """
    rows = fresh_name("key_rows", df)
    counts = df.groupBy(*[named(c) for c in on]).agg(F.count(F.lit(1)).alias(rows))
    total = counts.agg(F.sum(rows)).scalar()
    share = F.col(rows) * HOT_SHARE / total
    return counts.where(share > 1).select(
        *[named(c) for c in on],
        F.greatest(F.ceil(share), F.ceil(F.col(rows) / SPLIT_ROWS)).cast("int").alias(splits),
    )


def _deal(df: DataFrame) -> Column:
    """A hash of the row to deal by, not that which deals out the join keys."""
    hashable = [named(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(1), *hashable)


def split_hot_join(
    big: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Shuffle join that spreads each hot key of ``big`` over several tasks.

    Rows of a hot key are dealt out over its splits and the matching rows of
    ``other`` are repeated once per split, so each pair still meets exactly once.
    Null keys match nothing and are dealt out as well. Rows are dealt by a hash of
    their columns, so a task that is done again deals them as before, in whatever
    order they come to it; rows alike in all columns stay together. ``how``: inner, left,
    left_semi or left_anti.
    """
    on = list(on)
    split, splits = fresh_name("split", big, other), fresh_name("splits", big, other)
    hot = hot_keys(big, on, splits)
    has_null = F.lit(False)
    for name in on:
        has_null = has_null | named(name).isNull()
    deal = _deal(big)
    dealt = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn(
            split,
            F.when(has_null, F.pmod(deal, F.lit(NULL_SPLITS)))
            .when(F.col(splits).isNotNull(), F.pmod(deal, F.col(splits)))
            .otherwise(0)
            .cast("int"),
        )
        .drop(splits)
    )
    repeated = (
        other.join(F.broadcast(hot), on, "left")
        .withColumn(
            split, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(splits), F.lit(1)) - 1))
        )
        .drop(splits)
    )
    return dealt.join(repeated.hint("merge"), [*on, split], how).drop(split)


def equi_join(
    big: DataFrame, other: DataFrame, on: Sequence[str] | str, how: str = "inner"
) -> DataFrame:
    """Equi join that never shuffles ``big`` while ``other`` is measured to be small."""
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(other):
        return big.join(F.broadcast(other), keys, how)
    return split_hot_join(big, other, keys, how)


def listed_join(
    big: DataFrame, other: DataFrame, on: Sequence[str], measured: tuple[int, int] | None = None
) -> DataFrame:
    """Inner equi join for keys of many rows on both sides, where the pairs are the work.

    The rows that ``other`` has of a key become one array a column, so that a row of ``big`` is looked up once and its
    pairs are a loop over arrays, in which conditions put on the result are tried before a row is made. The first of the
    other columns of ``other`` is read for each pair, the rest as asked. Pairs are counted by key before they are made:
    keys of many are dealt to several shares, by rows of ``big`` and lists of ``LIST_ROWS`` rows of ``other``, and there
    are as many tasks as the pairs ask for. Rows are dealt by a hash of their columns, as in :func:`split_hot_join`.
    While ``other`` is small (``measured`` as in :func:`fits_broadcast`) and pairs are few, lists are broadcast and ``big`` isn't shuffled.
    """
    spark, on = big.sparkSession, list(on)
    keys = [named(c) for c in on]
    known = reduce(and_, [k.isNotNull() for k in keys])
    big, other = big.where(known), other.where(known)
    split, part, ours, theirs = (fresh_name(c, big, other) for c in ("split", "part", "big_rows", "other_rows"))
    both = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(ours)).join(other.groupBy(*keys).agg(F.count(F.lit(1)).alias(theirs)), on)
    parts = F.ceil(F.col(theirs) / LIST_ROWS)
    splits = F.ceil(F.col(ours).cast("double") * F.col(theirs) / parts / SHARE_PAIRS)
    hot = F.when((splits > 1) | (parts > 1), F.struct(*keys, splits.cast("int"), parts.cast("int")))
    total, met, repeated, dealt_rows, found = both.agg(
        F.coalesce(F.sum(F.col(ours).cast("double") * F.col(theirs)), F.lit(0.0)),
        F.coalesce(F.sum(ours), F.lit(0)),
        F.coalesce(F.sum(F.col(theirs) * splits), F.lit(0)),
        F.coalesce(F.sum(F.col(ours) * parts), F.lit(0)),
        F.collect_list(hot),  # a row for each SHARE_PAIRS pairs and LIST_ROWS rows at most
    ).first()
    others = [c for c in other.columns if c not in on]
    small = total <= MANY_PAIRS * met and fits_broadcast(other, measured=measured)
    if small:
        left, right, at = big, other, on
    else:
        kinds = {c: other.schema[c].dataType.simpleString() for c in on} | {split: "int", part: "int"}
        schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
        hot_rows = F.broadcast(local_rows(spark, [tuple(r) for r in found], schema))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
        one = lambda df, c: F.pmod(_deal(df), F.coalesce(F.col(c), F.lit(1))).cast("int")
        left = big.join(hot_rows, on, "left").withColumn(split, one(big, split)).withColumn(part, every(part))
        right = other.join(hot_rows, on, "left").withColumn(part, one(other, part)).withColumn(split, every(split))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_PAIRS), math.ceil((repeated + dealt_rows) / TASK_ROWS))
        # One column of one type on both sides, else a constant among the keys has Spark shuffle once more.
        share = fresh_name("share", big, other)
        whole = F.struct(*[named(c) for c in kinds]).cast(f"struct<{', '.join(f'`{c}`: {kind}' for c, kind in kinds.items())}>").alias(share)
        left, right = (df.select(*[named(c) for c in columns], whole).repartition(tasks, share) for df, columns in ((left, big.columns), (right, others)))
        at = [share]
    listed, place = fresh_name("listed", left, right), fresh_name("place", left, right)
    lists = right.groupBy(*[named(c) for c in at]).agg(F.collect_list(F.struct(*[named(c) for c in others])).alias(listed))
    arrays = {c: fresh_name(f"listed_{i}", left, right) for i, c in enumerate(others)}
    lists = lists.select(*[named(c) for c in at], *[F.col(listed).getField(c).alias(a) for c, a in arrays.items()])
    first, *rest = others
    joined = left.join(F.broadcast(lists) if small else lists.hint("shuffle_hash"), at)
    kept, value = [named(c) for c in big.columns], fresh_name("value", left, lists)
    pairs = joined.select(*kept, F.posexplode(named(arrays[first])).alias(place, value), *[named(arrays[c]) for c in rest])
    return pairs.select(*kept, F.col(value).alias(first), *[named(arrays[c])[F.col(place)].alias(c) for c in rest])
