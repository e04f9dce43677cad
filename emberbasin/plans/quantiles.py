"""Exact quantiles that never gather a whole column in one task.

Spark's ``percentile`` keeps a map of every distinct value of a group in one
task's memory. That is right for a measured small input only. Beyond it the
wanted ranks are narrowed down: values are counted, cut points split them into
ranges of about equal many distinct values, running sums over the few ranges
tell which range holds a rank, and only that range is looked into further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberbasin.plans.lineage import cut_lineage

GATHER_ROWS = 2_000_000
LEFT_ROWS = 1_000_000
RANGES = 64
ACCURACY = 10_000


def too_many_to_gather(df: DataFrame, values_per_row: int = 1) -> bool:
    """Whether the values are more than one task should hold. Counts rows without reading columns."""
    return df.count() * values_per_row > GATHER_ROWS


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    distributed: bool | None = None,
) -> DataFrame:
    """``by, prob, quantile`` with linear interpolation between neighbours; nulls are left out.

    ``by`` names columns with few distinct values (such as column names of a long
    form). ``distributed=None`` counts the rows and decides.
    """
    known = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    if distributed is None:
        distributed = too_many_to_gather(df)
    if not distributed:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        found = known.groupBy(*by).agg(F.percentile("v", levels).alias("q"))
        pairs = F.arrays_zip(levels.alias("prob"), F.col("q").alias("quantile"))
        return found.select(*by, F.inline(pairs).alias("prob", "quantile"))
    return _narrowed(known, list(by), probs)


def _narrowed(known: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    counted = known.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    positions = (
        counted.groupBy(*by)
        .agg(F.sum("n").alias("rows"))
        .select(*by, "rows", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("position", F.col("prob") * (F.col("rows") - 1))
    )
    ranks = positions.select(
        *by,
        "prob",
        F.explode(
            F.array_distinct(F.array(F.floor("position"), F.ceil("position")))
        ).alias("rank"),
    )
    keys = [*by, "prob", "rank"]
    targets = ranks.withColumn("target", F.col("rank"))
    values = cut_lineage(_narrow(counted, by, targets, keys))
    left, before = values.count(), None
    while left > LEFT_ROWS and left != before:
        targets = values.select(*keys, "target").distinct()
        values = cut_lineage(_narrow(values.drop("target"), keys, targets, keys))
        left, before = values.count(), left
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    at_rank = (
        values.withColumn("upto", F.sum("n").over(upto))
        .where("upto > target AND upto - n <= target")
        .select(*keys, "v")
    )
    part = F.first("position") - F.floor(F.first("position"))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    return (
        at_rank.join(F.broadcast(positions), [*by, "prob"])
        .groupBy(*by, "prob")
        .agg(F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high).alias("quantile"))
    )


def _narrow(
    values: DataFrame, group: list[str], targets: DataFrame, keys: list[str]
) -> DataFrame:
    """For each target rank, only the range of its group's values that holds it.

    ``values`` has ``group, v, n`` and ``targets`` has ``keys, target``; the result
    has ``keys, v, n, target`` with the target counted from the start of the range.
    There are few groups and targets, so both are broadcast along with the cut points.
    """
    levels = [i / RANGES for i in range(1, RANGES)]
    cuts = values.groupBy(*group).agg(F.percentile_approx("v", levels, ACCURACY).alias("cuts"))
    ranged = values.join(F.broadcast(cuts), group).select(
        *group, "v", "n", F.size(F.filter("cuts", lambda cut: cut < F.col("v"))).alias("range")
    )
    upto = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (
        ranged.groupBy(*group, "range")
        .agg(F.sum("n").alias("size"))
        .withColumn("before", F.sum("size").over(upto) - F.col("size"))
    )
    chosen = (
        sizes.join(F.broadcast(targets), group)
        .where("before <= target AND target < before + size")
        .select(*keys, "range", (F.col("target") - F.col("before")).alias("target"))
    )
    return ranged.join(F.broadcast(chosen), [*group, "range"]).select(*keys, "v", "n", "target")
