"""Mixing of sources to target weights by entropy balancing.

Of all document rates in [0, ``repeat``], those nearest to 1 in relative entropy that give each source its target of words are
``min(repeat, exp(lambda * size / scale))``, one lambda a source, where scale is the source's words over its documents. The dual is convex and falls apart by source;
its Newton steps (kept between bounds that close in) run as aggregations over the counts of (source, size), which is all
a rate depends on. Sums are of whole numbers, so they don't depend on the order and reruns agree.

Rates are then rounded into copies: each row gets its whole part, and the parts left over are carried from row to
row, longest first, within buckets of a source; a row takes one copy more when the words carried reach half its size.

A null source is a source, sorted last. Null texts have size 0 and one copy, since they cost nothing; so have rows of a source without words.
Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberbasin.llm.common import stored, word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
REPEAT = 3
#: Rows are rounded in buckets of about so many.
BUCKET_ROWS = 20_000
#: Tasks that the rows of one source are dealt to at least.
SALTS = 64
#: Parts of a word that sums of rates are counted in.
UNIT = 1 << 20
ROUNDS = 200


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, source_rows, target: all words shared by weight; no source gets over ``repeat`` times its own.

    ``sizes`` has source and size. The rows of one source a task are summed before the shuffle; what
    is ordered and summed on is one row a source.
    """
    own = sizes.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(order) - 1) % len(weights)
    weighed = own.withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))
    )
    # Sources in the order in which they reach their limit as all targets rise together.
    full = F.col("source_size") * repeat / F.col("_weight")
    rising = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        weighed.withColumn("_full", full)
        .withColumn("_held", F.coalesce(F.sum(F.col("source_size") * repeat).over(before), F.lit(0)))
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.sum("source_size").over(every) - F.col("_held")) / F.col("_open"))
        # The first source that the level of the rest doesn't fill is where the water stands.
        .withColumn("_stands", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(every)["_level"])
    )
    target = F.least(
        F.coalesce(F.col("_stands") * F.col("_weight"), F.lit(float("inf"))), (F.col("source_size") * repeat).cast("double")
    )
    return level.select("source", "source_size", "source_rows", target.alias("target"))


def rate(tilt: Column, size: Column, scale: Column, repeat: int) -> Column:
    """The rate of a document; a tilt of infinity is the limit itself."""
    power = F.least(tilt * size / scale, F.lit(60.0))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(repeat)), F.exp(power)))


def balance(counts: DataFrame, goals: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """source and tilt: the dual's solution, by Newton steps over counts of (source, size)."""
    joined = stored(
        counts.alias("counts").join(goals.alias("goals"), F.expr("counts.source <=> goals.source")).select(
            "counts.source", "size", "n", "target", "source_size",
            (F.col("source_size") / F.col("source_rows")).alias("scale"),
        )
    )
    state = stored(
        goals.select(
            "source",
            "target",
            F.when(F.col("target") >= F.col("source_size") * repeat, float("inf")).otherwise(0.0).alias("tilt"),
            F.lit(-1e9).alias("low"),
            F.lit(1e9).alias("high"),
            (F.col("source_size") == 0).alias("done"),
        ).withColumn("done", F.col("done") | (F.col("tilt") > 0))
    )
    for _ in range(ROUNDS):
        now = joined.alias("c").join(
            state.filter("NOT done").select(F.col("source").alias("_s"), "tilt"), F.expr("c.source <=> _s")
        )
        power = F.col("tilt") * F.col("size") / F.col("scale")
        one = rate(F.col("tilt"), F.col("size"), F.col("scale"), repeat)
        words = F.col("n") * F.col("size")
        slope = F.when(F.exp(F.least(power, F.lit(60.0))) < repeat, one * F.col("size") / F.col("scale")).otherwise(0.0)
        whole = lambda x: F.sum((words * F.round(x * UNIT).cast("long")).cast("decimal(38,0)")).cast("double") / UNIT
        sums = now.groupBy("_s").agg(whole(one).alias("has"), whole(slope).alias("slope"))
        with_sums = state.alias("s").join(sums, F.expr("s.source <=> _s"), "left")
        over = F.col("has") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.greatest("low", "tilt"))
        high = F.when(over, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("has") - F.col("target")) / F.col("slope")
        # Outside its bounds, or without a slope, a step goes to the middle, or further out where a side is still open.
        outward = F.when(over, F.least(F.col("tilt") * 2, F.lit(-1.0))).otherwise(F.greatest(F.col("tilt") * 2, F.lit(1.0)))
        inward = F.when((F.col("_low") > -1e9) & (F.col("_high") < 1e9), (F.col("_low") + F.col("_high")) / 2).otherwise(outward)
        inside = (F.col("slope") > 0) & (newton > F.col("_low")) & (newton < F.col("_high"))
        step = F.when(inside, newton).otherwise(inward)
        near = F.abs(F.col("has") - F.col("target")) <= F.greatest(F.lit(0.25), F.col("target") * 1e-6)
        closed = (F.col("_high") - F.col("_low")) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("tilt"))
        fresh = with_sums.withColumns({"_low": low, "_high": high}).select(
            "s.source", "target",
            F.when(F.col("done") | near | closed, F.col("tilt")).otherwise(step).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(F.col("_low")).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(F.col("_high")).alias("high"),
            (F.col("done") | F.coalesce(near | closed, F.lit(True))).alias("done"),
        )
        state = stored(fresh)
        if state.filter("NOT done").isEmpty():
            return state.select("source", "tilt")
    raise RuntimeError(f"no end after {ROUNDS} rounds")


def rounded_copies(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``copies`` to rows that have source, size and rate; see the module's text."""
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / BUCKET_ROWS)).cast("long")
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), buckets))

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", *keys], ascending=[False, *[True] * len(keys)], kind="stable")
        size, share = frame["size"].to_numpy(np.int64), frame["rate"].to_numpy(np.float64)
        whole = np.floor(share)
        part = np.rint((share - whole) * size * 1024).astype(np.int64)
        copies, carried = whole.astype(np.int64), 0
        for i in np.flatnonzero((part > 0) & (size > 0)):
            carried += int(part[i])
            if 2 * carried >= 1024 * int(size[i]):
                copies[i] += 1
                carried -= 1024 * int(size[i])
        return frame.assign(copies=copies)[[*names, "copies"]]

    return dealt.groupBy("source", "_bucket").applyInPandas(carry, f"{kinds}, copies long")


def mix(rows: DataFrame, keys: Sequence[str], weights: Sequence[float] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """source, size and the whole-number ``keys`` that tell rows apart, with source_size, target, rate and copies; join what else rows have by the keys."""
    rows = rows.select("source", "size", *keys)
    goals = stored(targets(rows, weights, repeat))
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    tilts = balance(counts, goals, repeat)
    per_source = goals.alias("g").join(tilts.alias("t"), F.expr("g.source <=> t.source")).select("g.*", "t.tilt")
    scale = F.col("p.source_size") / F.col("p.source_rows")
    # The rows of a source are dealt to many tasks, and its one row of figures is repeated for each.
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS))
    each = per_source.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    joined = rows.withColumn("_salt", salt).alias("r").join(each.alias("p"), F.expr("r.source <=> p.source AND r._salt = p._salt")).select(
        *[f"r.{c}" for c in rows.columns], "p.source_size", "p.source_rows", "p.target",
        F.when(F.col("p.source_size") == 0, 1.0).otherwise(rate(F.col("p.tilt"), F.col("r.size"), scale, repeat)).alias("rate"),
    )
    return rounded_copies(joined, keys).drop("source_rows")


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """doc_id, size, source, source_size, target, rate and copies of every row of a table with doc_id, text and source."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"),
    )
    return mix(stored(rows), ["doc_id", "mark"], weights, repeat).drop("mark")
