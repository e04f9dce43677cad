"""Shards of near equal bytes from a k-d tree over metadata.

A node that has to become k shards is cut in two, k // 2 of them on the left, at the weighted
median (the weight is a row's bytes, the fraction is that of the shards) of the dimension in which its rows spread widest,
as a share of the spread of all rows. All nodes of a level are cut together. The cut is exact: sums of bytes over equal
ranges of values narrow it down to few rows, and rows of equal value are cut by a hash of their id and by the id.
The tree has one node a shard, so the driver holds a few hundred numbers whatever the corpus holds.

Null metadata lie below all other values; a dimension without spread is never cut; empty input gives no
rows. Equal rows beyond the reach of the last tie-breaker stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberbasin.llm.common import fresh_names, stored

#: Ranges that a node is summed in at a time.
RANGES = 512
#: Rows a range may have to be cut exactly on the driver, over all nodes.
LAST_ROWS = 20_000
#: Slots are numbered in buckets of about so many rows.
BUCKET_ROWS = 20_000


def ordered_double(value: Column) -> Column:
    """A whole number from 0 to 2^62 in the order of doubles, from their bits without the last two; NaN is above all."""
    size = F.abs(value)
    finite = F.when((size > 0) & (size < float("inf")) & ~F.isnan(size), size)
    # The logarithm may be off by one beside a power of two; below 2^-1022 the bits have no exponent.
    near = F.greatest(F.floor(F.log2(finite)), F.lit(-1022))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when((two(near) > finite) & (near > -1022), near - 1).when(two(near + 1) <= finite, near + 1).otherwise(near)
    bits = (exponent + 1022) * F.lit(1 << 52) + (finite / two(exponent) * float(1 << 52)).cast("long")
    top = F.lit(2047 << 52)
    bits = F.when(size == 0, F.lit(0).cast("long")).when(F.isnan(size), top + F.lit(4)).when(size == float("inf"), top).otherwise(bits)
    half = F.shiftright(bits, 2)
    return F.lit(1 << 61) + F.when((value < 0) & ~F.isnan(size), -half).otherwise(half)


def coordinate(column: Column, kind: str) -> Column:
    """A whole number for any simple value, in the order of the values; null is -1, text is its checksum.

    Dates, times, decimals and doubles are moved so that they lie above null. A decimal of over 18 digits is taken as a double.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = column.cast("long")
    elif kind == "boolean":
        value = column.cast("int").cast("long")
    elif kind == "date":
        value = F.unix_date(column).cast("long") + F.lit(719162)  # days from the year 1
    elif kind == "timestamp":
        value = F.unix_micros(column) + F.lit(63_000_000_000_000_000)  # more than there are from the year 1
    elif kind == "timestamp_ntz":
        seconds = (F.unix_date(column.cast("date")).cast("long") + F.lit(719162)) * 86_400 + F.hour(column) * 3600 + F.minute(column) * 60
        value = seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    elif kind.startswith("decimal") and int(kind[len("decimal(") : -1].split(",")[0]) <= 18:
        value = F.floor(column * F.lit(Decimal(10 ** int(kind[:-1].split(",")[1])))).cast("long") + F.lit(10**18)
    elif kind in ("float", "double") or kind.startswith("decimal"):
        value = ordered_double(column.cast("double"))
    else:
        value = F.crc32(column.cast("string").cast("binary"))
    return F.coalesce(value, F.lit(-1).cast("long"))


def kd_shards(rows: DataFrame, weight: str, dimensions: Sequence[str], shards: int, tie: Sequence[str]) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1); columns of rows that are named so, or like the work columns ``_tie`` and ``_node``, come back as they are,
    and then the shard has underscores in front.

    ``dimensions`` are whole-number columns without nulls; ``tie`` are columns that tell rows of equal value apart.
    """
    (out,) = fresh_names(rows, "shard")
    clash = {n: f for n, f in zip(rows.columns, fresh_names(rows, *[f"_kept{i}" for i in range(len(rows.columns))])) if n.lower() in ("_tie", "_node")}
    if clash:
        moved = rows.withColumnsRenamed(clash)
        found = kd_shards(moved, clash.get(weight, weight), [clash.get(c, c) for c in dimensions], shards, [clash.get(c, c) for c in tie])
        return found.withColumnsRenamed({f: n for n, f in clash.items()})
    names = rows.columns
    # Ties: a hash, so that equal values are cut evenly, then nothing more: rows with one hash are equal rows.
    work = rows.withColumn("_tie", F.xxhash64(*tie)).withColumn("_node", F.lit(0))
    columns = [*dimensions]
    spread = work.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    if spread[0] is None:
        return rows.withColumn(out, F.lit(0))
    overall = {c: max(1, spread[2 * i + 1] - spread[2 * i]) for i, c in enumerate(columns)}
    leaves: dict[int, tuple[int, int]] = {}  # a node's first shard and how many it becomes
    open_nodes = {0: (0, shards)}
    node = F.lit(0)  # a row's node, as an expression that grows by one step a level
    made = 1
    while open_nodes:
        leaves |= {n: v for n, v in open_nodes.items() if v[1] == 1}
        open_nodes = {n: v for n, v in open_nodes.items() if v[1] > 1}
        if not open_nodes:
            break
        here = work.withColumn("_node", node).filter(F.col("_node").isin([*open_nodes]))
        sums = here.groupBy("_node").agg(
            F.sum(weight).alias("_w"), *[f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
        ).collect()  # one row a node
        goals, chosen = {}, {}
        for r in sums:
            wide = max(range(len(columns)), key=lambda i: ((r[f"_hi{i}"] - r[f"_lo{i}"]) / overall[columns[i]], -i))
            chosen[r["_node"]] = (columns[wide], r[f"_lo{wide}"], r[f"_hi{wide}"])
            goals[r["_node"]] = r["_w"] * (open_nodes[r["_node"]][1] // 2) / open_nodes[r["_node"]][1]
        cuts = _cuts(here, weight, chosen, goals)
        step, after = node, {}
        for n, (first, k) in open_nodes.items():
            left, right = made, made + 1
            made += 2
            if n in cuts:
                value, tie_value = cuts[n]
                column = F.col(chosen[n][0])
                below = (column < value) | ((column == value) & (F.col("_tie") < tie_value))
            else:
                below = F.lit(True)
            step = F.when(node == n, F.when(below, left).otherwise(right)).otherwise(step)
            after |= {left: (first, k // 2), right: (first + k // 2, k - k // 2)}
        open_nodes = after
        # The node goes to a written table, so that the expression stays short.
        work = stored(work.withColumn("_node", step))
        node = F.col("_node")
    shard = F.lit(0)
    for n, (first, _) in leaves.items():
        shard = F.when(node == n, first).otherwise(shard)
    return work.select(*names, shard.cast("int").alias(out))


def _cuts(here: DataFrame, weight: str, chosen: dict, goals: dict) -> dict[int, tuple[int, int]]:
    """By node: (value, tie) of the first row on the right."""
    low, high, start, key = {}, {}, {n: 0 for n in chosen}, {n: "value" for n in chosen}
    value_of = F.lit(0)
    for n, (column, lo, hi) in chosen.items():
        value_of = F.when(F.col("_node") == n, F.col(column)).otherwise(value_of)
        low[n], high[n] = lo, hi
    here = here.select("_node", F.col(weight).alias("_w"), value_of.alias("_v"), "_tie")
    at: dict[int, int] = {}  # the value in which the cut lies, once it is one value
    while True:
        bucket, within = F.lit(0), F.lit(False)
        for n in chosen:
            x = F.col("_tie") if key[n] == "tie" else F.col("_v")
            inside = (F.col("_node") == n) & x.between(low[n], high[n])
            if key[n] == "tie":
                inside &= F.col("_v") == at[n]
            width = (high[n] - low[n]) // RANGES + 1
            # As decimals, since the span of a hash is over a long; a span of values may be over what a double holds, so the rest goes first.
            place = F.floor((x.cast("decimal(38,0)") - F.lit(low[n]).cast("decimal(38,0)")) / F.lit(width).cast("decimal(20,0)")) if key[n] == "tie" else F.round((x - low[n] - (x - low[n]) % F.lit(width)) / F.lit(width))
            bucket = F.when(F.col("_node") == n, place.cast("long")).otherwise(bucket)
            within |= inside
        sums = here.filter(within).groupBy("_node", bucket.alias("_b")).agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[int, list] = {}
        for r in sums:  # at most RANGES + 1 rows a node
            by.setdefault(r["_node"], []).append((r["_b"], r["w"], r["n"]))
        rows_left = 0
        for n, found in by.items():
            done = start[n]
            width = (high[n] - low[n]) // RANGES + 1
            for b, w, count in sorted(found):
                last = (b, w, count)
                if done + w >= goals[n]:
                    break
                done += w
            else:
                done -= last[1]
            start[n] = done
            low[n], high[n] = low[n] + last[0] * width, min(high[n], low[n] + (last[0] + 1) * width - 1)
            rows_left += last[2]
            if low[n] == high[n] and key[n] == "value":
                at[n], key[n], low[n], high[n] = low[n], "tie", -(2**63), 2**63 - 1
        if rows_left <= LAST_ROWS or all(key[n] == "tie" and low[n] == high[n] for n in chosen):
            break
    within = F.lit(False)
    for n in chosen:
        inside = (F.col("_node") == n) & (
            ((F.col("_v") == at[n]) & F.col("_tie").between(low[n], high[n])) if key[n] == "tie" else F.col("_v").between(low[n], high[n])
        )
        within |= inside
    few = here.filter(within).groupBy("_node", "_v", "_tie").agg(F.sum("_w").alias("w")).collect()  # at most LAST_ROWS, or one a node
    by = {}
    for r in few:
        by.setdefault(r["_node"], []).append((r["_v"], r["_tie"], r["w"]))
    cuts = {}
    for n, found in by.items():
        done, found = start[n], sorted(found)
        for i, (v, tie, w) in enumerate(found):
            if done + w >= goals[n]:
                # The nearer of the two sides.
                if done + w - goals[n] <= goals[n] - done:
                    cuts[n] = (found[i + 1][0], found[i + 1][1]) if i + 1 < len(found) else (v, tie + 1) if tie < 2**63 - 1 else (v + 1, -(2**63))
                else:
                    cuts[n] = (v, tie)
                break
            done += w
        else:
            cuts[n] = (found[-1][0] + 1, -(2**63))
    return cuts


def slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard: ranks in hashed buckets, plus the buckets before."""
    names = rows.columns
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    sums = dealt.groupBy(shard, "_bucket").count()
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*names)
    return (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(sums, [shard, "_bucket"])
        .select(*names, (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int, metadata: Sequence[str] = ("source", "lang", "n_chars"), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32, the metadata's coordinates, shard and slot of every row.

    Metadata that the table lacks are left out. The id is a dimension too, the last, so there is always one to cut.
    """
    kinds = dict(docs.dtypes)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    there = [c for c in metadata if c in kinds]
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *[coordinate(F.col(c), kinds[c]).alias(f"_d{i}") for i, c in enumerate(there)],
        coordinate(F.col(id_col).cast("long"), "bigint").alias("_id"),
    )
    base = stored(base)  # a few numbers a row; the texts are read once
    placed = kd_shards(base, "size", [*[f"_d{i}" for i in range(len(there))], "_id"], shards, ["doc_id", "text_crc32", "size"])
    return slots(placed.select("doc_id", "size", "text_crc32", "shard"))
