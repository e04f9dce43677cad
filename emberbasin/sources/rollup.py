"""A kept summary of the fire table by day, one-degree cell, confidence, satellite and time of day, and answers from it.

Counts and totals over a range of time and a box are the sum of two parts: whole days and whole cells come from the
summary, whose size follows days and places and not fires; what is cut at the edges (the first and last day, the cells that the box's edges
run through) comes from rows, pruned by day and position. Each appended batch adds the groups of its own rows, no matter what
day they are of, so late rows need nothing special. Groups of several batches are summed on reading, and
``compact`` makes them one again.

A day's summary counts as true only while its count equals the table's rows of that day (a count from file footers). Where a job ended between the
table and the summary, or something else has written, the day is answered from rows until ``refresh`` does it anew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.functions.columns import named
from emberbasin.functions.emissions import emission_columns
from emberbasin.functions.filters import DAY_COLUMN, in_box, ntz
from emberbasin.operators.fires import TIME
from emberbasin.plans.lineage import cut_lineage
from emberbasin.schemas import FIRE_TABLE
from emberbasin.sources.layout import OVERWRITE_MODE
from emberbasin.sources.tables import full_name, on_days

GROUPS = ["confidence", "satellite", "day_night"]
CELL = ["cell_lat", "cell_lon"]
MASSES = ["total_energy_mj", "co2_kg", "ch4_kg", "n2o_kg", "co_kg", "total_co2e_kg"]
MEASURES = ["fire_count", "power_count", *MASSES]
Box = tuple[float, float, float, float]


def rollup_name(table: str = FIRE_TABLE) -> str:
    return f"{full_name(table)}_rollup"


def create_rollup(spark: SparkSession, table: str = FIRE_TABLE, location: str | None = None) -> str:
    """The summary's table if it isn't there yet, laid out by day."""
    name = rollup_name(table)
    columns = [f"{c} INT" for c in CELL] + [f"{c} STRING" for c in GROUPS]
    columns += ["fire_count BIGINT", "power_count BIGINT"] + [f"{c} DOUBLE" for c in MASSES]
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}, {DAY_COLUMN} DATE) USING parquet PARTITIONED BY ({DAY_COLUMN}){at}")
    return name


def measures() -> list[Column]:
    """Counts and emission sums over rows; masses are those of rows with power and age, rounded row by row as everywhere."""
    power = F.col("frp_mw").isNotNull() & F.col("hours_old").isNotNull()
    masses = emission_columns(F.col("frp_mw"), F.col("hours_old"))
    sums = [F.coalesce(F.sum(F.when(power, masses[m])), F.lit(0.0)).alias(m) for m in MASSES]
    return [F.count(F.lit(1)).alias("fire_count"), F.count_if(power).alias("power_count"), *sums]


def summed() -> list[Column]:
    """The same measures over groups."""
    return [F.coalesce(F.sum(m), F.lit(0).cast("long" if m.endswith("_count") else "double")).alias(m) for m in MEASURES]


def cells() -> list[Column]:
    positions = zip(("latitude", "longitude"), CELL)
    return [F.when(~F.isnan(p), F.floor(p)).cast("int").alias(name) for p, name in positions]


def summary(fires: DataFrame) -> DataFrame:
    """The groups of rows that have the day column; combined before the shuffle, so a hot cell is no hot task."""
    return fires.select("*", *cells()).groupBy(*CELL, *GROUPS, DAY_COLUMN).agg(*measures())


def _add(groups: DataFrame, name: str) -> None:
    columns = [*CELL, *GROUPS, *MEASURES, DAY_COLUMN]
    groups.select(*columns).hint("rebalance", DAY_COLUMN).sortWithinPartitions(DAY_COLUMN, *CELL).write.insertInto(name)
    groups.sparkSession.catalog.refreshTable(name)


def add_batch(fresh: DataFrame, table: str = FIRE_TABLE) -> None:
    """Adds the rows that were just appended to the table, and reads nothing else."""
    _add(summary(fresh.withColumn(DAY_COLUMN, F.to_date(TIME))), rollup_name(table))


def _overwrite(groups: DataFrame, name: str) -> None:
    spark = groups.sparkSession
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        groups.select(*[c for c in spark.table(name).columns]).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)
    spark.catalog.refreshTable(name)


def refresh(spark: SparkSession, table: str = FIRE_TABLE, days: Sequence[date | None] | None = None) -> None:
    """The summary of these days anew from rows, of all days without ``days``."""
    fires = spark.table(full_name(table))
    _overwrite(cut_lineage(summary(fires if days is None else on_days(fires, days))), rollup_name(table))


def compact(spark: SparkSession, table: str = FIRE_TABLE, days: Sequence[date | None] | None = None) -> None:
    """One row for each group where several batches left several."""
    groups = spark.table(rollup_name(table))
    groups = groups if days is None else on_days(groups, days)
    _overwrite(cut_lineage(groups.groupBy(*CELL, *GROUPS, DAY_COLUMN).agg(*summed())), rollup_name(table))


def true_days(spark: SparkSession, table: str, first: date, last: date) -> list[date]:
    """Days from ``first`` to ``last`` whose summary counts as many fires as the table has rows; a row a day comes to the driver."""
    within = F.col(DAY_COLUMN).between(F.lit(first), F.lit(last))
    rows = spark.table(full_name(table)).where(within).groupBy(DAY_COLUMN).agg(F.count(F.lit(1)).alias("n"))
    kept = spark.table(rollup_name(table)).where(within).groupBy(DAY_COLUMN).agg(F.sum("fire_count").alias("kept"))
    both = rows.join(kept, DAY_COLUMN, "full").where("n <=> kept")
    return sorted(r[0] for r in both.select(DAY_COLUMN).collect())


def whole_days_of(start: datetime, end: datetime) -> tuple[date, date]:
    """First and last day that lie wholly from ``start`` up to ``end`` (not included); the last is before the first where none does."""
    first = start.date() if start == datetime.combine(start.date(), datetime.min.time()) else start.date() + timedelta(days=1)
    return first, end.date() - timedelta(days=1)


def whole_cells(box: Box) -> tuple[int, int, int, int]:
    """First and last cell on both axes that lie wholly in a box; the last is before the first where none does."""
    south, north, west, east = box
    return math.ceil(south), math.floor(north) - 1, math.ceil(west), math.floor(east) - 1


def _time(start: datetime, end: datetime) -> Column:
    return (F.col(TIME) >= ntz(start)) & (F.col(TIME) < ntz(end))


def totals(
    spark: SparkSession,
    start: datetime,
    end: datetime,
    table: str = FIRE_TABLE,
    box: Box | None = None,
    group_by: Sequence[str] = (),
    confidence: str = "all",
) -> DataFrame:
    """MEASURES of the fires from ``start`` up to ``end`` (not included) in ``box`` (edges included), by groups of GROUPS and the day.

    The same numbers as an aggregation of all rows gives. Without groups there is one row, also when no fire is found.
    """
    if unknown := set(group_by) - {*GROUPS, DAY_COLUMN}:
        raise ValueError(f"no groups in the summary: {', '.join(sorted(unknown))}")
    fires, kept = spark.table(full_name(table)), spark.table(rollup_name(table))
    if confidence != "all":
        fires, kept = (df.where(F.col("confidence") == confidence) for df in (fires, kept))
    first, last = whole_days_of(start, end)
    days = true_days(spark, table, first, last) if first <= last else []
    in_days = F.col(DAY_COLUMN).isin(days) if days else F.lit(False)
    inside = [in_days]
    spans = [F.col(DAY_COLUMN).between(F.lit(start.date()), F.lit(end.date())), _time(start, end)]
    if box is not None:
        spans.append(in_box(*box))
    asked = fires.where(reduce(and_, spans))
    rows = asked.where(~in_days)  # also rows of a whole day that the summary doesn't answer
    if box is not None:
        south, north, west, east = whole_cells(box)
        inside += [F.col(CELL[0]).between(south, north), F.col(CELL[1]).between(west, east)]
        lat, lon = F.col("latitude"), F.col("longitude")
        some = south <= north and west <= east
        frame = [lat < south, lat >= north + 1, lon < west, lon >= east + 1] if some else [F.lit(True)]
        rows = rows.unionByName(asked.where(in_days).where(reduce(or_, frame)))
    from_rows = rows.groupBy(*map(named, group_by)).agg(*measures())
    from_kept = kept.where(reduce(and_, inside)).groupBy(*map(named, group_by)).agg(*summed())
    return from_rows.unionByName(from_kept).groupBy(*map(named, group_by)).agg(*summed())


def emission_answer(found: DataFrame) -> DataFrame:
    """The columns of ``total_emissions``: fires with power and age are what is counted."""
    others = [c for c in found.columns if c not in MEASURES]
    per_fire = F.try_divide(F.col("total_co2e_kg"), F.col("power_count"))
    return found.select(*map(named, others), F.col("power_count").alias("fire_count"), *MASSES, per_fire.alias("co2e_kg_per_fire"))
