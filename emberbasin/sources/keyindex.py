"""A compact filter of the keys that a fire table holds, day by day, kept beside the table.

For each day the filter holds sorted 40-bit hashes of its uids, delta-packed by Parquet: two or three bytes a key where
the uid itself takes thirty-two. A batch meets the filter first. What it hasn't is new for certain; only days on
which the filter knows a key of the batch have their uids read, for the exact anti join.

Keys go into the filter before their rows go into the table. So if a job ends between the two the filter has
keys too many, which cost a look at the uids, and never too few. Before use, a day's keys in the filter are counted against the day's
rows (both counts come from file footers); a day where they differ, because something else has written to the table or a job ended
midway, is treated as if every key may be there, until the filter is built anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.functions.filters import DAY_COLUMN
from emberbasin.plans.lineage import cut_lineage
from emberbasin.schemas import FIRE_TABLE, FIRES
from emberbasin.sources.layout import along_curve
from emberbasin.sources.tables import full_name, on_days, one_per_key, table_exists

BITS = 40


def fingerprint(uid: Column) -> Column:
    """The upper bits of a 64-bit hash of a key; null keys have one as well."""
    return F.shiftrightunsigned(F.xxhash64(uid), 64 - BITS)


def index_name(table: str = FIRE_TABLE) -> str:
    return f"{full_name(table)}_keys"


def create_key_index(spark: SparkSession, table: str = FIRE_TABLE, location: str | None = None) -> str:
    """The filter's table if it isn't there yet, laid out by day like the fire table."""
    name = index_name(table)
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (fingerprint BIGINT, {DAY_COLUMN} DATE) USING parquet "
        f"OPTIONS ('parquet.writer.version' = 'PARQUET_2_0', 'parquet.enable.dictionary' = 'false') "
        f"PARTITIONED BY ({DAY_COLUMN}){at}"
    )
    return name


def _add(keys: DataFrame, name: str) -> None:
    """Adds (fingerprint, day) rows, sorted within each file of a day."""
    dealt = keys.select("fingerprint", DAY_COLUMN).hint("rebalance", DAY_COLUMN)
    dealt.sortWithinPartitions(DAY_COLUMN, "fingerprint").write.insertInto(name)


def build_key_index(spark: SparkSession, table: str = FIRE_TABLE, location: str | None = None) -> DataFrame:
    """The filter anew from the whole table, each key once; also gets rid of keys that never reached the table."""
    name = create_key_index(spark, table, location)
    spark.catalog.refreshTable(full_name(table))
    stored = spark.table(full_name(table)).select(fingerprint(F.col("uid")).alias("fingerprint"), DAY_COLUMN)
    spark.sql(f"TRUNCATE TABLE {name}")
    _add(stored, name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def covered_days(spark: SparkSession, table: str, days: list[date | None]) -> list[date | None]:
    """Those of the days for which the filter holds as many keys as the table has rows; a row a day comes to the driver."""
    rows, keys = (
        {r[0]: r[1] for r in on_days(spark.table(name), days).groupBy(DAY_COLUMN).count().collect()}
        for name in (full_name(table), index_name(table))
    )
    return [d for d in days if keys.get(d, 0) == rows.get(d, 0)]


def may_be_stored(batch: DataFrame, index: DataFrame, days: list[date | None]) -> DataFrame:
    """The batch rows with ``maybe``: whether the filter knows the key on the row's day. ``batch`` has ``fingerprint`` and the day.

    The filter's rows of those days are read, two narrow columns. No key is hot on either side: the batch has each once.
    """
    known = on_days(index, days).select("fingerprint", F.coalesce(DAY_COLUMN, F.lit("0001-01-01").cast("date")).alias("_day"))
    keyed = batch.withColumn("_day", F.coalesce(DAY_COLUMN, F.lit("0001-01-01").cast("date")))
    met = keyed.join(known.distinct().withColumn("_known", F.lit(True)), ["fingerprint", "_day"], "left")
    return met.withColumn("maybe", F.coalesce("_known", F.lit(False))).drop("_known", "_day")


def append_indexed(
    batch: DataFrame, table: str = FIRE_TABLE, after: Sequence[Callable[[DataFrame, str], None]] = ()
) -> DataFrame:
    """``append_detections`` by way of the filter: the same rows are added, fewer are read. Returns the table.

    A batch without rows changes nothing; a filter that isn't there yet is built first. Rows without a uid are always new, as there.
    ``after`` are called with the rows that were added and the table, such as ``rollup.add_batch``.
    """
    spark = batch.sparkSession
    name, index = full_name(table), index_name(table)
    if not table_exists(spark, index):
        build_key_index(spark, table)
    for one in (name, index):
        spark.catalog.refreshTable(one)
    dated = one_per_key(batch).withColumn(DAY_COLUMN, F.to_date("acquisition_timestamp"))
    # Written once: the batch is asked three times, and what is asked has to be what is written.
    rows = cut_lineage(dated.withColumn("fingerprint", fingerprint(F.col("uid"))))
    days = [r[0] for r in rows.select(DAY_COLUMN).distinct().collect()]  # a row a day
    if not days:
        return spark.table(name)
    covered = covered_days(spark, table, days)
    on_covered = F.lit(False)
    for day in covered:
        on_covered = on_covered | (F.col(DAY_COLUMN).isNull() if day is None else F.col(DAY_COLUMN) == F.lit(day))
    flagged = cut_lineage(
        may_be_stored(rows, spark.table(index), days).withColumn("maybe", F.col("maybe") | ~F.coalesce(on_covered, F.lit(False)))
    )
    asked = [r[0] for r in flagged.where("maybe").select(DAY_COLUMN).distinct().collect()]
    fresh = flagged.where("NOT maybe")
    if asked:
        stored = on_days(spark.table(name), asked).select("uid")
        fresh = fresh.unionByName(flagged.where("maybe").join(stored, "uid", "left_anti").select(*flagged.columns))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in FIRES.fields if f.name not in fresh.columns}
    fresh = cut_lineage(fresh.withColumns(missing).select(*FIRES.fieldNames(), DAY_COLUMN, "fingerprint"))
    _add(fresh, index)
    along_curve(fresh.drop("fingerprint").hint("rebalance", DAY_COLUMN)).write.insertInto(name)
    for one in (name, index):
        spark.catalog.refreshTable(one)
    for keep in after:
        keep(fresh.drop("fingerprint"), name)
    return spark.table(name)
