"""Spatial layout of the fire table: within each day, rows in the order of a space-filling curve.

A box filter is pushed down to Parquet, which skips row groups by their least and greatest latitude and longitude.
In order of arrival each row group spans the globe and none is skipped; along the curve each covers a small area.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.functions.curve import hilbert_key
from emberbasin.functions.filters import DAY_COLUMN
from emberbasin.plans.joins import fresh_name
from emberbasin.plans.lineage import cut_lineage
from emberbasin.schemas import FIRE_TABLE, FIRES

ROWS_PER_FILE = 2_000_000
MOST_FILES = 100_000
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def along_curve(fires: DataFrame) -> DataFrame:
    """The rows of each task by day and place on the curve; those without a place come first. Shuffles nothing."""
    key = fresh_name("curve", fires)
    keyed = fires.withColumn(key, hilbert_key(F.col("latitude"), F.col("longitude")))
    return keyed.sortWithinPartitions(DAY_COLUMN, key).drop(key)


def ranged_along_curve(fires: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """The rows in ranges of day and place on the curve, a task each, of about ``rows_per_file`` rows.

    One shuffle, by sampled ranges, so a day with very many fires has many tasks and a
    quiet month has one. ``fires`` is read three times: counted, sampled and dealt out.
    """
    key = fresh_name("curve", fires)
    keyed = fires.withColumn(key, hilbert_key(F.col("latitude"), F.col("longitude")))
    files = max(1, min(MOST_FILES, -(-fires.count() // rows_per_file)))
    return keyed.repartitionByRange(files, DAY_COLUMN, key).sortWithinPartitions(DAY_COLUMN, key).drop(key)


def write_along_curve(fires: DataFrame, table: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Appends fires to a fire table in this layout, whatever is there already, and returns the table.

    The rows themselves are taken as they are: keys that are stored already are the business
    of ``append_detections``.
    """
    dated = fires.withColumn(DAY_COLUMN, F.to_date("acquisition_timestamp"))
    ranged_along_curve(dated, rows_per_file).select(*FIRES.fieldNames(), DAY_COLUMN).write.insertInto(table)
    return fires.sparkSession.table(table)


def rewrite_days(
    spark: SparkSession, table: str = FIRE_TABLE, days: Sequence[date] | None = None, rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """Days of the table written anew in this layout, all days without ``days``; small files of many appends become few.

    The rows are first written to the checkpoint folder, since a table can't be read while
    it is overwritten. Other days stay as they are. Nothing else may write to these days meanwhile.
    """
    spark.catalog.refreshTable(table)
    stored = spark.table(table)
    if days is not None:
        stored = stored.where(F.col(DAY_COLUMN).isin(list(days)) if days else F.lit(False))
    kept = cut_lineage(stored)
    if kept.isEmpty():
        return spark.table(table)
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        ranged_along_curve(kept, rows_per_file).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)
    spark.catalog.refreshTable(table)
    return spark.table(table)
