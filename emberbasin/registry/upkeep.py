"""The kept fire table: its layout, its key filter and its summary, each against the same question over plain rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.fixtures import duck, fixture
from emberbasin.functions.filters import DAY_COLUMN
from emberbasin.operators import fires
from emberbasin.operators.cleaning import clean_detections
from emberbasin.registry.base import ORACLES, query, rounded
from emberbasin.registry.cleaning import CLEAN_FEED
from emberbasin.registry.fires import MASS_CTE, TOTALS
from emberbasin.registry.sources import _new_table
from emberbasin.schemas import FIRES
from emberbasin.sources import keyindex, layout, rollup

WITH = duck("fires")
COLUMNS = ", ".join(FIRES.fieldNames())


@query(ORACLES["fires_by_location"])
def layout_fires_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _new_table(spark, "curve")
    stored = layout.write_along_curve(fixture(spark, sf_dir, "fires"), table)
    return fires.fires_in_box(stored, -35, 10, -80, -35, "2024-01-10", "2024-01-20")


@query(f"{WITH} SELECT {COLUMNS} FROM fires")
def layout_rewritten_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends in order of arrival, then every second day and last all days written anew."""
    table, rows = _new_table(spark, "rewritten"), fixture(spark, sf_dir, "fires")
    for even in (True, False):
        part = rows.where((F.pmod(F.xxhash64("uid"), F.lit(2)) == 0) == even)
        dated = part.withColumn(DAY_COLUMN, F.to_date("acquisition_timestamp"))
        dated.select(*FIRES.fieldNames(), DAY_COLUMN).write.insertInto(table)
    days = [r[0] for r in spark.table(table).select(DAY_COLUMN).distinct().collect()]
    layout.rewrite_days(spark, table, sorted(days)[::2])
    return layout.rewrite_days(spark, table).select(*FIRES.fieldNames())


@query(f"{CLEAN_FEED} SELECT DISTINCT * FROM clean")
def index_incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_detections(fixture(spark, sf_dir, "feed"))
    name = _new_table(spark, "indexed")
    early = rows.where(F.col("hours_old") > 240)
    for batch in (early, rows, early):
        keyindex.append_indexed(batch, name)
    return spark.table(name).select(*FIRES.fieldNames())


def _summarised(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The fires in three batches of any days, the last of them of early days again; one day's summary is made untrue."""
    table, rows = _new_table(spark, name), fixture(spark, sf_dir, "fires")
    rollup.create_rollup(spark, table)
    part = F.pmod(F.xxhash64("uid"), F.lit(3))
    late = F.col("hours_old") > 400
    for batch in (rows.where(late & (part > 0)), rows.where(~late), rows.where(late & (part == 0))):
        keyindex.append_indexed(batch, table, [rollup.add_batch])
    return table


@query(
    f"""{WITH} SELECT confidence, satellite, CAST(acquisition_timestamp AS DATE) AS {DAY_COLUMN}, count(*) AS fire_count FROM fires
    WHERE acquisition_timestamp >= '2024-01-04 07:30:00' AND acquisition_timestamp < '2024-01-22 19:45:10' GROUP BY ALL"""
)
def rollup_count_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _summarised(spark, sf_dir, "between")
    groups = ["confidence", "satellite", DAY_COLUMN]
    found = rollup.totals(spark, datetime(2024, 1, 4, 7, 30), datetime(2024, 1, 22, 19, 45, 10), table, group_by=groups)
    return found.select(*groups, "fire_count")


@query(
    f"""{WITH}{MASS_CTE} SELECT {TOTALS} FROM masses
    WHERE latitude BETWEEN -33.3 AND 41.75 AND longitude BETWEEN -120.25 AND 60.5
      AND acquisition_timestamp >= '2024-01-03 12:00:00' AND acquisition_timestamp < '2024-01-27 06:00:00'"""
)
def rollup_box_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _summarised(spark, sf_dir, "emissions")
    found = rollup.totals(spark, datetime(2024, 1, 3, 12), datetime(2024, 1, 27, 6), table, box=(-33.3, 41.75, -120.25, 60.5))
    return rounded(rollup.emission_answer(found), places=0)


@query(
    f"""{WITH} SELECT day_night, count(*) AS fire_count FROM fires
    WHERE confidence = 'high' AND latitude BETWEEN -60 AND 60 AND longitude BETWEEN -180 AND 180
      AND acquisition_timestamp >= '2024-01-01' AND acquisition_timestamp < '2024-02-01' GROUP BY day_night"""
)
def rollup_after_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked when some groups are of several batches, some days are compacted, and one day's summary is missing."""
    table = _summarised(spark, sf_dir, "late")
    days = rollup.true_days(spark, table, datetime(2024, 1, 1).date(), datetime(2024, 1, 31).date())
    rollup.compact(spark, table, days[::2])
    spark.sql(f"ALTER TABLE {rollup.rollup_name(table)} DROP PARTITION ({DAY_COLUMN} = DATE'{days[3]}')")
    found = rollup.totals(
        spark, datetime(2024, 1, 1), datetime(2024, 2, 1), table, (-60, 60, -180, 180), ["day_night"], confidence="high"
    )
    return found.select("day_night", "fire_count")
