"""Hourly counts and emissions of a detection stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.emissions import emission_totals
from emberbasin.functions.filters import known_power
from emberbasin.streaming.ingest import LATENESS, TIME


def rolling_emissions(
    detections: DataFrame, width: str = "1 hour", lateness: str = LATENESS
) -> DataFrame:
    """Counts and emission totals by time window and confidence.

    Works on a stream (append mode: a window comes out once the watermark has
    passed it) and on a table alike. Sums are combined before the shuffle, and the
    state is one row per open window and confidence.
    """
    timed = known_power(detections).withColumn("event_time", F.col(TIME).cast("timestamp"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", width).alias("window"), "confidence")
        .agg(*emission_totals(F.col("frp_mw"), F.col("hours_old")))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            "confidence",
            "fire_count",
            "total_energy_mj",
            "co2_kg",
            "total_co2e_kg",
        )
    )


SUMS = ["fire_count", "total_energy_mj", "co2_kg", "total_co2e_kg"]


def sliding_emissions(
    detections: DataFrame, span: str = "24 hours", step: str = "1 hour", lateness: str = LATENESS
) -> DataFrame:
    """Counts and emission totals of the last ``span``, anew each ``step``, by confidence; steps without a fire in the span have no row.

    Two aggregations in a row: fires into tumbling windows of one step, then those windows' few rows into the
    spans they are part of. So a fire isn't repeated for each span, sums are combined before the first shuffle whatever share of the fires
    one confidence has, and the state holds a row for each open step, span and confidence. Works on a stream
    (append mode: a span comes out once the watermark has passed its end) and on a table alike.
    """
    timed = known_power(detections).withColumn("event_time", F.col(TIME).cast("timestamp"))
    steps = (
        timed.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", step).alias("step"), "confidence")
        .agg(*emission_totals(F.col("frp_mw"), F.col("hours_old")))
    )
    return (
        steps.groupBy(F.window(F.window_time("step"), span, step).alias("window"), "confidence")
        .agg(*[F.sum(c).alias(c) for c in SUMS])
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            "confidence",
            *SUMS,
        )
    )
