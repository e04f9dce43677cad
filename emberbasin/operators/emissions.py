"""Greenhouse-gas emissions of fires, row by row and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.emissions import emission_columns, emission_totals
from emberbasin.functions.filters import in_box, in_days, known_power
from emberbasin.operators.fires import TIME


def with_emissions(fires: DataFrame, frp: str = "frp_mw", hours: str = "hours_old") -> DataFrame:
    """Each fire with its burning time, energy and gas masses."""
    added = {"duration_hours": F.col(hours)} | emission_columns(F.col(frp), F.col(hours))
    return fires.withColumns(added)


def total_emissions(fires: DataFrame) -> DataFrame:
    """One row of totals over the fires that have power and age."""
    return known_power(fires).agg(*emission_totals(F.col("frp_mw"), F.col("hours_old")))


def recent_emissions(fires: DataFrame, hours: float = 24) -> DataFrame:
    """Totals over fires at most ``hours`` old."""
    return total_emissions(fires.where(F.col("hours_old") <= hours))


def box_emissions(
    fires: DataFrame,
    min_lat: float,
    max_lat: float,
    min_lon: float,
    max_lon: float,
    start_date: str | None = None,
    end_date: str | None = None,
) -> DataFrame:
    """Totals over the fires in a box, by calendar day when days are given."""
    boxed = fires.where(in_box(min_lat, max_lat, min_lon, max_lon))
    return total_emissions(in_days(boxed, TIME, start_date, end_date))
