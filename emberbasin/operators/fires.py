"""Counts, row lists and statistics over the fire table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.columns import named
from emberbasin.functions.filters import (
    SECOND,
    apply_filters,
    apply_limit,
    between_days,
    between_seconds,
    cutoff_days,
    in_box,
    in_days,
    on_day,
    parse_day,
    prune_days,
    since,
    utc_now,
    whole_days,
    with_confidence,
    within,
)

TIME = "acquisition_timestamp"
ROW_CAP = 1000


def count_fires(
    fires: DataFrame,
    filters: Mapping[str, Any] | None = None,
    group_by: Sequence[str] | None = None,
) -> DataFrame:
    """``fire_count`` of the rows that pass, in all or by group with the largest group first.

    Groups also carry ``total_count``, the sum over all groups.
    """
    kept = apply_filters(fires, filters)
    rows = F.count(F.lit(1)).alias("fire_count")
    if not group_by:
        return kept.agg(rows)
    groups = kept.groupBy(*[named(c) for c in group_by]).agg(rows)
    total = groups.agg(F.sum("fire_count")).scalar()
    return groups.withColumn("total_count", total).orderBy(
        F.desc("fire_count"), *[named(c) for c in group_by]
    )


def count_on_date(
    fires: DataFrame,
    day: str,
    confidence: str = "all",
    group_by: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Fires of one day, up to and including 23:59:59."""
    counted = count_between(fires, day, day, confidence, group_by, filters)
    return counted.withColumnRenamed("start_date", "query_date").drop("end_date", "days_included")


def count_between(
    fires: DataFrame,
    start: str,
    end: str,
    confidence: str = "all",
    group_by: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Fires from ``start`` to ``end``; ValueError when the days are no dates or out of order."""
    first, last = whole_days(start, end)
    timed = prune_days(fires.where(between_seconds(F.col(TIME), start, end)), first, last)
    kept = with_confidence(timed, confidence)
    return count_fires(kept, filters, group_by).withColumns(
        {
            "start_date": F.lit(start),
            "end_date": F.lit(end),
            "days_included": F.lit((last.date() - first.date()).days + 1),
            "range_start": F.lit(first.strftime(SECOND)),
            "range_end": F.lit(last.strftime(SECOND)),
        }
    )


def count_last_days(
    fires: DataFrame,
    days_back: float,
    as_of: datetime | None = None,
    confidence: str = "all",
    group_by: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Fires of the last ``days_back`` days before ``as_of`` (UTC now when not given)."""
    cutoff = cutoff_days(as_of or utc_now(), days_back)
    kept = with_confidence(since(fires, TIME, cutoff), confidence)
    return count_fires(kept, filters, group_by).withColumns(
        {"days_back": F.lit(float(days_back)), "cutoff": F.lit(cutoff.strftime(SECOND))}
    )


def count_each(df: DataFrame, questions: Mapping[str, Column]) -> DataFrame:
    """``question, fire_count`` for many predicates, from one pass over the rows.

    The scan takes only rows that some predicate keeps.
    """
    asked = list(questions.items())
    kept = df.where(reduce(or_, [test for _, test in asked]))
    counts = kept.agg(*[F.count_if(test).alias(f"n{i}") for i, (_, test) in enumerate(asked)])
    answers = [
        F.struct(F.lit(text).alias("question"), F.col(f"n{i}").alias("fire_count"))
        for i, (text, _) in enumerate(asked)
    ]
    return counts.select(F.inline(F.array(*answers)))


def count_windows(
    fires: DataFrame, hours: Sequence[float], as_of: datetime | None = None
) -> DataFrame:
    """Counts for several look-back windows in hours."""
    now = as_of or utc_now()
    reached = prune_days(fires, now - timedelta(hours=max(hours)))
    return count_each(reached, {f"last {h} hours": within(F.col(TIME), now, hours=h) for h in hours})


def count_confidence_windows(
    fires: DataFrame, wanted: Sequence[tuple[str, float]], as_of: datetime | None = None
) -> DataFrame:
    """Counts for several (confidence, hours) pairs."""
    now = as_of or utc_now()
    return count_each(
        prune_days(fires, now - timedelta(hours=max(h for _, h in wanted))),
        {
            f"{level} last {h} hours": (F.col("confidence") == level)
            & within(F.col(TIME), now, hours=h)
            for level, h in wanted
        },
    )


def count_above_power(fires: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Counts strictly above several radiative powers."""
    return count_each(fires, {f"frp > {t}": F.col("frp_mw") > F.lit(float(t)) for t in thresholds})


def count_days(
    fires: DataFrame, days: Sequence[str] = (), ranges: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Counts on several calendar days and day ranges."""
    asked = {day: on_day(F.col(TIME), day) for day in days}
    asked |= {f"{a} to {b}": between_days(F.col(TIME), a, b) for a, b in ranges}
    edges = [parse_day(d) for d in [*days, *(d for pair in ranges for d in pair)]]
    return count_each(prune_days(fires, min(edges), max(edges)), asked)


def fire_statistics(fires: DataFrame, hours: float = 24) -> DataFrame:
    """One row of counts and power statistics over fires at most ``hours`` old."""
    return fires.where(F.col("hours_old") <= hours).agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.avg("frp_mw").alias("avg_frp"),
        F.max("frp_mw").alias("max_frp"),
        F.min("frp_mw").alias("min_frp"),
        F.avg("brightness_temp_i4").alias("avg_brightness"),
        F.count_if(F.col("confidence") == "nominal").alias("nominal_confidence"),
        F.count_if(F.col("confidence") == "low").alias("low_confidence"),
        F.count_if(F.col("day_night") == "D").alias("day_detections"),
        F.count_if(F.col("day_night") == "N").alias("night_detections"),
    )


def time_range(fires: DataFrame) -> DataFrame:
    return fires.agg(F.min(TIME).alias("min_date"), F.max(TIME).alias("max_date"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with ``dup_count``."""
    return (
        df.groupBy(*[named(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .where("dup_count > 1")
    )


def newest(df: DataFrame, limit: int | None) -> DataFrame:
    """Newest rows first; equal times by uid, so that the cut is the same on every run."""
    return apply_limit(df.orderBy(F.desc(TIME), "uid"), limit)


def strongest(df: DataFrame, limit: int | None) -> DataFrame:
    """Highest radiative power first; equal powers by uid."""
    return apply_limit(df.orderBy(F.desc("frp_mw"), "uid"), limit)


def recent_fires(
    fires: DataFrame, hours: float = 24, confidence: str = "nominal", limit: int | None = 100
) -> DataFrame:
    kept = with_confidence(fires.where(F.col("hours_old") <= hours), confidence)
    return newest(kept, limit).select(
        "latitude", "longitude", "brightness_temp_i4", "brightness_temp_i5", "frp_mw",
        "confidence", TIME, "hours_old", "satellite",
    )


def fires_in_box(
    fires: DataFrame,
    min_lat: float,
    max_lat: float,
    min_lon: float,
    max_lon: float,
    start_date: str | None = None,
    end_date: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    boxed = fires.where(in_box(min_lat, max_lat, min_lon, max_lon))
    return newest(in_days(boxed, TIME, start_date, end_date), limit).select(
        "latitude", "longitude", "brightness_temp_i4", "frp_mw", "confidence", TIME, "hours_old"
    )


def intense_fires(
    fires: DataFrame, min_frp: float = 20, hours: float = 72, limit: int | None = 50
) -> DataFrame:
    kept = fires.where((F.col("frp_mw") >= min_frp) & (F.col("hours_old") <= hours))
    return strongest(kept, limit).select(
        "latitude", "longitude", "frp_mw", "brightness_temp_i4", "brightness_temp_i5",
        "confidence", TIME, "hours_old",
    )


def fires_by_date(
    fires: DataFrame,
    start_date: str,
    end_date: str | None = None,
    confidence: str = "all",
    limit: int | None = 100,
) -> DataFrame:
    kept = in_days(fires, TIME, start_date, end_date or start_date)
    return newest(with_confidence(kept, confidence), limit).select(
        "latitude", "longitude", "brightness_temp_i4", "frp_mw", "confidence", TIME,
        "hours_old", "satellite",
    )


def fire_rows(
    fires: DataFrame,
    filters: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Chosen columns of the rows that pass. Which rows a limit keeps is open without ``order_by``."""
    kept = apply_filters(fires, filters)
    if order_by:
        kept = kept.orderBy(*[named(c) for c in order_by])
    kept = apply_limit(kept, limit)
    return kept.select(*[named(c) for c in columns]) if columns else kept


def capped_fire_rows(
    fires: DataFrame,
    filters: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
    limit: int = 100,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """``fire_rows`` as the row tool gives it: 100 rows unless asked, and at most 1000. A limit of 0 or below is no limit, as in ``fire_rows``."""
    return fire_rows(fires, filters, columns, min(limit, ROW_CAP), order_by)
