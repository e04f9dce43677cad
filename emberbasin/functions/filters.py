"""Filter documents, time and box predicates, limits."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.columns import named

DAY = "%Y-%m-%d"
SECOND = "%Y-%m-%d %H:%M:%S"
DAY_COLUMN = "acq_day"


def compile_filters(
    filters: Mapping[str, Any] | None, column: Callable[[str], Column] = named
) -> Column | None:
    """One predicate from a filter document, or None when nothing is asked for.

    A mapping value is a range with ``min`` and/or ``max`` (neither: no condition);
    a list asks for membership (empty: no row); anything else asks for equality,
    which no row meets for None.
    """
    terms: list[Column] = []
    for name, wanted in (filters or {}).items():
        value = column(name)
        if isinstance(wanted, Mapping):
            if "min" in wanted:
                terms.append(value >= F.lit(wanted["min"]))
            if "max" in wanted:
                terms.append(value <= F.lit(wanted["max"]))
        elif isinstance(wanted, (list, tuple, set)):
            terms.append(value.isin(list(wanted)) if wanted else F.lit(False))
        else:
            terms.append(value == F.lit(wanted))
    return reduce(and_, terms) if terms else None


def apply_filters(
    df: DataFrame, filters: Mapping[str, Any] | None, column: Callable[[str], Column] = named
) -> DataFrame:
    condition = compile_filters(filters, column)
    return df if condition is None else df.where(condition)


def apply_limit(df: DataFrame, limit: Any) -> DataFrame:
    """The first ``limit`` rows; anything but a positive whole number means all rows."""
    if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0:
        return df.limit(limit)
    return df


def parse_day(text: str) -> datetime:
    """Midnight of a ``YYYY-MM-DD`` day; ValueError for anything else."""
    return datetime.strptime(text, DAY)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ntz(moment: datetime) -> Column:
    """A zone-free timestamp literal, the same in every session time zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def whole_days(start: str, end: str) -> tuple[datetime, datetime]:
    """First and last whole second of the days from ``start`` to ``end``."""
    first, last = parse_day(start), parse_day(end)
    if last < first:
        raise ValueError(f"End date {end} is before start date {start}")
    return first, last + timedelta(hours=23, minutes=59, seconds=59)


def between_seconds(timestamp: Column, start: str, end: str) -> Column:
    """From 00:00:00 of ``start`` to 23:59:59 of ``end``: a fraction past that last second is out."""
    first, last = whole_days(start, end)
    return timestamp.between(ntz(first), ntz(last))


def on_or_after(timestamp: Column, day: str) -> Column:
    return F.to_date(timestamp) >= F.lit(parse_day(day).date())


def on_or_before(timestamp: Column, day: str) -> Column:
    return F.to_date(timestamp) <= F.lit(parse_day(day).date())


def on_day(timestamp: Column, day: str | date) -> Column:
    wanted = parse_day(day).date() if isinstance(day, str) else day
    return F.to_date(timestamp) == F.lit(wanted)


def between_days(timestamp: Column, start: str, end: str) -> Column:
    """Calendar days, both included, whatever the time of day."""
    return F.to_date(timestamp).between(
        F.lit(parse_day(start).date()), F.lit(parse_day(end).date())
    )


def optional_days(timestamp: Column, start: str | None, end: str | None) -> Column | None:
    terms = []
    if start:
        terms.append(on_or_after(timestamp, start))
    if end:
        terms.append(on_or_before(timestamp, end))
    return reduce(and_, terms) if terms else None


def cutoff_days(as_of: datetime, days: float) -> datetime:
    """``as_of`` less ``days`` (may be a fraction), down to the whole second."""
    return (as_of - timedelta(days=days)).replace(microsecond=0)


def cutoff_midnight(as_of: datetime, days: float) -> datetime:
    """Midnight of the day ``days`` before ``as_of``."""
    return (as_of - timedelta(days=days)).replace(hour=0, minute=0, second=0, microsecond=0)


def within(timestamp: Column, as_of: datetime, **span: float) -> Column:
    """No older than a span before ``as_of``; the span as for ``timedelta``."""
    return timestamp >= ntz(as_of - timedelta(**span))


def in_box(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Both edges included."""
    return F.col("latitude").between(float(min_lat), float(max_lat)) & F.col("longitude").between(
        float(min_lon), float(max_lon)
    )


def with_confidence(df: DataFrame, confidence: str) -> DataFrame:
    """Rows of exactly this confidence; "all" keeps every row. "nominal" leaves out "high"."""
    return df if confidence == "all" else df.where(F.col("confidence") == confidence)


def known_power(df: DataFrame) -> DataFrame:
    """Rows that have what an emission needs."""
    return df.where(F.col("frp_mw").isNotNull() & F.col("hours_old").isNotNull())


def prune_days(
    df: DataFrame, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Only the partitions of a table laid out by day that a time range can touch.

    Goes with the condition on the timestamp itself, which Spark cannot turn into
    one on the partition column. Frames without that column come back as they are.
    """
    if DAY_COLUMN not in df.columns:
        return df
    if first is not None:
        df = df.where(F.col(DAY_COLUMN) >= F.lit(_day(first)))
    if last is not None:
        df = df.where(F.col(DAY_COLUMN) <= F.lit(_day(last)))
    return df


def _day(moment: date) -> date:
    return moment.date() if isinstance(moment, datetime) else moment


def in_days(df: DataFrame, timestamp: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from the calendar day ``start`` to ``end``, either of which may be left open."""
    first, last = (parse_day(d).date() if d else None for d in (start, end))
    wanted = optional_days(F.col(timestamp), start, end)
    return df if wanted is None else prune_days(df.where(wanted), first, last)


def since(df: DataFrame, timestamp: str, moment: datetime) -> DataFrame:
    """Rows at or after a moment."""
    return prune_days(df.where(F.col(timestamp) >= ntz(moment)), moment)
