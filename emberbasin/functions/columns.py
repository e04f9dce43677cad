"""Scalar column expressions. Every one is a Spark built-in, so it stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.schemas import NUMERIC_FILLS, TEXT_FILLS

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
MILLIS_ABOVE = 10**12
FIRST_SECOND = -62_135_596_800  # 0001-01-01
LAST_SECOND = 253_402_300_799  # 9999-12-31 23:59:59


def named(name: str) -> Column:
    """The column with exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


# What counts as a number in a text: no type suffixes, no hexadecimal digits.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def number(value: Column, kind: str = "double") -> Column:
    """The number that a text spells, else null."""
    return F.when(value.cast("string").rlike(NUMBER), value.try_cast(kind))


def round_ties_even(value: Column, places: int) -> Column:
    """Round to ``places`` decimals, ties of the scaled value to even.

    Stays in double arithmetic, where ``F.round`` makes a BigDecimal of every
    value. Agrees with Python's rounding but for values that lie within one bit of
    a tie; powers in hundredths of a megawatt and whole hours give none.
    """
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def fills_to_null(
    value: Column,
    kind: T.DataType,
    numeric_fills: Sequence[float] = tuple(NUMERIC_FILLS),
    text_fills: Sequence[str] = (),
) -> Column:
    """Null where the value is one of the fill markers of its type."""
    if is_numeric(kind) and numeric_fills:
        return F.when(~value.isin(list(numeric_fills)), value)
    if isinstance(kind, T.StringType) and text_fills:
        return F.when(~value.isin(list(text_fills)), value)
    return value


def all_fills_to_null(value: Column, kind: T.DataType) -> Column:
    return fills_to_null(value, kind, NUMERIC_FILLS, TEXT_FILLS)


def epoch_to_utc(value: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e12, as a zone-free UTC timestamp.

    Text that is no whole number, and times outside the years 1 to 9999, give null.
    """
    count = value.try_cast("bigint")
    in_range = count.between(FIRST_SECOND, LAST_SECOND * 1000 + 999) & ~count.between(
        LAST_SECOND + 1, MILLIS_ABOVE
    )
    micros = count * F.when(count > MILLIS_ABOVE, 1000).otherwise(1_000_000)
    return F.when(in_range, F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH)))


def float_text(value: Column) -> Column:
    """The text Python gives a float, so that keys match those already stored.

    Both use the shortest digits that read back equal. Java turns to exponents
    below 1e-3, Python below 1e-4 and with at least two exponent digits.
    """
    text = value.cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.abs(F.substring_index(text, "E", -1).try_cast("int"))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(mantissa, r"[-.]", "")
    tiny = F.concat(mantissa, F.lit("e-"), F.lpad(power.cast("string"), 2, "0"))
    small = F.concat(sign, F.lit("0.000"), digits)
    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("nan"))
        .when((size >= 1e-3) | (size == 0), text)
        .when(size >= 1e-4, small)
        .otherwise(tiny)
    )


def detection_key(
    latitude: Column, longitude: Column, acq_date: Column, acq_time: Column, satellite: Column
) -> Column:
    """md5 over position, raw acquisition fields and satellite, joined by underscores."""
    text = [float_text(latitude), float_text(longitude)]
    text += [F.coalesce(c.cast("string"), F.lit("None")) for c in (acq_date, acq_time, satellite)]
    return F.md5(F.concat_ws("_", *text))


def age_hours(timestamp: Column, as_of: Column) -> Column:
    """Whole hours from ``timestamp`` to ``as_of``."""
    return F.timestamp_diff("HOUR", timestamp, as_of).cast("double")


def log_power(value: Column) -> Column:
    """log10 with values below 1 raised to 1; nulls stay null."""
    return F.when(value.isNotNull(), F.log10(F.greatest(value, F.lit(1.0))))


def marker_size(value: Column) -> Column:
    """Value held to at most 500, over 4; nulls stay null."""
    return F.when(value.isNotNull(), F.least(value, F.lit(500.0)) / 4)


def percent_change(before: Column, after: Column) -> Column:
    """``(after - before) / before * 100``; null when ``before`` is zero."""
    return F.try_divide(after - before, before) * 100


def iso_text(timestamp: Column) -> Column:
    """ISO text to the second, with microseconds only where there are any."""
    whole = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(timestamp, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def strip(text: Column) -> Column:
    """Without white space at either end, line breaks and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def box_around(latitude: Column, longitude: Column, buffer_deg: float | Column) -> list[Column]:
    """The four edges of the box ``buffer_deg`` around a centre. No wrap at 180 degrees."""
    by = buffer_deg if isinstance(buffer_deg, Column) else F.lit(float(buffer_deg))
    return [
        (latitude - by).alias("min_lat"),
        (latitude + by).alias("max_lat"),
        (longitude - by).alias("min_lon"),
        (longitude + by).alias("max_lon"),
    ]


def box_centre() -> list[Column]:
    """Centre of a box and its approximate radius in km, at 111 km a degree."""
    return [
        ((F.col("min_lat") + F.col("max_lat")) / 2).alias("centre_lat"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("centre_lon"),
        ((F.col("max_lat") - F.col("min_lat")) / 2 * 111).alias("radius_km"),
    ]


EARTH_KM = 6371.0


def great_circle_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Distance over the globe by the haversine formula, the short way round."""
    a, b = F.radians(lat), F.radians(other_lat)
    up, along = F.sin((b - a) / 2), F.sin(F.radians(other_lon - lon) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), up * up + F.cos(a) * F.cos(b) * along * along)))


def box_around_km(latitude: Column, longitude: Column, km: Column) -> list[Column]:
    """The four edges of the smallest box that holds a circle; may reach past 180 degrees, and is the whole round where it holds a pole."""
    angle = km / EARTH_KM
    by = F.degrees(angle) * (1 + 1e-9) + 1e-9
    south, north = F.greatest(latitude - by, F.lit(-90.0)), F.least(latitude + by, F.lit(90.0))
    pole = (F.abs(latitude) + by >= 90) | (angle >= 1.5)
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(latitude))))) * (1 + 1e-9) + 1e-9
    return [
        south.alias("min_lat"),
        north.alias("max_lat"),
        F.when(pole, F.lit(-180.0)).otherwise(longitude - side).alias("min_lon"),
        F.when(pole, F.lit(180.0)).otherwise(longitude + side).alias("max_lon"),
    ]
