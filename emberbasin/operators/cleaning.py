"""Cleaning steps for raw tables: renames, fill markers, casts, imputation, and the whole recipes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.functions.columns import (
    all_fills_to_null,
    detection_key,
    epoch_to_utc,
    fills_to_null,
    is_numeric,
    named,
    number,
)
from emberbasin.functions.names import (
    FUTURE_CODE,
    MONTHLY_CODE,
    containing,
    ending_with,
    future_long_name,
    month_names,
    monthly_long_names,
    upper_squeezed,
    upper_underscore,
)
from emberbasin.operators.profiling import long_form, modes, numeric_columns, text_columns
from emberbasin.operators.water import region_lookup
from emberbasin.plans.lineage import cut_lineage
from emberbasin.plans.quantiles import GATHER_ROWS, exact_quantiles
from emberbasin.schemas import FEED_NAMES, FIRES, LOADED_CONFIDENCE

NULL_SHARE = 0.80


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns under new names; names that are not there are passed over."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def rename_all(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def keep_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[named(c) for c in wanted if c in df.columns])


def null_fills(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric fill markers to null in the named columns, or all markers in all columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if columns is None:
        changed = {c: all_fills_to_null(named(c), kinds[c]) for c in df.columns}
    else:
        changed = {c: fills_to_null(named(c), kinds[c]) for c in columns}
    return df.withColumns(changed)


def to_numbers(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Casts that give null where the value does not fit, or a text spells no number."""
    kinds = dict(df.dtypes)
    cast = {c: number(named(c), kind) if kinds[c] == "string" else named(c).try_cast(kind) for c in columns}
    return df.withColumns(cast)


def count_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """The row count, and nulls by column, from one pass over all columns."""
    names = list(columns or df.columns)
    rows, *nulls = df.agg(
        F.count(F.lit(1)), *[F.count_if(named(c).isNull()) for c in names]
    ).first()
    return rows, dict(zip(names, nulls))


def drop_mostly_null(df: DataFrame, share: float = NULL_SHARE) -> DataFrame:
    """Without the columns whose null share is above ``share``."""
    rows, nulls = count_nulls(df)
    return df.select(*[named(c) for c, missing in nulls.items() if missing <= share * rows])


def fill_medians(
    df: DataFrame, columns: Sequence[str] | None = None, distributed: bool | None = None
) -> DataFrame:
    """Nulls of numeric columns to the column's median.

    A whole-number column that gets filled becomes double, as its median may lie
    between two whole numbers. A column without values stays null.
    """
    names = list(columns or numeric_columns(df))
    rows, nulls = count_nulls(df, names)
    return _fill_medians(df, [c for c in names if nulls[c]], rows, distributed)


def _fill_medians(
    df: DataFrame, gaps: Sequence[str], rows: int, distributed: bool | None
) -> DataFrame:
    if not gaps:
        return df
    if distributed is None:
        distributed = rows * len(gaps) > GATHER_ROWS
    found = exact_quantiles(
        long_form(df, gaps, "double"), ["column"], "value", [0.5], distributed
    )
    medians = {r["column"]: r["quantile"] for r in found.select("column", "quantile").collect()}
    return df.withColumns(
        {c: F.coalesce(named(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    )


def fill_modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls of text columns to the most frequent text, the smallest of equals."""
    names = list(columns or text_columns(df))
    _, nulls = count_nulls(df, names)
    return _fill_modes(df, [c for c in names if nulls[c]])


def _fill_modes(df: DataFrame, gaps: Sequence[str]) -> DataFrame:
    if not gaps:
        return df
    found = {r["column"]: r["mode"] for r in modes(df, gaps).collect()}
    return df.withColumns({c: F.coalesce(named(c), F.lit(m)) for c, m in found.items()})


def impute(
    df: DataFrame, share: float | None = None, distributed: bool | None = None
) -> DataFrame:
    """Medians and modes into all gaps, mostly-null columns dropped if asked.

    One pass counts the nulls for all three decisions.
    """
    rows, nulls = count_nulls(df)
    if share is not None:
        df = df.select(*[named(c) for c, missing in nulls.items() if missing <= share * rows])
    numbers = [c for c in numeric_columns(df) if nulls[c]]
    texts = [c for c in text_columns(df) if nulls[c]]
    return _fill_modes(_fill_medians(df, numbers, rows, distributed), texts)


def clean_baseline_annual(raw: DataFrame) -> DataFrame:
    """Fill markers of raw and score columns to null."""
    return null_fills(raw, ending_with(raw.columns, "_raw", "_score"))


def clean_future_annual(raw: DataFrame) -> DataFrame:
    """Fill markers of raw and score columns to null, then only rows without any null."""
    return null_fills(raw, ending_with(raw.columns, "_x_r", "_x_s")).dropna("any")


def clean_baseline_monthly(raw: DataFrame) -> DataFrame:
    """Markers to null, copies dropped, numbers as double, categories as int, labels as text.

    Rows with nulls stay, null categories and labels stay null.
    """
    values = containing(raw.columns, "_raw", "_score")
    categories = containing(raw.columns, "_cat")
    labels = containing(raw.columns, "_label")
    kept = null_fills(raw, values).dropDuplicates()
    kept = to_numbers(to_numbers(kept, values), categories, "int")
    return kept.withColumns({c: named(c).cast("string") for c in labels})


def clean_region_lookup(raw: DataFrame) -> DataFrame:
    return region_lookup(raw)


def clean_detections(feed: DataFrame) -> DataFrame:
    """Raw feed rows as fire-table rows: renamed, timed, filtered, keyed.

    Only the fire-table columns that the feed has come out, in table order.
    """
    renamed = rename(feed, FEED_NAMES)
    time = (
        epoch_to_utc(F.col("acquisition_time"))
        if "acquisition_time" in renamed.columns
        else F.lit(None).cast(T.TimestampNTZType())
    )
    timed = renamed.withColumn("acquisition_timestamp", time)
    kept = timed.where(F.col("confidence").isin(LOADED_CONFIDENCE)).dropna(
        subset=["latitude", "longitude", "acquisition_timestamp"]
    )
    keyed = kept.withColumn(
        "uid",
        detection_key(
            F.col("latitude"),
            F.col("longitude"),
            F.col("acquisition_date"),
            F.col("acquisition_time"),
            F.col("satellite"),
        ),
    )
    return keep_present(keyed, FIRES.fieldNames())


def impute_baseline_annual(raw: DataFrame, distributed: bool | None = None) -> DataFrame:
    """Copies dropped, all markers to null, mostly-null columns dropped, medians and modes filled in."""
    return impute(cut_lineage(null_fills(raw.dropDuplicates())), NULL_SHARE, distributed)


def impute_future_annual(raw: DataFrame, distributed: bool | None = None) -> DataFrame:
    """Long upper-case names, the low marker to null, medians and modes filled in."""
    named_out = rename_all(raw, lambda c: upper_underscore(future_long_name(c)))
    kinds = {f.name: f.dataType for f in named_out.schema.fields}
    marked = named_out.withColumns(
        {c: fills_to_null(named(c), k, [-9999]) for c, k in kinds.items() if is_numeric(k)}
    )
    return impute(marked, distributed=distributed)


def impute_baseline_monthly(raw: DataFrame, distributed: bool | None = None) -> DataFrame:
    """Long upper-case names with month names, copies dropped, markers to null, gaps filled in."""
    long_names = rename(raw, monthly_long_names())
    kept = rename_all(long_names, upper_squeezed).dropDuplicates()
    # Written once: nulls, medians, modes and the result all read it.
    marked = cut_lineage(null_fills(kept, numeric_columns(kept)))
    filled = impute(marked, distributed=distributed)
    return filled.toDF(*month_names(filled.columns))


def future_long_form(future: DataFrame, kind: str = "r", key: str = "pfaf_id") -> DataFrame:
    """``key, scenario, year, indicator, value`` of the coded columns of one value type."""
    coded = [c for c in future.columns if c.endswith(f"_x_{kind}")]
    to = "double" if kind in ("r", "s") else "string"
    cells = [
        F.struct(F.lit(c).alias("code"), named(c).cast(to).alias("value")) for c in coded
    ]
    part = [F.regexp_extract("code", FUTURE_CODE, i) for i in (1, 2, 3)]
    return future.select(named(key), F.inline(F.array(*cells))).select(
        key,
        part[0].alias("scenario"),
        (part[1].cast("int") + 2000).alias("year"),
        part[2].alias("indicator"),
        "value",
    )


def monthly_long_form(monthly: DataFrame, kind: str = "score", key: str = "pfaf_id") -> DataFrame:
    """``key, indicator, month, value`` of the monthly columns of one value type."""
    coded = [c for c in monthly.columns if c.endswith(f"_{kind}")]
    to = {"raw": "double", "score": "double", "cat": "int"}.get(kind, "string")
    cells = [
        F.struct(F.lit(c).alias("code"), named(c).cast(to).alias("value")) for c in coded
    ]
    part = [F.regexp_extract("code", MONTHLY_CODE, i) for i in (1, 2)]
    return monthly.select(named(key), F.inline(F.array(*cells))).select(
        key, part[0].alias("indicator"), part[1].cast("int").alias("month"), "value"
    )
