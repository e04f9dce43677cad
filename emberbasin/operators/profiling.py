"""Table profiles: null counts, distinct counts, describe, top values, histograms, box statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.functions.columns import is_numeric, named
from emberbasin.functions.names import CLEAN_NAME
from emberbasin.plans.local import local_rows
from emberbasin.plans.quantiles import exact_quantiles, too_many_to_gather
from emberbasin.schemas import MONTHLY_INDICATORS

QUARTILES = [0.25, 0.5, 0.75]
HIGH_CARDINALITY = 0.95
TOP_VALUES = 10
BINS = 30


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``column, value`` with each value cast to ``kind``."""
    cells = [
        F.struct(F.lit(c).alias("column"), named(c).cast(kind).alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, object]) -> DataFrame:
    """``column`` and one value per measure, from a single aggregation over all columns."""
    aggregates, cells = [], []
    for i, name in enumerate(columns):
        fields: list[Column] = [F.lit(name).alias("column")]
        for measure, make in measures.items():
            aggregates.append(make(named(name)).alias(f"{measure}_{i}"))
            fields.append(F.col(f"{measure}_{i}").alias(measure))
        cells.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def one_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with -0.0 as 0.0, which are one value but two texts."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floating = [c for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    return df.withColumns({c: (named(c) + F.lit(0.0)).cast(kinds[c]) for c in floating}) if floating else df


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` over the known values as text.

    Equal values are counted before the shuffle, so a value that fills a column
    reaches its task as one row per input task. Both zeros are one value.
    """
    return (
        long_form(one_zero(df, columns), columns, "string")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, null_count, null_fraction, null_percent``, most nulls first."""
    names = list(columns or df.columns)
    counted = _per_column(
        df, names, {"null_count": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1))}
    )
    fraction = F.try_divide("null_count", "rows")
    return counted.select(
        "column",
        "null_count",
        fraction.alias("null_fraction"),
        (fraction * 100).alias("null_percent"),
    ).orderBy(F.desc("null_count"), "column")


def most_null(df: DataFrame, limit: int = 20) -> DataFrame:
    return null_counts(df).select("column", "null_count").limit(limit)


def text_marks(df: DataFrame, marks: Sequence[str] = ("", "NA")) -> DataFrame:
    """``column, mark, n``: how often each text column holds each mark."""
    names = text_columns(df)
    counted = _per_column(
        df,
        names,
        {f"m{i}": (lambda mark: lambda c: F.count_if(c == mark))(m) for i, m in enumerate(marks)},
    )
    rows = [
        F.struct(F.lit(m).alias("mark"), F.col(f"m{i}").alias("n")) for i, m in enumerate(marks)
    ]
    return counted.select("column", F.inline(F.array(*rows)))


def duplicate_count(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: how many rows repeat an earlier one."""
    copies = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def type_report(df: DataFrame) -> DataFrame:
    """``position, column, type`` of every column."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return local_rows(df.sparkSession, rows, "position int, column string, type string")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, unique_count`` of known values; columns without any are there with 0."""
    names = list(columns or df.columns)
    found = value_frequencies(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    every = local_rows(df.sparkSession, [(c,) for c in names], "column string")
    return every.join(found, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("unique_count")
    )


def approximate_distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, lg_size: int = 14
) -> DataFrame:
    """``distinct_counts`` from sketches: one pass, no shuffle of values, for very wide tables.

    The error is about 0.8 / sqrt(2 ** lg_size), under one percent as set.
    """

    def estimate(value: Column) -> Column:
        sketch = F.hll_sketch_agg(value.cast("string"), lg_size)
        return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))

    names = list(columns or df.columns)
    return _per_column(one_zero(df, names), names, {"unique_count": estimate})


def cardinality_flags(df: DataFrame) -> DataFrame:
    """Per column: distinct count, and whether it is constant, all null, or nearly unique."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    share = F.try_divide(F.col("unique_count"), rows.scalar())
    return distinct_counts(df).select(
        "column",
        "unique_count",
        (F.col("unique_count") == 1).alias("is_constant"),
        (F.col("unique_count") == 0).alias("is_all_null"),
        F.coalesce(share > HIGH_CARDINALITY, F.lit(False)).alias("is_high_cardinality"),
    )


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, distributed: bool | None = None
) -> DataFrame:
    """``column, count, mean, std, min, p25, p50, p75, max`` of the numeric columns, exact."""
    names = list(columns or numeric_columns(df))
    if distributed is None:
        distributed = too_many_to_gather(df, len(names))
    basics = _per_column(
        df,
        names,
        {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
        },
    )
    found = exact_quantiles(
        long_form(df, names, "double"), ["column"], "value", QUARTILES, distributed
    )
    quartiles = found.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{p * 100:.0f}") for p in QUARTILES]
    )
    return basics.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, top: int = TOP_VALUES
) -> DataFrame:
    """``column, unique_count, place, value, n``: the most frequent values of each text column.

    Equal frequencies by value. The row-number filter is applied before the
    shuffle by column as well, so a column of any cardinality sends few rows.
    """
    counted = value_frequencies(df, list(columns or text_columns(df)))
    # Counted through n, so that both branches read the same columns and share one shuffle.
    unique = counted.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique_count"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.join(F.broadcast(unique), "column").select(
        "column", "unique_count", "place", "value", "n"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n`` of one column without nulls, most frequent first."""
    return (
        df.where(named(column).isNotNull())
        .groupBy(named(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mode``: the most frequent value, the smallest of equals."""
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("value")))
    return value_frequencies(df, columns).groupBy("column").agg(best["value"].alias("mode"))


def describe_all(df: DataFrame, distributed: bool | None = None) -> DataFrame:
    """Numeric and text columns in one table; measures that do not apply are null."""
    names = text_columns(df)
    counted = value_frequencies(df, names)
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("value")))
    words = (
        counted.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best"))
        .select(
            "column", "count", "unique", F.col("best.value").alias("top"),
            (-F.col("best.order")).alias("freq"),
        )
    )
    every = local_rows(df.sparkSession, [(c,) for c in names], "column string")
    words = every.join(words, "column", "left").withColumns(
        {"count": F.coalesce("count", F.lit(0)), "unique": F.coalesce("unique", F.lit(0))}
    )
    numbers = describe_numeric(df, distributed=distributed)
    return numbers.unionByName(words, allowMissingColumns=True).select(
        "column", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def dataset_summary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two halves of a table summary: numeric statistics, and top values of text columns."""
    return describe_numeric(df), top_values(df)


def column_overview(df: DataFrame) -> DataFrame:
    """Nulls, distinct values, type, a sample value and a name check for every column.

    The sample is the smallest value as text, so that it is the same on every run.
    """
    measured = _per_column(
        df,
        df.columns,
        {
            "null_count": lambda c: F.count_if(c.isNull()),
            "sample_value": lambda c: F.min(c.cast("string")),
        },
    )
    return (
        measured.join(distinct_counts(df), "column")
        .join(F.broadcast(type_report(df)), "column")
        .select(
            "position",
            "column",
            (F.col("null_count") > 0).alias("has_nulls"),
            "null_count",
            "unique_count",
            "type",
            "sample_value",
            F.col("column").rlike(CLEAN_NAME).alias("clean_name"),
        )
    )


def quality_report(df: DataFrame) -> DataFrame:
    """``metric, column, value``: size, duplicates, missing values and cardinality of a table.

    Three passes: sizes and missing values of all columns, copies, distinct values.
    """

    def entry(metric: str, value: Column, column: Column | None = None) -> Column:
        name = F.lit(None) if column is None else column
        return F.struct(
            F.lit(metric).alias("metric"),
            name.cast("string").alias("column"),
            value.cast("double").alias("value"),
        )

    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(named(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    missing = [F.col(f"n{i}") for i in range(len(df.columns))]
    sizes = [
        entry("rows", F.col("rows")),
        entry("columns", F.lit(len(df.columns))),
        entry("missing_values", reduce(add, missing)),
        entry("columns_with_missing", reduce(add, [(m > 0).cast("int") for m in missing])),
    ]
    for name, count in zip(df.columns, missing):
        sizes.append(entry("missing_by_column", count, F.lit(name)))
        share = F.try_divide(count, F.col("rows"))
        sizes.append(entry("missing_fraction", share, F.lit(name)))
    copies = [entry("duplicate_rows", F.col("duplicate_rows"))]
    column = F.col("column")
    kinds = [
        entry("all_missing", F.when(F.col("is_all_null"), 1), column),
        entry("one_unique_value", F.when(F.col("is_constant"), 1), column),
        entry("high_cardinality", F.when(F.col("is_high_cardinality"), F.col("unique_count")), column),
    ]
    return (
        counted.select(F.inline(F.array(*sizes)))
        .unionByName(duplicate_count(df).select(F.inline(F.array(*copies))))
        .unionByName(
            cardinality_flags(df).select(F.inline(F.array(*kinds))).where("value IS NOT NULL")
        )
    )


def monthly_scores(monthly: DataFrame) -> DataFrame:
    """``indicator, month, value`` of the score columns, only values from 0 to 5."""
    cells = [
        F.struct(
            F.lit(indicator).alias("indicator"),
            F.lit(month).alias("month"),
            named(f"{indicator}_{month:02d}_score").cast("double").alias("value"),
        )
        for indicator in MONTHLY_INDICATORS
        for month in range(1, 13)
        if f"{indicator}_{month:02d}_score" in monthly.columns
    ]
    return monthly.select(F.inline(F.array(*cells))).where(F.col("value").between(0, 5))


def monthly_means(monthly: DataFrame) -> DataFrame:
    return (
        monthly_scores(monthly).groupBy("indicator", "month").agg(F.avg("value").alias("mean_score"))
    )


def box_statistics(
    rows: DataFrame, by: Sequence[str], value: str = "value", distributed: bool | None = None
) -> DataFrame:
    """Quartiles, mean, whiskers at 1.5 times the quartile range, and how many values lie beyond."""
    by = list(by)
    known = rows.where(F.col(value).isNotNull())
    found = exact_quantiles(known, by, value, QUARTILES, distributed)
    quartiles = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
          for p, n in zip(QUARTILES, ["q1", "median", "q3"])]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = quartiles.withColumns(
        {"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach}
    )
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return (
        known.join(F.broadcast(fences), by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(value).alias("mean"),
            F.min(F.when(inside, F.col(value))).alias("low_whisker"),
            F.max(F.when(inside, F.col(value))).alias("high_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def monthly_distribution(monthly: DataFrame) -> DataFrame:
    """Box statistics of the valid scores of each indicator and month."""
    return box_statistics(monthly_scores(monthly), ["indicator", "month"])


def histograms(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """``column, bin, low, high, n``: equal bins from least to greatest value, the last one closed.

    A column with a single value gets bins half a unit to either side of it.
    """
    limits = _per_column(
        df,
        columns,
        {"lo": lambda c: F.min(c.cast("double")), "hi": lambda c: F.max(c.cast("double"))},
    ).where("lo IS NOT NULL")
    single = F.col("lo") == F.col("hi")
    limits = limits.select(
        "column",
        F.when(single, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(single, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        long_form(df, columns, "double")
        .where("value IS NOT NULL")
        .join(F.broadcast(limits), "column")
        .groupBy("column", place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = limits.select(
        "column",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("lo"),
        width.alias("width"),
    )
    return every.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + F.col("width") * F.col("bin")).alias("low"),
        (F.col("lo") + F.col("width") * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
