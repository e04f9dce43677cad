"""Row and aggregate queries over the water-risk tables, with region names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.columns import named
from emberbasin.functions.filters import apply_filters, apply_limit
from emberbasin.plans.joins import equi_join
from emberbasin.schemas import REGION_COLUMNS, REGION_REQUIRED

KEY = "pfaf_id"
REGION = "region_name"
TOOL_ROWS = 10


def region_lookup(baseline: DataFrame) -> DataFrame:
    """Distinct regions of the baseline table with all their names, plus ``region_name``.

    A basin that lies in several provinces has several rows.
    """
    distinct = baseline.select(*REGION_COLUMNS).dropDuplicates()
    return distinct.dropna(subset=REGION_REQUIRED).withColumn(REGION, F.col("name_1"))


def with_region(table: DataFrame, lookup: DataFrame, lookup_mode: str = "all") -> DataFrame:
    """Left join of region names by basin, sides named ``t`` and ``rl``.

    ``lookup_mode="all"`` repeats a row for each region of its basin, as a plain
    join does; ``"one_per_key"`` takes the first region name in text order, so
    that no row is counted twice.
    """
    names = lookup.select(KEY, REGION)
    if lookup_mode == "one_per_key":
        names = names.groupBy(KEY).agg(F.min(REGION).alias(REGION))
    elif lookup_mode != "all":
        raise ValueError(f"lookup_mode is 'all' or 'one_per_key', not {lookup_mode!r}")
    return equi_join(table.alias("t"), names.alias("rl"), KEY, "left")


def water_rows(
    table: DataFrame,
    lookup: DataFrame | None = None,
    filters: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] | None = None,
    lookup_mode: str = "all",
) -> DataFrame:
    """Chosen columns of the rows that pass; with a lookup, ``region_name`` always comes last.

    Conditions on the table's own columns are put before the join.
    """
    if lookup is None:
        kept, chosen = apply_filters(table, filters), list(columns or table.columns)
    else:
        own, joined = split_filters(filters)
        kept = with_region(apply_filters(table, own), lookup, lookup_mode)
        kept = apply_filters(kept, joined)
        chosen = [c for c in (columns or table.columns) if c != REGION] + [REGION]
    if order_by:
        kept = kept.orderBy(*[named(c) for c in order_by])
    return apply_limit(kept, limit).select(*[named(c) for c in chosen])


def split_filters(
    filters: Mapping[str, Any] | None,
) -> tuple[dict[str, Any], dict[str, Any]]:
    """Conditions on the table itself, and those on the joined region name."""
    own = {c: v for c, v in (filters or {}).items() if c != REGION}
    joined = {c: v for c, v in (filters or {}).items() if c == REGION}
    return own, joined


def water_aggregate(
    table: DataFrame,
    expressions: Sequence[str],
    group_by: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
    having: str | None = None,
    lookup: DataFrame | None = None,
    lookup_mode: str = "all",
) -> DataFrame:
    """Caller-written aggregates by group, with a condition on the groups.

    ``having`` may name group columns, aliases, or aggregates that are not selected.
    """
    own, joined = split_filters(filters)
    kept = apply_filters(table, own)
    if lookup is not None:
        kept = apply_filters(with_region(kept, lookup, lookup_mode), joined)
    keys: list[Column] = [named(c) for c in group_by or []]
    result = kept.groupBy(*keys).agg(*[F.expr(e) for e in expressions])
    return result.where(F.expr(having)) if having else result


def rows_for_region(table: DataFrame, key_column: str, key: Any, limit: int = TOOL_ROWS) -> DataFrame:
    """Rows of one region, found by equality on a key column."""
    return water_rows(table, filters={key_column: key}, limit=limit)


def compare_scenarios(
    baseline: DataFrame,
    future: DataFrame,
    lookup: DataFrame,
    baseline_query: Mapping[str, Any],
    future_query: Mapping[str, Any],
    limit: int | None = TOOL_ROWS,
) -> DataFrame:
    """Baseline and future rows of one location in one table, told apart by ``scenario``.

    The queries hold ``filters``, ``columns`` and, to fix which rows a limit keeps,
    ``order_by``. A column that only one side has is null on the other.
    """
    sides = []
    for name, table, query in (
        ("baseline", baseline, baseline_query),
        ("future", future, future_query),
    ):
        rows = water_rows(
            table, lookup, query.get("filters"), query.get("columns"), limit, query.get("order_by")
        )
        sides.append(rows.withColumn("scenario", F.lit(name)))
    return sides[0].unionByName(sides[1], allowMissingColumns=True)
