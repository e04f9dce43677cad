"""Country means of present and projected water risk, and the questions asked of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.columns import named, percent_change
from emberbasin.functions.names import resolve_column
from emberbasin.plans.local import local_rows

# Output name -> column averaged per country.
BASELINE_METRICS = {
    "bws_raw": "bws_raw",
    "bws_score": "bws_score",
    "rfr_score": "rfr_score",
    "drr_score": "drr_score",
    "sev_score": "sev_score",
    "iav_score": "iav_score",
    "gtd_raw": "gtd_raw",
    "overall_risk_score": "w_awr_def_tot_score",
}
FUTURE_METRICS = {
    "ws_2030": "bau30_ws_x_r",
    "ws_2050": "bau50_ws_x_r",
    "iv_2050": "bau50_iv_x_r",
}
BASIN_NAMES = ["pfafstetter_id", "pfaf_id"]

# Single-country questions as (question, metric, country).
COUNTRY_QUESTIONS = [
    ("Baseline water stress score", "bws_score", "Brazil"),
    ("Flood risk level", "rfr_score", "China"),
    ("Drought severity score", "drr_score", "Australia"),
    ("Groundwater depletion rate", "gtd_raw", "Mexico"),
    ("Projected water stress in 2030", "ws_2030", "South Africa"),
    ("Seasonal variability score", "sev_score", "Egypt"),
    ("Overall water risk score", "overall_risk_score", "Canada"),
    ("Drought severity score in 2050", "iv_2050", "Spain"),
    ("Flood risk score", "rfr_score", "United States"),
    ("Baseline water stress", "bws_score", "Japan"),
    ("Total renewable water availability", "1 - bws_raw", "Saudi Arabia"),
    ("Water risk index in 2030", "ws_2030", "Pakistan"),
]

# Two-country questions as (question, metric, country, country).
COUNTRY_COMPARISONS = [
    ("Higher baseline water stress", "bws_score", "India", "China"),
    ("Greater drought severity", "drr_score", "Spain", "Italy"),
    ("Higher groundwater depletion", "gtd_raw", "United States", "Mexico"),
    ("Lower flood risk", "rfr_score", "Japan", "South Korea"),
    ("Greater overall water stress", "overall_risk_score", "Egypt", "Sudan"),
    ("Higher projected 2050 stress", "ws_2050", "India", "Pakistan"),
    ("Improved water availability", "bws_score", "Brazil", "Argentina"),
    ("More seasonal variability", "sev_score", "Australia", "South Africa"),
    ("Higher drought in 2050", "iv_2050", "Saudi Arabia", "Iran"),
    ("Larger reduction in flood risk", "rfr_score", "United Kingdom", "France"),
    ("More groundwater stress", "gtd_raw", "India", "Bangladesh"),
    ("Higher total water demand", "ws_2050", "Indonesia", "Malaysia"),
    ("More drought resilience", "drr_score", "Kenya", "Ethiopia"),
    ("Higher flood frequency", "rfr_score", "Thailand", "Vietnam"),
    ("Greater projected improvement", "ws_2050", "Peru", "Chile"),
    ("Higher 2050 drought severity", "iv_2050", "Mexico", "Brazil"),
    ("Larger increase in water stress", "ws_2050", "Nigeria", "Ghana"),
    ("Higher baseline flood risk", "rfr_score", "United States", "Canada"),
    ("Larger flood-risk decrease", "rfr_score", "Germany", "Netherlands"),
    ("Greater flood-drought contrast", "abs(rfr_score - drr_score)", "India", "China"),
]

# The countries of the regional drought question.
MIDDLE_EAST = [
    "Saudi Arabia", "Iran", "Iraq", "UAE", "Jordan", "Oman", "Israel", "Lebanon", "Qatar",
]


def _require(df: DataFrame, columns: Sequence[str], table: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{table} has no column {', '.join(missing)}")


def country_baseline(
    baseline: DataFrame, metrics: Mapping[str, str] = BASELINE_METRICS, country: str = "name_0"
) -> DataFrame:
    """Mean of each metric per country over its basin rows."""
    _require(baseline, [country, *metrics.values()], "the baseline table")
    return baseline.groupBy(named(country).alias("country")).agg(
        *[F.avg(named(column)).alias(name) for name, column in metrics.items()]
    )


def basin_countries(
    baseline: DataFrame, country: str = "name_0", basin: str = "pfaf_id"
) -> DataFrame:
    """The distinct (basin, country) pairs."""
    return baseline.select(
        named(basin).cast("bigint").alias("pfaf"), named(country).alias("country")
    ).distinct()


def country_future(
    future: DataFrame,
    baseline: DataFrame,
    metrics: Mapping[str, str] = FUTURE_METRICS,
    country: str = "name_0",
) -> DataFrame:
    """Mean projections per country: first per basin, then over the basins of the country, unweighted."""
    basin = resolve_column(future.columns, BASIN_NAMES)
    _require(future, list(metrics.values()), "the future table")
    per_basin = future.groupBy(named(basin).cast("bigint").alias("pfaf")).agg(
        *[F.avg(named(column)).alias(name) for name, column in metrics.items()]
    )
    return (
        per_basin.join(basin_countries(baseline, country), "pfaf")
        .groupBy("country")
        .agg(*[F.avg(name).alias(name) for name in metrics])
    )


def continents(mapping: DataFrame) -> DataFrame:
    """Country to continent, both trimmed."""
    return mapping.select(
        F.trim("country").alias("country"), F.trim("continent").alias("continent")
    )


def continent_mean(
    countries: DataFrame, mapping: DataFrame, continent: str, metric: str, places: int = 4
) -> DataFrame:
    """Unweighted mean of a metric over the countries of a continent."""
    members = mapping.where(F.col("continent") == continent).select("country")
    return countries.join(members, "country").agg(F.round(F.avg(metric), places).alias("mean_value"))


def list_mean(
    countries: DataFrame, members: Sequence[str], metric: str, places: int = 4
) -> DataFrame:
    """Unweighted mean of a metric over named countries."""
    kept = countries.where(F.col("country").isin(list(members)))
    return kept.agg(F.round(F.avg(metric), places).alias("mean_value"))


def metric_rows(countries: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``country, metric, value`` in long form; a metric may be any expression over the columns."""
    values = [
        F.struct(F.lit(m).alias("metric"), F.expr(m).cast("double").alias("value"))
        for m in metrics
    ]
    return countries.select("country", F.inline(F.array(*values)))


def country_values(
    countries: DataFrame, questions: Sequence[tuple[str, str, str]], places: int = 4
) -> DataFrame:
    """Answers to (question, metric, country) in one pass; a country without data has no row."""
    asked = local_rows(
        countries.sparkSession, list(questions), "question string, metric string, country string"
    )
    rows = metric_rows(countries, sorted({metric for _, metric, _ in questions}))
    return rows.join(F.broadcast(asked), ["metric", "country"]).select(
        "question", "country", F.round("value", places).alias("value")
    )


def compare_countries(
    countries: DataFrame, comparisons: Sequence[tuple[str, str, str, str]], places: int = 4
) -> DataFrame:
    """Both values of each (question, metric, country, country), larger first within a question."""
    asked = local_rows(
        countries.sparkSession,
        [
            (number, question, metric, country)
            for number, (question, metric, *both) in enumerate(comparisons, 1)
            for country in both
        ],
        "number int, question string, metric string, country string",
    )
    rows = metric_rows(countries, sorted({c[1] for c in comparisons}))
    answers = rows.join(F.broadcast(asked), ["metric", "country"]).select(
        "number", "question", "country", F.round("value", places).alias("value")
    )
    return answers.orderBy("number", F.desc("value"), "country")


def projected_change(
    countries: DataFrame, before: str, after: str, only: Sequence[str] | None = None, places: int = 4
) -> DataFrame:
    """``after - before`` per country. With a score before and a raw value after the units differ."""
    kept = countries if only is None else countries.where(F.col("country").isin(list(only)))
    return kept.select(
        "country",
        F.round(before, places).alias("base"),
        F.round(after, places).alias("future"),
        F.round(F.col(after) - F.col(before), places).alias("change"),
    )


def demand_increase(
    countries: DataFrame, before: str = "ws_2030", after: str = "ws_2050", places: int = 2
) -> DataFrame:
    """Percent change per country; null where the earlier value is zero."""
    change = percent_change(F.col(before), F.col(after))
    return countries.select("country", F.round(change, places).alias("demand_increase_pct"))


def largest_drop(
    countries: DataFrame, before: str, after: str, limit: int = 15, places: int = 4
) -> DataFrame:
    """Countries whose later value is lower, largest drop first."""
    fallen = countries.where(F.col(after) < F.col(before))
    drop = F.round(F.col(before) - F.col(after), places).alias("improvement")
    return fallen.select("country", drop).orderBy(F.desc("improvement"), "country").limit(limit)


def largest_rise(
    countries: DataFrame, before: str, after: str, limit: int = 15, places: int = 4
) -> DataFrame:
    """Countries whose later value is higher, largest rise first."""
    risen = countries.where(F.col(after) > F.col(before))
    rise = F.round(F.col(after) - F.col(before), places).alias("increase")
    return risen.select("country", rise).orderBy(F.desc("increase"), "country").limit(limit)


def flood_rise(
    baseline: DataFrame,
    future: DataFrame,
    before: str = "rfr_score",
    after: str = "bau50_rf_x_r",
    country: str = "name_0",
    limit: int = 15,
) -> DataFrame:
    """Largest rises of a score from the baseline to the future table, both averaged by country.

    KeyError names a column that a table lacks.
    """
    _require(baseline, [country, before], "the baseline table")
    _require(future, [country, after], "the future table")
    now = country_baseline(baseline, {"before": before}, country)
    later = country_baseline(future, {"after": after}, country)
    return largest_rise(later.join(now, "country"), "before", "after", limit)
