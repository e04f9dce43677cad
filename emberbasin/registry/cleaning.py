"""Cleaning recipes and their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.fixtures import duck, fixture, table
from emberbasin.functions.columns import percent_change
from emberbasin.functions.names import (
    future_long_name,
    month_names,
    monthly_long_names,
    upper_squeezed,
    upper_underscore,
)
from emberbasin.operators import cleaning
from emberbasin.registry.base import query, rounded
from emberbasin.sources.tables import one_per_key

BASELINE_VALUES = [
    "bws_raw", "bws_score", "rfr_score", "drr_score", "sev_score", "iav_score", "gtd_raw",
    "w_awr_def_tot_score", "gtd_score",
]
FUTURE_COLUMNS = [
    "fid", "pfaf_id", "bau30_ws_x_r", "bau50_ws_x_r", "bau50_iv_x_r", "bau30_ws_x_s",
    "bau30_ws_x_l", "bau30_ws_x_c",
]
FUTURE_VALUES = ["bau30_ws_x_r", "bau50_ws_x_r", "bau50_iv_x_r", "bau30_ws_x_s"]
SCORES = [f"bws_{m:02d}_score" for m in range(1, 13)] + ["iav_01_score", "iav_02_score"]
RAWS = ["bws_01_raw", "bws_02_raw"]
CATEGORIES = ["bws_01_cat", "bws_02_cat"]
LABELS = ["bws_01_label", "bws_02_label"]


def marked(columns: list[str], fills: str = "-9999, 9999") -> str:
    """``* REPLACE`` list that turns the markers of these columns to null."""
    parts = [f"CASE WHEN {c} IN ({fills}) THEN NULL ELSE {c} END AS {c}" for c in columns]
    return "* REPLACE (" + ", ".join(parts) + ")"


def median_of(column: str, source: str) -> str:
    return f"(SELECT median(CAST({column} AS DOUBLE)) FROM {source})"


def mode_of(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    )


@query(f"{duck('baseline')} SELECT {marked(BASELINE_VALUES)} FROM baseline")
def clean_baseline_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_baseline_annual(fixture(spark, sf_dir, "baseline"))


@query(
    f"""{duck('future')} SELECT * FROM (SELECT {marked(FUTURE_VALUES)} FROM future)
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FUTURE_COLUMNS)}"""
)
def clean_future_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_future_annual(fixture(spark, sf_dir, "future"))


@query(
    f"""{duck('monthly')} SELECT DISTINCT {marked(SCORES + RAWS)}
    FROM (SELECT * FROM monthly UNION ALL SELECT * FROM monthly)"""
)
def clean_baseline_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = fixture(spark, sf_dir, "monthly")
    return cleaning.clean_baseline_monthly(monthly.unionByName(monthly))


CLEAN_FEED = f"""{duck('feed')}, timed AS (SELECT *, try_cast(acq_time AS BIGINT) AS t FROM feed),
clean AS (SELECT md5(concat_ws('_', CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR), acq_date,
    acq_time, satellite)) AS uid, latitude, longitude, bright_ti4 AS brightness_temp_i4,
    bright_ti5 AS brightness_temp_i5, frp AS frp_mw,
    make_timestamp(CASE WHEN t > 1000000000000 THEN t * 1000 ELSE t * 1000000 END) AS acquisition_timestamp,
    satellite, version, confidence, daynight AS day_night, hours_old
  FROM timed WHERE t IS NOT NULL AND confidence IN ('nominal', 'high'))"""


@query(f"{CLEAN_FEED} SELECT * FROM clean")
def clean_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_detections(fixture(spark, sf_dir, "feed"))


@query(f"{CLEAN_FEED} SELECT DISTINCT * FROM clean")
def clean_detections_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(cleaning.clean_detections(fixture(spark, sf_dir, "feed")))


LABEL = "CASE WHEN bws_label IN ('', 'N/A', 'nan') THEN NULL ELSE bws_label END AS bws_label"
KEPT_VALUES = [c for c in BASELINE_VALUES if c != "gtd_score"]


@query(
    f"""{duck('baseline')},
    kept AS (SELECT DISTINCT * EXCLUDE (bws_label, gtd_score), {LABEL} FROM baseline),
    marked AS (SELECT {marked(KEPT_VALUES)} FROM kept)
    SELECT * REPLACE (coalesce(bws_raw, {median_of('bws_raw', 'marked')}) AS bws_raw,
      coalesce(bws_score, {median_of('bws_score', 'marked')}) AS bws_score,
      coalesce(name_1, {mode_of('name_1', 'marked')}) AS name_1,
      coalesce(bws_label, {mode_of('bws_label', 'marked')}) AS bws_label) FROM marked"""
)
def impute_baseline_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.impute_baseline_annual(fixture(spark, sf_dir, "baseline"))


def _future_name(code: str) -> str:
    return upper_underscore(future_long_name(code))


@query(
    f"{duck('future')}, marked AS (SELECT {marked(FUTURE_VALUES, '-9999')} FROM future) SELECT "
    + ", ".join(
        (
            f"coalesce({c}, {mode_of(c, 'marked')})"
            if c.endswith("_l")
            else f"coalesce({c}, {median_of(c, 'marked')})"
            if c in FUTURE_VALUES
            else c
        )
        + f' AS "{_future_name(c)}"'
        for c in FUTURE_COLUMNS
    )
    + " FROM marked"
)
def impute_future_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.impute_future_annual(fixture(spark, sf_dir, "future"))


def _monthly_name(code: str) -> str:
    return month_names([upper_squeezed(monthly_long_names()[code])])[0]


@query(
    f"{duck('monthly')}, marked AS (SELECT {marked(SCORES + RAWS + CATEGORIES)} FROM monthly) SELECT "
    + ", ".join(
        [f'pfaf_id AS "{_monthly_name("pfaf_id")}"']
        + [
            f'coalesce(CAST({c} AS DOUBLE), {median_of(c, "marked")}) AS "{_monthly_name(c)}"'
            for c in SCORES + RAWS + CATEGORIES
        ]
        + [f'coalesce({c}, {mode_of(c, "marked")}) AS "{_monthly_name(c)}"' for c in LABELS]
    )
    + " FROM marked"
)
def impute_baseline_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.impute_baseline_monthly(fixture(spark, sf_dir, "monthly"))


@query(
    f"{duck('future')} "
    + " UNION ALL ".join(
        f"SELECT pfaf_id, 'bau' AS scenario, 20{c[3:5]} AS year, '{c[6:8]}' AS indicator, {c} AS value FROM future"
        for c in FUTURE_VALUES
        if c.endswith("_r")
    )
)
def clean_future_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.future_long_form(fixture(spark, sf_dir, "future"))


@query(
    f"{duck('monthly')} "
    + " UNION ALL ".join(
        f"SELECT pfaf_id, '{c[:3]}' AS indicator, {int(c[4:6])} AS month, {c} AS value FROM monthly"
        for c in SCORES
    )
)
def clean_monthly_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.monthly_long_form(fixture(spark, sf_dir, "monthly"))


@query(
    """SELECT doc_id, TRY_CAST(source AS DOUBLE) AS source, TRY_CAST(replace(source, 'src', '') AS INT) AS number
    FROM documents"""
)
def clean_numeric_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.regexp_replace("source", "src", "").alias("number")
    )
    return cleaning.to_numbers(cleaning.to_numbers(docs, ["source"]), ["number"], "int")


@query(
    """SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 <> 0
      THEN (o_totalprice - o_orderkey % 5) / (o_orderkey % 5) * 100 END, 6) AS change FROM orders"""
)
def clean_percent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = percent_change(F.col("o_orderkey") % 5, F.col("o_totalprice"))
    return rounded(
        table(spark, sf_dir, "orders").select("o_orderkey", change.alias("change")), "change"
    )
