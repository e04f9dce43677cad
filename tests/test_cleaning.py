from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberbasin.functions import names as n
from emberbasin.operators import cleaning as c
from emberbasin.schemas import FIRES


def test_markers_only_in_named_columns(spark, rows):
    df = spark.createDataFrame([(-9999.0, 9999, "N/A"), (1.0, 2, "x")], "a_raw double, b int, t string")
    assert rows(c.null_fills(df, ["a_raw"])) == [(1.0, 2, "x"), (None, 9999, "N/A")]
    assert rows(c.null_fills(df)) == [(1.0, 2, "x"), (None, None, None)]


@pytest.mark.parametrize("text", ["", "N/A", "nan"])
def test_text_markers(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert c.null_fills(df).first().t is None


def test_monthly_keeps_rows_with_nulls_and_null_labels(spark, rows):
    raw = spark.createDataFrame(
        [(1, "-9999", 2.0, None, None), (1, "-9999", 2.0, None, None), (2, "1.5", 9999.0, 3.0, "Low"), (3, "bad", 1.0, 2.0, "Low")],
        "pfaf_id int, bws_01_raw string, bws_01_score double, bws_01_cat double, bws_01_label string",
    )
    cleaned = c.clean_baseline_monthly(raw.withColumn("bws_01_raw", F.col("bws_01_raw").try_cast("double")))
    assert rows(cleaned) == [
        (1, None, 2.0, None, None), (2, 1.5, None, 3, "Low"), (3, None, 1.0, 2, "Low"),
    ]
    assert dict(cleaned.dtypes)["bws_01_cat"] == "int"


def test_casts_give_null_for_bad_values(spark, rows):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert rows(c.to_numbers(df, ["a"], "int")) == [(1,), (None,), (None,)]


def test_cleaning_twice_is_cleaning_once(spark, rows):
    raw = spark.createDataFrame([(-9999.0, 1.0), (2.0, 9999.0), (3.0, 4.0)], "a_x_r double, a_x_s double")
    once = c.clean_future_annual(raw)
    assert rows(once) == rows(c.clean_future_annual(once)) == [(3.0, 4.0)]


@pytest.mark.parametrize("distributed", [False, True])
def test_medians(spark, rows, distributed):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, None, None), (None, 5.0, None), (9, 6.0, None)], "a int, b double, e double"
    )
    filled = c.fill_medians(df, distributed=distributed)
    assert rows(filled) == [
        (1.0, 1.0, None), (2.0, 5.0, None), (2.0, 5.0, None), (9.0, 6.0, None),
    ]
    assert dict(filled.dtypes) == {"a": "double", "b": "double", "e": "double"}


def test_columns_without_gaps_keep_their_type(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, t string")
    assert c.fill_modes(c.fill_medians(df)).dtypes == df.dtypes


def test_mode_of_equals_is_the_smallest(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert rows(c.fill_modes(df)) == [("a",), ("a",), ("a",), ("b",), ("b",)]


def test_mostly_null_columns_go(spark):
    df = spark.createDataFrame([(1, None, 1)] + [(1, None, None)] * 4, "a int, b int, e int")
    assert c.drop_mostly_null(df).columns == ["a", "e"]
    assert c.drop_mostly_null(df, 0.5).columns == ["a"]


def test_imputation_takes_a_key_that_equals_a_marker_for_missing(spark, rows):
    raw = spark.createDataFrame([(1, "x"), (3, "x"), (9999, None)], "pfaf_id int, name string")
    assert rows(c.impute_baseline_annual(raw)) == [(1.0, "x"), (2.0, "x"), (3.0, "x")]


FEED = "OBJECTID long, latitude double, longitude double, bright_ti4 double, frp double, acq_date string, acq_time string, confidence string, satellite string, hours_old double"


def test_detections(spark):
    feed = spark.createDataFrame(
        [
            (1, 1.5, 2.5, 300.0, 9.0, "d", "1704879000", "nominal", "N", 1.0),
            (2, 1.5, 2.5, 300.0, 9.0, "d", "1704879000000", "high", "N", 1.0),
            (3, 1.5, 2.5, 300.0, 9.0, "d", "1704879000", "low", "N", 1.0),
            (4, None, 2.5, 300.0, 9.0, "d", "1704879000", "high", "N", 1.0),
            (5, 1.5, 2.5, 300.0, 9.0, "d", "text", "high", "N", 1.0),
        ],
        FEED,
    )
    cleaned = c.clean_detections(feed)
    missing = {"brightness_temp_i5", "version", "day_night"}
    assert cleaned.columns == [x for x in FIRES.fieldNames() if x not in missing]
    found = cleaned.collect()
    assert {r.confidence for r in found} == {"nominal", "high"}
    assert {r.acquisition_timestamp for r in found} == {datetime(2024, 1, 10, 9, 30)}


def test_detections_without_a_time_are_none(spark):
    feed = spark.createDataFrame([(1.0, 2.0, "d", "high", "N")], "latitude double, longitude double, acq_date string, confidence string, satellite string")
    assert c.clean_detections(feed.withColumn("acq_time", F.lit(None).cast("string"))).count() == 0


def test_long_names():
    assert n.future_long_name("bau30_ws_x_r") == (
        "Water Stress (Business as Usual, Year 2030 (2015-2045)) - Raw Value (Median of 5 GCMs)"
    )
    assert n.future_long_name("pes80_zz_x_l").startswith("zz (Pessimistic")
    assert n.future_long_name("pfaf_id") == "Pfafstetter ID"
    assert n.future_long_name("other") == "other"
    assert len(n.monthly_long_names()) == 3 * 12 * 4 + 1
    assert n.monthly_long_names()["iav_12_cat"] == "Interannual_Variability (Month 12) - Category"


def test_name_rules():
    assert n.upper_underscore("Water Stress (x) - 1") == "WATER_STRESS__X____1"
    long_name = n.upper_squeezed("Baseline_Water_Stress (Month 1) - Raw_Value")
    assert long_name == "BASELINE_WATER_STRESS_(MONTH_1)_RAW_VALUE"
    assert n.month_names([long_name, "MONTH_12", "MONTH_13"]) == [
        "BASELINE_WATER_STRESS_(JANUARY)_RAW_VALUE", "DECEMBER", "MONTH_13",
    ]
    assert [n.is_clean_name(x) for x in ("AB_1", "ab", "A (B)", "")] == [True, False, False, False]


def test_column_groups_and_resolution():
    columns = ["a_raw", "a_score", "x_raw_more", "Pfaf_ID"]
    assert n.ending_with(columns, "_raw", "_score") == ["a_raw", "a_score"]
    assert n.containing(columns, "_raw") == ["a_raw", "x_raw_more"]
    assert n.resolve_column(columns, ["pfafstetter_id", "pfaf_id"]) == "Pfaf_ID"
    with pytest.raises(KeyError):
        n.resolve_column(columns, ["nothing"])
