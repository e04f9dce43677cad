from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberbasin.functions import filters as f
from emberbasin.operators import fires


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "a")], "n int, t string")


@pytest.fixture(scope="module")
def timed(spark):
    texts = [
        "2024-01-09 23:59:59.999999", "2024-01-10 00:00:00", "2024-01-10 23:59:59",
        "2024-01-10 23:59:59.5", "2024-01-11 00:00:00",
    ]
    rows = [(datetime.fromisoformat(t), c) for t, c in zip(texts, ["high", "nominal"] * 3)]
    return spark.createDataFrame(rows, "acquisition_timestamp timestamp_ntz, confidence string")


@pytest.mark.parametrize(
    "document, kept",
    [
        (None, 4),
        ({}, 4),
        ({"n": {}}, 4),
        ({"n": {"min": 2}}, 2),
        ({"n": {"max": 2}}, 2),
        ({"n": {"min": 2, "max": 2}}, 1),
        ({"n": {"min": None}}, 0),
        ({"n": []}, 0),
        ({"n": [1, 3]}, 2),
        ({"n": None}, 0),
        ({"t": "a"}, 2),
        ({"t": "a", "n": {"min": 1}}, 1),
    ],
)
def test_filter_documents(numbers, document, kept):
    assert f.apply_filters(numbers, document).count() == kept


@pytest.mark.parametrize("limit, kept", [(2, 2), (0, 4), (-1, 4), (None, 4), ("2", 4), (True, 4)])
def test_limits(numbers, limit, kept):
    assert f.apply_limit(numbers, limit).count() == kept


def test_last_second_differs_from_calendar_day(timed):
    by_second = fires.count_on_date(timed, "2024-01-10").first()
    by_day = fires.count_days(timed, ["2024-01-10"]).first()
    assert (by_second.fire_count, by_day.fire_count) == (2, 3)
    assert by_second.range_end == "2024-01-10 23:59:59"


def test_confidence_is_equality(timed):
    assert f.with_confidence(timed, "nominal").count() == 2
    assert f.with_confidence(timed, "all").count() == 5


def test_bad_days_are_refused(timed):
    with pytest.raises(ValueError):
        fires.count_on_date(timed, "10/01/2024")
    with pytest.raises(ValueError):
        fires.count_between(timed, "2024-01-11", "2024-01-10")


def test_range_counts_days_included(timed):
    row = fires.count_between(timed, "2024-01-09", "2024-01-11").first()
    assert (row.fire_count, row.days_included) == (5, 3)


def test_last_days_cut_to_the_second(timed):
    row = fires.count_last_days(timed, 0.5, datetime(2024, 1, 11, 11, 59, 59, 700000)).first()
    assert (row.cutoff, row.fire_count) == ("2024-01-10 23:59:59", 3)


def test_cutoff_at_midnight():
    assert f.cutoff_midnight(datetime(2024, 1, 11, 18), 7) == datetime(2024, 1, 4)


def test_groups_sum_to_total(timed, rows):
    grouped = fires.count_fires(timed, group_by=["confidence"])
    assert rows(grouped, ordered=True) == [("high", 3, 5), ("nominal", 2, 5)]


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.range(10).select(
        F.col("id").cast("double").alias("latitude"), F.col("id").cast("double").alias("longitude")
    ).write.parquet(path)
    spark.read.parquet(path).where(f.in_box(1, 2, 3, 4)).explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(latitude,1.0)" in pushed and "LessThanOrEqual(longitude,4.0)" in pushed


def test_row_cap(spark):
    many = spark.range(1500).select(F.col("id").cast("string").alias("uid"))
    assert fires.capped_fire_rows(many, limit=5000, order_by=["uid"]).count() == 1000
    assert fires.capped_fire_rows(many, order_by=["uid"]).count() == 100
