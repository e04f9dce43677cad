"""Small and large paths give the same rows, whatever the columns are called."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberbasin.operators import cleaning, places
from emberbasin.plans import joins, quantiles
from emberbasin.sources import files, tables

WORK_NAMES = ["split", "splits", "cell_lat", "cell_lon", "name_key", "key_rows", "rank"]


@pytest.fixture(params=["small", "large"])
def path(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(joins, "fits_broadcast", lambda *_, **__: False)
        monkeypatch.setattr(places, "fits_broadcast", lambda *_, **__: False)
        monkeypatch.setattr(quantiles, "GATHER_ROWS", 0)
    return request.param


def test_columns_with_the_names_of_work_columns_stay(spark, path, rows):
    big = spark.range(40).select(F.when(F.col("id") < 30, 1).otherwise(F.col("id")).alias("k"), *[F.lit(i).alias(n) for i, n in enumerate(WORK_NAMES[:3])])
    other = spark.range(30, 60).select(F.col("id").alias("k"), F.lit(9).alias("splits_of"), F.lit(8).alias("name_key"))
    joined = joins.equi_join(big, other, "k")
    assert joined.columns == ["k", *WORK_NAMES[:3], "splits_of", "name_key"]
    assert rows(joined) == [(k, 0, 1, 2, 9, 8) for k in range(30, 40)]


def _fires(spark, n=60):
    return spark.range(n).select(
        F.col("id").cast("string").alias("uid"), (F.col("id") % 7 * 0.1).alias("latitude"), (F.col("id") % 5 * 0.1).alias("longitude"),
        F.col("id").cast("double").alias("frp_mw"), F.lit("nominal").alias("confidence"), F.lit(1).alias("brightness_temp_i4"),
        F.lit(2).alias("brightness_temp_i5"), F.lit(datetime(2024, 1, 30)).cast("timestamp_ntz").alias("acquisition_timestamp"),
        F.lit("N").alias("satellite"), F.lit(5.0).alias("hours_old"), *[F.lit(7).alias(c) for c in WORK_NAMES],
    )


def test_box_join_keeps_such_columns(spark, path):
    boxes = spark.createDataFrame([("a", -1.0, 0.35, -1.0, 0.25)], "place string, min_lat double, max_lat double, min_lon double, max_lon double")
    found = places.fires_in_boxes(_fires(spark), boxes)
    assert set(WORK_NAMES) <= set(found.columns)
    want = [i for i in range(60) if i % 7 <= 3 and i % 5 <= 2]
    assert sorted(int(r.uid) for r in found.collect()) == want


def test_the_limit_holds_for_each_place(spark, path):
    asked = spark.createDataFrame([("One", 1), ("two", 2)], "place string, name_key int")
    gazetteer = spark.createDataFrame([("one", 0.0, 0.0), ("Two", 0.3, 0.2)], "place string, lat double, lon double")
    found = places.fires_near(_fires(spark), asked, gazetteer, 0.15, limit=3).collect()
    by = {}
    for r in found:
        by.setdefault(r["place"], []).append(r.frp_mw)
    inside = lambda lat, lon: sorted((i for i in range(60) if abs(i % 7 * 0.1 - lat) <= 0.15 and abs(i % 5 * 0.1 - lon) <= 0.15), reverse=True)
    assert {k: sorted(v, reverse=True) for k, v in by.items()} == {"One": inside(0, 0)[:3], "two": inside(0.3, 0.2)[:3]}


def test_places_without_fires_have_zeros(spark, path):
    boxes = spark.createDataFrame([("sea", 50.0, 51.0, 50.0, 51.0)], "place string, min_lat double, max_lat double, min_lon double, max_lon double")
    found = places.emissions_near(_fires(spark), boxes, datetime(2024, 1, 31)).collect()
    assert [tuple(r)[0] for r in found] == ["sea"] and set(tuple(found[0])[1:]) == {0}


@pytest.mark.parametrize("values", [[1, 2, float("inf"), float("inf"), float("inf")], [float("-inf"), 1.0, 1.0, 2.0], [0.0, -0.0, 5.0], [3.0], [1.0, float("nan"), float("nan")]])
def test_quantiles_of_infinities(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    got = [
        {r.prob: r.quantile for r in quantiles.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0], distributed=d).collect()}
        for d in (False, True)
    ]
    assert str(sorted(got[0].items())) == str(sorted(got[1].items())) or got[0] == got[1]


def test_rows_without_a_time_are_stored_once(spark):
    name = tables.create_fire_table(spark, "main.without_time")
    try:
        batch = spark.createDataFrame(
            [("a", datetime(2012, 5, 1)), ("b", datetime(2024, 1, 1)), ("c", None), ("d", None)], "uid string, acquisition_timestamp timestamp_ntz"
        )
        for _ in range(3):
            tables.append_detections(batch, name)
        assert sorted(r.uid for r in spark.table(name).collect()) == ["a", "b", "c", "d"]
        stored = tables.on_days(spark.table(name), [datetime(2012, 5, 1).date(), None])
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and sorted(r.uid for r in stored.collect()) == ["a", "c", "d"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_texts_that_java_takes_for_numbers_stay_text(spark, tmp_path):
    texts = ["1", "1D", "2F", "0x1p3", " 2.5 ", "-3e2", ".5", "inf", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.v for r in cleaning.to_numbers(df, ["v"]).collect()] == [1.0, None, None, None, 2.5, -300.0, 0.5, float("inf"), None]
    files.write_csv(spark.createDataFrame([("1D", "1"), ("2F", "2")], "a string, b string"), str(tmp_path / "c"))
    assert dict(files.read_raw_csv(spark, str(tmp_path / "c")).dtypes) == {"a": "string", "b": "bigint"}
