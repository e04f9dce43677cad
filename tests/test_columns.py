import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberbasin.functions import columns as c
from emberbasin.functions.emissions import emission_columns


def test_float_text_is_pythons(spark):
    values = [
        0.0, -0.0, 5.0, -12.34, 0.1, 123.456789, 0.001, 0.0001, -0.00012, 0.000999, 1e-05,
        -1.5e-07, 2.5e-12, 179.99999, float("nan"),
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [r[0] for r in df.select(c.float_text(F.col("v"))).collect()]
    assert texts == [repr(v) for v in values]


def test_detection_key(spark):
    row = (-12.5, 0.00012, "2024-01-10", "1704879000", "N20")
    df = spark.createDataFrame([row], "a double, b double, d string, t string, s string")
    key = df.select(c.detection_key(*[F.col(x) for x in "abdts"])).first()[0]
    text = "_".join(str(v) for v in row)
    assert key == hashlib.md5(text.encode()).hexdigest()


def test_detection_key_with_whole_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 17, 18, "N")], "a double, b double, d long, t long, s string")
    key = df.select(c.detection_key(*[F.col(x) for x in "abdts"])).first()[0]
    assert key == hashlib.md5(b"1.0_2.0_17_18_N").hexdigest()


def test_epochs(spark):
    texts = [
        "1704879000", "1704879000123", " 5 ", "-1", "0", None, "bad", "12.5", "",
        "999999999999", "253402300799", "999999999999999999",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    start = datetime(1970, 1, 1)
    expected = [
        start + timedelta(seconds=1704879000),
        start + timedelta(milliseconds=1704879000123),
        start + timedelta(seconds=5),
        start - timedelta(seconds=1),
        start,
        None, None, None, None, None,
        datetime(9999, 12, 31, 23, 59, 59),
        None,
    ]
    assert [r[0] for r in df.select(c.epoch_to_utc(F.col("t"))).collect()] == expected


def test_epochs_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(1704879000,)], "t long").select(c.epoch_to_utc(F.col("t")))
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        assert df.first()[0] == datetime(2024, 1, 10, 9, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rounding_is_pythons(spark):
    values = [1.005, 0.285, 0.125, 0.375, 2.5, -2.674, 1234567.891, 12.34 * 7 * 3600 * 1.37]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ours = [r[0] for r in df.select(c.round_ties_even(F.col("v"), 2)).collect()]
    assert ours == [round(v, 2) for v in values]


def test_emissions_of_one_fire(spark):
    df = spark.createDataFrame([(12.5, 6.0), (3.3, 0.0)], "f double, h double")
    masses = emission_columns(F.col("f"), F.col("h"))
    first, second = df.select(*[m.alias(n) for n, m in masses.items()]).collect()
    energy = 12.5 * 6 * 3600
    assert first.total_energy_mj == energy
    assert first.co2_kg == round(energy * 1.37, 2)
    assert first.ch4_kg == round(energy * 0.0048, 4)
    assert first.n2o_kg == round(energy * 0.0002, 4)
    assert first.co_kg == round(energy * 0.063, 2)
    whole = energy * 1.37 + energy * 0.0048 * 28 + energy * 0.0002 * 265
    assert first.total_co2e_kg == round(whole, 2)
    assert first.total_co2e_tonnes == round(whole / 1000, 4)
    assert set(second) == {0.0}


def test_clipped_columns_keep_nulls(spark):
    df = spark.createDataFrame([(0.5,), (1000.0,), (None,)], "v double")
    found = df.select(c.log_power(F.col("v")), c.marker_size(F.col("v"))).collect()
    assert [tuple(r) for r in found] == [(0.0, 0.125), (3.0, 125.0), (None, None)]


def test_percent_change_from_zero_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "a double, b double")
    found = df.select(c.percent_change(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [None, 50.0]


def test_iso_text(spark):
    moments = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 600)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert [r[0] for r in df.select(c.iso_text(F.col("t"))).collect()] == [m.isoformat() for m in moments]
