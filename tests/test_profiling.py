import math

import numpy as np
import pandas as pd
import pytest

from emberbasin.operators import profiling as p


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame(
        {
            "a": [1.0, 2.0, None, 4.0, 4.0, 100.0],
            "b": [1, 2, 3, 4, 5, 6],
            "t": ["x", "y", "x", None, "y", "z"],
            "one": ["k"] * 6,
        }
    )


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b int, t string, one string")


@pytest.mark.parametrize("distributed", [False, True])
def test_describe_numeric(df, frame, distributed):
    found = {r["column"]: r for r in p.describe_numeric(df, distributed=distributed).collect()}
    for c in ("a", "b"):
        ours = [found[c][m] for m in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert ours == pytest.approx(list(frame[c].describe()))


def test_describe_all(df):
    found = {r["column"]: r for r in p.describe_all(df).collect()}
    assert (found["t"]["count"], found["t"]["unique"], found["t"]["top"], found["t"]["freq"]) == (5, 3, "x", 2)
    assert found["a"]["unique"] is None and found["t"]["mean"] is None


def test_top_values(df, rows):
    assert rows(p.top_values(df, ["t"], 2)) == [("t", 3, 1, "x", 2), ("t", 3, 2, "y", 2)]


def test_nulls_and_marks(df, rows):
    assert rows(p.most_null(df, 2), ordered=True) == [("a", 1), ("t", 1)]
    assert rows(p.text_marks(df, ["k", "x"])) == [("one", "k", 6), ("one", "x", 0), ("t", "k", 0), ("t", "x", 2)]


def test_duplicates_and_shape(df, rows):
    assert p.duplicate_count(df).first().duplicate_rows == 0
    assert p.duplicate_count(df.unionByName(df)).first().duplicate_rows == 6
    assert p.duplicate_count(df.limit(0)).first().duplicate_rows == 0
    assert rows(p.shape(df)) == [(6, 4)]
    assert rows(p.type_report(df), "column", "type") == [("a", "double"), ("b", "int"), ("one", "string"), ("t", "string")]


def test_cardinality(df, rows):
    flags = {r[0]: r[1:] for r in rows(p.cardinality_flags(df))}
    assert flags == {"a": (4, False, False, False), "b": (6, False, False, True), "t": (3, False, False, False), "one": (1, True, False, False)}
    exact = dict(rows(p.distinct_counts(df)))
    assert dict(rows(p.approximate_distinct_counts(df))) == exact


def test_histogram_is_numpys(spark, rows):
    values = [0.0, 0.5, 1.0, 2.5, 9.9, 10.0, 10.0]
    df = spark.createDataFrame([(v, 3.0) for v in values], "v double, same double")
    binned = p.histograms(df, ["v", "same"], 10).orderBy("bin")
    for c, data in (("v", values), ("same", [3.0] * 7)):
        counts, edges = np.histogram(data, 10)
        found = binned.where(f"column = '{c}'").collect()
        assert [r.n for r in found] == list(counts)
        assert [r.low for r in found] == pytest.approx(list(edges[:-1]))


@pytest.mark.parametrize("distributed", [False, True])
def test_box_statistics(spark, distributed):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 50.0, None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    r = p.box_statistics(df, ["g"], distributed=distributed).first()
    q1, q2, q3 = np.quantile(values[:-1], [0.25, 0.5, 0.75])
    assert (r.q1, r.median, r.q3) == (q1, q2, q3)
    assert (r.low_whisker, r.high_whisker, r.outliers, r["count"]) == (1.0, 5.0, 1, 6)


def test_monthly_scores_outside_the_range_are_left_out(spark, rows):
    df = spark.createDataFrame([(5.0, 5.1), (-0.1, None), (0.0, 1.0)], "bws_01_score double, iav_12_score double")
    assert rows(p.monthly_means(df)) == [("bws", 1, 2.5), ("iav", 12, 1.0)]


def test_modes(df, rows):
    assert rows(p.modes(df, ["t", "one"])) == [("one", "k"), ("t", "x")]


def test_overview_and_report(df, rows):
    overview = {r["column"]: r for r in p.column_overview(df).collect()}
    assert overview["t"].has_nulls and overview["t"].sample_value == "x" and not overview["t"].clean_name
    report = {(r[0], r[1]): r[2] for r in rows(p.quality_report(df))}
    assert report["rows", None] == 6 and report["missing_values", None] == 2
    assert report["one_unique_value", "one"] == 1 and report["missing_by_column", "b"] == 0
