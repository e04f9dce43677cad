import pytest

from emberbasin.operators import countries, water


@pytest.fixture(scope="module")
def tables(spark):
    facts = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0), (None, "a", 7.0)], "pfaf_id int, kind string, score double"
    )
    lookup = spark.createDataFrame(
        [(1, "East", "x"), (1, "Coast", "y"), (3, "Far", "z")], "pfaf_id int, region_name string, kind string"
    )
    return facts, lookup


def test_join_repeats_rows_or_not(tables, rows):
    facts, lookup = tables
    assert water.water_rows(facts, lookup).count() == 6
    single = water.water_rows(facts, lookup, columns=["score"], lookup_mode="one_per_key")
    assert rows(single) == [(1.0, "Coast"), (3.0, "Coast"), (5.0, None), (7.0, None)]
    with pytest.raises(ValueError):
        water.water_rows(facts, lookup, lookup_mode="some")


def test_region_name_is_always_last(tables):
    facts, lookup = tables
    assert water.water_rows(facts, lookup, columns=["region_name", "score"]).columns == ["score", "region_name"]
    assert water.water_rows(facts, lookup).columns == [*facts.columns, "region_name"]


def test_filter_on_region(tables, rows):
    facts, lookup = tables
    kept = water.water_rows(facts, lookup, {"region_name": "East", "kind": ["a"]}, ["score"])
    assert rows(kept) == [(1.0, "East")]


def test_names_in_both_tables_are_not_ambiguous(tables, rows):
    facts, lookup = tables
    result = water.water_aggregate(
        facts, ["MAX(kind) AS k", "COUNT(DISTINCT pfaf_id) AS basins"], ["region_name"], lookup=lookup
    )
    assert rows(result) == [("Coast", "b", 1), ("East", "b", 1), (None, "a", 1)]


def test_having_may_name_unselected_aggregates(tables, rows):
    facts, lookup = tables
    result = water.water_aggregate(facts, ["AVG(t.score) AS m"], ["kind"], having="COUNT(*) > 2", lookup=lookup)
    assert rows(result) == [("a", 3.5)]
    plain = water.water_aggregate(facts, ["SUM(score) AS s"], having="MIN(score) > 100")
    assert plain.count() == 0


def test_lookup_builder(spark, rows):
    raw = spark.createDataFrame(
        [("A", 1, "p", 2.0, "g"), ("A", 1, "p", 2.0, "g"), ("A", 1, "q", 2.0, "g"), (None, 2, "p", 1.0, "g")],
        "name_0 string, pfaf_id int, name_1 string, area_km2 double, gid_0 string",
    )
    assert rows(water.region_lookup(raw), "name_1", "region_name") == [("p", "p"), ("q", "q")]


def test_scenarios_side_by_side(tables, rows):
    facts, lookup = tables
    later = facts.withColumnRenamed("score", "later")
    both = water.compare_scenarios(
        facts, later, lookup, {"filters": {"pfaf_id": 2}, "columns": ["score"]}, {"filters": {"pfaf_id": 2}, "columns": ["later"]}
    )
    assert rows(both, "scenario", "score", "later") == [("baseline", 5.0, None), ("future", None, 5.0)]


def test_two_level_mean_is_unweighted(spark, rows):
    future = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0)], "PFAF_ID int, w double")
    baseline = spark.createDataFrame([("X", 1), ("X", 1), ("X", 2), ("Y", 2)], "name_0 string, pfaf_id int")
    means = countries.country_future(future, baseline, {"w": "w"})
    assert rows(means) == [("X", 6.0), ("Y", 10.0)]


def test_missing_columns_are_named(spark):
    baseline = spark.createDataFrame([("X", 1.0)], "name_0 string, rfr_score double")
    future = spark.createDataFrame([(1.0,)], "bau50_rf_x_r double")
    with pytest.raises(KeyError, match="name_0"):
        countries.flood_rise(baseline, future)
    with pytest.raises(KeyError, match="bws_raw"):
        countries.country_baseline(baseline)


def test_demand_from_zero_is_null(spark, rows):
    df = spark.createDataFrame([("X", 0.0, 1.0), ("Y", 2.0, 3.0)], "country string, ws_2030 double, ws_2050 double")
    assert rows(countries.demand_increase(df)) == [("X", None), ("Y", 50.0)]


def test_comparison_order_and_missing_country(spark, rows):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "country string, m double")
    asked = [("q", "m", "A", "B"), ("r", "abs(m - 3)", "A", "C")]
    assert rows(countries.compare_countries(df, asked), ordered=True) == [
        (1, "q", "B", 2.0), (1, "q", "A", 1.0), (2, "r", "A", 2.0),
    ]


def test_improvers(spark, rows):
    df = spark.createDataFrame(
        [(f"c{i:02d}", 5.0, float(i % 6)) for i in range(30)], "country string, now double, later double"
    )
    best = rows(countries.largest_drop(df, "now", "later"), ordered=True)
    assert len(best) == 15 and best[0] == ("c00", 5.0) and best[-1][1] == 3.0
    assert countries.largest_rise(df, "now", "later").count() == 0
