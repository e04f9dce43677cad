import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberbasin.plans import joins, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    big = [(None if i % 50 == 0 else 1 if i % 3 == 0 else rng.randint(2, 400), i) for i in range(6000)]
    other = [(k, f"n{k}") for k in range(1, 300)] + [(1, "again"), (None, "null")]
    return (
        spark.createDataFrame(big, "k int, i int"),
        spark.createDataFrame(other, "k int, name string"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_hot_join_is_the_plain_join(skewed, rows, how):
    big, other = skewed
    assert rows(joins.split_hot_join(big, other, ["k"], how)) == rows(big.join(other, "k", how))


def test_hot_keys_are_few_and_split_in_proportion(skewed, rows):
    hot = {k: n for k, n in rows(joins.hot_keys(skewed[0], ["k"]))}
    assert hot[1] > 1 and len(hot) < joins.HOT_SHARE


def test_a_hot_key_lands_in_many_tasks(spark, skewed):
    big, other = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.split_hot_join(big, other, ["k"]).where("k = 1 AND name = 'n1'")
        assert joined.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_broadcast_is_decided_by_measured_size(spark):
    df = spark.createDataFrame([("x" * 100,)] * 10, "t string")
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, max_rows=9)
    assert not joins.fits_broadcast(df, max_bytes=500)


def test_equi_join_beyond_the_bound(skewed, rows, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    big, other = skewed
    assert rows(joins.equi_join(big, other, "k", "left")) == rows(big.join(other, "k", "left"))


@pytest.mark.parametrize("left_rows", [10**6, 1])
def test_narrowed_quantiles_are_exact(spark, monkeypatch, left_rows):
    monkeypatch.setattr(quantiles, "LEFT_ROWS", left_rows)
    rng = random.Random(11)
    columns = {
        "spread": [rng.lognormvariate(0, 4) for _ in range(4000)],
        "hot": [7.0] * 2000 + [rng.uniform(-1, 20) for _ in range(1000)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "signs": [-5.0, -0.5, 0.0, 2.0, 1e12],
    }
    data = [(c, v) for c, values in columns.items() for v in values] + [("hot", None)]
    df = spark.createDataFrame(data, "column string, value double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for distributed in (False, True):
        found = quantiles.exact_quantiles(df, ["column"], "value", probs, distributed).collect()
        got = {(r["column"], r["prob"]): r["quantile"] for r in found}
        assert len(got) == len(columns) * len(probs)
        for c, values in columns.items():
            for p in probs:
                assert got[c, p] == pytest.approx(np.quantile(values, p), rel=1e-12), (c, p)


@pytest.mark.parametrize("many", [0, 10**9])
@pytest.mark.parametrize("list_rows, share_pairs", [(joins.LIST_ROWS, joins.SHARE_PAIRS), (3, 50)])
def test_listed_join_is_the_plain_join(spark, skewed, rows, monkeypatch, many, list_rows, share_pairs):
    monkeypatch.setattr(joins, "MANY_PAIRS", many)
    monkeypatch.setattr(joins, "LIST_ROWS", list_rows)
    monkeypatch.setattr(joins, "SHARE_PAIRS", share_pairs)
    big, other = skewed
    other = other.union(other.where("k < 4")).union(spark.range(20).selectExpr("CAST(1 AS int) k", "CASE WHEN id % 3 > 0 THEN CONCAT('m', id) END name"))
    found = joins.listed_join(big, other, ["k"])
    assert found.columns == ["k", "i", "name"]
    assert rows(found) == rows(big.join(other, "k"))
    two = joins.listed_join(big.selectExpr("5 AS one", "*"), other.selectExpr("k % 7 + 2 AS one", "k", "k AS split", "name"), ["one", "k"])
    assert rows(two, "k", "i", "split", "name") == rows(big.join(other.where("k % 7 = 3"), "k").selectExpr("k", "i", "k AS split", "name"))


def test_listed_join_shuffles_once_with_a_constant_key(skewed, monkeypatch):
    monkeypatch.setattr(joins, "MANY_PAIRS", 0)
    big, other = skewed
    found = joins.listed_join(big.selectExpr("5 AS one", "*"), other.selectExpr("CAST(5 AS int) AS one", "*").where("k > 0"), ["one", "k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ShuffledHashJoin" in plan and plan.count("REPARTITION_BY_NUM") == 2
