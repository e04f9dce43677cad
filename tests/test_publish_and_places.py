"""Publishing in one step, circles over the globe, and rows dealt by their hash."""

from __future__ import annotations

import math
import random

import pytest
from emberbasin.operators import places
from emberbasin.plans import joins
from emberbasin.sources import publish
from pyspark.sql import functions as F


def test_a_version_that_fails_midway_changes_nothing(spark, rows, tmp_path):
    root = str(tmp_path / "store")
    assert publish.current(spark, root) is None and publish.read_published(spark, root) == {}
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("b",)], "y string")
    assert publish.publish(spark, root, {"a": a, "b": b}) == 1
    broken = b.select(F.raise_error("midway").cast("string").alias("y"))
    with pytest.raises(Exception, match="midway"):
        publish.publish(spark, root, {"a": a.select((F.col("x") + 1).alias("x")), "b": broken})
    held = publish.read_published(spark, root)
    assert rows(held["a"]) == [(1,)] and rows(held["b"]) == [("b",)]
    assert publish.versions(spark, root) == [1]
    # A version that a job left behind unnamed isn't read, and its number isn't used again.
    a.write.parquet(f"{root}/v7/a")
    assert publish.current(spark, root)[0] == 1
    # The next version reads the current one and has fewer tables.
    assert publish.publish(spark, root, {"a": held["a"].select((F.col("x") + 10).alias("x"))}, keep=2) == 8
    assert list(publish.read_published(spark, root)) == ["a"] and rows(publish.read_published(spark, root)["a"]) == [(11,)]
    assert publish.versions(spark, root) == [7, 8]
    assert not list((tmp_path / "store").glob("_CURRENT*"))
    with pytest.raises(ValueError):
        publish.publish(spark, root, {"../a": a})


def test_the_catalog_follows_the_pointer(spark, rows, tmp_path):
    root, database = str(tmp_path / "store"), f"pub_{tmp_path.name.replace('-', '_')}"
    frame = spark.createDataFrame([(1,)], "x int")
    publish.publish(spark, root, {"one": frame, "two": frame})
    assert publish.open_published(spark, root, database) == ["one", "two"]
    publish.publish(spark, root, {"one": frame.select((F.col("x") + 1).alias("x"))})
    assert publish.open_published(spark, root, database) == ["one"]
    assert rows(spark.table(f"{database}.one")) == [(2,)] and not spark.catalog.tableExists(f"{database}.two")
    spark.sql(f"DROP DATABASE {database} CASCADE")


def km(a, b):
    (p, q), (r, s) = (map(math.radians, x) for x in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("radius", [0.0, 300.0, 2500.0, 9000.0, 25_000.0])
def test_circles_as_by_brute_force(spark, radius):
    r = random.Random(radius)
    centres = [("pole", 89.0, 10.0), ("south", -90.0, 0.0), ("line", 10.0, 179.5), ("line too", -20.0, -179.9), ("edge", 0.0, 180.0), ("home", 38.0, -100.0)]
    fires = [(f"f{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(400)] + [("a", 10.0, -180.0), ("b", 10.0, 180.0), ("c", 90.0, 0.0), ("d", 38.0, -100.0), ("e", None, 1.0)]
    found = places.fires_within_km(
        spark.createDataFrame(fires, "uid string, latitude double, longitude double"),
        spark.createDataFrame(centres + [("nowhere", None, 1.0)], "place string, lat double, lon double"), radius,
    ).collect()
    want = {(p, u) for p, *at in centres for u, *f in fires if f[0] is not None and km(at, f) <= radius}
    assert {(x.place, x.uid) for x in found} == want and len(found) == len(want)


def test_boxes_are_cut_at_the_date_line(spark, rows):
    boxes = [("a", 170.0, 190.0), ("b", -200.0, -170.0), ("c", -10.0, 10.0), ("d", -180.0, 180.0), ("e", -300.0, 300.0)]
    frame = spark.createDataFrame([(p, 0.0, 1.0, w, e) for p, w, e in boxes], "place string, min_lat double, max_lat double, min_lon double, max_lon double")
    assert rows(places.cut_at_date_line(frame), "place", "min_lon", "max_lon") == [
        ("a", -180.0, -170.0), ("a", 170.0, 180.0), ("b", -180.0, -170.0), ("b", 160.0, 180.0), ("c", -10.0, 10.0), ("d", -180.0, 180.0), ("e", -180.0, 180.0),
    ]


def test_hot_rows_are_dealt_alike_in_any_order(spark, rows, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    big = spark.createDataFrame([(None if i % 3 == 0 else 1 if i % 3 == 1 else i, i) for i in range(300)], "k int, v int")
    other = spark.createDataFrame([(k, f"n{k}") for k in range(300)], "k int, name string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        want = rows(big.join(other, "k", how))
        for order in (big, big.orderBy(F.desc("v")), big.repartition(7, F.rand(1))):
            assert rows(joins.split_hot_join(order, other, ["k"], how)) == want
    plan = joins.split_hot_join(big, other, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan
