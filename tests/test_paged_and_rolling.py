"""The paged data source, sliding totals and keyed stream state."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from emberbasin.schemas import FIRES
from emberbasin.sources.pages import FeedPages, landed
from emberbasin.streaming.rolling import sliding_emissions
from emberbasin.streaming.sightings import PROVIDER, ROCKS, Sightings, sightings
from pyspark.sql import functions as F


def land(folder, offset, objects, whole=True):
    folder.mkdir(exist_ok=True)
    rows = [{"attributes": {"OBJECTID": i, "latitude": i, "acq_time": 17 * i, "confidence": None if i % 2 else "high", "unknown": "x"}} for i in objects]
    (folder / f"offset={offset}.json").write_text(json.dumps({"features": rows} if whole else {"error": "busy"}))


@pytest.fixture
def paged(spark, tmp_path):
    spark.dataSource.register(FeedPages)
    return tmp_path / "pages", lambda: spark.read.format("feed_pages").option("pageSize", 3).load(str(tmp_path / "pages"))


def test_pages_are_partitions(paged):
    folder, read = paged
    for offset in (0, 3, 6):
        land(folder, offset, range(offset, min(offset + 3, 8)))
    (folder / "_SUCCESS").write_text("")
    (folder / ".offset=9.json.crc").write_text("x")
    found = read()
    assert found.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in found.select("OBJECTID", "latitude", "acq_time", "confidence", "frp").orderBy("OBJECTID").collect()] == [
        (i, float(i), str(17 * i), None if i % 2 else "high", None) for i in range(8)
    ]
    few = found.sparkSession.read.format("feed_pages").schema("OBJECTID long").option("pageSize", 3).load(folder.as_uri())
    assert few.agg(F.sum("OBJECTID")).first()[0] == 28
    land(folder, 9, [])  # an empty page behind a short one
    with pytest.raises(Exception, match="page of offset 6 is short"):
        read().count()


def test_an_empty_last_page_ends_a_pull(paged):
    folder, read = paged
    folder.mkdir()
    assert read().count() == 0
    land(folder, 0, range(3))
    land(folder, 3, [])
    assert read().count() == 3


@pytest.mark.parametrize("offsets, size, says", [([0, 6], 3, "offset 3 is missing"), ([3], 3, "offset 0 is missing"), ([0, 2], 3, "multiple"), ([0], 4, "more than 3")])
def test_a_pull_that_is_not_whole_is_an_error(paged, offsets, size, says):
    folder, read = paged
    for offset in offsets:
        land(folder, offset, range(size))
    with pytest.raises(Exception, match=says):
        read().count()


def test_a_page_without_features_is_an_error(paged):
    folder, read = paged
    land(folder, 0, [], whole=False)
    with pytest.raises(Exception, match="no 'features'"):
        read().count()
    (folder / "more").mkdir()
    land(folder / "more", 0, [1])
    with pytest.raises(ValueError, match="two pages"):
        landed(str(folder))


def test_a_stream_takes_pages_as_they_land(spark, paged, tmp_path):
    folder, _ = paged
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        feed = spark.readStream.format("feed_pages").option("pageSize", 3).load(str(folder)).select("OBJECTID")
        query = feed.writeStream.format("parquet").option("checkpointLocation", check).start(out)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r[0] for r in spark.read.schema("OBJECTID long").parquet(out).collect())

    land(folder, 0, range(0, 3))
    land(folder, 6, range(6, 8))
    assert run() == [0, 1, 2]  # offset 3 has still to come
    land(folder, 3, range(3, 6))
    assert run() == list(range(8))


# -- sliding totals ----------------------------------------------------------------------


def fire(uid, at, confidence="high", frp=10.0, age=1.0):
    return (uid, 1.0, 2.0, 300.0, 280.0, frp, at, "N", "v", confidence, "D", age)


def plain_spans(rows, hours=24):
    """By end and confidence: count and energy of the hours before."""
    out = defaultdict(lambda: [0, 0.0])
    for r in rows:
        hour = r[6].replace(minute=0, second=0, microsecond=0)
        for k in range(1, hours + 1):
            held = out[hour + timedelta(hours=k), r[9]]
            held[0] += 1
            held[1] += r[5] * r[11] * 3600
    return {k: (n, pytest.approx(e)) for k, (n, e) in out.items()}


def as_spans(rows):
    return {(r.window_end, r.confidence): (r.fire_count, r.total_energy_mj) for r in rows}


def test_sliding_totals_of_a_table(spark):
    r = random.Random(6)
    rows = [fire(f"u{i}", datetime(2024, 1, 1) + timedelta(minutes=r.randint(0, 6000)), r.choice(["high", "low", None]), r.choice([1.0, 2.5])) for i in range(150)]
    rows += [fire("edge", datetime(2024, 1, 2, 5)), fire("last", datetime(2024, 1, 2, 5, 59, 59, 999999))]
    found = sliding_emissions(spark.createDataFrame(rows + [fire("none", datetime(2024, 1, 1), frp=None)], FIRES)).collect()
    assert as_spans(found) == plain_spans(rows) and all(x.window_end - x.window_start == timedelta(days=1) for x in found)


def test_sliding_totals_of_a_stream_with_late_rows(spark, tmp_path):
    day = datetime(2024, 1, 1)
    first = [fire("a", day + timedelta(hours=3)), fire("b", day + timedelta(hours=3, minutes=30)), fire("c", day + timedelta(hours=20))]
    late = [fire("d", day + timedelta(hours=2))]
    last = [fire("z", day + timedelta(days=30))]  # the watermark passes all the others
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (first, late, last, [fire("y", day + timedelta(days=31))]):
        spark.createDataFrame(batch, FIRES).coalesce(1).write.mode("append").parquet(folder)
        rows = sliding_emissions(spark.readStream.schema(FIRES).parquet(folder))
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.schema(rows.schema).parquet(out).where("window_end < '2024-01-15'").collect()
    assert as_spans(found) == plain_spans(first + late)
    assert len(found) == len(as_spans(found))  # each span once


# -- keyed state -------------------------------------------------------------------------


def test_pulls_of_a_detection_over_batches_and_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "uid string, hours_old double"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for batch in ([("a", 5.0), ("b", 1.0)], [("a", 7.0), ("a", 6.0), (None, 2.0)], [("a", 2.0), ("c", None), ("b", 1.0)]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
            rows = sightings(spark.readStream.schema(schema).parquet(folder))  # a new query each time, from the checkpoint
            rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start(out).awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    found = Counter(map(tuple, spark.read.schema(rows.schema).parquet(out).collect()))
    assert found == Counter([
        ("a", "first", 1, 5.0, 5.0, 5.0), ("b", "first", 1, 1.0, 1.0, 1.0), ("a", "update", 2, 6.0, 5.0, 6.0), ("a", "update", 3, 7.0, 5.0, 7.0),
        (None, "first", 1, 2.0, 2.0, 2.0), ("a", "update", 4, 2.0, 2.0, 7.0), ("c", "first", 1, None, None, None), ("b", "update", 2, 1.0, 1.0, 1.0),
    ])


def test_state_ends_with_its_time(spark, tmp_path):
    """With a time-to-live of a moment the second pull is a first sight again."""
    folder, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "uid string, hours_old double"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for _ in range(2):
            spark.createDataFrame([("a", 5.0)], schema).coalesce(1).write.mode("append").parquet(folder)
            rows = sightings(spark.readStream.schema(schema).parquet(folder), kept_ms=1)
            rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start(out).awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    assert [r.kind for r in spark.read.schema(rows.schema).parquet(out).collect()] == ["first", "first"]


class HeldMap(dict):
    """A map state of the keyed store, kept in a dictionary."""

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_a_call_takes_many_uids_and_orders_pulls_over_frames():
    r = random.Random(4)
    pulls = [(r.choice(["a", "b", "c", None, "d"]), r.choice([1.0, 2.0, 3.5, 7.0, float("nan")])) for _ in range(200)]
    state, found = Sightings(1), []
    state.seen = HeldMap()
    for batch in (pulls[:120], pulls[120:]):
        frames = (pd.DataFrame(batch[i : i + 9], columns=["uid", "hours_old"]) for i in range(0, len(batch), 9))
        for out in state.handleInputRows((0,), frames, None):
            found += [tuple(None if x != x else x for x in row) for row in out.itertuples(index=False)]
    want, held = [], {}
    for batch in (pulls[:120], pulls[120:]):
        for uid, age in sorted(batch, key=lambda p: (p[1] != p[1], 0 if p[1] != p[1] else p[1])):
            n, first, last = held.get(uid, (0, None, None))
            if age == age:
                first, last = age if first is None else min(first, age), age if last is None else max(last, age)
            held[uid] = n + 1, first, last
            want.append((uid, "update" if n else "first", n + 1, age if age == age else None, first, last))
    assert Counter(found) == Counter(want)
    assert state.seen == {(uid,): row for uid, row in held.items()}
