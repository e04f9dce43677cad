"""Layout along the curve, the key filter and the summary of the fire table."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import eventlog
import pytest
from emberbasin.functions.curve import BITS, hilbert_key
from emberbasin.operators import fires as ops
from emberbasin.operators.emissions import box_emissions
from emberbasin.schemas import FIRES
from emberbasin.sources import keyindex, layout, rollup, tables
from pyspark.sql import functions as F


def detection(uid, day=10, hour=9, lat=1.0, lon=2.0, frp=5.0, confidence="high", age=1.0, moment=None):
    at = moment or (datetime(2024, 1, day, hour) if day else None)
    return (uid, lat, lon, 300.0, 280.0, frp, at, "N", "v", confidence, "D", age)


@pytest.fixture
def fire_table(spark, tmp_path):
    name = f"main.kept_{tmp_path.name.replace('-', '_')}"
    return tables.create_fire_table(spark, name, str(tmp_path / "fires"))


def curve(x, y, n=1 << BITS):
    """The usual loop from the coarsest to the finest square."""
    d, s = 0, n // 2
    while s:
        a, b = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * a ^ b)
        if not b:
            x, y = (n - 1 - y, n - 1 - x) if a else (y, x)
        s //= 2
    return d


def test_curve_as_by_the_plain_loop(spark):
    r = random.Random(1)
    rows = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(500)]
    rows += [(90.0, 180.0), (-90.0, -180.0), (95.0, -500.0), (0.0, 0.0), (None, 1.0), (1.0, float("nan"))]
    found = spark.createDataFrame(rows, "lat double, lon double").select("lat", "lon", hilbert_key(F.col("lat"), F.col("lon"))).collect()
    place = lambda v, low, span: max(0, min((1 << BITS) - 1, math.floor((v - low) / span * (1 << BITS))))
    for lat, lon, key in found:
        known = lat is not None and not math.isnan(lon)
        assert key == (curve(place(lon, -180.0, 360.0), place(lat, -90.0, 180.0)) if known else None)


BOX_SCRIPT = """
from emberbasin.sources import layout, tables
from emberbasin.operators import fires as ops
from datetime import datetime
rows = spark.range(60_000).select(
    F.md5(F.col("id").cast("string")).alias("uid"),
    (F.pmod(F.xxhash64("id"), F.lit(180_000)) / 1000 - 90).alias("latitude"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(360_000)) / 1000 - 180).alias("longitude"),
    F.lit(300.0).alias("brightness_temp_i4"), F.lit(280.0).alias("brightness_temp_i5"), (F.col("id") % 90).cast("double").alias("frp_mw"),
    F.expr("timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(cast(id % 2 as int), 0, 0, cast(id % 86000 as decimal(18,6)))").alias("acquisition_timestamp"),
    F.lit("N").alias("satellite"), F.lit("v").alias("version"), F.lit("high").alias("confidence"), F.lit("D").alias("day_night"), F.lit(1.0).alias("hours_old"))
for kind in ("arrival", "curve"):
    table = tables.create_fire_table(spark, "main." + kind, row_group_bytes=100_000)
    if kind == "curve":
        stored = layout.write_along_curve(rows, table, rows_per_file=10_000)
    else:
        rows.repartition(6).withColumn("acq_day", F.to_date("acquisition_timestamp")).write.insertInto(table)
        stored = spark.table(table)
    step("box " + kind)
    found = ops.fires_in_box(stored, 10, 14, 20, 26, limit=None).collect()
    step("no")
    print(kind, len(found), hash(tuple(map(tuple, found))))
"""


@pytest.fixture(scope="module")
def logged(tmp_path_factory):
    """Lines by their first word, and the scans, of all three scripts in one session."""
    printed, scans = eventlog.run(BOX_SCRIPT + APPEND_SCRIPT + ROLLUP_SCRIPT, tmp_path_factory.mktemp("logged"))
    return dict(line.split(" ", 1) for line in printed if line.split(" ")[0] in ("arrival", "curve", "plain", "indexed", "summed")), scans


def test_a_box_reads_few_row_groups(logged):
    printed, scans = logged
    arrival, along = printed["arrival"], printed["curve"]
    assert arrival == along and int(along.split()[0]) > 10
    rows = {kind: sum(s["rows"] for s in scans if s["step"] == f"box {kind}") for kind in ("arrival", "curve")}
    assert rows["arrival"] > 50_000 and rows["curve"] < rows["arrival"] / 8, rows


def test_rewriting_days_keeps_rows_and_makes_few_files(spark, fire_table, tmp_path):
    r = random.Random(2)
    rows = [detection(f"u{i}", 10 + i % 2, lat=r.uniform(-90, 90), lon=r.uniform(-180, 180)) for i in range(300)] + [detection("none", None, lat=None)]
    for k in range(0, 301, 101):
        tables.append_detections(spark.createDataFrame(rows[k : k + 101], FIRES), fire_table)
    before = spark.table(fire_table).collect()
    files = lambda day: len(list((tmp_path / "fires" / f"acq_day={day}").glob("*.parquet")))
    many = files("2024-01-11")
    layout.rewrite_days(spark, fire_table, [date(2024, 1, 10)])
    assert files("2024-01-10") < many == files("2024-01-11")
    stored = layout.rewrite_days(spark, fire_table)
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, before))
    assert layout.rewrite_days(spark, fire_table, []).count() == 301
    day = spark.read.parquet(str(tmp_path / "fires" / "acq_day=2024-01-10")).select(hilbert_key(F.col("latitude"), F.col("longitude"))).collect()
    assert [k for (k,) in day] == sorted(k for (k,) in day)


# -- the key filter ----------------------------------------------------------------------


def test_append_by_the_filter_as_without_it(spark, rows, fire_table, tmp_path):
    plain = tables.create_fire_table(spark, f"{fire_table}_plain", str(tmp_path / "plain"))
    r = random.Random(3)
    for _ in range(3):
        batch = [detection(f"u{k}", [10, 11, 12, None][k % 4], age=float(r.randint(1, 5))) for k in r.choices(range(60), k=40)]
        batch += [detection(None, 10, age=2.0)]
        frame = spark.createDataFrame(batch, FIRES)
        tables.append_detections(frame, plain)
        keyindex.append_indexed(frame, fire_table)
        assert rows(spark.table(fire_table)) == rows(spark.table(plain))
    assert keyindex.append_indexed(spark.createDataFrame([], FIRES), fire_table).count() == spark.table(plain).count()


def test_false_hits_of_the_filter_lose_nothing(spark, rows, fire_table, monkeypatch):
    monkeypatch.setattr(keyindex, "BITS", 3)  # 8 different hashes
    first = [detection(f"a{i}", 10) for i in range(20)]
    keyindex.append_indexed(spark.createDataFrame(first, FIRES), fire_table)
    keyindex.append_indexed(spark.createDataFrame(first + [detection(f"b{i}", 10) for i in range(20)], FIRES), fire_table)
    assert rows(spark.table(fire_table), "uid") == sorted([(f"a{i}",) for i in range(20)] + [(f"b{i}",) for i in range(20)])


def test_rows_written_past_the_filter_are_seen(spark, rows, fire_table):
    keyindex.append_indexed(spark.createDataFrame([detection("a", 10)], FIRES), fire_table)
    tables.append_detections(spark.createDataFrame([detection("b", 10), detection("c", 11)], FIRES), fire_table)
    keyindex.append_indexed(spark.createDataFrame([detection(x, d) for x, d in (("a", 10), ("b", 10), ("c", 11), ("d", 11))], FIRES), fire_table)
    assert rows(spark.table(fire_table), "uid") == [("a",), ("b",), ("c",), ("d",)]
    assert keyindex.build_key_index(spark, fire_table).count() == 4
    assert keyindex.covered_days(spark, fire_table, [date(2024, 1, 10), date(2024, 1, 11)]) == [date(2024, 1, 10), date(2024, 1, 11)]


def test_keys_without_rows_do_no_harm(spark, rows, fire_table):
    """As after a job that ended between the filter and the table."""
    keyindex.append_indexed(spark.createDataFrame([detection("a", 10)], FIRES), fire_table)
    lost = spark.createDataFrame([("b", date(2024, 1, 10))], "uid string, acq_day date")
    keyindex._add(lost.select(keyindex.fingerprint(F.col("uid")).alias("fingerprint"), "acq_day"), keyindex.index_name(fire_table))
    keyindex.append_indexed(spark.createDataFrame([detection("b", 10)], FIRES), fire_table)
    assert rows(spark.table(fire_table), "uid") == [("a",), ("b",)]


APPEND_SCRIPT = """
from emberbasin.sources import keyindex, tables
def batch(first, last, day):
    return spark.range(first, last).select(
        F.md5(F.col("id").cast("string")).alias("uid"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(300.0).alias("brightness_temp_i4"),
        F.lit(280.0).alias("brightness_temp_i5"), F.lit(5.0).alias("frp_mw"), F.expr(f"timestamp_ntz'2024-01-{day} 09:00:00'").alias("acquisition_timestamp"),
        F.lit("N").alias("satellite"), F.lit("v").alias("version"), F.lit("high").alias("confidence"), F.lit("D").alias("day_night"), F.lit(1.0).alias("hours_old"))
for kind, append in (("plain", tables.append_detections), ("indexed", keyindex.append_indexed)):
    table = tables.create_fire_table(spark, "main." + kind)
    for day in (10, 11):
        append(batch(1000 * day, 1000 * day + 5000, day), table)
    step(kind)
    append(batch(50_000, 50_200, 10).unionByName(batch(60_000, 60_200, 11)).unionByName(batch(11_000, 11_010, 11)), table)
    step("no")
    print(kind, spark.table(table).count(), spark.table(table).agg(F.sum(F.xxhash64("uid").cast("decimal(38,0)"))).first()[0])
"""


def test_the_filter_reads_fewer_keys(logged):
    printed, scans = logged
    assert printed["plain"] == printed["indexed"] and printed["indexed"].split()[0] == "10400"
    # The rows counted by day are rows of the fire table as well, though no column of them is read.
    uids = {k: sum(s["rows"] for s in scans if s["step"] == k and s["place"].rstrip("]").split("?")[0].count(f"/{k}/") and not s["place"].count("_keys")) for k in ("plain", "indexed")}
    assert uids["plain"] >= 10_000, scans
    assert uids["indexed"] <= 15_000, scans


# -- the summary -------------------------------------------------------------------------


@pytest.fixture
def summarised(spark, fire_table):
    r = random.Random(4)
    moments = [datetime(2024, 1, 1) + timedelta(seconds=r.randint(0, 9 * 86400), microseconds=r.choice([0, 0, 500_000])) for _ in range(600)]
    edge = [10.0, 13.0, 12.999, 20.0, 25.5, 9.999, float("nan"), None, -10.0, 95.0]
    rows = [
        detection(f"u{i}", lat=r.choice(edge) if i % 5 == 0 else r.uniform(5, 20), lon=r.uniform(15, 30), frp=r.choice([None, 1.25, 70.0]),
                  confidence=r.choice(["high", "nominal", None]), age=float(r.randint(0, 5)), moment=m)
        for i, m in enumerate(moments)
    ] + [detection("timeless", None)]
    r.shuffle(rows)
    rollup.create_rollup(spark, fire_table)
    for k in range(0, len(rows), 301):  # rows of all days in each batch
        keyindex.append_indexed(spark.createDataFrame(rows[k : k + 301], FIRES), fire_table, [rollup.add_batch])
    return fire_table


def direct(spark, table, start, end, box):
    kept = spark.table(table).where((F.col("acquisition_timestamp") >= F.lit(start.isoformat()).cast("timestamp_ntz")) & (F.col("acquisition_timestamp") < F.lit(end.isoformat()).cast("timestamp_ntz")))
    if box:
        kept = kept.where(ops.in_box(*box))
    return kept


SPANS = [
    (datetime(2024, 1, 2, 7, 31), datetime(2024, 1, 8, 18)), (datetime(2024, 1, 2), datetime(2024, 1, 8)), (datetime(2024, 1, 3, 1), datetime(2024, 1, 3, 2)),
    (datetime(2024, 1, 3), datetime(2024, 1, 4)), (datetime(2023, 1, 1), datetime(2025, 1, 1)), (datetime(2024, 3, 1), datetime(2024, 3, 5)),
]
ASKED = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 1), (3, 3), (4, 0), (4, 4), (5, 0)]
BOXES = [None, (10.0, 13.0, 16.0, 26.0), (9.5, 13.5, 16.2, 25.9), (11.2, 11.4, 17.0, 25.0), (-95.0, 95.0, -200.0, 200.0)]


def test_totals_from_the_summary(spark, rows, summarised):
    spark.sql(f"ALTER TABLE {rollup.rollup_name(summarised)} DROP PARTITION (acq_day = DATE'2024-01-05')")
    for (start, end), box in ((SPANS[i], BOXES[j]) for i, j in ASKED):
        want = direct(spark, summarised, start, end, box).agg(*rollup.measures()).collect()
        got = rollup.totals(spark, start, end, summarised, box).collect()
        assert [x[:2] for x in got] == [x[:2] for x in want], (start, end, box)
        assert all(a == pytest.approx(b) for a, b in zip(got[0], want[0]))
    got = rollup.emission_answer(rollup.totals(spark, datetime(2024, 1, 2), datetime(2024, 1, 9), summarised, BOXES[2])).first()
    want = box_emissions(spark.table(summarised), *BOXES[2], "2024-01-02", "2024-01-08").first()
    assert got.fire_count == want.fire_count and all(a == pytest.approx(b) for a, b in zip(got, want))
    # Late rows of many days, compaction, and a day that something else has written to.
    late = [detection(f"late{i}", 2 + i % 5, lat=12.0, lon=20.0) for i in range(30)]
    keyindex.append_indexed(spark.createDataFrame(late, FIRES), summarised, [rollup.add_batch])
    rollup.compact(spark, summarised, [date(2024, 1, 3)])
    start, end = SPANS[0]
    ask = lambda: rows(rollup.totals(spark, start, end, summarised, BOXES[2], ["confidence", "acq_day"]).select("confidence", "acq_day", "fire_count"))
    want = rows(direct(spark, summarised, start, end, BOXES[2]).groupBy("confidence", "acq_day").agg(F.count(F.lit(1))))
    assert ask() == want
    tables.append_detections(spark.createDataFrame([detection("past", 4, lat=12.0, lon=20.0)], FIRES), summarised)
    assert date(2024, 1, 4) not in rollup.true_days(spark, summarised, date(2024, 1, 2), date(2024, 1, 8))
    want = rows(direct(spark, summarised, start, end, BOXES[2]).groupBy("confidence", "acq_day").agg(F.count(F.lit(1))))
    assert ask() == want
    rollup.refresh(spark, summarised, [date(2024, 1, 4)])
    assert date(2024, 1, 4) in rollup.true_days(spark, summarised, date(2024, 1, 2), date(2024, 1, 8))
    assert ask() == want
    high = rollup.totals(spark, start, end, summarised, group_by=["satellite"], confidence="high").collect()
    assert high[0].fire_count == direct(spark, summarised, start, end, None).where("confidence = 'high'").count()
    with pytest.raises(ValueError):
        rollup.totals(spark, start, end, summarised, group_by=["frp_mw"])


ROLLUP_SCRIPT = """
from emberbasin.sources import keyindex, rollup, tables
from datetime import datetime
table = tables.create_fire_table(spark, "main.summed")
rollup.create_rollup(spark, table)
rows = spark.range(40_000).select(
    F.md5(F.col("id").cast("string")).alias("uid"), (F.col("id") % 4 + 0.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit(300.0).alias("brightness_temp_i4"),
    F.lit(280.0).alias("brightness_temp_i5"), F.lit(5.0).alias("frp_mw"), F.expr("timestamp_ntz'2024-01-01 09:00:00' + make_dt_interval(cast(id % 10 as int))").alias("acquisition_timestamp"),
    F.lit("N").alias("satellite"), F.lit("v").alias("version"), F.lit("high").alias("confidence"), F.lit("D").alias("day_night"), F.lit(1.0).alias("hours_old"))
keyindex.append_indexed(rows, table, [rollup.add_batch])
step("asked")
found = rollup.totals(spark, datetime(2024, 1, 1, 12), datetime(2024, 1, 10, 12), table).first()
step("no")
print("summed", found.fire_count)
"""


def test_whole_days_are_answered_without_their_rows(logged):
    printed, scans = logged
    assert printed["summed"] == "36000"
    read = [s["rows"] for s in scans if s["step"] == "asked" and "_rollup" not in s["place"]]
    assert sum(sorted(read)[:-1] or read) <= 44_000  # the counts by day are from footers, a scan without columns
