"""Landing and reading pages: files, batches and partitions grow with the rows and no faster."""

from __future__ import annotations

import json

import pytest
from emberbasin.registry import sources as registered
from emberbasin.schemas import FEED
from emberbasin.sources import files
from emberbasin.sources.pages import PARTITIONS, FeedPages
from emberbasin.streaming import ingest
from pyspark.sql import functions as F


@pytest.fixture
def feed(spark):
    def make(rows):
        known = {"OBJECTID": F.col("id"), "latitude": F.col("id") % 90 + 0.5, "confidence": F.lit("high")}
        return spark.range(rows).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FEED.fields])

    return make


def test_landed_pages_are_as_large_as_those_of_a_pull(spark, feed, tmp_path):
    registered._land_pages(feed(20_000), str(tmp_path / "pages"))
    assert len(list((tmp_path / "pages").glob("*.json"))) <= 3
    found = files.read_feed_pages(spark, str(tmp_path / "pages"))
    assert found.agg(F.count("OBJECTID"), F.sum("OBJECTID")).first() == (20_000, 199_990_000)


def test_small_pages_make_no_more_batches(spark, tmp_path, monkeypatch):
    batches = []
    monkeypatch.setattr(ingest, "append_detections", lambda batch, table: batches.append(batch.count()))
    (tmp_path / "in").mkdir()
    row = {f.name: None for f in FEED.fields} | {"latitude": 1.0, "longitude": 2.0, "confidence": "high", "acq_time": "1704879000000"}
    for i in range(1_100):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"features": [{"attributes": row | {"OBJECTID": i}}]}))
    for per_batch in (None, 600):
        pages = ingest.stream_feed_pages(spark, str(tmp_path / "in"), per_batch)
        ingest.start_ingest(pages, "main.none", str(tmp_path / f"check{per_batch}"), available_now=True).awaitTermination()
    assert len(batches) == 3 and batches[0] == sum(batches[1:]) > 0


def test_small_pages_in_a_row_share_a_partition(spark, feed, tmp_path):
    folder = tmp_path / "offsets"
    registered._land_offsets(feed(3_005), str(folder), 10)
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == sorted(f"offset={i}.json" for i in range(0, 3_005, 10))
    spark.dataSource.register(FeedPages)
    found = spark.read.format("feed_pages").option("pageSize", 10).load(str(folder))
    assert found.rdd.getNumPartitions() <= 2 * PARTITIONS
    assert found.agg(F.count("OBJECTID"), F.sum("OBJECTID")).first() == (3_005, 3_004 * 3_005 // 2)
    assert len(json.loads((folder / "offset=3000.json").read_text())["features"]) == 5
    (folder / "offset=200.json").write_text('{"features": []}')
    with pytest.raises(Exception, match="page of offset 200 is short"):
        found.count()
