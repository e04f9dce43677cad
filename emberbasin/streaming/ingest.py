"""Continuous ingest of landed feed pages, each detection once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberbasin.operators.cleaning import clean_detections
from emberbasin.schemas import FEED_PAGE, FIRE_TABLE
from emberbasin.session import shared_root
from emberbasin.sources.files import explode_pages
from emberbasin.sources.tables import append_detections

TIME = "acquisition_timestamp"
LATENESS = "2 days"
#: About a thousand pages of the feed's own size.
BATCH_BYTES = 4 << 30


def stream_feed_pages(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, bytes_per_batch: int = BATCH_BYTES
) -> DataFrame:
    """Feed rows of the pages that land in a folder.

    A batch is bounded by the bytes of its pages, as each batch looks at the stored keys: by a number of
    files, many small pages would make many batches. ``files_per_batch`` bounds it by files instead.
    """
    pages = spark.readStream.schema(FEED_PAGE).option("multiLine", True)
    if files_per_batch is None:
        pages = pages.option("maxBytesPerTrigger", bytes_per_batch)
    else:
        pages = pages.option("maxFilesPerTrigger", files_per_batch)
    return explode_pages(pages.json(folder))


def once_per_key(detections: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First arrival of each uid while the watermark remembers it.

    A watermark needs a time with zone, so the zone-free UTC time is cast for it
    (the session runs in UTC) and the cast column is dropped afterwards.
    """
    timed = detections.withColumn("event_time", F.col(TIME).cast("timestamp"))
    first = timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["uid"])
    return first.drop("event_time")


def start_ingest(
    feed: DataFrame,
    table: str = FIRE_TABLE,
    checkpoint: str | None = None,
    lateness: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Cleans the feed and appends what is new to the fire table.

    The anti join against the table in each batch keeps every uid once, however
    late it comes, and makes a batch that is run again after a failure add nothing.
    Where detections are known to arrive within ``lateness``, stream state of that
    length drops the repeats before they reach the join; it also drops rows that
    are later still, so it is off unless asked for.
    """
    root = checkpoint or f"{shared_root(feed.sparkSession)}/ingest/{table}"

    def append(batch: DataFrame, _: int) -> None:
        # The append looks at the batch twice; pages are parsed, and state is read, once.
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            append_detections(kept, table)
        finally:
            kept.unpersist()

    detections = clean_detections(feed)
    if lateness is not None:
        detections = once_per_key(detections, lateness)
    writer = detections.writeStream.foreachBatch(append).option("checkpointLocation", root)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
