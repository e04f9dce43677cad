"""Scans, sinks, tables, catalog and streams: each writes derived data to a new folder and reads it back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberbasin.fixtures import duck, fixture, table
from emberbasin.operators.cleaning import clean_detections, clean_region_lookup
from emberbasin.plans.lineage import cut_lineage
from emberbasin.plans.local import local_rows
from emberbasin.registry.base import ORACLES, query, scratch
from emberbasin.registry.cleaning import BASELINE_VALUES, CLEAN_FEED, marked
from emberbasin.schemas import FEED, FIRES, REGION_TABLE, WATER_TABLES
from emberbasin.sources import files, publish, tables
from emberbasin.sources.pages import PAGE_SIZE, FeedPages, land
from emberbasin.streaming.ingest import once_per_key, start_ingest, stream_feed_pages
from emberbasin.streaming.sightings import PROVIDER, ROCKS, sightings


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"""
)
def source_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orders-csv")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    files.write_csv(orders, path)
    return files.read_csv(spark, path, orders.schema)


@query(
    f"""{duck('baseline')} SELECT aq30_id, name_1, bws_raw,
      CASE WHEN bws_label = 'N/A' THEN NULL ELSE bws_label END AS bws_label, gtd_score FROM baseline"""
)
def source_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "baseline-csv")
    columns = ["aq30_id", "name_1", "bws_raw", "bws_label", "gtd_score"]
    files.write_csv(fixture(spark, sf_dir, "baseline").select(*columns), path)
    return files.read_raw_csv(spark, path)


@query(f"{duck('continents')} SELECT trim(country) AS country, trim(continent) AS continent FROM continents")
def source_continents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "continents")
    files.write_csv(fixture(spark, sf_dir, "continents"), path)
    return files.read_continents(spark, path)




def _land_pages(feed: DataFrame, path: str) -> None:
    """The feed as JSON pages of up to the features that a pull asks for at a time, one page a file."""
    row = F.struct(F.struct(*[F.col(c) for c in feed.columns]).alias("attributes"))
    number = F.pmod(F.xxhash64(*feed.columns), F.lit(1 + feed.count() // (PAGE_SIZE // 2)))
    pages = feed.groupBy(number.alias("page")).agg(F.collect_list(row).alias("features"))
    pages.select("features").write.option("maxRecordsPerFile", 1).json(path)


@query(f"{duck('feed')} SELECT * FROM feed")
def source_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pages")
    _land_pages(fixture(spark, sf_dir, "feed").select(*FEED.fieldNames()), path)
    return files.read_feed_pages(spark, path)


PAGE = 250


RANGE_ROWS = 50_000


def _land_offsets(feed: DataFrame, path: str, size: int) -> None:
    """The feed as full JSON pages and a last short one, each in a file of its offset.

    Rows are numbered by ranges: a count a range, and numbers within it.
    """
    order = ["OBJECTID", F.xxhash64(*feed.columns)]
    ranges = max(8, feed.count() // RANGE_ROWS)
    dealt = feed.repartitionByRange(ranges, *order).select("*", F.spark_partition_id().alias("_range"))
    dealt = cut_lineage(dealt)
    sums = dealt.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    row = F.struct(F.struct(*[F.col(c) for c in feed.columns]).alias("attributes"))
    numbered = dealt.join(F.broadcast(sums), "_range").select(place.alias("_place"), row.alias("_row"))
    numbered = numbered.select((F.floor(F.col("_place") / size) * size).alias("offset"), "_row")
    texts = numbered.groupBy("offset").agg(F.to_json(F.struct(F.collect_list("_row").alias("features"))).alias("value"))
    land(texts, path)


def _new_table(spark: SparkSession, name: str) -> str:
    location = scratch(spark, name)
    unique = f"main.{name}_{location.rsplit('-', 1)[1]}"
    return tables.create_fire_table(spark, unique, location)


@query(f"{duck('feed')} SELECT * FROM feed")
def source_paged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages by the data source, a partition a page."""
    path = scratch(spark, "offsets")
    _land_offsets(fixture(spark, sf_dir, "feed").select(*FEED.fieldNames()), path, PAGE)
    spark.dataSource.register(FeedPages)
    return spark.read.format("feed_pages").option("pageSize", PAGE).load(path)


@query(f"{CLEAN_FEED} SELECT DISTINCT * FROM clean")
def stream_paged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream into a new table."""
    path = scratch(spark, "paged")
    _land_offsets(fixture(spark, sf_dir, "feed").select(*FEED.fieldNames()), f"{path}/in", PAGE)
    spark.dataSource.register(FeedPages)
    name = _new_table(spark, "paged")
    feed = spark.readStream.format("feed_pages").option("pageSize", PAGE).load(f"{path}/in")
    query = start_ingest(feed, name, f"{path}/check")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).select(*FIRES.fieldNames())


@query(f"{CLEAN_FEED} SELECT DISTINCT * FROM clean")
def source_incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_detections(fixture(spark, sf_dir, "feed"))
    name = _new_table(spark, "detections")
    early = rows.where(F.col("hours_old") > 240)
    tables.append_detections(early, name)
    tables.append_detections(rows, name)
    tables.append_detections(early, name)
    return spark.table(name).select(*FIRES.fieldNames())


@query(f"{CLEAN_FEED} SELECT uid FROM clean WHERE hours_old <= 240")
def source_unseen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_detections(fixture(spark, sf_dir, "feed"))
    stored = rows.where(F.col("hours_old") > 240)
    return tables.unseen(rows, stored, within_batch=False).select("uid")


@query(f"{CLEAN_FEED} SELECT count(*) AS rows, '2024-01-31_P2' AS name FROM clean")
def source_numbered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "exports")
    rows = clean_detections(fixture(spark, sf_dir, "feed"))
    files.export_numbered(rows, folder, "cleaned", date(2024, 1, 31))
    path = files.export_numbered(rows, folder, "cleaned", date(2024, 1, 31))
    written = files.read_csv(spark, path, rows.schema)
    return written.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "name", F.lit(path.rsplit("cleaned_", 1)[1])
    )


@query(
    f"""{duck('baseline')}, clean AS (SELECT {marked(BASELINE_VALUES)} FROM baseline)
    SELECT 'Baseline_Annual' AS "table", count(*) AS rows FROM clean
    UNION ALL SELECT 'Region_Lookup', count(*) FROM (
      SELECT DISTINCT name_0, pfaf_id, name_1, area_km2, gid_0 FROM clean
      WHERE name_0 IS NOT NULL AND name_1 IS NOT NULL AND gid_0 IS NOT NULL)"""
)
def source_load_and_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSVs loaded into a new store, which is then opened again from its files."""
    root = scratch(spark, "store")
    database = f"store_{root.rsplit('-', 1)[1]}"
    baseline = fixture(spark, sf_dir, "baseline")
    csv = {
        "Baseline_Annual": f"{root}/csv/baseline",
        "Region_Lookup": f"{root}/csv/lookup",
        "Future_Annual": f"{root}/csv/not-there",
    }
    files.write_csv(baseline, csv["Baseline_Annual"])
    files.write_csv(clean_region_lookup(baseline), csv["Region_Lookup"])
    tables.open_store(spark, root, csv, database=database)
    opened = tables.open_store(spark, root, csv, database=database)
    return tables.row_counts({name: spark.table(f"{database}.{name}") for name in opened})


@query(
    f"""{duck('fires')}, columns_ AS (SELECT * FROM (VALUES
      {', '.join(f"({i}, '{f.name}', '{f.dataType.simpleString()}')" for i, f in enumerate(FIRES.fields))})
      v(position, "column", type))
    SELECT 'fires' AS dataset, (SELECT count(*) FROM fires) AS rows, position, "column", type
    FROM columns_"""
)
def source_describe_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = tables.describe_fires(fixture(spark, sf_dir, "fires"), "fires")
    return described.drop("note", "description")


@query(f"{duck('baseline')} SELECT * FROM baseline ORDER BY aq30_id LIMIT 5")
def source_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.head(fixture(spark, sf_dir, "baseline"), 5, ["aq30_id"])


@query(
    """SELECT 'orders' AS "table", count(*) AS rows FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'events', count(*) FROM events"""
)
def source_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["orders", "lineitem", "events"]
    return tables.row_counts({name: table(spark, sf_dir, name) for name in names})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def source_query_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return tables.query_frame(events, "SELECT event_type, count(*) AS n FROM {df} GROUP BY 1")


@query(
    r"""WITH lines AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents)
    SELECT doc_id, CAST(i - 1 AS INT) AS position, a[i] AS line
    FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM lines)
    WHERE NOT (i = len(a) AND a[i] = '')"""
)
def source_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.document_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"{CLEAN_FEED} SELECT DISTINCT * FROM clean")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages as a stream into a new table; a second run over the same pages adds nothing."""
    path = scratch(spark, "landed")
    _land_pages(fixture(spark, sf_dir, "feed").select(*FEED.fieldNames()), path)
    name = _new_table(spark, "stream")
    for run in ("first", "second"):
        start_ingest(stream_feed_pages(spark, path), name, f"{path}-{run}", available_now=True).awaitTermination()
    return spark.table(name).select(*FIRES.fieldNames())


@query(f"{CLEAN_FEED} SELECT DISTINCT uid FROM clean")
def stream_once_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream state alone: with all rows in one batch nothing is late."""
    path = scratch(spark, "keys")
    feed = fixture(spark, sf_dir, "feed").select(*FEED.fieldNames())
    feed.write.parquet(f"{path}/in")
    source = spark.readStream.schema(feed.schema).parquet(f"{path}/in")
    once_per_key(clean_detections(source), "60 days").select("uid").writeStream.format(
        "parquet"
    ).option("checkpointLocation", f"{path}/check").trigger(once=True).start(
        f"{path}/out"
    ).awaitTermination()
    return spark.read.schema("uid string").parquet(f"{path}/out")


@query(
    f"""{CLEAN_FEED} SELECT uid, CASE WHEN row_number() OVER w = 1 THEN 'first' ELSE 'update' END AS kind, row_number() OVER w AS pull, hours_old,
      min(hours_old) OVER (PARTITION BY uid) AS first_hours_old, max(hours_old) OVER w AS last_hours_old
    FROM clean WINDOW w AS (PARTITION BY uid ORDER BY hours_old ROWS UNBOUNDED PRECEDING)"""
)
def stream_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sights and repeats of the feed's detections, by keyed state; all rows come in one batch."""
    path = scratch(spark, "sightings")
    feed = fixture(spark, sf_dir, "feed").select(*FEED.fieldNames())
    feed.write.parquet(f"{path}/in")
    rows = sightings(clean_detections(spark.readStream.schema(feed.schema).parquet(f"{path}/in")))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        # One batch: with a time-to-live batches without rows never end by themselves.
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").trigger(once=True).start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


class _Store:
    """A database of its own, dropped with its tables at the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch(spark, name)
        self.database = f"{name}_{self.root.rsplit('-', 1)[1]}"

    def __enter__(self) -> _Store:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def csv(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/csv/{name}"
        files.write_csv(rows, path)
        return path

    def table(self, name: str) -> str:
        return f"{self.database}.{name}"

    def counts(self) -> list[tuple[str, int]]:
        """Tables in the order of the catalog listing, with their rows."""
        names = [r["dataset"] for r in tables.list_datasets(self.spark, [self.database]).collect()]
        return [(n.rsplit(".", 1)[1], self.spark.table(n).count()) for n in names]


COUNTS = 'step string, position int, "table" string, rows bigint'.replace('"', "`")


def _steps(spark: SparkSession, steps: dict[str, list[tuple[str, int]]]) -> DataFrame:
    rows = [(step, i, name, n) for step, found in steps.items() for i, (name, n) in enumerate(found)]
    return local_rows(spark, rows, COUNTS)


@query(
    """WITH o AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer)
    SELECT 'loaded' AS step, 0::INTEGER AS position, 'customers' AS "table", n AS rows FROM c
    UNION ALL SELECT 'loaded', 1, 'orders', n FROM o
    UNION ALL SELECT 'loaded again', 0, 'orders', n FROM o
    UNION ALL SELECT 'missing made', 0, 'customers', n FROM c
    UNION ALL SELECT 'missing made', 1, 'orders', n FROM o"""
)
def source_load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables anew from their CSVs, one of which is then gone, and then only what is missing."""
    with _Store(spark, "load") as store:
        paths = {
            store.table("orders"): store.csv("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")),
            store.table("customers"): store.csv("customers", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")),
        }
        steps = {}
        tables.load_tables(spark, paths)
        steps["loaded"] = store.counts()
        tables.load_tables(spark, paths | {store.table("customers"): f"{store.root}/not-there"})
        steps["loaded again"] = store.counts()
        tables.ensure_tables(spark, paths)
        steps["missing made"] = store.counts()
    return _steps(spark, steps)


def _built(name: str, text: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS n FROM ({text})"


@query(
    "WITH built AS ("
    + " UNION ALL ".join(
        _built(name.lower(), ORACLES[q])
        for name, q in zip(WATER_TABLES, ("clean_baseline_annual", "clean_baseline_monthly", "clean_future_annual"))
    )
    + f""" UNION ALL {_built(REGION_TABLE.lower(), f"{duck('baseline')}, clean AS (SELECT {marked(BASELINE_VALUES)} FROM baseline) SELECT DISTINCT name_0, pfaf_id, name_1, area_km2, gid_0 FROM clean WHERE name_0 IS NOT NULL AND name_1 IS NOT NULL AND gid_0 IS NOT NULL")})
    SELECT 'built' AS step, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS position, name AS "table", n AS rows FROM built"""
)
def source_build_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprocessing chain: raw CSVs to cleaned tables."""
    with _Store(spark, "water") as store:
        raw = [store.csv(name, fixture(spark, sf_dir, name)) for name in ("baseline", "monthly", "future")]
        tables.build_water_tables(spark, *raw, database=store.database)
        return _steps(spark, {"built": store.counts()})


@query(
    """WITH t AS (SELECT count(*) AS n FROM orders)
    SELECT 'orders' AS dataset, true AS there, n AS rows, position, "column", type
    FROM t, (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_totalprice', 'double'), (2, 'o_orderstatus', 'string')) v(position, "column", type)
    UNION ALL SELECT 'nothing', false, NULL, NULL, NULL, NULL"""
)
def source_dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, columns and types of a table, and the answer for a table that isn't there."""
    with _Store(spark, "info") as store:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double"), "o_orderstatus")
        tables.save_table(orders, store.table("orders"))
        rows = []
        for name in ("orders", "nothing"):
            there, info = tables.table_exists(spark, store.table(name)), tables.dataset_info(spark, store.table(name))
            found = [tuple(r) for r in info.select("rows", "position", "column", "type").collect()] if info else [(None,) * 4]
            rows += [(name, there, *r) for r in found]
    return local_rows(spark, rows, "dataset string, there boolean, rows bigint, position int, `column` string, type string")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def source_loaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table that was loaded from its CSV, overwritten by another load."""
    name = f"main.loaded_{scratch(spark, 'x').rsplit('-', 1)[1]}"
    path = scratch(spark, "orders-load")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    for part in (rows.where("o_orderkey % 2 = 0"), rows):
        files.write_csv(part, path)
        tables.load_tables(spark, {name: path})
    return spark.table(name).select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_orderpriority")


@query(
    f"""SELECT * REPLACE (CAST(bws_cat AS BIGINT) AS bws_cat, CAST(pfaf_id AS BIGINT) AS pfaf_id, nullif(bws_label, 'N/A') AS bws_label)
    FROM ({ORACLES["clean_baseline_annual"]})"""
)
def source_published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water tables published, published anew, and a third version that fails midway: the second is what is read."""
    root = scratch(spark, "published")
    raw = []
    for name in ("baseline", "monthly", "future"):
        raw.append(f"{root}/csv/{name}")
        files.write_csv(fixture(spark, sf_dir, name), raw[-1])
    cleaned = publish.water_tables(spark, *raw)
    names = list(cleaned)
    publish.publish(spark, f"{root}/store", {n: df.limit(0) for n, df in cleaned.items()})
    publish.publish(spark, f"{root}/store", cleaned)
    try:
        broken = cleaned[names[1]].select(F.raise_error("midway").cast("string").alias("x"))
        publish.publish(spark, f"{root}/store", {names[0]: cleaned[names[0]].limit(1), names[1]: broken})
    except Exception as error:
        if "midway" not in str(error):
            raise
    return publish.read_published(spark, f"{root}/store")[names[0]]
