"""Tables: creation, loading, incremental append, and questions about the catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.functions.columns import named
from emberbasin.functions.filters import DAY_COLUMN
from emberbasin.operators.cleaning import (
    clean_baseline_annual,
    clean_baseline_monthly,
    clean_future_annual,
    clean_region_lookup,
)
from emberbasin.plans.joins import equi_join
from emberbasin.plans.local import local_rows
from emberbasin.schemas import FIRE_TABLE, FIRES, REGION_TABLE, WATER_TABLES
from emberbasin.sources.files import read_csv, read_raw_csv

DATABASE = "main"
FIRE_NOTES = (
    "Thermal hotspots of the VIIRS 375 m active-fire product, near real time. "
    "Each row is one detected hotspot pixel."
)


def full_name(name: str, database: str = DATABASE) -> str:
    """``database.table``; a bare name belongs to the default database."""
    return name if "." in name else f"{database}.{name}"


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(full_name(name))


def create_fire_table(
    spark: SparkSession, name: str = FIRE_TABLE, location: str | None = None, row_group_bytes: int | None = None
) -> str:
    """The fire table if it is not there yet, as Parquet laid out by day of acquisition.

    Smaller row groups than Parquet's own let a box filter skip more, see ``sources.layout``.
    """
    table = full_name(name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()} COMMENT '{f.metadata['comment']}'"
        for f in FIRES.fields
    )
    at = f" LOCATION '{location}'" if location else ""
    sized = f"OPTIONS ('parquet.block.size' = '{row_group_bytes}') " if row_group_bytes else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {DAY_COLUMN} DATE) USING parquet {sized}"
        f"PARTITIONED BY ({DAY_COLUMN}){at}"
    )
    return table


def one_per_key(rows: DataFrame, key: str = "uid", first_by: str = "hours_old") -> DataFrame:
    """One row per key: the one with the smallest ``first_by``, then the smallest of the rest.

    A minimum over structs is combined before the shuffle, so many copies of one
    key reach a task as one row per input task, and the choice repeats.
    """
    if first_by not in rows.columns:
        return rows.dropDuplicates([key])
    others = [c for c in rows.columns if c not in (key, first_by)]
    least = F.min(F.struct(named(first_by), *[named(c) for c in others])).alias("row")
    return rows.groupBy(key).agg(least).select(
        *[named(c) if c == key else F.col("row")[c].alias(c) for c in rows.columns]
    )


def unseen(
    batch: DataFrame, stored: DataFrame, key: str = "uid", within_batch: bool = True
) -> DataFrame:
    """Batch rows whose key is not stored yet.

    ``within_batch=False`` leaves copies inside the batch, as a check against
    stored rows alone would; a key with very many copies is then split.
    """
    known = stored.select(key)
    if within_batch:
        fresh = one_per_key(batch, key).join(known, key, "left_anti")
    else:
        fresh = equi_join(batch, known, key, "left_anti")
    return fresh.select(*batch.columns)


def on_days(fires: DataFrame, days: Sequence[date | None]) -> DataFrame:
    """The partitions of these days; None stands for rows without a time."""
    known = [d for d in days if d is not None]
    wanted = F.col(DAY_COLUMN).isin(known) if known else F.lit(False)
    return fires.where(wanted | F.col(DAY_COLUMN).isNull() if None in days else wanted)


def append_detections(
    batch: DataFrame, name: str = FIRE_TABLE, within_batch: bool = True
) -> DataFrame:
    """Appends the cleaned rows whose uid is new to the fire table and returns the table.

    A uid contains the acquisition time, so only the days that the batch has rows of can hold it:
    the stored side is pruned to those partitions, that of rows without a time among
    them. Columns go by name, missing ones become null. Writing the same batch again adds nothing.
    The file listing is refreshed first: another session, such as a stream's, may
    have written since this one last looked.
    """
    spark = batch.sparkSession
    table = full_name(name)
    dated = batch.withColumn(DAY_COLUMN, F.to_date("acquisition_timestamp"))
    days = [r[0] for r in dated.select(DAY_COLUMN).distinct().collect()]  # a row for each day
    if not days:
        return spark.table(table)
    spark.catalog.refreshTable(table)
    stored = on_days(spark.table(table), days)
    fresh = unseen(dated, stored, within_batch=within_batch)
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in FIRES.fields if f.name not in fresh.columns
    }
    ordered = fresh.withColumns(missing).select(*FIRES.fieldNames(), DAY_COLUMN)
    ordered.hint("rebalance", DAY_COLUMN).write.insertInto(table)
    return spark.table(table)


def save_table(df: DataFrame, name: str, location: str | None = None) -> None:
    """Writes a table, in place of one that is there."""
    table = full_name(name)
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", location) if location else writer).saveAsTable(table)


def _csv_or_none(spark: SparkSession, path: str | None, raw: bool = False) -> DataFrame | None:
    if not path:
        return None
    try:
        return read_raw_csv(spark, path) if raw else read_csv(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_tables(spark: SparkSession, csv_paths: Mapping[str, str]) -> list[str]:
    """Each table anew from its CSV; tables whose file is missing are dropped and passed over."""
    loaded = []
    for name, path in csv_paths.items():
        rows = _csv_or_none(spark, path)
        if rows is None:
            spark.sql(f"DROP TABLE IF EXISTS {full_name(name)}")
        else:
            save_table(rows, name)
            loaded.append(name)
    return loaded


def ensure_tables(
    spark: SparkSession, csv_paths: Mapping[str, str], read_only: bool = False
) -> list[str]:
    """Only the missing tables from their CSVs; RuntimeError when any is missing in read-only use."""
    missing = [name for name in csv_paths if not table_exists(spark, name)]
    if missing and read_only:
        raise RuntimeError(f"read-only, but tables are missing: {', '.join(missing)}")
    return load_tables(spark, {name: csv_paths[name] for name in missing})


def build_water_tables(
    spark: SparkSession, raw_annual: str, raw_monthly: str, raw_future: str, database: str = DATABASE
) -> list[str]:
    """Raw CSVs cleaned and saved as the three water tables and the region lookup."""
    annual = read_raw_csv(spark, raw_annual)
    cleaned = [
        clean_baseline_annual(annual),
        clean_baseline_monthly(read_raw_csv(spark, raw_monthly)),
        clean_future_annual(read_raw_csv(spark, raw_future)),
        clean_region_lookup(annual),
    ]
    names = [*WATER_TABLES, REGION_TABLE]
    for name, rows in zip(names, cleaned):
        save_table(rows, full_name(name, database))
    return names


def list_datasets(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    """``dataset`` of every table as ``database.table``, in order; views are left out."""
    wanted = list(databases) if databases else [d.name for d in spark.catalog.listDatabases()]
    names = [
        (f"{database}.{table.name}",)
        for database in wanted
        if spark.catalog.databaseExists(database)
        for table in spark.catalog.listTables(database)
        if not table.isTemporary and table.tableType != "VIEW"
    ]
    return local_rows(spark, names, "dataset string").orderBy("dataset")


def describe_frame(df: DataFrame, name: str, notes: Mapping[str, str] | None = None) -> DataFrame:
    """``dataset, rows, position, column, type, note`` for every column."""
    comments = {f.name: f.metadata.get("comment") for f in df.schema.fields} | dict(notes or {})
    columns = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(column).alias("column"),
            F.lit(kind).alias("type"),
            F.lit(comments.get(column)).cast("string").alias("note"),
        )
        for position, (column, kind) in enumerate(df.dtypes)
    ]
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.lit(name).alias("dataset"), "rows", F.inline(F.array(*columns)))


def dataset_info(spark: SparkSession, name: str) -> DataFrame | None:
    """Row count, columns and types of a table; None for an unknown one."""
    if not table_exists(spark, name):
        return None
    return describe_frame(spark.table(full_name(name)), full_name(name))


def describe_fires(fires: DataFrame, name: str = FIRE_TABLE) -> DataFrame:
    """The fire table's row count, columns, types and field notes."""
    notes = {f.name: f.metadata["comment"] for f in FIRES.fields}
    return describe_frame(fires, name, notes).withColumn("description", F.lit(FIRE_NOTES))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, rows`` for several tables."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    result = counted[0]
    for one in counted[1:]:
        result = result.unionByName(one)
    return result


def head(df: DataFrame, rows: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first rows; which ones is open without ``order_by``."""
    return (df.orderBy(*[named(c) for c in order_by]) if order_by else df).limit(rows)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Temp views, so that SQL can name the frames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query_frame(df: DataFrame, sql: str) -> DataFrame:
    """SQL over one frame, named ``{df}`` in the text."""
    return df.sparkSession.sql(sql, df=df)


def open_store(
    spark: SparkSession,
    root: str,
    csv_paths: Mapping[str, str] | None = None,
    auto_load: bool = True,
    database: str = DATABASE,
) -> list[str]:
    """Points the tables at Parquet folders below another root; loads from CSV when there are none."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = list(csv_paths or [*WATER_TABLES, REGION_TABLE])
    opened = []
    for name in names:
        path = f"{root.rstrip('/')}/{name}"
        try:
            spark.read.parquet(path)
        except AnalysisException:
            continue
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet")
        opened.append(name)
    if not opened and auto_load and csv_paths:
        for name, csv in csv_paths.items():
            rows = _csv_or_none(spark, csv)
            if rows is not None:
                save_table(rows, f"{database}.{name}", f"{root.rstrip('/')}/{name}")
                opened.append(name)
    return opened
