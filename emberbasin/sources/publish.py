"""A set of tables published in one step: staged under a new version, then switched to by one small file.

``save_table`` overwrites in place, table after table, and a failure between two leaves a mix. Here all tables of a version are
written first, each under the version's own folder; only then does the pointer file ``CURRENT`` name it, by a rename that replaces the old
pointer in one step. Whoever reads the pointer gets a whole set, the old or the new one. A version whose writing
fails is never named and its folder is removed; one that was left behind by a job that ended has a number that is not used again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from emberbasin.operators.cleaning import clean_baseline_annual, clean_baseline_monthly, clean_future_annual, clean_region_lookup
from emberbasin.schemas import REGION_TABLE, WATER_TABLES
from emberbasin.sources.files import read_raw_csv
from emberbasin.sources.tables import full_name

POINTER = "CURRENT"
VERSION = re.compile(r"v(\d+)")


def _path(spark: SparkSession, *parts: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _files(spark: SparkSession, path: JavaObject) -> JavaObject:
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions whose folders are there, published or not."""
    base = _path(spark, root)
    system = _files(spark, base)
    found = system.listStatus(base) if system.exists(base) else []
    return sorted(int(m[1]) for f in found if (m := VERSION.fullmatch(f.getPath().getName())))


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]] | None:
    """The published version and the folder of each of its tables; None before the first."""
    pointer = _path(spark, root, POINTER)
    system = _files(spark, pointer)
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        held = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return held["version"], {name: f"{root.rstrip('/')}/v{held['version']}/{name}" for name in held["tables"]}


def _switch(spark: SparkSession, root: str, content: dict) -> None:
    """Replaces the pointer by one rename; a reader sees the old pointer or the new."""
    jvm = spark.sparkContext._jvm
    staged, pointer = _path(spark, root, f"_{POINTER}-{uuid.uuid4().hex}"), _path(spark, root, POINTER)
    stream = _files(spark, staged).create(staged)
    try:
        stream.write(json.dumps(content).encode())
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(staged, pointer, overwrite)


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], keep: int | None = None) -> int:
    """Writes the tables as a new version and switches to it; returns its number.

    Tables of the current version that aren't given are not carried over: a version is the whole set. Frames may
    read the current version. With ``keep`` only so many versions stay, the new one included; readers of older ones have to
    be done. One publisher at a time: of two the later switch wins.
    """
    if bad := [n for n in tables if not re.fullmatch(r"\w+", n)]:
        raise ValueError(f"no table names: {', '.join(bad)}")
    number = max(versions(spark, root), default=0) + 1
    folder = f"{root.rstrip('/')}/v{number}"
    try:
        for name, rows in tables.items():
            rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    except Exception:
        _files(spark, _path(spark, folder)).delete(_path(spark, folder), True)
        raise
    _switch(spark, root, {"version": number, "tables": list(tables)})
    if keep is not None:
        for old in versions(spark, root)[:-keep] if keep > 0 else []:
            _files(spark, _path(spark, root)).delete(_path(spark, root, f"v{old}"), True)
    return number


def read_published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the published version by name; the pointer is read once, so they go together."""
    found = current(spark, root)
    return {name: spark.read.parquet(path) for name, path in found[1].items()} if found else {}


def open_published(spark: SparkSession, root: str, database: str) -> list[str]:
    """The catalog's tables of a database pointed at the published version; names that are no longer in it are dropped."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    found = current(spark, root)
    paths = found[1] if found else {}
    for table in spark.catalog.listTables(database):
        if not table.isTemporary and table.name not in {n.lower() for n in paths}:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{table.name}")
    for name, path in paths.items():
        spark.sql(f"DROP TABLE IF EXISTS {full_name(name, database)}")
        spark.catalog.createTable(full_name(name, database), path=path, source="parquet")
    return list(paths)


def water_tables(spark: SparkSession, raw_annual: str, raw_monthly: str, raw_future: str) -> dict[str, DataFrame]:
    """The three water tables and the region lookup, cleaned from raw CSVs."""
    annual = read_raw_csv(spark, raw_annual)
    cleaned = [
        clean_baseline_annual(annual),
        clean_baseline_monthly(read_raw_csv(spark, raw_monthly)),
        clean_future_annual(read_raw_csv(spark, raw_future)),
        clean_region_lookup(annual),
    ]
    return dict(zip([*WATER_TABLES, REGION_TABLE], cleaned))
