"""Runs a registered query and its DuckDB text on the same tables and compares the results."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

from emberbasin.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind):
        return "string"
    return str(kind)


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names]) if names else []
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    found = []
    ours = {f.name: _kind(f.type) for f in spark_table.schema}
    theirs = {f.name: _kind(f.type) for f in duck_table.schema}
    if ours != theirs:
        found.append(f"schema {sorted(set(ours.items()) ^ set(theirs.items()))}")
    if set(ours) != set(theirs):
        return found
    a, b = _rows(spark_table), _rows(duck_table)
    if len(a) != len(b):
        found.append(f"rows {len(a)} and {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(_same, x, y))]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
