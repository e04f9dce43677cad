"""Free SELECT statements over named DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

STARTS_A_QUERY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


def run_select(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The result of one SELECT or WITH query; ValueError for any other statement.

    ``tables`` are made known under their names first. The text is placed inside
    a FROM clause, where Spark's own grammar takes nothing but a query, so a
    command behind a WITH does not parse.
    """
    if not STARTS_A_QUERY.match(sql):
        raise ValueError("Only SELECT queries are allowed.")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
