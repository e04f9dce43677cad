"""Registration of queries and of their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.session import shared_root

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the DuckDB text of the same result."""

    def register(make: Query) -> Query:
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


def rounded(df: DataFrame, *columns: str, places: int = PLACES) -> DataFrame:
    """Sums and means rounded, since their last digits depend on the order of addition."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, places) for c in names})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query has to write, in the shared folder of the session."""
    return f"{shared_root(spark)}/emberbasin/{name}-{uuid.uuid4().hex}"
