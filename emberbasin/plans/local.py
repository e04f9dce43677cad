"""Frames of a few rows known to the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """The rows as part of the plan itself.

    Rows given as Python tuples become an RDD of unknown size; by way of Arrow
    they become a local relation, whose size the planner knows.
    """
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], schema)
    columns = {f.name: list(values) for f, values in zip(fields, zip(*rows))}
    typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]
    return spark.createDataFrame(pa.table(columns)).select(*typed)
