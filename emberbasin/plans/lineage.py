"""Cutting the lineage of an iterative job, so that neither its plan nor a recomputation grows with each round."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberbasin.session import shared_root


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as written to the shared checkpoint folder; they outlive the executors that made them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
