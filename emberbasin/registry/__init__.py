"""Every operator as a query over the driver's tables, with the same question in DuckDB SQL."""

from __future__ import annotations

from emberbasin.registry import (  # noqa: F401
    cleaning,
    countries,
    fires,
    places,
    profiling,
    sources,
    text,
    upkeep,
    water,
)
from emberbasin.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
