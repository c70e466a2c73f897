"""Every query of the library over the driver tables, with its oracle in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import content, market, relational, streams

_MODULES = (relational, market, content, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for m in _MODULES for f in m.QUERIES}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
