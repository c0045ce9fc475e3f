"""The registered queries of the engine and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.plans import channels, life, linking, pieces, restructure, search, steps

FLAGSHIP = "recall"
_AREAS = (search, channels, linking, life, pieces, steps, restructure)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _AREAS for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _AREAS for k, s in m.ORACLE_SQL.items()}
