"""All registered queries and, where SQL can say the same, their DuckDB twins.

Every query reads whole tables of a folder (through the derived views), runs a
library operator and aliases its result; the twin computes the same rows from
the same views without using any of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its twin under a name."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from watchloom.plans import (  # noqa: F401
        catalog_chains, catalog_detection, catalog_functions, catalog_intel, catalog_inventory, catalog_respond, catalog_report,
        catalog_telemetry,
    )
