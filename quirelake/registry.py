"""The catalogue engine's queries over the driver's tables, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where there is one."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


from . import queries_bitmaps, queries_catalog, queries_fulltext, queries_functions, queries_network, queries_people, queries_quality  # noqa: E402, F401
