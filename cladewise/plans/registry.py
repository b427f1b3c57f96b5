"""Registry of checked queries: name -> DataFrame builder and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register the decorated builder under ``name``; ``covers`` lists the survey rows it shows."""

    def keep(build):
        if name in BUILDERS:
            raise ValueError(f"{name} is registered twice")
        BUILDERS[name] = build
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return keep
