"""Named relations for Spark SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Makes each DataFrame a temporary view of the session under its name."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
