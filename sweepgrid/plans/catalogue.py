"""The registered queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sweepgrid.plans import detection, labelling, mapping, terrain

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return mapping.QUERIES | terrain.QUERIES | detection.QUERIES | labelling.QUERIES


def oracle_sql() -> dict[str, str]:
    return mapping.ORACLES | terrain.ORACLES | detection.ORACLES | labelling.ORACLES


