"""All core queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.plans import energy, evaluation, forms, implausible, samples, storage, vectors
from stridelake.plans.common import nudged

_MODULES = [implausible, energy, evaluation, vectors, samples, storage, forms]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: nudged(v) for m in _MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["segments_batch"](spark, d)
