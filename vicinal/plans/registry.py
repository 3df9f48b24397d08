"""All queries of the engine and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boxes_q, evaluation_q, features_q, ivf_q, knn_q, usage_q

_PARTS = (knn_q, boxes_q, ivf_q, features_q, evaluation_q, usage_q)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
