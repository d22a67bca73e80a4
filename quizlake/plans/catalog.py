"""The query registry behind ``__spark_entry__``: name -> Spark builder, and
name -> DuckDB oracle SQL where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accuracy_queries, io_queries, practice_queries, session_queries

_FAMILIES = [accuracy_queries, session_queries, practice_queries, io_queries]


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for fam in _FAMILIES:
        out.update(fam.SPARK)
    return out


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    for fam in _FAMILIES:
        out.update(fam.ORACLE)
    return out
