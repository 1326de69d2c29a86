"""Queries over the demand operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.queries import board, files, panels, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = scoring.QUERIES | panels.QUERIES | board.QUERIES | files.QUERIES
ORACLES: dict[str, str] = scoring.ORACLES | panels.ORACLES | board.ORACLES | files.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["demand_scores"](spark, sf_dir)
