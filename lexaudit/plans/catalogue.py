"""All queries over the standard tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexaudit.plans import alignment, corpus, evaluation, extras, scores, statistics

PARTS = (corpus, statistics, evaluation, alignment, scores, extras)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
