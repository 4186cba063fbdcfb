"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a temporary folder stands in for it in local mode only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            place = tempfile.mkdtemp(prefix="lexaudit-checkpoint-")
        context.setCheckpointDir(place)
    return df.checkpoint()


def settle_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """settle(df), whose Python functions get that many rows at a time; for rows that are long arrays."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(rows))
    try:
        return settle(df)
    finally:
        conf.set(BATCH_ROWS, before)
