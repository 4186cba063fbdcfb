"""Shared pieces of the training-data operators: shared storage, skew-proof joins, text normalisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A key that holds more than 1/HEAVY_SHARE of all rows is heavy; so there are fewer than HEAVY_SHARE heavy keys, whatever the input.
HEAVY_SHARE = 1000


_HELD: dict = {}


def held(key, build: Callable):
    """What ``build`` makes, kept in this Python worker from task to task; only one such thing is kept, so workers that stages share stay small."""
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = build()
    return _HELD[key]


#: A table of fewer bytes for each core comes in too few splits to occupy the cores, and is dealt over them.
CORE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    table, cores = spark.read.parquet(path), context.defaultParallelism
    return table.repartition(cores) if size < CORE_BYTES * cores else table


def ascii_lower(column: Column | str) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the checkpoint folder that driver and executors share, a temporary one only in local mode. It goes when the driver ends."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            configured = tempfile.mkdtemp(prefix="lexaudit-checkpoint-")
        context.setCheckpointDir(configured)
    own = context._jsc.sc().getCheckpointDir().get()
    at = context._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder; a lost executor costs nothing that was cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes a (compressed, columnar) table into the shared folder and reads it again; also its path, for ``drop_path``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def salted_join(rows: DataFrame, groups: DataFrame, key: str | list[str], heavy: DataFrame, salt_by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to ``groups``, one row for each key; keys in ``heavy`` (key, __salts) are dealt into so many shares.

    ``heavy`` has fewer than HEAVY_SHARE rows and is broadcast; its groups are repeated for each salt.
    """
    keys = [key] if isinstance(key, str) else key
    marked = rows.join(F.broadcast(heavy), keys, "left")
    marked = marked.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    spread = groups.join(F.broadcast(heavy), keys, "left")
    spread = spread.withColumn("__salt", F.explode(F.when(F.col("__salts").isNotNull(), F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array(F.lit(0))))).drop("__salts")
    return marked.join(spread, [*keys, "__salt"], how).drop("__salt")


def heavy_of(groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """key, __salts of the groups of more than 1/HEAVY_SHARE of ``total`` rows: fewer than HEAVY_SHARE, in shares of about that size."""
    keys = [key] if isinstance(key, str) else key
    least = max(total // HEAVY_SHARE, 1)
    return groups.where(F.col(size) > least).select(*keys, F.ceil(F.col(size) / F.lit(least)).cast("int").alias("__salts"))


def heavy_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, salt_by: str) -> DataFrame:
    """``rows`` joined (inner) to ``groups``: one row for each key, with the number of its rows in ``size``, lineage cut.

    If no group is heavy, the join is plain; if all are, ``groups`` has fewer than HEAVY_SHARE rows and is broadcast; else
    the heavy ones are salted, so one shuffle joins all without a hot key.
    """
    heavy = heavy_of(groups, key, size, total)
    n_all, n_heavy = groups.count(), heavy.count()
    if n_heavy == 0:
        return rows.join(groups, key)
    if n_heavy == n_all:
        return rows.join(F.broadcast(groups), key)
    return salted_join(rows, groups, key, heavy, salt_by)
