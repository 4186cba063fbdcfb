"""Exact duplicates: 128-bit content hash, byte comparison inside hash groups, one row of each group stays. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import ascii_lower, cut, heavy_join


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Adds ``keep_id``, ``group_size``, ``kept`` and ``norm_sha256`` to every row of ``docs``.

    Rows with equal normalised text form a group; the row with the smallest id stays (``keep="max"``: the largest).
    Rows are grouped by ``content_hash`` (128 bits) together with the text itself, so that the grouping compares bytes
    and two texts that share a hash stay apart. That aggregation combines copies before its shuffle, however many there are.

    Null text counts as empty. Null ids lose against any id; a group of null ids only has a null ``keep_id`` and one of its
    rows is kept. Of repeated rows with the id that stays, one is kept. Columns named as the added ones are replaced.
    No row is dropped: filter by ``kept``.
    """
    if keep not in ("min", "max"):
        raise ValueError(keep)
    best = F.min if keep == "min" else F.max
    added = ["keep_id", "group_size", "kept", "norm_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {*added, "__h", "__norm", "__texts", "__n", "__first"}])
    norm = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumn("__norm", norm).withColumn("__h", content_hash(F.col("__norm")))
    texts = rows.groupBy("__h", "__norm").agg(F.count(F.lit(1)).alias("group_size"), best(id_col).alias("keep_id"))
    groups = cut(texts.groupBy("__h").agg(F.count(F.lit(1)).alias("__texts"), F.sum("group_size").alias("group_size"), best("keep_id").alias("keep_id")))
    seen = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.max("__texts"), F.lit(0))).first()
    rows = rows.withColumn("norm_sha256", F.sha2(F.col("__norm"), 256))
    if seen[1] > 1:  # two texts share a hash: their rows join by hash and text
        shared = groups.where("__texts > 1").select("__h")
        clash = rows.join(shared, "__h", "left_semi").join(texts, ["__h", "__norm"])
        alone = heavy_join(rows, groups.where("__texts = 1").drop("__texts"), "__h", "group_size", seen[0], id_col)
        joined = alone.unionByName(clash.select(*alone.columns))
    else:
        joined = heavy_join(rows.drop("__norm"), groups.drop("__texts"), "__h", "group_size", seen[0], id_col).withColumn("__norm", F.lit(""))
    marked = joined.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():  # repeated ids: of the rows that would stay, one does
        stays = cut(marked.where("kept").withColumn("__n", F.monotonically_increasing_id()))
        first = stays.groupBy("__h", "__norm", id_col).agg(F.min("__n").alias("__n")).select("__n", F.lit(True).alias("__first"))
        stays = stays.join(first, "__n", "left").withColumn("kept", F.col("__first").isNotNull()).drop("__n", "__first")
        marked = marked.where("not kept").unionByName(stays)
    return marked.drop("__h", "__norm").select(*docs.columns, *added)
