"""Connected components by alternating large-star and small-star until the edges stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.llm.common import cut


#: A node with more than 1/HUB_SHARE of all edges is a hub; there are fewer than twice as many hubs.
HUB_SHARE = 1000


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with m, the smallest b of each a.

    One shuffle by a, except for hubs: the few of them (by their share of all edges) are counted by an aggregation that
    combines before its shuffle, come back as a bounded broadcast, and their edges are dealt by b as well.
    """
    spark = edges.sparkSession
    hubs = [tuple(r) for r in edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") > max(total // HUB_SHARE, 1000)).select("a", "m").collect()]
    marked = edges.join(F.broadcast(spark.createDataFrame(hubs, "a long, hub long")), "a", "left") if hubs else edges.withColumn("hub", F.lit(None).cast("long"))
    spread = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(HUB_SHARE))).otherwise(F.lit(0))
    return marked.withColumn("__s", spread).withColumn("m", F.coalesce("hub", F.min("b").over(Window.partitionBy("a", "__s")))).select("a", "b", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b long) to rows (node, component): for each node of an edge the smallest node it reaches.

    Large-star sends each node's larger neighbours to its smallest neighbour, small-star the smaller ones; rounds grow with
    the logarithm of the longest path. It ends when large-star changes no edge and every node has one parent. Each half
    round is written into the shared folder. Loops and repeated edges are allowed, null ends are ignored. Raises if
    ``max_rounds`` are not enough.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        total = now.count()
        if not total:
            break
        large = _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
        large = cut(large)
        moved, rows, nodes = large.agg(F.bool_or("moved"), F.count(F.lit(1)), F.count_distinct("a")).first()
        if not moved and rows == nodes:
            break
        lower = _with_least(large.select("a", "b"), total)
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(lower.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
