"""Running totals over an order without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def running_totals(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Adds ``<value>_before`` for each value: its total over the rows of the group that come before in ``order``.

    ``df`` has one row for each group and order value. Rows are dealt into ranges of the order by approximate quantiles;
    running sums stay inside a range, and the ranges' own totals, RANGES rows for each group, are summed on top.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [(i + 1) / RANGES for i in range(RANGES - 1)], 10_000).alias("__cuts"))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(order)))).drop("__cuts")
    sums = dealt.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__in_{v}") for v in values])
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = local.join(sums, same)
    return out.select(*df.columns, *[(F.col(f"__in_{v}") + F.col(f"__{v}")).alias(f"{v}_before") for v in values])


def running_max(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the largest ``value`` of the rows up to each in ``order`` (distinct); as above, in ranges and on top of them."""
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [(i + 1) / RANGES for i in range(RANGES - 1)], 10_000).alias("__cuts"))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(order)))).drop("__cuts")
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy("__range").agg(F.max(value).alias("__top")).withColumn("__ahead", F.max("__top").over(ahead)).drop("__top")
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("__in", F.max(value).over(inside)).join(tops, "__range")
    return out.select(*df.columns, F.greatest("__in", "__ahead").alias(name))
