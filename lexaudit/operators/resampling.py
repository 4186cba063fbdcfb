"""Resampling with draws from a portable hash: bootstrap, paired and cluster intervals, corrections and rank tests.

Draws come from MD5 of names and numbers, so results do not hang on the order of rows and other engines can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexaudit.functions.vectorised import NumberedHashes
from lexaudit.operators.evaluate import auc
from lexaudit.operators.running import running_max, running_totals
from lexaudit.storage import settle


def draw(*parts: Column) -> Column:
    """32 bits of MD5 of the parts joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Adds i, the place of a row in its group from 0 in ``order``, a column that is distinct in a group. By a number no group is sorted in one task; names, of the few clusters of a benchmark, are."""
    if isinstance(rows.schema[order].dataType, StringType):
        return rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    placed = running_totals(rows.withColumn("__one", F.lit(1)), by, order, ["__one"])
    return placed.withColumn("i", F.col("__one_before").cast("int")).drop("__one", "__one_before")


def resampled(rows: DataFrame, by: Sequence[str], order: str, rounds: int, seed: str) -> DataFrame:
    """rows drawn with replacement, as many as each group has, ``rounds`` times: all columns, b and times (how often the row was drawn)."""
    placed = settle(numbered(rows, by, order))
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    slots = placed.select(*by, F.col("i").alias("slot")).join(sizes, list(by)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    pick = F.pmod(draw(F.lit(seed), F.concat_ws("/", *by), F.col("b"), F.col("slot")), F.col("size")).cast("int")
    picks = slots.select(*by, "b", pick.alias("i")).groupBy(*by, "b", "i").agg(F.count(F.lit(1)).alias("times"))
    return picks.join(placed, [*by, "i"]).drop("i")


def weighted_auc(drawn: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """by, auc of rows that count ``times`` each, by tallies of distinct scores."""
    times = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    tallied = drawn.groupBy(*by, F.col(score).cast("double").alias("score")).agg(times(F.col("member")).alias("pos"), times(~F.col("member")).alias("neg"))
    return auc(tallied, by).select(*by, "auc")


#: Rows of an evaluation cell up to which its scores travel as arrays, rounds computed at a time, and rows of a block from which the arrays are joined.
CELL_ROWS, CELL_ROUNDS, CELL_BLOCK = 4_000_000, 25, 65_536


def drawn_aucs(rows: DataFrame, by: Sequence[str], order: str, rounds: int, seed: str, score_cols: Sequence[str]) -> DataFrame:
    """by, b and an AUC for each of ``score_cols`` (under its name), null if a side is empty: members and non-members drawn separately, alike for all scores.

    Cells of up to CELL_ROWS rows are arrays, 8 bytes for a score, and rounds are dealt over tasks, where draws are hashed and
    tallied by array operations: no drawn row is ever shuffled. Larger ones go through tallies of drawn rows. Draws are the same in both.
    """
    rows = rows.select(*by, order, "member", F.col("member").cast("string").alias("__side"), *[F.col(c).cast("double").alias(c) for c in score_cols]).where("member is not null")
    rows = settle(rows)  # read several times below
    largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > CELL_ROWS:
        drawn, keys, out = settle(resampled(rows, [*by, "__side"], order, rounds, seed)), [*by, "b"], None
        for c in score_cols:
            cells = weighted_auc(drawn, keys, c).withColumnRenamed("auc", c)
            out = cells if out is None else out.join(cells, keys)
        return out
    block = F.floor(F.col("i") / CELL_BLOCK).alias("__block")
    blocks = numbered(rows, [*by, "__side"], order).groupBy(*by, "member", block).agg(F.sort_array(F.collect_list(F.struct("i", *score_cols))).alias("r"))
    packed = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("member", "__block", *[F.col(f"r.{c}").alias(c) for c in score_cols]))).alias("rows"))
    chunks = packed.select(*by, F.concat_ws("/", *by).alias("__name"), "rows", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(CELL_ROUNDS))).alias("__first"))

    @F.arrow_udf("array<array<double>>")
    def aucs(names: pa.Array, cells: pa.Array, firsts: pa.Array) -> pa.Array:
        out = []
        for name, cell, first in zip(names.to_pylist(), cells, firsts.to_pylist()):
            blocks = cell.values
            member = blocks.field("member").to_numpy(zero_copy_only=False)
            sides, sizes = [], []
            for side, flag in (("true", True), ("false", False)):
                own = blocks.filter(pa.array(member == flag))
                values = [own.field(c).flatten().to_numpy(zero_copy_only=False) for c in score_cols]
                sizes.append(len(values[0]))
                sides.append((f"{seed}:{name + '/' if name else ''}{side}:", NumberedHashes(sizes[-1]), values))
            kinds = [np.unique(np.concatenate([values[k] for _, _, values in sides]), return_inverse=True) for k in range(len(score_cols))]
            codes = [[code[: sizes[0]].astype(np.int32), code[sizes[0] :].astype(np.int32)] for _, code in kinds]
            pairs = float(sizes[0]) * float(sizes[1])
            got = []
            for b in range(first, min(first + CELL_ROUNDS, rounds)):
                picked = [hashes(f"{text}{b}:") % np.uint32(max(n, 1)) for (text, hashes, _), n in zip(sides, sizes)] if pairs else None
                line = []
                for (values, _), code in zip(kinds, codes):
                    pos, neg = (np.bincount(c[x], minlength=len(values)) for c, x in zip(code, picked)) if pairs else (None, None)
                    line.append(float((pos * (np.cumsum(neg) - neg / 2)).sum()) / pairs if pairs else None)
                got.append(line)
            out.append(got)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    dealt = chunks.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*by, "__first") if by else F.col("__first"))
    rounds_of = dealt.select(*by, "__first", F.posexplode(aucs("__name", "rows", "__first")).alias("__k", "__v"))
    return rounds_of.select(*by, (F.col("__first") + F.col("__k")).alias("b"), *[F.col("__v")[k].alias(c) for k, c in enumerate(score_cols)])


def bootstrap_interval(rows: DataFrame, by: Sequence[str], order: str, rounds: int, seed: str, level: float = 0.95) -> DataFrame:
    """by, lo, hi: percentile interval of the AUC; members and non-members are drawn separately."""
    tail = (1 - level) / 2
    values = drawn_aucs(rows, by, order, rounds, seed, ["score"])
    return values.groupBy(*by).agg(F.percentile("score", tail).alias("lo"), F.percentile("score", 1 - tail).alias("hi"))


def paired_interval(rows: DataFrame, by: Sequence[str], order: str, rounds: int, seed: str) -> DataFrame:
    """by, delta, lo, hi, p for two scores (score_a, score_b) of the same rows, drawn alike; p two-sided with one added to both counts. Null where a side is empty."""
    both = drawn_aucs(rows, by, order, rounds, seed, ["score_a", "score_b"]).withColumn("d", F.col("score_a") - F.col("score_b"))
    low, high = (F.count_if(c) + 1 for c in (F.col("d") <= 0, F.col("d") >= 0))
    return both.groupBy(*by).agg(F.avg("d").alias("delta"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.when(F.count("d") > 0, F.least(2 * F.least(low, high) / (F.count("d") + 1), F.lit(1.0))).alias("p"))


def cluster_interval(values: DataFrame, order: str, value: str, rounds: int, seed: str) -> DataFrame:
    """mean, lo, hi of a mean over clusters (one row each), clusters drawn with replacement."""
    drawn = resampled(values.withColumn("__all", F.lit("all")), ["__all"], order, rounds, seed)
    means = drawn.groupBy("b").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def classify(lo: Column, hi: Column, margin: float = 0.05) -> Column:
    return F.when(hi < 0, "degraded").when(lo > 0, "inflated").when((lo > -margin) & (hi < margin), "robust").otherwise("inconclusive")


def holm(tests: DataFrame, key: str, p: str) -> DataFrame:
    """Adds p_holm: step-down corrected values, never falling, 1 at most. Equal p share the smallest rank, which gives the same largest value."""
    # one row for each p: how many tests have it and how many a smaller one
    values = tests.groupBy(F.col(p).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = running_totals(values, [], "__p", ["__c"])
    n = values.agg(F.sum("__c").alias("__n"))
    stepped = before.crossJoin(n).withColumn("__s", F.least((F.col("__n") - F.col("__c_before")) * F.col("__p"), F.lit(1.0)))
    corrected = running_max(stepped, "__p", "__s", "p_holm").select("__p", "p_holm")
    return tests.join(corrected, F.col(p).cast("double") == F.col("__p"), "left").drop("__p")


#: Pairs up to which the rank test's p is exact, if no two differences tie.
EXACT_PAIRS = 50


def rank_test_p(n: int, w: float, variance: float, ties: bool, side: str = "two-sided") -> float:
    """p of a signed rank sum: exact for few pairs without ties, else by the normal approximation."""
    if n < 1:
        return float("nan")
    if n <= EXACT_PAIRS and not ties:
        ways = [1]
        for k in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - k] if 0 <= s - k < len(ways) else 0) for s in range(len(ways) + k)]
        above = sum(ways[math.ceil(w) :]) / 2**n
        below = sum(ways[: math.floor(w) + 1]) / 2**n
        return above if side == "greater" else min(1.0, 2 * min(above, below))
    if variance <= 0:
        return float("nan")
    z = (w - n * (n + 1) / 4) / math.sqrt(variance)
    return math.erfc(z / math.sqrt(2)) / 2 if side == "greater" else math.erfc(abs(z) / math.sqrt(2))


def wilcoxon(pairs: DataFrame, by: Sequence[str], difference: str, side: str = "two-sided") -> DataFrame:
    """by, n, w, z, p: signed rank sum of the positive differences, zeros left out, ties by mean ranks.

    z by the normal approximation; p two-sided, or one-sided (``greater``), exact for up to EXACT_PAIRS pairs without ties
    or zeros. Ranks come from tallies of distinct absolute differences.
    """
    d = F.col(difference).cast("double")
    tallied = pairs.where(d != 0).groupBy(*by, F.abs(d).alias("__a")).agg(F.count(F.lit(1)).alias("c"), F.count_if(d > 0).alias("up"))
    ranked = running_totals(tallied, by, "__a", ["c"]).withColumn("r", F.col("c_before") + (F.col("c") + 1) / 2.0)
    out = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w"), (F.sum(F.col("c") * F.col("r") * F.col("r")) / 4.0).alias("v"), (F.max("c") > 1).alias("ties"))
    zeros = pairs.groupBy(*by).agg((F.count_if(d == 0) > 0).alias("zeros"))
    out = out.join(zeros, list(by)) if by else out.crossJoin(zeros)

    @F.pandas_udf("double")
    def p_of(n: pd.Series, w: pd.Series, v: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([rank_test_p(int(a), b, c, t, side) for a, b, c, t in zip(n, w, v, ties)])

    z = F.try_divide(F.col("w") - F.col("n") * (F.col("n") + 1) / 4.0, F.sqrt("v"))
    return out.select(*by, "n", "w", z.alias("z"), p_of("n", "w", "v", F.col("ties") | F.col("zeros")).alias("p"))


def direction_counts(draws: DataFrame, method: str, group: str, unit: str, value: str, levels: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """method, level, inflated, degraded, n: groups whose interval of the mean over their units lies above 0 or below.

    ``draws``: method, group, unit, b and value; units of a group share a draw, so they are averaged draw by draw first.
    """
    means = draws.groupBy(method, group, "b").agg(F.avg(value).alias("m"))
    out = None
    for level in levels:
        tail = (1 - level) / 2
        ends = means.groupBy(method, group).agg(F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"))
        rows = ends.groupBy(method).agg(F.lit(level).alias("level"), F.count_if(F.col("lo") > 0).alias("inflated"), F.count_if(F.col("hi") < 0).alias("degraded"), F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def nested_subsets(rows: DataFrame, key: str, shares: Sequence[float], seeds: int) -> DataFrame:
    """key, seed, share: growing subsets of one hash order for each seed; a row is in a share if its hash falls below it."""
    u = draw(F.lit("nest"), F.col("seed"), F.col(key)) / F.lit(float(2**32))
    every = rows.select(key).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return every.where(u < F.col("share"))


def class_draws(rows: DataFrame, label: str, key: str, size: int, rounds: int) -> DataFrame:
    """b, label, key: ``size`` rows of each class without replacement, the same draw for whatever scores them."""
    every = rows.select(label, key).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("__d", draw(F.lit("class"), F.col("b"), F.col(key)))
    return every.withColumn("__n", F.row_number().over(Window.partitionBy("b", label).orderBy("__d", key))).where(F.col("__n") <= size).select("b", label, key)
