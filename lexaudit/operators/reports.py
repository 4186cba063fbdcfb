"""Job matrices and report aggregates over cells of results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_matrix(leaves: DataFrame, sizes: DataFrame, allowed: Column) -> DataFrame:
    """Every leaf with every model size that the rule allows; both are small dimension tables."""
    return leaves.crossJoin(sizes).where(allowed)


def averages(cells: DataFrame, by: Sequence[str], over: str, value: str) -> DataFrame:
    """by, mean (of the ``over`` that have a value), present, best: whether the mean is the largest; ties share it."""
    out = cells.groupBy(*by).agg(F.avg(value).alias("mean"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col(over))).alias("present"))
    top = out.agg(F.max("mean").alias("top"))
    return out.crossJoin(top).select(*by, "mean", "present", (F.col("mean") == F.col("top")).alias("best"))


def gain(base: DataFrame, tuned: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, gain: tuned less base of the same row; null unless both are finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    b, t = F.col("__b"), F.col("__t")
    joined = base.select(*key, F.col(value).cast("double").alias("__b")).join(tuned.select(*key, F.col(value).cast("double").alias("__t")), list(key))
    return joined.select(*key, F.when(finite(b) & finite(t), t - b).alias("gain"))


def yes_probability(top: Column) -> Column:
    """From (token, logprob) pairs the probability of ``yes``, in any case and spacing."""
    return F.aggregate(F.filter(top, lambda x: F.lower(F.trim(x["token"])) == "yes"), F.lit(0.0), lambda s, x: s + F.exp(x["logprob"]))


def reuse_cost(cells: DataFrame, group: str, setting: str, value: str, reference: str) -> DataFrame:
    """group, cost: what a group loses by the setting that is best for the reference group, against its own best; ties: smallest setting."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), setting))
    best = cells.withColumn("__r", rank).where("__r = 1").select(group, F.col(setting).alias("__own"), F.col(value).alias("__best"))
    chosen = best.where(F.col(group) == reference).select(F.col("__own").alias("__ref"))
    used = cells.crossJoin(chosen).where(F.col(setting) == F.col("__ref")).select(group, F.col(value).alias("__used"))
    return best.join(used, group).select(group, (F.col("__best") - F.col("__used")).alias("cost"))


# --- tables ------------------------------------------------------------------------------------------------------------

#: Columns of a cell: one AUC (or other value) of a method on a subset.
CELL = ("setting", "method", "size", "stage", "domain", "subset")
ALL, AVERAGE = "all", "Model-Avg"
#: Stages in their order.
STAGES = ("pre", "mid", "post")


def stage_means(cells: DataFrame, by: Sequence[str] = ("setting", "method", "size"), value: str = "value") -> DataFrame:
    """by, scope, value, complete: subsets averaged to domains, domains to stages, stages to ``all``; missing values are left out, complete tells if none was missing or partial.

    ``cells``: CELL, value (null if there is none) and complete.
    """
    now = cells.groupBy(*by, "stage", "domain").agg(F.avg(value).alias("value"), F.bool_and(F.col(value).isNotNull() & F.col("complete")).alias("complete"))
    stage = now.groupBy(*by, "stage").agg(F.avg("value").alias("value"), F.bool_and("complete").alias("complete"))
    whole = stage.groupBy(*by).agg(F.avg("value").alias("value"), F.bool_and("complete").alias("complete"))
    return stage.withColumnRenamed("stage", "scope").unionByName(whole.withColumn("scope", F.lit(ALL)))


def with_averages(rows: DataFrame, over: str, name: str, by: Sequence[str]) -> DataFrame:
    """rows (by, over, value, complete) and those of the mean over ``over``, under ``name``; complete if all that have a value are."""
    have = rows.where("value is not null")
    means = have.groupBy(*by).agg(F.avg("value").alias("value"), F.bool_and("complete").alias("complete")).withColumn(over, F.lit(name))
    return rows.unionByName(means.select(*rows.columns))


def contrast(cells: DataFrame, by: str, chosen: Sequence[str]) -> DataFrame:
    """by, inside, outside, difference: mean over sizes first, then over the ``chosen`` subsets and over the others; without a value for each chosen subset there is no row."""
    sizes = cells.where("value is not null").groupBy(by, "subset").agg(F.avg("value").alias("v"))
    inside = F.col("subset").isin(*chosen)
    out = sizes.groupBy(by).agg(F.avg(F.when(inside, F.col("v"))).alias("inside"), F.avg(F.when(~inside, F.col("v"))).alias("outside"), F.count_if(inside).alias("n"))
    return out.where(F.col("n") == len(chosen)).select(by, "inside", "outside", (F.col("inside") - F.col("outside")).alias("difference"))


def wide(rows: DataFrame, rows_by: Sequence[str], columns_by: str, names: Sequence[str] | None = None, value: str = "value") -> DataFrame:
    """One row for each ``rows_by``, a column for each of ``names`` (all that occur, in order, if not given: they are the few of a report)."""
    names = names or [r[0] for r in rows.select(columns_by).distinct().orderBy(columns_by).collect()]
    return rows.groupBy(*rows_by).pivot(columns_by, list(names)).agg(F.max(value))


@dataclass(frozen=True)
class Table:
    """A report table: which cells, what is averaged, and what stands in rows and columns."""

    rows: tuple[str, ...]
    columns: tuple[str, ...]
    keep: str = "true"
    level: str = "stage"  # stage (with all), domain or subset
    averages: bool = True  # over model sizes
    methods_mean: bool = False
    gain_over: str = ""  # prefix of the methods whose value is taken off


#: The tables of a report, from cells with settings matched, shifted, in_domain, lodo, pooled, learning and no_cot.
TABLES = {
    "unsupervised": Table(("method",), ("size", "scope"), "setting = 'matched' and not supervised", methods_mean=True),
    "unsupervised_grouped": Table(("method",), ("scope", "size"), "setting = 'matched' and not supervised"),
    "unsupervised_transposed": Table(("size", "scope"), ("method",), "setting = 'matched' and not supervised"),
    "domains": Table(("domain", "method"), ("subset", "size"), "setting = 'matched' and not supervised", "subset"),
    "domains_grouped": Table(("method",), ("domain", "size"), "setting = 'matched' and not supervised", "domain"),
    "stages": Table(("scope", "method"), ("size",), "setting = 'matched' and not supervised"),
    "supervised": Table(("setting", "method"), ("size", "scope"), "supervised and setting in ('in_domain', 'lodo')"),
    "supervised_in_domain": Table(("method",), ("size", "scope"), "supervised and setting = 'in_domain'"),
    "supervised_lodo": Table(("method",), ("size", "scope"), "supervised and setting = 'lodo'"),
    "tuned_gain": Table(("setting", "method"), ("size",), "supervised and setting in ('in_domain', 'lodo')", gain_over="base_"),
    "no_cot": Table(("method",), ("setting", "size"), "domain = 'RLVR' and setting in ('matched', 'no_cot')", "subset"),
    "cross_stage": Table(("method",), ("subset",), "setting = 'matched'", "subset"),
    "shift": Table(("method",), ("setting", "size"), "setting in ('matched', 'shifted')"),
    "generalisation": Table(("method",), ("setting",), "supervised and setting in ('in_domain', 'pooled', 'lodo')"),
    "learning_curve": Table(("domain",), ("setting", "size"), "setting like 'learning%'", "domain"),
    "three_settings": Table(("method", "setting"), ("size",), "setting in ('in_domain', 'pooled', 'lodo')"),
}


def long_table(cells: DataFrame, name: str) -> DataFrame:
    """row, column, value, complete, best (the largest value of a column) of a report table, row and column being the names joined by " | "."""
    spec = TABLES[name]
    chosen = cells.where(spec.keep)
    by = ["setting", "method", "size"]
    if spec.level == "stage":
        rows = stage_means(chosen, by)
    else:
        rows = chosen.groupBy(*by, "stage", "domain", *(["subset"] if spec.level == "subset" else [])).agg(F.avg("value").alias("value"), F.bool_and(F.col("value").isNotNull() & F.col("complete")).alias("complete")).drop("stage")
    if spec.gain_over:
        rest = [c for c in rows.columns if c not in ("method", "value", "complete")]
        base = rows.where(F.startswith("method", F.lit(spec.gain_over))).select(*rest, F.substring("method", len(spec.gain_over) + 1, 1 << 20).alias("__m"), F.col("value").alias("__base"), F.col("complete").alias("__whole"))
        tuned = rows.where(~F.startswith("method", F.lit(spec.gain_over))).withColumn("__m", F.regexp_replace("method", "^[a-z]+_", ""))
        rows = tuned.join(base, [*rest, "__m"]).select(*rest, "method", (F.col("value") - F.col("__base")).alias("value"), (F.col("complete") & F.col("__whole")).alias("complete"))
    dims = [c for c in rows.columns if c not in ("value", "complete")]
    if spec.averages:
        rows = with_averages(rows, "size", AVERAGE, [c for c in dims if c != "size"])
    if spec.methods_mean:
        rows = with_averages(rows, "method", "Method-Avg", [c for c in dims if c != "method"])
    label = lambda names: F.concat_ws(" | ", *names)
    named = rows.where("value is not null").groupBy(label(spec.rows).alias("row"), label(spec.columns).alias("column")).agg(F.avg("value").alias("value"), F.bool_and("complete").alias("complete"))
    top = named.where("row not like 'Method-Avg%'").groupBy("column").agg(F.max("value").alias("__top"))
    return named.join(top, "column", "left").select("row", "column", "value", "complete", F.coalesce((F.col("value") == F.col("__top")) & ~F.startswith("row", F.lit("Method-Avg")), F.lit(False)).alias("best"))


def text_table(rows: DataFrame, style: str = "markdown", digits: int = 2) -> str:
    """A report table as text, for reading: the best of a column bold, incomplete cells starred, missing ones dashed. ``rows`` (of long_table) are the few of a report."""
    cells = {(r.row, r.column): r for r in rows.collect()}
    names, heads = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})

    def cell(r) -> str:
        if r is None:
            return "---"
        shown = f"{r.value:.{digits}f}"
        if style == "latex":
            return (f"\\textbf{{{shown}}}" if r.best else shown) + ("" if r.complete else "$^{*}$")
        return (f"**{shown}**" if r.best else shown) + ("" if r.complete else "*")

    body = [[n, *(cell(cells.get((n, h))) for h in heads)] for n in names]
    if style == "latex":
        return "\n".join(" & ".join(x) + " \\\\" for x in [["", *heads], *body])
    return "\n".join("| " + " | ".join(x) + " |" for x in [["", *(h.replace("|", "/") for h in heads)], ["---"] * (len(heads) + 1), *body])
