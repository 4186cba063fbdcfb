"""Bringing scores of the same instances together: keys, fallbacks, verification, unions and intersections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.text import blank_to_null, text_key


def record_key(text: Column, text_sha1: Column) -> Column:
    """The key of the text, else the stored hash, else empty."""
    return F.coalesce(F.when(F.length(text) > 0, text_key(text)), text_sha1, F.lit(""))


def common_keys(scores: DataFrame, by: Sequence[str], key: str, part: str) -> DataFrame:
    """The scores whose key every ``part`` of a group (by) has: keys are counted once, then joined."""
    parts = scores.select(*by, part).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__parts"))
    held = scores.select(*by, key, part).distinct().groupBy(*by, key).agg(F.count(F.lit(1)).alias("__held"))
    whole = (held.join(parts, list(by)) if by else held.crossJoin(parts)).where("__held = __parts").select(*by, key)
    return scores.join(whole, [*by, key], "left_semi")


def by_text_or_id(instances: DataFrame, scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """instances (by, text_key, sample_id) with score: by text in groups whose scores carry texts, else by sample id.

    ``scores``: by, text_key (null or empty if the file has none), sample_id, score; of scores that repeat a key the largest
    counts. An instance without a score keeps a null.
    """
    kinds = scores.groupBy(*by).agg((F.max(F.coalesce(F.length("text_key"), F.lit(0))) > 0).alias("__texts"))
    keyed = scores.join(kinds, list(by)).select(*by, F.when(F.col("__texts"), F.col("text_key")).otherwise(F.col("sample_id")).alias("__key"), "score")
    keyed = keyed.where(F.length("__key") > 0).groupBy(*by, "__key").agg(F.max("score").alias("score"))
    rows = instances.join(kinds, list(by), "left").withColumn("__key", F.when(F.col("__texts"), F.col("text_key")).otherwise(F.col("sample_id")))
    return rows.join(keyed, [*by, "__key"], "left").drop("__key", "__texts")


def current_instances(results: DataFrame, benchmark: DataFrame, mtime: str = "mtime") -> DataFrame:
    """Of each current instance (leaf, instance) and each model and method the row of the latest file.

    ``results``: leaf, model, method, text_key (of the text as scored), sample_id, mtime and more; ``benchmark``: leaf,
    instance (the raw text's key), formatted_key (of the text as it is formatted) and sample_id. A result is matched by the
    raw key, else by the formatted one, else by its sample id within its leaf; other results go.
    """
    rows = results
    for key, match in (("instance", "text_key"), ("formatted_key", "text_key"), ("sample_id", "sample_id")):
        known = benchmark.where(F.col(key).isNotNull()).groupBy("leaf", F.col(key).alias(match)).agg(F.min("instance").alias(f"__{key}"))
        rows = rows.join(known, ["leaf", match], "left")
    found = rows.withColumn("instance", F.coalesce("__instance", "__formatted_key", "__sample_id")).drop("__instance", "__formatted_key", "__sample_id").where("instance is not null")
    rest = [c for c in found.columns if c not in ("leaf", "model", "method", "instance", mtime)]
    latest = found.groupBy("leaf", "model", "method", "instance").agg(F.max(F.struct(mtime, *rest)).alias("__r"))
    return latest.select("leaf", "model", "method", "instance", "__r.*")


def with_judgement(records: DataFrame, judged: DataFrame, key: str = "id") -> DataFrame:
    """records with p_yes of the judge's answers (key, top: token and logprob pairs, answer: text); a text stands in where there are no pairs: 1 for yes, 0 for no, 0.5 for anything else. Records that were not judged keep a null."""
    from lexaudit.operators.reports import yes_probability

    said = F.lower(blank_to_null(F.col("answer")))
    spoken = F.when(F.startswith(said, F.lit("yes")), 1.0).when(F.startswith(said, F.lit("no")), 0.0).otherwise(0.5)
    p = F.when(F.size("top") > 0, yes_probability(F.col("top"))).otherwise(spoken)
    return records.join(judged.select(key, p.alias("p_yes")), key, "left")


def with_options(records: DataFrame, options: DataFrame, key: str = "id") -> DataFrame:
    """The records that have a text and all four options (key, options: letter to text), with them."""
    whole = F.forall(F.array(*[F.col("options")[c] for c in "ABCD"]), lambda x: F.length(F.coalesce(x, F.lit(""))) > 0)
    return records.where(F.length("text") > 0).join(options.where(whole).select(key, "options"), key)


def ablation(cells: DataFrame, keys: Sequence[str], marker: str, value: str) -> DataFrame:
    """keys, with_it, without, difference: cells of the same keys where ``marker`` is true and where it is not."""
    on, off = (cells.where(c).select(*keys, F.col(value).alias(n)) for c, n in ((F.col(marker), "with_it"), (~F.col(marker), "without")))
    return on.join(off, list(keys)).withColumn("difference", F.col("with_it") - F.col("without"))


def union_of_signals(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; a signal that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pooled_sides(scores: DataFrame, leaf: str, sides: Sequence[str] = ("chosen", "rejected")) -> DataFrame:
    """scores whose leaf names a side (``..._chosen...``) under one leaf for all sides: a bag, nothing is merged."""
    pattern = "_(" + "|".join(sides) + ")(?=_|$)"
    return scores.withColumn(leaf, F.regexp_replace(leaf, pattern, ""))


def first_usable(rows: DataFrame, text: str, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group that have a text, in order; the limit is the feature."""
    usable = rows.where(blank_to_null(text).isNotNull())
    if not by:
        return usable.orderBy(*order).limit(n)
    return usable.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def in_order(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Adds ordinal: the place of ``column`` in ``names``, after them for others; sort by it to keep a stated order."""
    place = F.coalesce(*[F.when(F.col(column) == n, F.lit(k)) for k, n in enumerate(names)], F.lit(len(names)))
    return df.withColumn("ordinal", place)
