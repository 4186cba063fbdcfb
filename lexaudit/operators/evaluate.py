"""Evaluation of membership scores: exact AUC, true positives at a false positive rate, thresholds, pooled and macro means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.operators.running import running_totals


def valid(score: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def valid_text(score: Column, both_infinities: bool = False) -> Column:
    """Of a score as JSON has it (text): not null, no NaN, a number; "Infinity" is one, "-Infinity" only with ``both_infinities``."""
    number = score.try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number)
    return ok if both_infinities else ok & (number > float("-inf"))


def tally(scores: DataFrame, by: Sequence[str] = (), sets: Sequence[Sequence[str]] | None = None, member: str = "member", score: str = "score") -> DataFrame:
    """One row for each group and distinct score, with members (pos) and non-members (neg). ``sets``: grouping sets of ``by``."""
    rows = scores.where(valid(F.col(score).cast("double"))).select(*by, F.col(score).cast("double").alias("score"), F.col(member).cast("boolean").alias("member"))
    counts = [F.count_if("member").alias("pos"), F.count_if(~F.col("member")).alias("neg")]
    if sets is None:
        return rows.groupBy(*by, "score").agg(*counts)
    names = [F.col(c) for c in [*by, "score"]]
    return rows.groupingSets([[F.col(c) for c in [*s, "score"]] for s in sets], *names).agg(*counts)


def auc(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n_pos, n_neg, auc: the share of pairs in which the member scores higher, ties half; null if a side is empty."""
    before = running_totals(tallied, by, "score", ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    out = before.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pairs.alias("pairs"))
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("pairs"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def roc_points(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, score, tpr, fpr of the rule score >= threshold, at each distinct score; groups with both sides only."""
    down = running_totals(tallied.withColumn("down", -F.col("score")), by, "down", ["pos", "neg"])
    totals = tallied.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).where("n_pos > 0 and n_neg > 0")
    joined = down.join(totals, list(by)) if by else down.crossJoin(totals)
    return joined.select(*by, "score", ((F.col("pos_before") + F.col("pos")) / F.col("n_pos")).alias("tpr"), ((F.col("neg_before") + F.col("neg")) / F.col("n_neg")).alias("fpr"))


def tpr_at_fpr(tallied: DataFrame, at: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """by, tpr: linear interpolation on the ROC curve from (0, 0); at equal rates the largest true positive rate counts."""
    points = roc_points(tallied, by)
    low = points.where(F.col("fpr") <= at).groupBy(*by).agg(F.max(F.struct("fpr", "tpr")).alias("lo"))
    high = points.where(F.col("fpr") > at).groupBy(*by).agg(F.min(F.struct("fpr", "tpr")).alias("hi"))
    both = high.join(low, list(by), "full") if by else high.crossJoin(low)
    lo = F.coalesce("lo", F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    x0, y0 = lo["fpr"], lo["tpr"]
    inside = y0 + (F.col("hi.tpr") - y0) * (F.lit(at) - x0) / (F.col("hi.fpr") - x0)
    return both.select(*by, F.coalesce(inside, y0).alias("tpr"))


def quantile(values: DataFrame, at: float, by: Sequence[str] = (), value: str = "value", count: str = "n") -> DataFrame:
    """by, quantile of values with their numbers (one row for each group and value), linear between neighbours; no group is gathered in one task."""
    placed = running_totals(values, by, value, [count])
    totals = values.groupBy(*by).agg(F.sum(count).alias("__all"))
    joined = placed.join(totals, list(by)) if by else placed.crossJoin(totals)
    place = (F.col("__all") - 1) * F.lit(at)
    holds = lambda k: F.max(F.when((F.col(f"{count}_before") <= k) & (k < F.col(f"{count}_before") + F.col(count)), F.col(value)))
    out = joined.groupBy(*by).agg(holds(F.floor(place)).alias("lo"), holds(F.ceil(place)).alias("hi"), F.first(place - F.floor(place)).alias("share"))
    return out.select(*by, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("quantile"))


def tpr_over_quantile(scores: DataFrame, at: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, tpr: members strictly above the linear (1 - at) quantile of the non-members."""
    tallied = tally(scores, by)
    cut = quantile(tallied.where("neg > 0"), 1 - at, by, "score", "neg").withColumnRenamed("quantile", "threshold")
    members = tallied.where("pos > 0")
    joined = members.join(cut, list(by)) if by else members.crossJoin(cut)
    return joined.groupBy(*by, "threshold").agg((F.sum(F.when(F.col("score") > F.col("threshold"), F.col("pos")).otherwise(0)) / F.sum("pos")).alias("tpr"))


def _curve(tallied: DataFrame, by: Sequence[str], falling: bool) -> DataFrame:
    """tallied with the totals of its group, and of what comes before in falling or rising order of score."""
    order = "__down" if falling else "score"
    ordered = running_totals(tallied.withColumn("__down", -F.col("score")) if falling else tallied, by, order, ["pos", "neg"])
    totals = tallied.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return ordered.join(totals, list(by)) if by else ordered.crossJoin(totals)


def best_threshold(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, accuracy of the most accurate rule score >= threshold; ties: the largest threshold.

    Thresholds: infinity (no members), half way between neighbouring scores, minus infinity (members only).
    """
    curve = _curve(tallied, by, True)
    # a score's cut takes in all scores down to it; below it comes the next score, if there is one
    n = F.col("n_pos") + F.col("n_neg")
    right = (F.col("pos_before") + F.col("pos") + F.col("n_neg") - F.col("neg_before") - F.col("neg")) / n
    cuts = curve.select(*by, "score", right.alias("accuracy"), (F.col("pos_before") + F.col("neg_before") + F.col("pos") + F.col("neg")).alias("place"), F.lit(0).alias("none"))
    none = curve.groupBy(*by).agg(F.first(F.col("n_neg") / n).alias("accuracy")).select(*by, F.lit(float("inf")).alias("score"), "accuracy", F.lit(0).cast("long").alias("place"), F.lit(1).alias("none"))
    best = cuts.unionByName(none).groupBy(*by).agg(F.max(F.struct("accuracy", "none", "score", "place")).alias("b"))
    chosen = best.select(*by, "b.*")
    # the next smaller score of the group, where the cut is between two
    joined = curve.select(*by, F.col("score").alias("other"), (F.col("pos_before") + F.col("neg_before")).alias("place"))
    below = chosen.join(joined, [*by, "place"], "left") if by else chosen.join(joined, "place", "left")
    threshold = F.when(F.col("none") == 1, float("inf")).when(F.col("other").isNull(), float("-inf")).otherwise((F.col("score") + F.col("other")) / 2)
    return below.select(*by, threshold.alias("threshold"), "accuracy")


def best_cut(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, accuracy of the most accurate rule score > threshold, thresholds being the scores themselves; ties: the smallest. "All are members" is no candidate."""
    curve = _curve(tallied, by, False)
    right = (F.col("n_pos") - F.col("pos_before") - F.col("pos") + F.col("neg_before") + F.col("neg")) / (F.col("n_pos") + F.col("n_neg"))
    best = curve.groupBy(*by).agg(F.max(F.struct(right.alias("accuracy"), (-F.col("score")).alias("down"))).alias("b"))
    return best.select(*by, (-F.col("b.down")).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


#: Domains of a leave-one-out evaluation, at most: their names pass through the driver.
MAX_DOMAINS = 1000


def leave_one_out_accuracy(scores: DataFrame, domain: str) -> DataFrame:
    """domain, threshold, accuracy: each domain judged by the best threshold of all others together.

    Scores are tallied once by domain and score; the others' tally is the total less the domain's own. Domains are the few
    of a benchmark: more than MAX_DOMAINS raise.
    """
    own = tally(scores, [domain]).withColumnRenamed(domain, "held_out")
    names = [r[0] for r in own.select("held_out").distinct().limit(MAX_DOMAINS + 1).collect() if r[0] is not None]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    whole = own.groupBy("score").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n")).withColumn("held_out", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    rest = whole.join(own, ["held_out", "score"], "left").select("held_out", "score", (F.col("__p") - F.coalesce("pos", F.lit(0))).alias("pos"), (F.col("__n") - F.coalesce("neg", F.lit(0))).alias("neg")).where("pos + neg > 0")
    chosen = best_threshold(rest, ["held_out"]).select("held_out", "threshold")
    judged = own.join(chosen, "held_out")
    over = F.col("score") >= F.col("threshold")
    right = F.when(over, F.col("pos")).otherwise(F.col("neg"))
    return judged.groupBy("held_out", "threshold").agg((F.sum(right) / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def macro_means(cells: DataFrame, levels: Sequence[str], value: str = "auc") -> DataFrame:
    """level, name, value, complete: means of means from the last of ``levels`` up to ``all``, nulls left out; complete tells if none was."""
    now = cells.select(*levels, F.col(value).alias("value"), F.col(value).isNotNull().alias("complete"))
    out = None
    for k in range(len(levels), -1, -1):
        up = now.groupBy(*levels[:k]).agg(F.avg("value").alias("value"), F.bool_and("complete").alias("complete"))
        named = up.select(F.lit(levels[k - 1] if k else "all").alias("level"), (F.concat_ws("/", *levels[:k]) if k else F.lit("all")).alias("name"), "value", "complete")
        out, now = (named if out is None else out.unionByName(named)), up
    return out


def grid_best(scores: DataFrame, grid: Sequence[str]) -> DataFrame:
    """The grid cell of the highest AUC; ties: the smallest cell."""
    cells = auc(tally(scores, list(grid)), list(grid))
    return cells.where("auc is not null").orderBy(F.desc("auc"), *grid).limit(1)


def constant_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, spread, kinds, suspicious: hardly any deviation, or two values at most after six decimals."""
    s = F.col("score").cast("double")
    out = scores.where(valid(s)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(s).alias("spread"), F.count_distinct(F.round(s, 6)).alias("kinds"))
    return out.withColumn("suspicious", (F.col("spread") < 1e-6) | (F.col("kinds") <= 2))


def audit(scores: DataFrame, by: Sequence[str], low: float = 0.03, high: float = 0.97) -> DataFrame:
    """by, auc, extreme, constant: cells whose AUC is beyond ``low`` or ``high``, or one of whose sides has constant scores."""
    sides = constant_scores(scores, [*by, "member"]).groupBy(*by).agg(F.bool_or("suspicious").alias("constant"))
    cells = auc(tally(scores, by), by)
    return cells.join(sides, list(by)).select(*by, "auc", ((F.col("auc") <= low) | (F.col("auc") >= high)).alias("extreme"), "constant")


def pooled_scopes(scores: DataFrame, levels: Sequence[str], size: str, fpr: float = 0.05) -> DataFrame:
    """scope columns (null above a scope's level), auc, tpr, sizes: pooled metrics of each scope, averaged over the model sizes that have a value."""
    by = [*levels, size]
    sets = [[*levels[:k], size] for k in range(len(levels), -1, -1)]
    tallied = tally(scores, by, sets)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    flat = tallied.select(*named, "score", "pos", "neg")
    cells = auc(flat, by).where("auc is not null").join(tpr_at_fpr(flat, fpr, by), by)
    out = cells.groupBy(*levels).agg(F.avg("auc").alias("auc"), F.avg("tpr").alias("tpr"), F.count(F.lit(1)).alias("sizes"))
    return out.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in levels], "auc", "tpr", "sizes")


def coverage(expected: DataFrame, scores: DataFrame, leaf: Sequence[str], key: str, method: str) -> DataFrame:
    """leaf, method, covered, expected: how many of a leaf's instances each method has scored."""
    wanted = expected.groupBy(*leaf).agg(F.count_distinct(key).alias("expected"))
    methods = scores.select(method).distinct()
    have = scores.join(expected.select(*leaf, key).distinct(), [*leaf, key], "left_semi").groupBy(*leaf, method).agg(F.count_distinct(key).alias("covered"))
    return wanted.crossJoin(methods).join(have, [*leaf, method], "left").select(*leaf, method, F.coalesce("covered", F.lit(0)).alias("covered"), "expected")


def config_differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Settings that both runs have, with other values."""
    return left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key).where("left_value <> right_value")
