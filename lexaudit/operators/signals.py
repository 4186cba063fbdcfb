"""Context signals of token log-probabilities, their directions, p-values and combination."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexaudit.functions import vectorised as V
from lexaudit.operators.running import running_totals
from lexaudit.operators.scoring import offsets_of

#: Lengths at which signals are cut, thresholds and numbers of bins. The first cut leaves out the last token.
CUTS, HEAD, TREND_CUTS, BEFORE_CUTS = (-1, 200, 300), 200, (600, 800, 1000), (10**9, 200, 300)
THRESHOLDS, BINS = (-1.0, -2.0, -3.0), (3, 4, 5)
#: Signals of which the first occurrence's less the second's, and less the third's, are signals too.
REPEATED = ("loss", "ppl", "count_above", "lz_complexity", "count_mean", "calibrated_loss", "calibrated_ppl")
GROUPS = ("base", "parse", "before", "repetition", "trend", "entropy")
ROWS = "id long, signal string, variation int, value double"


def _mean(a: np.ndarray) -> float:
    return float(a.mean()) if len(a) else float("nan")


def base(lp: np.ndarray, ids: np.ndarray, parse: bool = True) -> dict[str, np.ndarray]:
    """Signals of one sequence: a value for each cut, threshold or number of bins."""
    cut = [lp[:c] for c in CUTS]
    loss = np.array([_mean(x) for x in cut])
    ppl = np.exp(-loss)
    diversity = np.array([len(np.unique(x)) / len(x) if len(x) else float("nan") for x in (ids[:c] for c in CUTS)])
    head = lp[:HEAD]
    out = {
        "loss": loss, "ppl": ppl, "token_diversity": diversity, "calibrated_loss": loss / diversity, "calibrated_ppl": ppl / diversity,
        "count_mean": np.array([float((x > x.mean()).sum()) if len(x) else float("nan") for x in cut]),
        "count_above": np.array([_mean(head >= t) for t in THRESHOLDS]),
    }
    if parse:
        out["lz_complexity"] = np.array([V.parse_complexity(head, b) for b in BINS])
    return out


def above_before(lp: np.ndarray, cut: int) -> float:
    """Share of the tokens from the second on that exceed the mean of all before them."""
    x = lp[:cut]
    return float((x[1:] > np.cumsum(x[:-1]) / np.arange(1, len(x))).mean()) if len(x) > 1 else float("nan")


def slope(lp: np.ndarray, cut: int) -> float:
    x = lp[:cut]
    if len(x) <= 2:
        return float("nan")
    at = np.arange(len(x)) - (len(x) - 1) / 2
    return float((at * (x - x.mean())).sum() / (at * at).sum())


def of_record(lp: np.ndarray, ids: np.ndarray, rep_lp: np.ndarray, rep_ids: np.ndarray, groups: Sequence[str]) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    if not len(lp):
        return out
    parse = "parse" in groups
    if "base" in groups or parse:
        own = base(lp, ids, parse)
        out |= own if "base" in groups else {"lz_complexity": own["lz_complexity"]}
    if "before" in groups:
        out["count_above_pre"] = np.array([above_before(lp, c) for c in BEFORE_CUTS])
    if "repetition" in groups and len(rep_lp):
        found = V.occurrences(ids, rep_ids)
        if found:
            starts, n = found
            first, *others = (base(rep_lp[s : s + n], ids, parse) for s in starts)
            for k, other in enumerate(others, 1):
                out |= {f"overall_diff_{k}_{name}": first[name] - other[name] for name in REPEATED if name in first}
    if "trend" in groups:
        out["slope"] = np.array([slope(rep_lp, c) for c in TREND_CUTS])
    if "entropy" in groups:
        out["approximate_entropy"] = np.array([V.approximate_entropy(rep_lp[:c]) for c in TREND_CUTS])
    return out


def signals(stats: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """id, signal, variation (from 0), value of records (id, ids, lp), and of their repeated texts (rep_ids, rep_lp) if there.

    A record without tokens has no rows; what is too short for a signal is NaN. ``groups`` chooses signals: base, parse (phrase
    counts), before (against the running mean), repetition (differences of occurrences), trend and entropy (of the repeated
    sequence). Records are mapped one by one; token ids are told apart by 64-bit hashes.
    """
    repeated = "rep_lp" in stats.columns and bool({"repetition", "trend", "entropy"} & set(groups))
    number = lambda c: F.transform(c, lambda t: F.xxhash64(t)).alias(c)
    rows = stats.select("id", number("ids"), "lp", *((number("rep_ids"), "rep_lp") if repeated else ()))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0)
        for batch in batches:
            lists = [(offsets_of(c), c.flatten().to_numpy(zero_copy_only=False)) for c in batch.columns[1:]]
            kinds, variations, values, at = [], [], [], []
            for i in range(batch.num_rows):
                ids, lp, *rest = (x[ends[i] : ends[i + 1]] for ends, x in lists)
                rep_ids, rep_lp = rest or (none, none)
                got = of_record(lp, ids, rep_lp, rep_ids, groups)
                for name in sorted(got):
                    kinds += [name] * len(got[name])
                    variations += range(len(got[name]))
                    values += got[name].tolist()
                    at += [i] * len(got[name])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(variations, pa.int32()), pa.array(values, pa.float64())], names=["id", "signal", "variation", "value"])

    return rows.mapInArrow(f, ROWS)


def repeat(stats: DataFrame, copies: int = 6) -> DataFrame:
    """Adds rep_ids and rep_lp of ``copies`` copies for a scorer without a model: each copy's tokens are as many times as likely as they have come, at most certain."""
    again = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(copies)), lambda k: F.transform("lp", lambda x: F.least(x + F.log(k.cast("double")), F.lit(0.0)))))
    return stats.withColumn("rep_ids", F.flatten(F.array_repeat("ids", copies))).withColumn("rep_lp", again)


def matrix(rows: DataFrame, names: Sequence[tuple[str, int]]) -> DataFrame:
    """id and one column for each (signal, variation) of ``names``: the blocks side by side, null where a record lacks one."""
    pick = [F.max(F.when((F.col("signal") == s) & (F.col("variation") == v), F.col("value"))).alias(f"{s}_{v}") for s, v in names]
    return rows.groupBy("id").agg(*pick)


def directions(rows: DataFrame) -> DataFrame:
    """signal, sign: -1 where the mean of the members (member) over all variations is above the non-members', else 1; so a small signed value speaks for a member."""
    m, n = (F.avg(F.when(c, F.col("value"))) for c in (F.col("member"), ~F.col("member")))
    return rows.where(~F.isnan("value")).groupBy("signal").agg(F.when(m > n, -1).otherwise(1).alias("sign"))


def p_values(targets: DataFrame, null: DataFrame, signs: DataFrame) -> DataFrame:
    """id, signal, variation, p: share of the finite null values (signal, variation, value) below a target's signed value, half of those equal; 0.5 if the target is not finite.

    Signals without a null value have no row; a signal without a sign counts as it is. Targets and null values are ranked
    together by running totals over distinct values, never pair by pair.
    """
    key = ["signal", "variation"]
    signed = lambda df: df.join(signs, "signal", "left").withColumn("value", F.col("value") * F.coalesce("sign", F.lit(1))).drop("sign")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    t, n = signed(targets), signed(null).where(finite)
    every = n.select(*key, "value", F.lit(1).alias("k")).unionByName(t.where(finite).select(*key, "value", F.lit(0).alias("k")))
    tallied = every.groupBy(*key, "value").agg(F.sum("k").alias("k"))
    sizes = n.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(tallied, key, "value", ["k"]).join(sizes, key)
    p = ranked.select(*key, "value", ((F.col("k_before") + F.col("k") / 2) / F.col("n")).alias("p"))
    return t.join(sizes.select(*key), key, "left_semi").join(p, [*key, "value"], "left").select("id", *key, F.coalesce("p", F.lit(0.5)).alias("p"))


def chi_square_above(x: float, n: int) -> float:
    """Probability that a chi-square variable of 2 n degrees exceeds x: a Poisson count of mean x / 2 below n."""
    half = x / 2
    if half <= 0:
        return 1.0
    logs = [k * math.log(half) - half - math.lgamma(k + 1) for k in range(n)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


def student_above(t: float, degrees: int) -> float:
    """Probability that a Student variable exceeds t, by the continued fraction of the incomplete beta function."""
    a, b, x = degrees / 2, 0.5, degrees / (degrees + t * t)

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        out = d
        for k in range(1, 400):
            for top in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * out

    tail = beta(a, b, x) / 2
    return tail if t >= 0 else 1 - tail


def _combined(method: str):
    def one(n: int, low: float, high: float) -> float:
        if method == "fisher":
            return -chi_square_above(-2 * low, n)
        if method == "pearson":
            return -(1 - chi_square_above(-2 * high, n))
        degrees = 5 * n + 4
        return -student_above((high - low) * math.sqrt(3 / n) / math.pi * math.sqrt(degrees / (degrees - 2)), degrees)

    @F.pandas_udf(DoubleType())
    def f(n: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(n, low, high)])

    return f


def combine(p: DataFrame, floor: float = 1e-10) -> DataFrame:
    """id, edgington (less the mean of p), and less the combined p-values by fisher, pearson and george (logits): higher means more likely a member.

    For the latter p is kept ``floor`` away from 0 and 1; only their number and sums of logs leave a record's group.
    """
    c = F.least(F.greatest(F.col("p"), F.lit(floor)), F.lit(1 - floor))
    sums = p.groupBy("id").agg((-F.avg("p")).alias("edgington"), F.count(F.lit(1)).alias("n"), F.sum(F.log(c)).alias("low"), F.sum(F.log(1 - c)).alias("high"))
    return sums.select("id", "edgington", *[_combined(m)("n", "low", "high").alias(m) for m in ("fisher", "pearson", "george")])
