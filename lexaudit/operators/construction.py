"""Building candidate splits: quality bands, first-seen dedup, n-gram overlap with a reference corpus, matched sampling."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.text import marked_words, ngrams
from lexaudit.storage import settle

GRAM = 13
#: Share of a text's n-grams in the corpus at which it is discarded.
OVERLAP = 0.2


def code_band(t1: Column, t2: Column, stars: Column) -> Column:
    """Non-member code: stars, and shares of the two most frequent tokens inside the band."""
    both = t1 + t2
    return (stars >= 2) & (((t1 <= 0.3) & (both > 0.5) & (both < 0.51)) | ((t1 > 0.3) & (t1 < 0.31) & (both <= 0.5)))


def answer_band(question: Column, answer: Column) -> Column:
    return ((question == 2) & (answer >= 5)) | ((question >= 3) & (answer == 4))


def web_band(p: Column) -> Column:
    return p >= 0.018


def code_candidate(t1: Column, t2: Column) -> Column:
    return (t1 >= 0.28) | (t1 + t2 >= 0.48)


def answer_candidate(question: Column, answer: Column) -> Column:
    return (question == 3) | (answer == 5)


def web_candidate(p: Column) -> Column:
    return p < 0.0181122


def top2_share(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, w1, s1, w2, s2: the two most frequent tokens and their shares, ties by first place; no row with fewer than two."""
    tokens = docs.select(id_col, F.posexplode(marked_words(F.col(text_col))).alias("pos", "tok"))
    counts = tokens.groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("p"))
    best = counts.groupBy(id_col).agg(F.sum("c").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "p", "tok"))), 1, 2).alias("b"))
    return best.where(F.size("b") > 1).select(id_col, F.col("b")[0]["tok"].alias("w1"), (-F.col("b")[0]["c"] / F.col("n")).alias("s1"), F.col("b")[1]["tok"].alias("w2"), (-F.col("b")[1]["c"] / F.col("n")).alias("s2"))


def first_seen(rows: DataFrame, text: Column, order: str) -> DataFrame:
    """Of equal texts the row that comes first in ``order``; compared by 256-bit hash. Copies are combined before the shuffle, so a hot text is no hot key."""
    kept = rows.groupBy(F.sha2(text, 256).alias("__h")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("__r"))
    return kept.select("__r.*")


def gram_rows(tokens: DataFrame, n: int = GRAM) -> DataFrame:
    """id, pos, gram from (id, w), w a materialised token array."""
    return tokens.select("id", F.posexplode(ngrams(F.col("w"), n)).alias("pos", "gram"))


def gram_hashes(tokens: DataFrame, n: int = GRAM, variant: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, pos, h (and v) from (id, w): 128 bits for each n-gram, from its tokens' hashes; v: with the first token's ``variant``, null if it has none.

    Tokens are hashed once, and n-grams row by row after the explode, so no n-gram is ever written out.
    """
    double = lambda t: F.struct(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(n)).alias("b"))
    hashed = tokens.where(F.size("w") >= n).select("id", *(["w"] if variant else []), F.transform("w", lambda t: F.xxhash64(t)).alias("__t"))
    rows = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("__t") - n)).alias("pos"))
    out = ["id", "pos", double(F.slice("__t", F.col("pos") + 1, F.lit(n))).alias("h")]
    if variant:
        other = variant(F.get("w", F.col("pos")))
        out.append(F.when(other.isNotNull(), double(F.concat(F.array(F.xxhash64(other)), F.slice("__t", F.col("pos") + 2, F.lit(n - 1))))).alias("v"))
    return rows.select(*out)


def overlap(queries: DataFrame, corpus: DataFrame, n: int = GRAM) -> DataFrame:
    """id, n_grams, hits, overlap of each query with at least one n-gram. ``queries`` and ``corpus``: (id, w).

    Only existence counts, so the corpus side is reduced to distinct grams; 128 bits stand for a gram on both sides.
    """
    c = gram_hashes(corpus, n).select("h").distinct().withColumn("__in", F.lit(True))
    hit = gram_hashes(queries, n).join(c, "h", "left")
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("n_grams"), F.count("__in").alias("hits")).withColumn("overlap", F.col("hits") / F.col("n_grams"))


#: Fixed value: the mark of a token that begins a word.
WORD_MARK = "\u2581"


def first_token_variant(token: Column) -> Column:
    """The token with its word mark put in front or taken off; null for digits and bare marks."""
    bare = F.regexp_replace(token, f"^{WORD_MARK}+", "")
    none = token.rlike(r"^\p{Nd}+$") | token.isin(WORD_MARK, WORD_MARK * 2)
    return F.when(~none, F.when(F.startswith(token, F.lit(WORD_MARK)), bare).otherwise(F.concat(F.lit(WORD_MARK), token)))


def corpus_counts(corpora: DataFrame, n: int = GRAM) -> DataFrame:
    """h, counts (source to number) of the n-grams of ``corpora`` (source, id, w); sources are the few of a training mix."""
    rows = gram_hashes(corpora.select(F.struct("source", "id").alias("id"), "w"), n).groupBy("h", F.col("id.source").alias("source")).agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("source", "c"))).alias("counts"))


def overlap_of_models(queries: DataFrame, corpora: DataFrame, models: Mapping[str, Mapping[str, int]], raw: Sequence[str] = (), n: int = GRAM) -> DataFrame:
    """id and a column for each model: the share of a query's n-gram places that the model's sources hold, 1.0 for queries with fewer than n tokens.

    ``models``: the sources of each model with their weights in its mix (a place counts if the weighted number is above 0).
    A place also counts if its n-gram with the first token's variant is there, but not in ``raw`` sources, which are
    searched as text. A query stays if all of its shares are below OVERLAP (``kept_by_all``).
    """
    counts = settle(corpus_counts(corpora, n))
    rows = gram_hashes(queries, n, first_token_variant)
    rows = rows.join(counts, "h", "left").join(counts.select(F.col("h").alias("v"), F.col("counts").alias("others")), "v", "left")

    def share(mix: Mapping[str, int]) -> Column:
        held = lambda m, leave: sum((F.lit(w) * F.coalesce(F.try_element_at(m, F.lit(s)), F.lit(0)) for s, w in mix.items() if s not in leave), F.lit(0))
        return F.count_if(held("counts", ()) + held("others", raw) > 0) / F.count(F.lit(1))

    found = rows.groupBy("id").agg(*[share(mix).alias(m) for m, mix in models.items()])
    short = queries.where(F.size("w") < n).select("id", *[F.lit(1.0).alias(m) for m in models])
    return found.unionByName(short)


def kept_by_all(overlaps: DataFrame, models: Sequence[str], least: float = OVERLAP) -> DataFrame:
    """The overlaps of the queries that no model's sources hold to ``least`` or more."""
    return overlaps.where(F.greatest(*map(F.col, models), F.lit(0.0)) < least)


def contaminated(overlaps: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Early-stopped view: 1.0 from ``least`` on (the cut includes it)."""
    return overlaps.withColumn("reported", F.when(F.col("overlap") >= least, 1.0).otherwise(F.col("overlap"))).withColumn("discard", F.col("overlap") >= least)


def top_sources(queries: DataFrame, corpus: DataFrame, n: int = GRAM, k: int = 10) -> DataFrame:
    """id, source, hits, rank: the corpus documents with most of a query's gram places.

    Only corpus grams that some query has are joined to their holders, and a query's places of one gram travel as a number.
    """
    q = gram_hashes(queries, n).groupBy("id", "h").agg(F.count(F.lit(1)).alias("places"))
    c = gram_hashes(corpus, n).select(F.col("id").alias("source"), "h").join(q.select("h").distinct(), "h", "left_semi").distinct()
    hits = q.join(c, "h").groupBy("id", "source").agg(F.sum("places").alias("hits"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "source"))).where(F.col("rank") <= k)


def merged_windows(hits: DataFrame, margin: int = 400) -> DataFrame:
    """id, begin, end: windows of ``margin`` around hits (id, at, length), touching ones merged."""
    w = hits.select("id", F.greatest(F.col("at") - margin, F.lit(0)).alias("b"), (F.col("at") + F.col("length") + margin).alias("e"))
    order = Window.partitionBy("id").orderBy("b", "e")
    new = w.withColumn("new", (F.col("b") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    island = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("id", "island").agg(F.min("b").alias("begin"), F.max("e").alias("end")).drop("island")


def divergence(counts: DataFrame, group: str, token: str = "tok", n: str = "n") -> DataFrame:
    """group, jsd: base-2 Jensen-Shannon divergence of each group's tokens from those of all other groups together."""
    totals = counts.groupBy(token).agg(F.sum(n).alias("all_n"))
    sizes = counts.groupBy(group).agg(F.sum(n).alias("size"))
    whole = totals.agg(F.sum("all_n").alias("whole"))
    # tokens that a group lacks add (1/2) q log2 2 each: their mass is what the rest of the group's tokens leave
    rows = counts.join(totals, token).join(sizes, group).crossJoin(whole)
    p = F.col(n) / F.col("size")
    q = (F.col("all_n") - F.col(n)) / (F.col("whole") - F.col("size"))
    m = (p + q) / 2
    part = 0.5 * p * F.log2(p / m) + F.when(q > 0, 0.5 * q * F.log2(q / m)).otherwise(0.0)
    return rows.where("whole > size").groupBy(group).agg((F.sum(part) + 0.5 * (1 - F.sum(q))).alias("jsd"))


def drift(rows: DataFrame, group: str, day: str) -> DataFrame:
    """group, drift: shift of mean and deviation of days against all rows, in deviations of all rows (1 if there is none)."""
    every = rows.agg(F.avg(day).alias("m"), F.stddev_pop(day).alias("s"))
    own = rows.groupBy(group).agg(F.avg(day).alias("gm"), F.stddev_pop(day).alias("gs"))
    scale = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return own.crossJoin(every).select(group, ((F.abs(F.col("gm") - F.col("m")) + F.abs(F.col("gs") - F.col("s"))) / scale).alias("drift"))


def jensen_shannon(a: Counter, b: Counter) -> float:
    tokens = sorted(a.keys() | b.keys(), key=str)
    return histogram_divergence(np.array([a[t] for t in tokens], float), np.array([b[t] for t in tokens], float))


def histogram_divergence(a: np.ndarray, b: np.ndarray) -> float:
    """Base-2 Jensen-Shannon divergence of two histograms over the same tokens."""
    p, q = a / max(a.sum(), 1), b / max(b.sum(), 1)
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return (part(p) + part(q)) / 2


@dataclass
class Matching:
    """What a matched sample aims at: tokens as numbers from 0 on, their histogram, days (or none), and how far the total may be off."""

    histogram: np.ndarray
    margin: int = 250
    days: np.ndarray | None = None

    def loss(self, counts: np.ndarray, days: np.ndarray) -> float:
        """Divergence of the tokens, and the shift of mean and deviation of the days in deviations of the aim's (1 if there is none)."""
        out = histogram_divergence(counts, self.histogram)
        if self.days is not None and len(self.days) and len(days):
            spread = self.days.std() or 1.0
            out += (abs(days.mean() - self.days.mean()) + abs(days.std() - self.days.std())) / spread
        return out


def anneal(items: Sequence[tuple[np.ndarray, np.ndarray]], aim: Matching, size: int, steps: int, days: np.ndarray | None = None, heat: float = 1e-3, cool: float = 0.999995, seed: int = 42) -> list[int]:
    """Indices of ``size`` items (token numbers and their counts) near the aim, for one bounded group.

    While the total of tokens is more than the margin off, only swaps that bring it nearer are made; then swaps that keep it
    inside are taken if they lower the loss, or by chance as the heat allows. Raises if the total does not get inside.
    """
    rng = random.Random(seed)
    order = list(range(len(items)))
    rng.shuffle(order)
    inside, outside = order[:size], order[size:]
    lengths = np.array([c.sum() for _, c in items], float)
    counts = np.zeros(len(aim.histogram))
    for i in inside:
        counts[items[i][0]] += items[i][1]
    goal = aim.histogram.sum()
    known = days if days is not None and aim.days is not None else None
    days_of = lambda chosen: np.empty(0) if known is None else known[chosen][~np.isnan(known[chosen])]
    now, off = aim.loss(counts, days_of(inside)), counts.sum() - goal
    for _ in range(steps if outside else 0):
        a, b = rng.randrange(size), rng.randrange(len(outside))
        i, j = inside[a], outside[b]
        new_off = off - lengths[i] + lengths[j]
        near = abs(off) <= aim.margin
        if (abs(new_off) > aim.margin) if near else (abs(new_off) >= abs(off)):
            continue
        counts[items[i][0]] -= items[i][1]
        counts[items[j][0]] += items[j][1]
        inside[a], outside[b] = j, i
        if not near:
            off = new_off
            now = aim.loss(counts, days_of(inside)) if abs(off) <= aim.margin else now
            continue
        cost = aim.loss(counts, days_of(inside))
        if cost < now or rng.random() < math.exp((now - cost) / heat):
            now, off, heat = cost, new_off, heat * cool
        else:
            counts[items[i][0]] += items[i][1]
            counts[items[j][0]] -= items[j][1]
            inside[a], outside[b] = i, j
    if abs(off) > aim.margin:
        raise ValueError(f"{off:+.0f} tokens off the aim, more than {aim.margin}")
    return sorted(inside)


#: Items of a pool, and tokens of its vocabulary, that one restart holds at most.
MAX_POOL, MAX_VOCABULARY = 1_000_000, 5_000_000


def matched_sample(pool: DataFrame, target: DataFrame, size: int | None = None, restarts: int = 4, steps: int | None = None, margin: int = 250, **options) -> DataFrame:
    """restart, id, loss, tokens: independent annealing runs side by side; take the best restart.

    ``pool`` and ``target``: id, w (and day, a number, to match days too). As many items as the target has, if ``size`` is
    not given. A restart holds the whole pool's token counts in one task, so a pool beyond MAX_POOL items or MAX_VOCABULARY
    tokens raises; ``steps`` grow with the pool (50 for each item, 2000 at least) if not given.
    """
    dated = "day" in pool.columns and "day" in target.columns
    counts = target.select(F.explode("w").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    n_pool, n_target = pool.count(), target.count()
    size = size or n_target
    if n_pool < size:
        raise ValueError(f"a pool of {n_pool} items for a sample of {size}")
    if n_pool > MAX_POOL or counts.count() > MAX_VOCABULARY:
        raise ValueError("a pool too large for one task")
    goal = {r.tok: r.c * size / max(n_target, 1) for r in counts.collect()}
    goal_days = np.array([r.day for r in target.select(F.col("day").cast("double")).collect() if r.day is not None]) if dated else None
    steps = steps or max(2000, 50 * n_pool)
    packed = pool.select("id", "w", F.col("day").cast("double").alias("day") if dated else F.lit(None).cast("double").alias("day"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        code = {t: k for k, t in enumerate(goal)}
        items = []
        for w in group["w"]:
            of = Counter(w)
            items.append((np.array([code.setdefault(t, len(code)) for t in of], np.int64), np.array(list(of.values()), float)))
        histogram = np.zeros(len(code))
        histogram[: len(goal)] = list(goal.values())
        aim, days = Matching(histogram, margin, goal_days), group["day"].to_numpy(float) if dated else None
        chosen = anneal(items, aim, size, steps, days, seed=int(group["restart"][0]), **options)
        total = np.zeros(len(code))
        for i in chosen:
            total[items[i][0]] += items[i][1]
        mine = np.empty(0) if days is None else days[chosen][~np.isnan(days[chosen])]
        return pd.DataFrame({"restart": group["restart"][0], "id": group["id"][chosen], "loss": aim.loss(total, mine), "tokens": int(total.sum())})

    runs = packed.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    return runs.groupBy("restart").applyInPandas(run, "restart int, id long, loss double, tokens long")
