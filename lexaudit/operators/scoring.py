"""The seam to models: tables of token statistics, and the scores computed from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions.text import words
from lexaudit.storage import settle

#: Log-probabilities of the stand-in scorer are multiples of 1/GRID, so that their sums are exact in any order.
GRID = float(1 << 20)
#: Words up to which a vocabulary is broadcast, as 16 bytes each; a larger one is joined.
MAX_VOCABULARY = 4_000_000
#: Words looked up at a time, which bounds a worker's memory.
LOOKED_UP = 1 << 18


class TokenScorer(Protocol):
    """From (id, w) to (id, ids, lp, mu, sigma); sigma is a variance."""

    def score(self, tokens: DataFrame) -> DataFrame: ...


@dataclass
class RecordedScorer:
    """Reads statistics that a model run has recorded."""

    table: DataFrame

    def score(self, tokens: DataFrame) -> DataFrame:
        return self.table.join(tokens.select("id"), "id", "left_semi")


class Frequencies:
    """Counts (tok, c) of a corpus as add-one frequencies of token arrays.

    A vocabulary up to ``most`` words is broadcast by 64-bit hash, so a table of token arrays is looked up row by row,
    without a shuffle and without a hot word; a larger one is joined to exploded tokens.
    """

    def __init__(self, counts: DataFrame, most: int = MAX_VOCABULARY) -> None:
        self.counts = settle(counts)  # counted once for all that follows
        n, v = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.n, self.v, self.fits = n, v, v <= most
        if self.fits:
            table = self.counts.select(F.xxhash64("tok").alias("h"), "c").toArrow()
            h, c = (table.column(k).to_numpy() for k in ("h", "c"))
            order = np.argsort(h)
            self.shared = counts.sparkSession.sparkContext.broadcast((h[order], c[order].astype(np.float64)))

    @property
    def unseen(self) -> float:
        """log frequency of a word that is not there."""
        return float(-np.log(self.n + self.v)) if self.n else 0.0

    def moments(self) -> tuple[float, float]:
        """Mean and variance of the log frequency under the frequencies."""
        if not self.fits:
            lp = F.round(F.log((F.col("c") + 1) / F.lit(float(self.n + self.v))) * GRID) / GRID
            mu, square = self.counts.agg(F.sum(F.exp(lp) * lp), F.sum(F.exp(lp) * lp * lp)).first()
            return mu, square - mu * mu
        lp = np.rint(np.log((self.shared.value[1] + 1) / max(self.n + self.v, 1)) * GRID) / GRID
        mu = float((np.exp(lp) * lp).sum())
        return mu, float((np.exp(lp) * lp * lp).sum()) - mu * mu

    def _look_up(self):
        shared, size = self.shared, max(self.n + self.v, 1)

        def look_up(hashes: np.ndarray) -> np.ndarray:
            h, c = shared.value
            if not len(h):
                return np.full(len(hashes), -np.log(size))
            at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
            return np.log((np.where(h[at] == hashes, c[at], 0.0) + 1) / size)

        return look_up

    def log_frequencies(self, tokens: DataFrame) -> DataFrame:
        """tokens (id, w) with lp, the log frequency of each token, to 1/GRID; ids are distinct."""
        if not self.fits:
            logs = self.counts.select("tok", F.log((F.col("c") + 1) / F.lit(float(self.n + self.v))).alias("lp"))
            rows = tokens.select("id", F.posexplode("w").alias("pos", "tok")).join(logs, "tok", "left")
            lp = F.round(F.coalesce("lp", F.lit(self.unseen)) * GRID) / GRID
            packed = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", lp.alias("lp")))).alias("t"))
            return tokens.join(packed, "id", "left").withColumn("lp", F.coalesce(F.col("t.lp"), F.array().cast("array<double>"))).drop("t")
        look_up = self._look_up()

        @F.arrow_udf("array<double>")
        def logs_of(hashes: pa.Array) -> pa.Array:
            words = hashes.flatten().to_numpy()
            logs = np.empty(len(words))
            for at in range(0, len(words), LOOKED_UP):
                logs[at : at + LOOKED_UP] = np.rint(look_up(words[at : at + LOOKED_UP]) * GRID) / GRID
            return pa.ListArray.from_arrays(pa.array(offsets_of(hashes), pa.int32()), pa.array(logs))

        return tokens.withColumn("lp", logs_of(F.transform(F.coalesce("w", F.array().cast("array<string>")), lambda t: F.xxhash64(t))))


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Where each list begins and the last one ends in the flattened array."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])


@dataclass
class UnigramScorer:
    """Add-one unigram statistics of a corpus. A stand-in that exercises every formula; it says nothing about membership."""

    counts: DataFrame | Frequencies  # tok, c

    def score(self, tokens: DataFrame) -> DataFrame:
        frequencies = self.counts if isinstance(self.counts, Frequencies) else Frequencies(self.counts)
        mu, sigma = frequencies.moments()
        flat = lambda x: F.array_repeat(F.lit(x), F.size("w"))
        return frequencies.log_frequencies(tokens.select("id", "w")).select("id", F.col("w").alias("ids"), "lp", flat(mu).alias("mu"), flat(sigma).alias("sigma"))


def token_counts(tokens: DataFrame, first: int | None = None) -> DataFrame:
    """tok, c over all documents (id, w); of each at most its ``first`` tokens."""
    w = F.col("w") if first is None else F.slice("w", 1, first)
    return tokens.select(F.explode(w).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))


def tokens_of(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), words(text).alias("w"))


def calibrated_frequency(stats: DataFrame, counts: DataFrame | Frequencies, ceilings: Sequence[float] = (0.01,)) -> DataFrame:
    """id, ceiling, dcpdd: over first occurrences of each token, the mean of p * ln(1 / f), ``ceiling`` at most; f is the add-one frequency.

    All ceilings are swept over the same tokens. Records without tokens have no row.
    """
    known = counts if isinstance(counts, Frequencies) else Frequencies(counts)
    if not known.fits:
        first = F.transform(F.array_distinct("ids"), lambda t: F.struct(t.alias("tok"), F.get(F.col("lp"), F.array_position("ids", t).cast("int") - 1).alias("lp")))
        rows = stats.select("id", F.explode(first).alias("x")).select("id", "x.*").join(known.counts, "tok", "left")
        value = F.exp("lp") * F.log(F.lit(float(known.n + known.v)) / (F.coalesce("c", F.lit(0)) + 1))
        return rows.withColumn("ceiling", F.explode(F.array(*map(F.lit, ceilings)))).groupBy("id", "ceiling").agg(F.avg(F.least(value, F.col("ceiling"))).alias("dcpdd"))
    look_up = known._look_up()

    @F.arrow_udf("array<double>")
    def swept(hashes: pa.Array, lps: pa.Array) -> pa.Array:
        ends, words, lp = offsets_of(hashes), hashes.flatten().to_numpy(), lps.flatten().to_numpy()
        weighted = np.exp(lp) * -look_up(words)
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            value = weighted[a:b][np.unique(words[a:b], return_index=True)[1]]
            out.append([float(np.minimum(value, c).mean()) for c in ceilings])
        return pa.array(out, pa.list_(pa.float64()))

    rows = stats.where(F.size("ids") > 0).select("id", swept(F.transform("ids", lambda t: F.xxhash64(t)), F.col("lp")).alias("s"))
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, ceilings)).alias("ceiling"), F.col("s").alias("dcpdd")))
    return rows.select("id", pairs.alias("x")).select("id", "x.ceiling", "x.dcpdd")
