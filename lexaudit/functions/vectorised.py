"""What has no built-in form: compressed length, edit distance and common subsequence of tokens, parsing, regularity measures, occurrences, perturbations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType


@F.pandas_udf(LongType())
def zlib_length(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else len(zlib.compress(x.encode())))


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of token lists: a row at a time, insertions by running minimum."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    ids = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([ids[t] for t in b])
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, t in enumerate(a):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != ids[t]))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def common_subsequence(a: list, b: list) -> int:
    if not len(a) or not len(b):
        return 0
    ids = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([ids[t] for t in b])
    row = np.zeros(len(y) + 1, np.int64)
    for t in a:
        row = np.maximum.accumulate(np.concatenate([[0], np.maximum(row[1:], row[:-1] + (y == ids[t]))]))
    return int(row[-1])


@F.pandas_udf(LongType())
def token_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays."""

    def one(x: list, y: list) -> float:
        n = common_subsequence(x, y)
        return 2 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(list(x), list(y)) for x, y in zip(a, b)])


def ascending(lists: pa.Array) -> Iterator[tuple[np.ndarray, int] | None]:
    """Of each list its values in ascending order, NaN and then nulls (as NaN) last, and how many are null; None if it is null."""
    values = lists.flatten()
    flat, holes = values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    for k, there in enumerate(lists.is_valid().to_pylist()):
        a, b = ends[k], ends[k + 1]
        yield (np.sort(flat[a:b]), 0 if holes is None else int(holes[a:b].sum())) if there else None


def bottom_means(values: Column, ratios: Sequence[float]) -> Column:
    """An array: for each ratio the mean of that share of the smallest values, at least one; nulls if there are none. Values are sorted once for all ratios."""

    @F.arrow_udf("array<double>")
    def means(lists: pa.Array) -> pa.Array:
        out = []
        for run in ascending(lists):
            if run is None or not len(run[0]):
                out.append([None] * len(ratios))
                continue
            n, known, sums = len(run[0]), len(run[0]) - run[1], np.cumsum(run[0]) + 0.0
            counts = [max(1, int(n * r)) for r in ratios]
            out.append([float(sums[k - 1] / k) if k <= known else None for k in counts])
        return pa.array(out, pa.list_(pa.float64()))

    return means(values.cast("array<double>"))


def polarised_gaps(own: Column, copies: Column, fars: Sequence[float], nears: Sequence[float]) -> Column:
    """An array: for each share of ``fars`` and, within it, of ``nears``, the mean over the copies (an array of arrays) of their polarised distance less that of ``own``. Each array is sorted once for all shares."""
    size = len(fars) * len(nears)

    def distances(lists: pa.Array) -> Iterator[np.ndarray | None]:
        for run in ascending(lists):
            if run is None or not len(run[0]):
                yield np.zeros(size)
                continue
            if run[1]:  # the largest take the nulls in
                yield None
                continue
            n, sums = len(run[0]), np.cumsum(run[0])
            low = [sums[k - 1] / k for k in (max(1, int(n * r)) for r in nears)]
            top = [np.cumsum(run[0][n - k :])[-1] / k for k in (max(1, int(n * r)) for r in fars)]
            yield np.subtract.outer(top, low).ravel()

    @F.arrow_udf("array<double>")
    def gaps(own: pa.Array, copies: pa.Array) -> pa.Array:
        out, each = [], distances(copies.flatten())
        with np.errstate(invalid="ignore"):
            for plain, n in zip(distances(own), copies.value_lengths().to_pylist()):
                those = [next(each) for _ in range(n or 0)]
                out.append([None] * size if not those or plain is None or any(x is None for x in those) else (sum(those, np.zeros(size)) / n - plain).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return gaps(own.cast("array<double>"), copies.cast("array<array<double>>"))


def phrases(symbols: list[int]) -> int:
    """Phrases of an incremental (Lempel-Ziv 1978) parse; an unfinished last one does not count."""
    root: dict = {}
    node, n = root, 0
    for s in symbols:
        if s in node:
            node = node[s]
        else:
            node[s] = {}
            node, n = root, n + 1
    return n


#: Fixed value: edges from the smallest value up to 0 of the first of two binnings.
FINE_EDGES = 100


def parse_complexity(values: np.ndarray, bins: int) -> float:
    """Phrases for each value of log-probabilities, put into fine bins and those into ``bins``; NaN if there are none."""
    if not len(values):
        return float("nan")
    fine = np.searchsorted(np.linspace(values.min(), 0.0, FINE_EDGES), values)
    coarse = np.searchsorted(np.linspace(fine.min(), fine.max(), bins + 1)[1:], fine)
    return phrases(coarse.tolist()) / len(values)


def approximate_entropy(values: np.ndarray, m: int = 8, r: float = 0.8) -> float:
    """How much less often windows of m + 1 values than windows of m have others within r deviations: the difference of the
    mean logs of those shares, without sign. 0 if there are no more than m + 1 values or no spread.

    Windows are near if all their values are, so nearness of longer windows follows from that of shorter ones.
    """
    n, width = len(values), r * float(np.std(values)) if len(values) else 0.0
    if n <= m + 1 or width == 0:
        return 0.0
    close = np.abs(values[:, None] - values[None, :]) <= width
    near, logs = close, []
    for k in range(1, m + 1):
        if k == m:
            logs.append(np.log(near.mean(axis=0)).mean())
        near = near[:-1, :-1] & close[k:, k:]
    logs.append(np.log(near.mean(axis=0)).mean())
    return float(abs(logs[0] - logs[1]))


def occurrences(pattern: np.ndarray, whole: np.ndarray, wanted: int = 3, shortest: int = 3) -> tuple[np.ndarray, int] | None:
    """First starts in ``whole`` of the longest tail of ``pattern`` that is there ``wanted`` times, and the tail's length.

    The tail's length is the ``wanted``-th largest of the lengths to which the text before a place ends like the pattern.
    """
    n = len(pattern)
    joined = [*pattern[::-1].tolist(), None, *whole[::-1].tolist()]
    same, left, right = [0] * len(joined), 0, 0
    for i in range(1, len(joined)):
        k = min(right - i, same[i - left]) if i < right else 0
        while i + k < len(joined) and joined[k] == joined[i + k]:
            k += 1
        same[i] = k
        if i + k > right:
            left, right = i, i + k
    ends = np.array(same[n + 1 :][::-1])  # of the text up to and with each place
    if len(ends) < wanted:
        return None
    length = min(n, int(np.sort(ends)[-wanted]))
    if length < shortest:
        return None
    return np.flatnonzero(ends >= length)[:wanted] - length + 1, length


def swapped(text: str, key: str, share: float = 0.3) -> str:
    """Some words exchanged, by a generator seeded with the key alone, so that the order of rows does not matter."""
    rng = random.Random(hashlib.md5(key.encode()).hexdigest())
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        if len(w) > 1:
            i, j = rng.sample(range(len(w)), 2)
            w[i], w[j] = w[j], w[i]
    return " ".join(w)


@F.pandas_udf(StringType())
def swap_words(text: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else swapped(t, k) for t, k in zip(text, key)])


def masked(text: str, key: str, share: float = 0.3, span: int = 2, buffer: int = 1) -> str:
    """Spans of words replaced by numbered marks, ``buffer`` words apart at least."""
    rng = random.Random(hashlib.md5(key.encode()).hexdigest())
    w = text.split()
    want, taken, starts = int(share * len(w) / (span + 2 * buffer)), set(), []
    for _ in range(5 * want + 50):
        if len(starts) >= want or len(w) < span:
            break
        s = rng.randrange(len(w) - span + 1)
        if not taken & set(range(s - buffer, s + span + buffer)):
            starts.append(s)
            taken |= set(range(s, s + span))
    out, i = [], 0
    numbers = {s: k for k, s in enumerate(sorted(starts))}
    while i < len(w):
        if i in numbers:
            out.append(f"<extra_id_{numbers[i]}>")
            i += span
        else:
            out.append(w[i])
            i += 1
    return " ".join(out)


@F.pandas_udf(StringType())
def mask_spans(text: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else masked(t, k) for t, k in zip(text, key)])


@F.pandas_udf(StructType().add("head", StringType()).add("tail", StringType()))
def split_randomly(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Head and tail of a text, cut after 40 to 70 % of its sentences, else words, else characters."""
    for texts, keys in batches:
        out = []
        for t, k in zip(texts, keys):
            rng = random.Random(hashlib.md5(k.encode()).hexdigest())
            share, got = rng.uniform(0.4, 0.7), (t, "")
            for parts, glue in ((re.split(r"(?<=[.!?])\s+(?=[A-Z\"'])", t or ""), " "), ((t or "").split(), " "), (list(t or ""), "")):
                if len(parts) > 1:
                    n = min(max(1, int(len(parts) * share)), len(parts) - 1)
                    got = (glue.join(parts[:n]), glue.join(parts[n:]))
                    if got[0].strip() and got[1].strip():
                        break
            out.append(got)
        yield pd.DataFrame(out, columns=["head", "tail"])


#: Fixed values of MD5: sines and rotations, by step.
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = [np.uint32((7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21)[i // 16 * 4 + i % 4]) for i in range(64)]
PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
#: Numbers hashed at a time, so that registers stay in a core's cache.
HASHED = 8192


def md5_block(words: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits, as hex digits read them, of the MD5 of messages of one block, given as its 16 words (one of them at least an array over messages)."""
    a, b, c, d = (np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(61):  # later steps do not touch the first register
        if i < 16:
            f = ((c ^ d) & b) ^ d
        elif i < 32:
            f = ((b ^ c) & d) ^ c
        elif i < 48:
            f = (b ^ c) ^ d
        else:
            f = (b | ~d) ^ c
        f += a
        f += SINES[i]
        f = f + words[PLACES[i]]
        high = f >> (np.uint32(32) - TURNS[i])
        f <<= TURNS[i]
        f |= high
        f = f + b
        a, b, c, d = d, f, b, c
    return (b + np.uint32(0x67452301)).byteswap()


class NumberedHashes:
    """For texts like ``name:`` the first 8 hex digits of the MD5 of the text followed by each of 0, 1, ..., n - 1, as numbers.

    The digits, which do not change from text to text, are laid into words once for each place in a word at which they can begin.
    """

    def __init__(self, n: int) -> None:
        self.n, self.place, self.digits = n, -1, []

    def _lay(self, place: int) -> None:
        self.place, self.digits, low = place, [], 0
        while low < self.n:
            high, size = min(self.n, 10 ** len(str(low))), len(str(low))
            for at in range(low, high, HASHED):
                numbers = np.arange(at, min(at + HASHED, high), dtype=np.uint32)
                words = [np.zeros(len(numbers), np.uint32) for _ in range((place + size) // 4 + 1)]
                for k in range(size):
                    p = place + size - 1 - k
                    words[p // 4] |= (numbers % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (p % 4))
                    numbers = numbers // np.uint32(10)
                words[(place + size) // 4] |= np.uint32(0x80 << (8 * ((place + size) % 4)))
                self.digits.append((at, size, words))
            low = high

    def __call__(self, text: str) -> np.ndarray:
        out, prefix = np.empty(self.n, np.uint32), text.encode()
        if len(prefix) + len(str(self.n)) > 55:  # more than one block
            for i in range(self.n):
                out[i] = int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16)
            return out
        if self.place != len(prefix) % 4:
            self._lay(len(prefix) % 4)
        first, fixed = len(prefix) // 4, np.frombuffer(prefix + bytes(64 - len(prefix)), "<u4")
        for at, size, words in self.digits:
            block = [fixed[k : k + 1] for k in range(14)] + [np.array([8 * (len(prefix) + size)], np.uint32), np.zeros(1, np.uint32)]
            for k, w in enumerate(words):
                block[first + k] = block[first + k] | w
            out[at : at + len(words[0])] = md5_block(block)
        return out
