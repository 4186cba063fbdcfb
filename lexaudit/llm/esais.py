"""Suffix order and common prefixes by induced sorting, with queues on disk.

Suffixes smaller than their successor right after a larger one (the starred ones) are sorted first: their substrings are
named in order, and names are doubled until they tell the suffixes apart. All other suffixes are induced: a priority queue
keyed by first symbol and arrival hands out suffixes in order, and each puts its predecessor back in. The queue is a row of
bucket files; the tuples in it carry the suffix and its common prefix with the tuple before it in the bucket, which follows
from the smallest value passed since. Work goes on in blocks of arrays, never symbol by symbol.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Tuples handled at a time, and tuples that a queue holds in memory before it writes.
BLOCK, HELD = 1 << 18, 1 << 21
#: Arrays of more bytes than this are mapped files.
IN_MEMORY = 64 << 20


class Store:
    """Arrays that live in memory while small, and in files of a folder of their own otherwise."""

    def __init__(self) -> None:
        self.dir = tempfile.mkdtemp(prefix="suffixes-")
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return os.path.join(self.dir, str(self.n))

    def array(self, size: int, kind) -> np.ndarray:
        if size * np.dtype(kind).itemsize <= IN_MEMORY:
            return np.zeros(size, kind)
        return np.memmap(self.path(), kind, "w+", shape=(size,))

    def close(self) -> None:
        shutil.rmtree(self.dir, ignore_errors=True)


class Queue:
    """Tuples (suffix, common prefix) by first symbol, in order of arrival; buckets overflow into files."""

    def __init__(self, store: Store, symbols: int) -> None:
        self.store = store
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: list[str | None] = [None] * symbols
        self.size = np.zeros(symbols, np.int64)  # tuples that ever arrived
        self.flushed = np.zeros(symbols, np.int64)
        self.held = 0

    def push(self, symbol: int, pairs: np.ndarray) -> None:
        if len(pairs):
            self.parts[symbol].append(pairs)
            self.size[symbol] += len(pairs)
            self.held += len(pairs)
            if self.held > HELD:
                self.flush()

    def flush(self) -> None:
        for s, parts in enumerate(self.parts):
            if parts:
                self.files[s] = self.files[s] or self.store.path()
                with open(self.files[s], "ab") as out:
                    for x in parts:
                        x.tofile(out)
                self.flushed[s] += sum(map(len, parts))
                self.parts[s] = []
        self.held = 0

    def read(self, symbol: int, begin: int, end: int) -> np.ndarray:
        """Tuples begin..end of a bucket."""
        out: list[np.ndarray] = []
        if begin < self.flushed[symbol]:
            stop = min(end, int(self.flushed[symbol]))
            out.append(np.fromfile(self.files[symbol], np.int64, 2 * (stop - begin), offset=16 * begin).reshape(-1, 2))
            begin = stop
        at = int(self.flushed[symbol])
        for x in self.parts[symbol]:
            if at + len(x) > begin and at < end:
                out.append(x[max(begin - at, 0) : end - at])
            at += len(x)
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _smaller_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (type S); the end is smaller than all."""
    step = np.sign(np.diff(text.astype(np.int32), append=-1)).astype(np.int8)
    at = np.where(step != 0, np.arange(len(text)), len(text))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _runs(text: np.ndarray) -> np.ndarray:
    """How many equal symbols begin at each place."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)


class Prefixes:
    """Common prefixes of pairs of suffixes, up to a limit, by fingerprints of ranges."""

    def __init__(self, text: np.ndarray, store: Store) -> None:
        n = len(text)
        values = np.random.default_rng(11).integers(1, 2**63, int(text.max(initial=0)) + 1, dtype=np.uint64)
        self.powers, self.sums = store.array(n + 1, np.uint64), store.array(n + 1, np.uint64)
        self.powers[:] = np.uint64(0x9E3779B97F4A7C15)
        self.powers[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums[1:] = values[text] * self.powers[:n]
        np.add.accumulate(self.sums, out=self.sums)
        self.n = n

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether so many symbols from a and from b on are the same; a <= b."""
        return (self.sums[a + length] - self.sums[a]) * self.powers[b - a] == self.sums[b + length] - self.sums[b]

    def of(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, most = np.zeros(len(a), np.int64), np.minimum(self.n - b, limit)
        whole = self.equal(a, b, most)  # as a rule for many: copies
        low[whole] = most[whole]
        rest = np.flatnonzero(~whole)
        a, b, most, found = a[rest], b[rest], most[rest], low[rest]
        step = 1 << max(int(limit).bit_length() - 1, 0)
        while step:
            longer = found + step
            ok = longer <= most
            ok[ok] = self.equal(a[ok], b[ok], longer[ok])
            found[ok] = longer[ok]
            step >>= 1
        low[rest] = found
        return low


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[0], (np.diff(keys[order]) != 0).cumsum()]) if len(keys) else np.empty(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = new
    return out, int(new[-1]) + 1 if len(keys) else 0


def sort_starred(text: np.ndarray, small: np.ndarray, starred: np.ndarray, limit: int) -> np.ndarray:
    """The starred suffixes in order; those that agree in ``limit`` symbols may come in any order."""
    if len(starred) < 2:
        return starred
    n = len(text)
    typed = np.concatenate([text.astype(np.int64) * 2 + small + 1, np.zeros(8, np.int64)])
    ends = np.append(starred[1:], n - 1)
    name, kinds = np.zeros(len(starred), np.int64), 1
    open_, offset = np.arange(len(starred)), 0
    while len(open_):  # name the substrings, four symbols at a time
        key = np.zeros(len(open_), np.int64)
        for k in range(4):
            at = starred[open_] + offset + k
            key = (key << 10) | np.where(at <= ends[open_], typed[np.minimum(at, n)], 0)
        sub, _ = _ranks(key)
        fresh = np.zeros(len(starred), np.int64)
        fresh[open_] = sub + 1
        name, kinds = _ranks(name * (len(starred) + 2) + fresh)
        offset += 4
        size = np.bincount(name, minlength=kinds)
        open_ = open_[(size[name[open_]] > 1) & (starred[open_] + offset <= ends[open_])]
    # names of twice as many substrings, where several suffixes still share one; a name is its first place in the order
    size = np.bincount(name, minlength=kinds)
    name = (np.cumsum(size) - size)[name]
    count, width = len(starred), 1
    open_ = np.flatnonzero(np.bincount(name, minlength=count)[name] > 1)
    while len(open_):
        after = np.zeros(len(open_), np.int64)
        inside = open_ + width < count
        after[inside] = name[open_[inside] + width] + 1
        key = name[open_] * (count + 2) + after
        by = np.argsort(key, kind="stable")
        open_, key, old = open_[by], key[by], name[open_[by]]
        at = np.arange(len(open_))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, at, 0))
        name[open_] = old + first - head
        sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
        width *= 2
        end = np.where(open_ + width < count, starred[np.minimum(open_ + width, count - 1)], n + limit)
        open_ = open_[(np.repeat(sizes, sizes) > 1) & (end - starred[open_] < limit)]
    return starred[np.argsort(name, kind="stable")]


class _Carry:
    """Smallest common prefix passed since each bucket last got a tuple."""

    def __init__(self, symbols: int, limit: int) -> None:
        self.limit = limit
        self.least = np.zeros(symbols, np.int64)  # the first of a bucket has no prefix in common with one before it

    def pass_(self, queue: Queue, targets: np.ndarray, symbols: np.ndarray, passed: np.ndarray, where: np.ndarray) -> None:
        """``passed``: common prefixes of the handed out tuples, each with the one before; those at ``where`` put ``targets`` into buckets."""
        whole = int(passed.min(initial=self.limit))
        before = self.least.copy()
        np.minimum(self.least, whole, out=self.least)
        if not len(where):
            return
        by = np.argsort(symbols, kind="stable")
        symbols, where, targets = symbols[by], where[by], targets[by]
        first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        start = np.where(first, 0, np.concatenate([[0], where[:-1] + 1]))
        padded = np.append(passed, self.limit)
        pairs = np.empty(2 * len(where), np.int64)
        pairs[0::2], pairs[1::2] = start, where + 1
        common = np.minimum.reduceat(padded, pairs)[0::2]
        common[first] = np.minimum(common[first], before[symbols[first]])
        common = np.minimum(common + 1, self.limit)
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(where))
        rest = np.minimum.accumulate(padded[::-1])[::-1]  # smallest from here to the end of the block
        for a, b in zip(heads, tails):
            s = int(symbols[a])
            if queue.size[s] == 0:
                common[a] = 0
            queue.push(s, np.column_stack([targets[a:b], common[a:b]]))
            self.least[s] = rest[where[b - 1] + 1]


def suffix_order(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols from 0 on) in order, and each one's common prefix with the one before, up to ``limit``.

    Suffixes that agree in ``limit`` symbols may come in any order. Arrays beyond IN_MEMORY and queues beyond HELD are files.
    """
    n = len(text)
    store = Store()
    try:
        if n == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        symbols = int(text.max()) + 1
        small = _smaller_next(text)
        star = np.zeros(n, bool)
        star[1:] = small[1:] & ~small[:-1]
        runs = _runs(text)
        starred = sort_starred(text, small, np.flatnonzero(star), limit)
        common = np.zeros(len(starred), np.int64)
        if len(starred) > 1:
            common[1:] = Prefixes(text, store).of(starred[:-1], starred[1:], limit)
        first_of = np.searchsorted(text[starred], np.arange(symbols + 1))

        # ascending: predecessors that are larger than their successor
        large, carry = Queue(store, symbols), _Carry(symbols, limit)
        large.push(int(text[n - 1]), np.array([[n - 1, 0]]))
        for c in range(symbols):
            done = 0
            while done < large.size[c]:
                got = large.read(c, done, min(done + BLOCK, int(large.size[c])))
                done += len(got)
                _hand_on(got, text, ~small, large, carry)
            last = int(large.read(c, done - 1, done)[0, 0]) if done else -1
            for a in range(first_of[c], first_of[c + 1], BLOCK):
                b = min(a + BLOCK, first_of[c + 1])
                got = np.column_stack([starred[a:b], common[a:b]])
                if a == first_of[c]:
                    got[0, 1] = min(runs[last], runs[got[0, 0]], limit) if done else 0
                _hand_on(got, text, ~small, large, carry)

        # descending: predecessors that are smaller; a tuple's value is that with the one handed out before it, the next larger
        least, carry = Queue(store, symbols), _Carry(symbols, limit)
        for c in range(symbols - 1, -1, -1):
            done = 0
            while done < least.size[c]:
                got = least.read(c, done, min(done + BLOCK, int(least.size[c])))
                done += len(got)
                _hand_on(got, text, small, least, carry)
            last = int(least.read(c, done - 1, done)[0, 0]) if done else -1
            size = int(large.size[c])
            for b in range(size, 0, -BLOCK):
                a = max(b - BLOCK, 0)
                got = large.read(c, a, min(b + 1, size))[::-1].copy()
                if b == size:  # the largest of these against the smallest of those before
                    values = np.append(min(runs[last], runs[got[0, 0]], limit) if last >= 0 else 0, got[:-1, 1])
                else:
                    values, got = got[:-1, 1], got[1:]
                _hand_on(np.column_stack([got[:, 0], values]), text, small, least, carry)

        order, prefix, at = store.array(n, np.int64), store.array(n, np.int64), 0
        for c in range(symbols):
            for a in range(0, int(large.size[c]), BLOCK):
                got = large.read(c, a, min(a + BLOCK, int(large.size[c])))
                order[at : at + len(got)], prefix[at : at + len(got)] = got[:, 0], got[:, 1]
                at += len(got)
            size = int(least.size[c])
            for b in range(size, 0, -BLOCK):
                a = max(b - BLOCK, 0)
                got = least.read(c, a, min(b + 1, size))[::-1]
                # a value stands with the smaller of two here, so it is shifted by one
                if b < size:
                    begin, got = got[0, 1], got[1:]
                else:
                    begin = min(runs[order[at - 1]], runs[got[0, 0]], limit) if large.size[c] else 0
                m = len(got)
                order[at : at + m], prefix[at] = got[:, 0], begin
                prefix[at + 1 : at + m] = got[:-1, 1]
                at += m
        return np.array(order), np.array(prefix)
    finally:
        store.close()


def _hand_on(got: np.ndarray, text: np.ndarray, wanted: np.ndarray, queue: Queue, carry: _Carry) -> None:
    """Puts the wanted predecessors of the handed out tuples into their buckets."""
    before = got[:, 0] - 1
    where = np.flatnonzero((before >= 0) & wanted[before])
    targets = before[where]
    carry.pass_(queue, targets, text[targets].astype(np.int64), got[:, 1], where)
