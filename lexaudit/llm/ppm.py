"""Prediction by partial matching over bytes: a counted context trie, escapes with symbol exclusion, code lengths of whole texts.

Texts are read as tokens, words (A-Z lower-cased) and one end; as bytes: words joined by blanks, and a line end. A trie of
contexts of up to ORDER bytes holds how often each byte followed. An n-gram of bytes is a 64-bit number, so counting and
looking up are sorts and hash probes of arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import cut, drop_path, written

ORDER = 6
#: Most words whose counts are broadcast; the counts of others come by a join.
MAX_WORDS = 1 << 20
DISCOUNT = 0.5
#: A symbol stands in a context if it was seen there so often, and a context of two bytes or more if it was seen so often;
#: rarer ones leave the estimate to shorter contexts, whose counts are firmer.
MIN_COUNT, MIN_TOTAL = 2, 32
#: Bytes of text in a chunk that is scored, and bytes whose n-grams are in memory at a time.
BATCH_BYTES, PIECE_BYTES = 16_000_000, 1 << 19
#: N-grams sorted at a time, and distinct ones that a counting task holds.
SORTED, HELD = 1 << 20, 1 << 21
#: Bytes of training text for each part of the model, about; there are as many parts as shuffle partitions at least.
PART_BYTES = 1 << 28
#: Contexts are dealt by their last three bytes, so the trie of orders 3 and up is complete in each part.
DEAL_BYTES = 3
LOW_PARTS = 16
WORD_KIND, GRAM_KIND = 0, 1
_MULT = np.uint64(0x9E3779B97F4A7C15)


_BLANK = re.compile(rb"\s")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words, those of about PIECE_BYTES at a time."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        end = blank.start() if blank else len(text)
        yield text[at:end].lower().split()
        at = end


def normal_bytes(text: bytes) -> tuple[bytes, np.ndarray]:
    """The text as it is modelled, and the hashes of its words."""
    data, hashes = [], []
    for words in words_of(text):
        if words:
            data.append(b" ".join(words))
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return b" ".join(data) + b"\n", np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


def packed(data: np.ndarray, n: int) -> np.ndarray:
    """Of each byte, the number made of it and the n - 1 bytes before it (line ends before the first)."""
    out = np.empty(len(data), np.uint64)
    wide = np.concatenate([np.full(n - 1, 10, np.uint8), data]).astype(np.uint64)
    out[:] = wide[: len(data)]
    for k in range(1, n):
        out <<= np.uint64(8)
        out |= wide[k : k + len(data)]
    return out


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def joined_counts(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both counts together, of sorted distinct keys; those of ``old`` are overwritten."""
    if not len(old[0]):
        return new
    at = np.searchsorted(old[0], new[0])
    same = old[0][np.minimum(at, len(old[0]) - 1)] == new[0]
    old[1][at[same]] += new[1][same]
    at, fresh = at[~same], ~same
    return np.insert(old[0], at, new[0][fresh]), np.insert(old[1], at, new[1][fresh])


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, byte by byte of equal weight together, compressed."""
    planes = keys.astype("<u8").view(np.uint8).reshape(-1, 8).T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + planes.tobytes() + small.tobytes() + large.tobytes())


def unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    keys = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").reshape(-1)
    counts = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, 8 + 9 * n)
    return keys.astype(np.uint64), counts


def _mixed(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _MULT) >> np.uint64(40)).astype(np.int64) % parts


def gram_part(grams: np.ndarray, parts: int) -> np.ndarray:
    return _mixed((grams >> np.uint64(8)) & np.uint64((1 << 8 * DEAL_BYTES) - 1), parts)


def count_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """kind, part, n, data: counts of word hashes and of byte n-grams of ``text``, in compressed blocks, several for each part."""

    def emit(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        where = (gram_part(keys, parts) if kind == GRAM_KIND else _mixed(keys, parts)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(np.bincount(where, minlength=parts))
        got = [(p, squeeze(keys[order[a:b]], counts[order[a:b]])) for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(got), pa.int32()), pa.array([p for p, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], names=["kind", "part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: (np.empty(0, np.uint64), np.empty(0, np.int64)) for kind in (WORD_KIND, GRAM_KIND)}
        fresh: dict[int, list[np.ndarray]] = {WORD_KIND: [], GRAM_KIND: []}
        size = {WORD_KIND: 0, GRAM_KIND: 0}

        def take(kind: int, keys: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
            fresh[kind].append(keys)
            size[kind] += len(keys)
            if size[kind] >= SORTED or last:
                keys = np.concatenate(fresh[kind])
                fresh[kind], size[kind] = [], 0
                held[kind] = joined_counts(held[kind], counted(keys))
                if len(held[kind][0]) > HELD or last and len(held[kind][0]):
                    yield emit(kind, *held[kind])
                    held[kind] = (np.empty(0, np.uint64), np.empty(0, np.int64))

        for batch in batches:
            for x in batch.column(0).cast(pa.binary()):
                data, hashes = normal_bytes(x.as_py() or b"")
                for _, grams in grams_of(np.frombuffer(data, np.uint8), np.zeros(1, np.int64)):
                    yield from take(GRAM_KIND, grams)
                yield from take(WORD_KIND, hashes)
        for kind in held:
            yield from take(kind, np.empty(0, np.uint64), last=True)

    return docs.mapInArrow(count, "kind int, part int, data binary")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """One block for each kind and part: kind, part, keys, total, data."""

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = zip(*(unsqueeze(x.as_py()) for x in table.column("data")))
        k, c = counted(np.concatenate(keys), np.concatenate(counts))
        return pa.table({"kind": table.column("kind").slice(0, 1), "part": table.column("part").slice(0, 1), "keys": pa.array([len(k)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64()), "data": pa.array([squeeze(k, c)], pa.binary())})

    return blocks.groupBy("kind", "part").applyInArrow(merge, "kind int, part int, keys long, total long, data binary")


def rounded(counts: np.ndarray) -> np.ndarray:
    """Counts to 16 leading bits, rounded down: few different ones, whatever the input."""
    shift = np.maximum(np.frexp(counts.astype(np.float64))[1] - 16, 0)
    return (counts >> shift) << shift


def least_count(merged: DataFrame, kind: int, most: int) -> int:
    """A count that at most ``most`` keys of a kind have or exceed; the smallest such, to 16 leading bits."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                at, n = np.unique(rounded(unsqueeze(x.as_py())[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["c", "n"])

    rows = merged.where(F.col("kind") == kind).select("data").mapInArrow(tally, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    seen, least = 0, (1 << 63) - 1
    for c, n in sorted(((r.c, r.n) for r in rows), reverse=True):
        seen += n
        if seen > most:
            return least
        least = c
    return 1


@dataclass
class Order:
    """Counts of one order: symbols after contexts (n-grams), and context nodes with totals, kept counts and kept symbols."""

    grams: np.ndarray
    counts: np.ndarray
    nodes: np.ndarray
    totals: np.ndarray
    kept: np.ndarray
    symbols: np.ndarray


@dataclass
class Level:
    """The logs of one order that scoring needs, in 12 bytes for each n-gram and 24 for each node.

    total, escape: of a context met first; below_total, below_escape: of the context one byte shorter, without the symbols kept here.
    """

    grams: np.ndarray
    logs: np.ndarray
    nodes: np.ndarray
    total: np.ndarray
    escape: np.ndarray
    below_total: np.ndarray
    below_escape: np.ndarray


def build_order(grams: np.ndarray, counts: np.ndarray, least: int, n: int) -> Order:
    """``grams``: all of the contexts of n bytes. Symbols seen less often than ``least`` are pruned, their count stays in the total."""
    ctx = grams >> np.uint64(8)
    new = np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(ctx) else np.empty(0, bool)
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    totals = np.bincount(of, weights=counts, minlength=len(first)).astype(np.int64)
    firm = totals >= (MIN_TOTAL if n > 1 else 0)
    keep = (counts >= least) & firm[of]
    kept = np.bincount(of[keep], weights=counts[keep], minlength=len(first)).astype(np.int64)
    symbols = np.bincount(of[keep], minlength=len(first))
    live = symbols > 0
    return Order(grams[keep], counts[keep], ctx[first][live], totals[live], kept[live], symbols[live])


def shorter(grams: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same counts of n-grams one byte shorter, n bytes."""
    return counted(grams & np.uint64((1 << 8 * n) - 1), counts)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _logs(total: np.ndarray, kept: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the totals and of the escapes' shares of them; 0 where nothing is left, as then the escape is certain."""
    some = total > 0
    share = (total - kept + DISCOUNT * symbols) / np.maximum(total, 1)
    return np.where(some, np.log10(np.maximum(total, 1)), 0).astype(np.float32), np.log10(np.where(some, share, 1.0)).astype(np.float32)


def level(own: Order, lower: Order | None, n: int) -> Level:
    """Logs of the order of n-byte contexts, ``lower`` being that of contexts one byte shorter.

    The highest order's logs are less their totals' already: a sure symbol's log is next to 0 and would drown in a difference.
    """
    logs = np.log10(own.counts - DISCOUNT)
    if n == ORDER and len(logs):
        logs -= np.log10(own.totals[find(own.nodes, own.grams >> np.uint64(8))])
    logs = logs.astype(np.float32)
    total, escape = _logs(own.totals, own.kept, own.symbols)
    if lower is None:
        return Level(own.grams, logs, own.nodes, total, escape, np.zeros(len(own.nodes), np.float32), np.zeros(len(own.nodes), np.float32))
    short = find(lower.nodes, own.nodes & np.uint64((1 << 8 * (n - 1)) - 1))
    same = lower.counts[find(lower.grams, own.grams & np.uint64((1 << 8 * n) - 1))]  # what is kept here is kept below
    ctx = own.grams >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, np.int64)
    same = np.add.reduceat(same, first) if len(first) else np.empty(0, np.int64)
    below = _logs(lower.totals[short] - same, lower.kept[short] - same, lower.symbols[short] - own.symbols)
    return Level(own.grams, logs, own.nodes, total, escape, *below)


class Logs:
    """A log for each of some n-grams, in a hash table."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(len(logs), 1) * 2.0))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.logs = np.zeros(1 << bits, np.float32)
        slot, todo = self._slot(grams), np.arange(len(logs))
        while len(todo):  # of those at a free slot one gets it, the others go on
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            self.keys[slot[todo[free]]] = grams[todo[free]]
            done = self.keys[slot[todo]] == grams[todo]
            self.logs[slot[todo[done]]] = logs[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _MULT) >> self.shift).astype(np.int64)

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of n-grams, and which are not in the table."""
        slot = self._slot(grams)
        got = self.keys[slot]
        out = self.logs[slot].astype(np.float64)
        hit = got == grams
        miss = np.zeros(len(grams), bool)
        todo = np.flatnonzero(~hit)
        gone = got[todo] == np.iinfo(np.uint64).max
        miss[todo[gone]] = True
        todo = todo[~gone]
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            hit = got == grams[todo]
            out[todo[hit]] = self.logs[slot[hit]]
            gone = got == np.iinfo(np.uint64).max
            miss[todo[gone]] = True
            on = ~(hit | gone)
            todo, slot = todo[on], slot[on]
        return out, miss


class Trie(Logs):
    """log10 probabilities of bytes after their contexts; levels[n]: contexts of n bytes, the highest order's n-grams hashed."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels
        super().__init__(levels[-1].grams, levels[-1].logs)

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last byte after its context."""
        out, miss = self.look_up(grams)
        if miss.any():
            out[miss] = self.escape_down(grams[miss])
        return out

    def escape_down(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last byte after its context, by way of escapes."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        node = np.full(len(grams), -1)  # of the next longer context, if it is in the trie
        for n in range(len(self.levels) - 1, -1, -1):
            own = self.levels[n]
            g = grams[todo] & np.uint64((1 << 8 * (n + 1)) - 1)
            here, came = find(own.nodes, g >> np.uint64(8)), node[todo]
            total, escape = np.zeros(len(todo)), np.zeros(len(todo))
            first = (came < 0) & (here >= 0)
            total[first], escape[first] = own.total[here[first]], own.escape[here[first]]
            if n + 1 < len(self.levels):
                up, after = self.levels[n + 1], came >= 0
                total[after], escape[after] = up.below_total[came[after]], up.below_escape[came[after]]
            at = find(own.grams, g)
            hit = at >= 0
            out[todo[hit]] += own.logs[at[hit]] - total[hit]
            rest = ~hit
            out[todo[rest]] += escape[rest]
            node[todo] = here
            todo = todo[rest]
        if len(todo):
            out[todo] -= np.log10(max(256 - len(self.levels[0].grams), 1))
        return out


def low_orders(merged: DataFrame, least: int) -> list[Order]:
    """The orders of contexts shorter than DEAL_BYTES. The parts' counts are merged in LOW_PARTS tasks; at most 256 ** DEAL_BYTES counts in all, whatever the input, go to the driver."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                grams, counts = shorter(*unsqueeze(x.as_py()), DEAL_BYTES)
                where = _mixed(grams, LOW_PARTS)
                got = [(p, squeeze(grams[where == p], counts[where == p])) for p in range(LOW_PARTS) if (where == p).any()]
                yield pa.RecordBatch.from_arrays([pa.array([GRAM_KIND] * len(got), pa.int32()), pa.array([p for p, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], names=["kind", "part", "data"])

    short = merged.where(F.col("kind") == GRAM_KIND).select("data").mapInArrow(shorten, "kind int, part int, data binary")
    got = [unsqueeze(r.data) for r in merge_blocks(short).select("data").collect()]
    grams, counts = counted(*(np.concatenate([np.empty(0, kind), *x]) for kind, x in zip((np.uint64, np.int64), zip(*got) if got else ((), ()))))
    orders = [build_order(grams, counts, least, DEAL_BYTES - 1)]
    for n in range(DEAL_BYTES - 2, -1, -1):
        grams, counts = shorter(grams, counts, n + 1)
        orders.insert(0, build_order(grams, counts, least, n))
    return orders


def part_trie(grams: np.ndarray, counts: np.ndarray, least: int, low: list[Order]) -> Trie:
    """The trie of one part: all of its contexts of DEAL_BYTES bytes and more, over the shorter ones of ``low``."""
    orders = []
    for n in range(ORDER, DEAL_BYTES - 1, -1):
        if n < ORDER:
            grams, counts = shorter(grams, counts, n + 1)
        orders.insert(0, build_order(grams, counts, least, n))
    orders = [*low, *orders]
    return Trie([level(o, orders[n - 1] if n else None, n) for n, o in enumerate(orders)])


def _slices(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """256 rows at a time: rows, word hashes of their texts (the last column), the bytes of all normal texts and where each begins."""
    for batch in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            normal = [normal_bytes(x.as_py() or b"") for x in part.column(part.num_columns - 1).cast(pa.binary())]
            begins = np.cumsum([0, *(len(d) for d, _ in normal[:-1])])
            yield part, [h for _, h in normal], np.frombuffer(b"".join(d for d, _ in normal), np.uint8), begins


#: Part of the rows of a chunk, beside those of its n-grams.
ROWS = -1


def ask(rows: DataFrame, parts: int, chunk_bytes: int) -> DataFrame:
    """chunk, part, data: rows of ``rows`` (its last column a text) by chunks of about ``chunk_bytes``, under the part ROWS, and the distinct n-grams of each chunk by the part whose trie knows them."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            begin, before = 0, 0
            while begin < batch.num_rows:
                end = min(int(np.searchsorted(sizes, before + chunk_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                size += int(sizes[end - 1]) - before
                begin, before = end, int(sizes[end - 1])
                if size >= chunk_bytes:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, table in enumerate(chunks(batches)):
            grams, few = np.empty(0, np.uint64), []
            for _, _, data, begins in _slices(table):
                few += [counted(g)[0] for _, g in grams_of(data, begins)]
                if sum(map(len, few)) >= SORTED:
                    grams, few = counted(np.concatenate([grams, *few]))[0], []
            grams = counted(np.concatenate([grams, *few]))[0]
            where = gram_part(grams, parts)
            order = np.argsort(where, kind="stable")
            grams, ends = grams[order], np.searchsorted(where[order], np.arange(parts + 1))
            got = [(p, squeeze(grams[a:b], np.ones(b - a, np.int64))) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            got.append((ROWS, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}:{k}"] * len(got)), pa.array([p for p, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], names=["chunk", "part", "data"])

    return rows.mapInArrow(f, "chunk string, part int, data binary")


def answer(merged: DataFrame, asked: DataFrame, parts: int, least: int) -> DataFrame:
    """chunk, part, data, logs: the n-grams asked for and their log10 probabilities. A task holds the trie of one part at a time."""
    low = merged.sparkSession.sparkContext.broadcast(low_orders(merged, least))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trie = None, None
        for batch in batches:
            for p, chunk, data in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1))), batch.column(2)):
                if chunk is None or p != part:
                    part, trie = p, None
                    trie = part_trie(*(unsqueeze(data.as_py()) if chunk is None else (np.empty(0, np.uint64), np.empty(0, np.int64))), least, low.value)
                if chunk is not None:
                    logs = trie.log_probabilities(unsqueeze(data.as_py())[0]).astype("<f4")
                    logs = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(logs.view(np.uint8).reshape(-1, 4).T).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([p], pa.int32()), pa.array([data.as_py()], pa.binary()), pa.array([logs], pa.binary())], names=["chunk", "part", "data", "logs"])

    model = merged.where(F.col("kind") == GRAM_KIND).select("part", F.lit(None).cast("string").alias("chunk"), "data")
    both = model.unionByName(asked.where(F.col("part") != ROWS))
    # the null chunk, the part's counts, comes first
    return both.repartitionById(parts, "part").sortWithinPartitions("part", F.col("chunk").asc_nulls_first()).mapInArrow(f, "chunk string, part int, data binary, logs binary")


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_grams: int | None = None,
    max_words: int = MAX_WORDS,
    parts: int | None = None,
) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score: code lengths of whole texts under a trie of the training rows.

    ``train`` chooses rows of ``docs``; all of their text is counted, in compressed blocks of sorted n-grams that are
    merged part by part and stay on disk. Texts are scored by chunks: the distinct n-grams of a chunk go to the parts that
    know them and come back with their logs, so no task holds more than one part's trie or one chunk's logs. Only the
    caller's ``max_grams``, if any, prunes the highest order (shorter contexts at the same count); the mass of a pruned
    symbol, or of one seen less than MIN_COUNT times, goes to its context's escape. A byte's probability: the longest
    context in the trie in which the byte was seen, (c - 1/2) / total; before it each longer context's escape, in whose
    shorter context its symbols no longer count; in the end all bytes alike. They add up to 1 after every context.

    base_score: unigram tokens with 0.5 added to every count. Counts of the ``max_words`` most frequent words are
    broadcast; any other word's count comes by an exact join.

    Null or empty text: the end alone, one token. Rows are kept as they are, repeated and null ids too; other columns are
    not read. No training rows: every byte has probability 1/256.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_docs, size = rows.where("train").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = parts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    merged = cut(merge_blocks(count_blocks(rows.where("train").select("text"), parts)))
    stats = {r.kind: r for r in merged.groupBy("kind").agg(F.sum("keys").alias("keys"), F.sum("total").alias("total")).collect()}
    n = (stats[WORD_KIND].total if WORD_KIND in stats else 0) + n_docs
    v = (stats[WORD_KIND]["keys"] if WORD_KIND in stats else 0) + (n_docs > 0)
    least = MIN_COUNT if max_grams is None else max(MIN_COUNT, least_count(merged, GRAM_KIND, max_grams))
    head_least = least_count(merged, WORD_KIND, max_words)
    words = merged.where(F.col("kind") == WORD_KIND).select("data")

    def split(head: bool):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0):
                    k, c = unsqueeze(x.as_py())
                    ok = (c >= head_least) == head
                    yield pa.RecordBatch.from_arrays([pa.array(k[ok].view(np.int64)), pa.array(c[ok], pa.int64())], names=["word", "c"])

        return f

    top = words.mapInArrow(split(True), "word long, c long").toArrow()
    low = np.log10(n + 0.5 * (v + 1)) if n else 0.0
    keys = top.column("word").to_numpy().view(np.uint64) if top.num_rows else np.empty(0, np.uint64)
    by = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[by], np.log10(top.column("c").to_numpy()[by] + 0.5) - low if top.num_rows else np.empty(0)))
    del top, keys, by
    end_log = float(np.log10(n_docs + 0.5) - low)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {kind}, train boolean, n_tokens long, n_head long, head_score double, score double, rare array<struct<word:long,tf:int>>"

    def measure(table: pa.Table) -> pa.Table:
        known, logs = head.value
        kinds, data = table.column("part").to_pylist(), table.column("data")
        grams, own = [], []
        for p, d, x in zip(kinds, data, table.column("logs")):
            if p != ROWS:
                grams.append(unsqueeze(d.as_py())[0])
                own.append(np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8).reshape(4, -1).T).view("<f4").reshape(-1))
        model = Logs(np.concatenate(grams), np.concatenate(own))
        out = []
        for part, normal, text, begins in _slices(pa.ipc.open_stream(data[kinds.index(ROWS)].as_buffer()).read_all()):
            scores = np.zeros(len(begins))
            for at, asked_grams in grams_of(text, begins):
                found, miss = model.look_up(asked_grams)
                if miss.any():
                    raise ValueError("an n-gram came back without its log")
                first = int(np.searchsorted(begins, at, side="right")) - 1  # the text that goes on here, then those that begin here
                starts = np.concatenate([[0], begins[first + 1 : np.searchsorted(begins, at + len(found))] - at])
                scores[first : first + len(starts)] += np.add.reduceat(found, starts)
            tokens, heads, bases, rares = [], [], [], []
            for h in normal:
                place = find(known, h)
                hit = place >= 0
                odd, tf = counted(h[~hit])
                tokens.append(len(h) + 1)
                heads.append(int(hit.sum()) + (n_docs > 0))
                bases.append(float(logs[place[hit]].sum()) + end_log)
                rares.append(list(zip(odd.view(np.int64).tolist(), tf.tolist())))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rares])]), pa.int32()), pa.StructArray.from_arrays([pa.array([w for x in rares for w, _ in x], pa.int64()), pa.array([t for x in rares for _, t in x], pa.int32())], names=["word", "tf"]))
            out.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.int64()), pa.array(heads, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()), rare], names=["doc_id", "train", "n_tokens", "n_head", "head_score", "score", "rare"]))
        return pa.Table.from_batches(out)

    asked, asked_path = written(ask(rows.select("doc_id", "train", "text"), parts, BATCH_BYTES))
    chunks = answer(merged, asked, parts, least).unionByName(asked.where(F.col("part") == ROWS).withColumn("logs", F.lit(b"")))
    scored, _ = written(chunks.groupBy("chunk").applyInArrow(measure, out_schema).withColumn("__row", F.monotonically_increasing_id()))
    drop_path(spark, asked_path)
    tail = scored.select("__row", F.explode("rare").alias("r")).select("__row", "r.word", "r.tf")
    counts = words.mapInArrow(split(False), "word long, c long")
    tail = tail.join(counts, "word", "left").groupBy("__row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(float(low)))).alias("rare_score"),
    )
    joined = scored.drop("rare").join(tail, "__row", "left")
    return joined.select(
        F.col("doc_id").alias(id_col), "train", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
    )


def grams_of(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Place and n-grams of PIECE_BYTES bytes at a time of several texts in one array, each text as if it stood alone: line ends before its first byte."""
    n = ORDER + 1
    for at in range(0, len(data), PIECE_BYTES):
        end = min(at + PIECE_BYTES, len(data))
        low = max(at - ORDER, 0)
        grams = packed(data[low:end], n)[at - low :]
        near = begins[np.searchsorted(begins, low) : np.searchsorted(begins, end)]
        for k in range(n - 1):  # byte k of a text may look back k bytes only
            places = near + k
            places = places[(places >= at) & (places < end)]
            of = begins[np.searchsorted(begins, places, side="right") - 1]
            places = places[of == places - k] - at
            keep = np.uint64((1 << 8 * (k + 1)) - 1)
            grams[places] = (grams[places] & keep) | (np.uint64(0x0A0A0A0A0A0A0A0A) & ~keep & np.uint64((1 << 8 * n) - 1))
        yield at, grams
