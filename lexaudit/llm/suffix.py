"""Repeated byte strings across documents: windows dealt by their smallest fingerprint, then suffix order by induced sorting.

Equal strings of LENGTH bytes have the same smallest fingerprint of GRAM bytes, so they meet in one shard, whatever documents
they stand in; a document's stretch of strings with one smallest fingerprint is a segment. Only segments whose fingerprint
comes twice, and that share the bytes on one side of it with another, are fetched, equal segments once, and each shard of
them is sorted with disk-backed queues.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.llm import esais
from lexaudit.llm.common import cut, drop_path, heavy_of, salted_join, written

LENGTH, GRAM = 400, 16
#: Bytes of segments in a shard, about.
SHARD_BYTES = 2_000_000

_TABLE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit number of each ``gram`` bytes (a power of two)."""
    h, width, factor = _TABLE[data], 1, 0xD6E8FEB86659FD93
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        h ^= h >> np.uint64(29)
        factor = (factor * factor + 2) % (1 << 64)
        width *= 2
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass
class Segments:
    """Stretches of a text whose strings share a smallest fingerprint.

    key: the fingerprint; first, last: starts of the strings; times: how often the fingerprint is there; left, right: a
    number of the bytes before and after its first place, with_left, with_right: whether any of the strings holds those.
    """

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    times: np.ndarray
    left: np.ndarray
    right: np.ndarray
    with_left: np.ndarray
    with_right: np.ndarray


def segments(data: np.ndarray, length: int, gram: int) -> Segments:
    """The segments of a text. A string holds its fingerprint and ``length - gram`` bytes more, so half of those on one side at least.

    Hence equal strings, if their fingerprint is in their segments once, stand in segments of equal left or of equal right.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return Segments(np.empty(0, np.uint64), none, none, none, none, none, none.astype(bool), none.astype(bool))
    width = length - gram + 1
    prints = fingerprints(data, gram)
    least = sliding_min(prints, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    keys = least[first]
    # places whose fingerprint is the smallest of some string: the largest of those minima is no more than their own
    edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    places = np.flatnonzero(sliding_min(~np.concatenate([~edge, least, ~edge]), width) == ~prints)
    kinds, of = np.unique(prints[places], return_inverse=True)
    n = len(data) + 1
    sorted_ = np.sort(of * n + places)
    mine = np.searchsorted(kinds, keys) * n
    at = np.searchsorted(sorted_, mine + first)
    times = np.searchsorted(sorted_, mine + last + width) - at
    place = sorted_[at] - mine
    half = -(-(length - gram) // 2)
    with_left, with_right = place - half >= first, place + gram + half <= last + length
    values, step = (prints, gram) if half >= gram else (_TABLE[data], 1)
    offsets = sorted({*range(0, half - step + 1, step), max(half - step, 0)}) if half else []
    sides = []
    for begin, there in ((place - half, with_left), (place + gram, with_right)):
        begin, mixed = np.where(there, begin, 0), np.zeros(len(keys), np.uint64)
        for o in offsets:
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + values[np.minimum(begin + o, len(values) - 1)]
        sides.append((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return Segments(keys, first, last, times, *sides, with_left, with_right)


def repeated_starts(parts: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each part, where a string of ``length`` bytes begins that begins elsewhere too, as pairs of first and last start.

    A part that stands for several copies repeats throughout. ``parts`` are laid out with a separator after each; a common
    prefix counts up to the end of the shorter part.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1 if len(parts) else 0, np.int16)
    for p, end in zip(parts, ends):
        text[end - len(p) : end] = np.frombuffer(p, np.uint8)
        text[end - len(p) : end] += 1
    order, prefix = esais.suffix_order(text, length)
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))  # bytes to the end of the part
    fits = left[order] >= length
    pair = np.flatnonzero((prefix >= length) & fits & np.concatenate([[False], fits[:-1]]))
    again = np.zeros(len(text), bool)
    again[order[pair]] = True
    again[order[pair - 1]] = True
    out = []
    for p, end, n in zip(parts, ends, copies):
        starts = len(p) - length + 1
        flags = np.ones(starts, bool) if n > 1 else again[end - len(p) : end - len(p) + starts]
        out.append(runs_of(flags))
    return out


def runs_of(flags: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1])


def covered(ranges: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes (begin, end) covered by strings of ``length`` bytes that begin in the ranges (first, last)."""
    if not len(ranges):
        return np.empty((0, 2), np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    begin, end = ranges[:, 0], np.maximum.accumulate(ranges[:, 1] + length)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    heads = np.flatnonzero(new)
    return np.column_stack([begin[heads], end[np.append(heads[1:], len(begin)) - 1]])


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_py() or b""


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id_col, kept (the remaining bytes), removed (begin, end of each maximal run, in bytes), n_bytes; a row for each row.

    A byte goes if a string of ``length`` bytes covers it that begins anywhere else too: in this or another document, at
    overlapping places also. Strings are judged on the input and never cross documents.

    1. Each text is cut into segments (fingerprint, its number, text hash, first and last start, segment hash, numbers of the
       bytes on both sides of the fingerprint), without its bytes.
    2. Those whose fingerprint is there once, in all texts, are done. Of the others, equal segments become one class with its
       number. Of a fingerprint with several classes, those that share neither side with another hold no repeat of another
       class; a class of several equal segments repeats throughout.
    3. The bytes of the other classes are fetched from one text each and dealt into shards by fingerprint and shared side (by
       fingerprint alone if it repeats inside a segment); each shard is sorted.
    4. Ranges go back to the texts by segment, are joined up and cut out.

    Null or empty text and texts shorter than ``length`` lose nothing. Rows that repeat, or ids that are null or repeat, are
    rows of their own: their texts are copies of each other. Equal texts are told by 128-bit hash, equal segments of a
    fingerprint by 63 further bits. Copies of a text that hold more than 1/HEAVY_SHARE of all rows are salted by their ids.
    Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    short = texts.where(F.length("text") < length)
    hashed = texts.where(F.length("text") >= length).select("text", F.unhex(F.md5("text")).alias("h"), "doc_id")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "h", "first", "last", "times", "seg", "left", "right"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found, segs = [], []
                for x in part.column(0):
                    text = _bytes(x)
                    found.append(segments(np.frombuffer(text, np.uint8), length, gram))
                    segs += [xxhash.xxh3_64_intdigest(text[i : j + length]) >> 1 for i, j in zip(found[-1].first.tolist(), found[-1].last.tolist())]
                own = pa.array(np.repeat(np.arange(len(found)), [len(f.key) for f in found]))
                every = lambda name, found=found: np.concatenate([getattr(f, name) for f in found])
                columns = [pa.array(every("key").view(np.int64)), part.column(1).take(own), *(pa.array(every(c).astype(np.int32)) for c in ("first", "last", "times")), pa.array(segs, pa.int64())]
                columns += [pa.array(every(c).astype(np.int32), mask=~every("with_" + c)) for c in ("left", "right")]
                yield pa.RecordBatch.from_arrays([part.column(2).take(own), *columns], names=names)

    found, place = written(hashed.mapInArrow(cut_up, f"doc_id {kind}, key long, h binary, first int, last int, times int, seg long, left int, right int"))
    # copies of a text: the first segment of each begins at 0
    copies = found.where("first = 0").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = heavy_of(copies, "h", "n", total)
    heavy = spark.createDataFrame([tuple(r) for r in heavy.collect()], heavy.schema)
    # equal segments are counted before the shuffle; what is left of a fingerprint that came once ends here
    tallied = found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"))
    # a class has to be sorted if its fingerprint has another, or if it is there once but holds its fingerprint twice
    several_kinds = (F.count(F.lit(1)) > 1) | (F.sum("n") == 1)
    again = tallied.groupBy("key").agg(F.sum("times").alias("times"), several_kinds.alias("sort"), F.bool_or(F.col("times") > F.col("n")).alias("loose")).where("times > 1").select("key", "sort", "loose")
    several = cut(found.drop("times").join(again, "key"))
    drop_path(spark, place)
    at = F.min(F.struct("doc_id", "h", "first", "last")).alias("at")
    classes = several.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.bool_or("sort").alias("sort"), F.bool_or("loose").alias("loose"), F.min("left").alias("left"), F.min("right").alias("right"), at)
    share = lambda *by: Window.partitionBy("key", *by)
    counted = classes.select("key", "seg", "n", "sort", "loose", "left", "right", "at.*").withColumn("__left", F.count("left").over(share("left"))).withColumn("__both", F.count("left").over(share("left", "right"))).withColumn("__right", F.count("right").over(share("right")))
    by_left = F.col("__left") > 1
    # those of an equal right that also have an equal left meet by it already
    by_right = (F.col("__right") > 1) & ~(by_left & (F.col("__both") == F.col("__right")))
    deals = F.when(F.col("loose"), F.array(F.xxhash64("key"))).otherwise(F.filter(F.array(F.when(by_left, F.xxhash64(F.lit("left"), "key", "left")), F.when(by_right, F.xxhash64(F.lit("right"), "key", "right"))), lambda x: x.isNotNull()))
    classes = cut(counted.withColumn("deals", F.when(F.col("sort"), deals).otherwise(F.array().cast("array<long>"))).select("key", "seg", "n", "deals", "doc_id", "h", "first", "last"))
    open_ = classes.where(F.size("deals") > 0)
    size = open_.agg(F.coalesce(F.sum(F.size("deals") * (F.col("last") - F.col("first") + length)), F.lit(0))).first()[0]
    shards = int(size // shard_bytes) + 1

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                rows: list[tuple] = []
                for x, wanted, h in zip(part.column(0), part.column(1), part.column(2).to_pylist()):
                    if h != done:  # rows that repeat a text and its id mostly follow each other; one of them is enough
                        text = _bytes(x)
                        rows += [(w["key"], w["seg"], w["n"], text[w["first"] : w["last"] + length], w["deals"]) for w in wanted.as_py()]
                        done = h
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["key", "seg", "n", "data", "deals"])

    wanted = open_.groupBy("h", "doc_id").agg(F.collect_list(F.struct("key", "seg", "n", "first", "last", "deals")).alias("wanted"))
    same = hashed["h"].eqNullSafe(wanted["h"]) & hashed["doc_id"].eqNullSafe(wanted["doc_id"])
    data = hashed.join(wanted, same).select("text", "wanted", hashed["h"]).mapInArrow(fetch, "key long, seg long, n long, data binary, deals array<long>")
    shard = F.explode(F.array_distinct(F.transform("deals", lambda d: F.pmod(F.xxhash64(d), F.lit(shards)).cast("int"))))
    dealt = data.select("key", "seg", "n", "data", shard.alias("shard"))

    def order(table: pa.Table) -> pa.Table:
        names = list(zip(table.column("key").to_pylist(), table.column("seg").to_pylist()))
        table = table.take(pa.array(list({x: i for i, x in enumerate(names)}.values()), pa.int64()))
        runs = repeated_starts([_bytes(x) for x in table.column("data")], table.column("n").to_numpy(), length)
        return pa.table({"key": table.column("key"), "seg": table.column("seg"), "runs": pa.array([[{"a": int(a), "b": int(b)} for a, b in r] for r in runs], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    runs = dealt.groupBy("shard").applyInArrow(order, "key long, seg long, runs array<struct<a:int,b:int>>").where(F.size("runs") > 0)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first")).alias("b")))
    runs = cut(runs.groupBy("key", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs"))).unionByName(classes.where((F.size("deals") == 0) & (F.col("n") > 1)).select("key", "seg", whole.alias("runs")))
    # of each text once, however many copies it has; a class that many texts share is dealt by their hashes
    spots = several.select("key", "seg", "h", "first").distinct()
    segments_, crowd = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], classes.select("key", "seg", "n")
    ranges = salted_join(spots, runs, ["key", "seg"], heavy_of(crowd, ["key", "seg"], "n", segments_), "h")
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    joined = cut(ranges.select("h", moved.alias("runs")).groupBy("h").agg(F.flatten(F.collect_list("runs")).alias("runs")))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                kept, removed, sizes = [], [], []
                for x, r in zip(part.column(1), part.column(2).to_pylist()):
                    text = _bytes(x)
                    gone = covered(np.array([(w["a"], w["b"]) for w in r or ()], np.int64).reshape(-1, 2), length)
                    edges = [0, *gone.reshape(-1).tolist(), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2])))
                    removed.append([{"begin": int(a), "end": int(b)} for a, b in gone])
                    sizes.append(len(text))
                spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(removed, spans), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "removed", "n_bytes"])

    every = salted_join(hashed, joined, "h", heavy, "doc_id", "left").select("doc_id", "text", "runs")
    every = every.unionByName(short.withColumn("runs", F.lit(None).cast("array<struct<a:int,b:int>>")))
    out = every.mapInArrow(cut_out, f"doc_id {kind}, kept binary, removed array<struct<begin:int,end:int>>, n_bytes long")
    return out.withColumnRenamed("doc_id", id_col)
