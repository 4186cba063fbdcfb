"""MinHash near-duplicates: many universal hash minima, banding, verification, components by large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import cut, drop_path, heavy_join, written
from lexaudit.llm.components import connected_components

#: Bands and rows: a pair of similarity 0.85 shares no band with probability 7e-7, one of 0.8 with 6e-5.
BANDS, ROWS = 24, 5
#: Members of a bucket compared at a time, when a star has not joined all of a bucket.
BLOCK = 512
#: A pair is counted in full unless its signature falls this many standard deviations short of the threshold.
SIGMAS = 5.0


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text, A-Z lower-cased; all words as one if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def _universal(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 2**63, (2, size), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest ``a * x + b`` modulo 2**64, for each pair of a and b."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 256):
        part = np.multiply.outer(a, items[k : k + 256])
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[bytes]:
    for x in batch.column(k).cast(pa.binary()):
        yield x.as_py() or b""


def signatures(docs: DataFrame, n: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits, null if there are no words), sig (BANDS * ROWS unsigned 32-bit)."""
    a, b = _universal(BANDS * ROWS, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, hashes, sigs = [], [], []
                for text in _texts(part, 1):
                    items = shingle_set(text, n)
                    sizes.append(len(items))
                    hashes.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    sigs.append(minima(items, a, b).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_hash binary, sig binary")


def shingle_sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, set_hash and the whole set, as sorted 64-bit hashes in a binary."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                items = [shingle_set(x, n).tobytes() for x in _texts(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in items], pa.binary()), pa.array(items, pa.binary())], names=["doc_id", "set_hash", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sets, "doc_id long, set_hash binary, items binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) < 64 else int(np.isin(x, y, assume_unique=True, kind="sort").sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, set_a, set_b) whose full sets are linked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, sig_a, sig_b) those whose signatures do not speak clearly against a link: (a, b)."""
    least = least_equal(percent)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [int((np.frombuffer(x.as_buffer(), "<u4") == np.frombuffer(y.as_buffer(), "<u4")).sum()) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(look, "a long, b long")


def least_equal(percent: int) -> int:
    p, k = percent / 100, BANDS * ROWS
    return int(k * p - SIGMAS * (k * p * (1 - p)) ** 0.5)


def with_partner(labels: np.ndarray, left: np.ndarray, sigs: np.ndarray, percent: int) -> np.ndarray:
    """Which members of two blocks (all left: one block) have a partner of another component whose signature does not speak clearly against a link."""
    least, one, out = least_equal(percent), bool(left.all()), np.zeros(len(labels), bool)
    for i in range(len(labels)) if one else np.flatnonzero(left):
        others = np.arange(i + 1, len(labels)) if one else np.flatnonzero(~left)
        others = others[labels[others] != labels[i]]
        near = others[(sigs[others] == sigs[i]).sum(axis=1) >= least]
        out[near] = True
        out[i] |= len(near) > 0
    return out


def join_block(ids: np.ndarray, labels: np.ndarray, left: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components among the members of two blocks (``left`` tells the block; all left: one block).

    Members already joined are not compared; a link found joins two components at once. So at most one link for each
    member comes out, whatever the number of near copies.
    """
    parent: dict[int, int] = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    least, out, one = least_equal(percent), [], bool(left.all())
    for i in range(len(ids)):
        if one:
            others = np.arange(i + 1, len(ids))
        elif left[i]:
            others = np.flatnonzero(~left)
        else:
            continue
        mine = root(int(labels[i]))
        others = others[labels[others] != labels[i]]
        for j in others[(sigs[others] == sigs[i]).sum(axis=1) >= least]:
            other = root(int(labels[j]))
            if other != mine and linked(sets[i], sets[j], percent):
                parent[max(mine, other)] = min(mine, other)
                mine = min(mine, other)
                out.append((int(ids[i]), int(ids[j])))
    return out


def minhash_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240607) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components of documents.

    A document's set holds its distinct ``shingle_words``-word shingles (words: runs of non-blank characters, A-Z
    lower-cased; fewer words: all as one). Documents are linked if 100 * intersection >= ``percent`` * union.
    ``component_id`` is the smallest id reachable; ``kept`` marks it.

    1. Signatures; equal sets (by 128-bit hash) are one class from here on, named by its smallest id.
    2. Band buckets. In each, all members are paired with one centre drawn by hash, another in each band: at most BANDS pairs
       for each class. Pairs whose signatures come near are verified on full sets; components are computed.
    3. Buckets that still hold several components are compared in blocks of BLOCK members: each block of those outside the
       bucket's largest component with each block of those in it, and with each other. First by signatures; only members
       with a promising partner of another component bring their sets. A block emits links between components only. So no
       link between components is lost, and copies are never expanded.

    Null or empty text, or blanks only: no set, linked with nothing. Null ids: one row each with a null component, kept.
    Rows that repeat an id are one node with the sets of all. Other columns are not read.
    """
    spark = docs.sparkSession
    sigs, _ = written(signatures(docs, shingle_words, seed, id_col, text_col))
    named = sigs.where("doc_id is not null and set_hash is not null")
    classes = cut(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    best = classes.select("set_hash", F.col("rep").alias("doc_id"))
    reps, _ = written(named.select("set_hash", "doc_id", "sig").join(best, ["set_hash", "doc_id"], "left_semi").dropDuplicates(["set_hash", "doc_id"]).select(F.col("doc_id").alias("rep"), "set_hash", "sig"))
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    bands = cut(_crowded(reps.select("rep", F.explode(keys).alias("key"))))

    def with_sets(pairs: DataFrame) -> DataFrame:
        """Verifies the pairs (a, b) on full sets."""
        ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        near = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        near = cut(_promising(near, percent))
        ends = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        sets, path = written(shingle_sets(docs.select(id_col, text_col).join(ends.withColumnRenamed("doc_id", id_col), id_col, "left_semi"), shingle_words, id_col, text_col))
        found = cut(_confirmed(near.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("set_b")), "b"), percent))
        drop_path(spark, path)
        return found

    centres = bands.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("centre"))
    stars = bands.join(centres, "key").where("rep <> centre").select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()
    edges = with_sets(stars)
    same = _same_id(named.select("doc_id", "set_hash"), classes)
    edges = edges if same is None else cut(edges.unionByName(same))
    labels = cut(connected_components(edges))
    more = _blocks(docs, bands, labels, reps, shingle_words, percent, id_col, text_col)
    if more is not None:
        labels = cut(connected_components(edges.unionByName(more)))
    groups = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("__component"), "size")
    light = sigs.select("doc_id", "n_shingles", "set_hash")
    joined = heavy_join(light.where("doc_id is not null and set_hash is not null"), cut(groups), "set_hash", "size", total, "doc_id")
    rest = light.where("doc_id is null or set_hash is null").withColumn("__component", F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", "__component").unionByName(rest.select("doc_id", "n_shingles", "__component"))
    return out.select("doc_id", "n_shingles", F.col("__component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("__component")).alias("kept"))


def _crowded(bands: DataFrame) -> DataFrame:
    """The rows of bands whose key has two members or more."""
    crowd = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return bands.join(crowd, "key", "left_semi")


def _same_id(named: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) from ids that several rows repeat to the classes of those rows; None, as a rule, if there are no such ids."""
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return None
    return named.join(repeated, "doc_id", "left_semi").join(classes, "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _blocks(docs: DataFrame, bands: DataFrame, labels: DataFrame, reps: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """Links between the components that still share a bucket, or None if there are none."""
    named = bands.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    blocks = lambda size: F.ceil(size / F.lit(BLOCK)).cast("int")
    split = sizes.where("kinds > 1").select("key", F.col("top.component").alias("big"), blocks(F.col("top.n")).alias("bigs"), blocks(F.col("n") - F.col("top.n")).alias("rests"))
    left = cut(named.join(split, "key"))
    if left.isEmpty():
        return None
    # block pairs: rest with rest (j from 0 on), rest with the largest component (j from -1 down)
    in_big = F.col("component") == F.col("big")
    mine = F.pmod(F.xxhash64("rep"), F.when(in_big, F.col("bigs")).otherwise(F.col("rests"))).cast("int")
    rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    to_big = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda k: F.struct(F.col("mine").alias("i"), (-1 - k).alias("j")))
    to_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("mine")).alias("j")))
    rows = left.withColumn("in_big", in_big).withColumn("mine", mine).withColumn("at", F.explode(F.when(F.col("in_big"), to_rest).otherwise(F.concat(rest, to_big))))
    rows = rows.select("key", "at.i", "at.j", (~F.col("in_big") & ((F.col("at.j") < 0) | (F.col("mine") == F.col("at.i")))).alias("first"), "rep", "component")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.vstack([np.frombuffer(x.as_buffer(), "<u4") for x in column])

    def look(table: pa.Table) -> pa.Table:
        labels, left = table.column("component").to_numpy(), table.column("first").to_numpy()
        return table.drop_columns(["sig"]).filter(pa.array(with_partner(labels, left, matrix(table.column("sig")), percent)))

    kinds = "key long, i int, j int, first boolean, rep long, component long, set_hash binary"
    near = cut(rows.join(reps, "rep").select("key", "i", "j", "first", "rep", "component", "set_hash", "sig").groupBy("key", "i", "j").applyInArrow(look, kinds))
    if near.isEmpty():
        return None
    who = near.select(F.col("rep").alias(id_col)).distinct()
    sets, path = written(shingle_sets(docs.select(id_col, text_col).join(who, id_col, "left_semi"), n, id_col, text_col).dropDuplicates(["doc_id", "set_hash"]).withColumnRenamed("doc_id", "rep"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids, comps = (table.column(c).to_numpy() for c in ("rep", "component"))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        found = join_block(ids, comps, table.column("first").to_numpy(), matrix(table.column("sig")), full, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    found = cut(near.join(reps, ["rep", "set_hash"]).join(sets, ["rep", "set_hash"]).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())
    drop_path(docs.sparkSession, path)
    return found
