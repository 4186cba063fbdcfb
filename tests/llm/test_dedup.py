import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexaudit.llm import exact, minhash
from lexaudit.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_components(rows, n, percent):
    sets = [(d, brute_sets(t, n)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in parent}


def near_rows(seed=1, groups=6, size=25):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 150, 400]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(words).upper() if rng.random() < 0.2 else "\t".join(words))
    rows += [None, "", "   \n", "one", "One", "one two", rows[0] + " tail", rows[0]]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 85, 512), (5, 80, 7)])
def test_minhash_components_equal_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    found = minhash.minhash_components(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS), n, percent).collect()
    want = brute_components(rows, n, percent)
    texts = dict(rows)
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute_sets(texts[r.doc_id], n)) for r in found)


def test_minhash_blocks_join_what_stars_leave():
    import numpy as np

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(3, 103, dtype=np.uint64), np.arange(6, 106, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    a, b = minhash._universal(minhash.BANDS * minhash.ROWS, 1)
    sigs = np.vstack([minhash.minima(x, a, b) for x in sets])
    ids = np.array([1, 2, 3, 4])
    assert minhash.join_block(ids, ids, np.ones(4, bool), sigs, sets, 90) == [(1, 2), (2, 3)]
    assert minhash.join_block(ids, np.array([1, 1, 3, 4]), np.array([True, True, False, False]), sigs, sets, 90) == [(2, 3)]


@pytest.mark.parametrize("block", [512, 2])
def test_minhash_ids_with_several_texts_keep_all_links(spark, monkeypatch, block):
    """An id that rows with different texts repeat is one node: its component joins those of all of its texts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocab) for _ in range(120)] for _ in range(5)]
    near = lambda g: " ".join([*bases[g][: rng.randint(100, 118)], rng.choice(vocab)])
    rows = [(10 * g + k, near(g)) for g in range(5) for k in range(8)] + [(3, near(2)), (3, near(4)), (44, near(0)), (44, "short"), (700, "short"), (800, "alone text")]
    got = minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    sets = [(d, brute_sets(t, 3)) for d, t in rows]
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a == b or 100 * len(x & y) >= 85 * len(x | y)]
    reach = {d: d for d, _ in rows}
    for _ in range(len(reach)):
        for a, b in edges:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == reach


def test_minhash_members_with_partners():
    import numpy as np

    base = np.arange(0, 300, dtype=np.uint64)
    a, b = minhash._universal(minhash.BANDS * minhash.ROWS, 1)
    sigs = np.vstack([minhash.minima(x, a, b) for x in (base, base + np.uint64(4), base + np.uint64(10000), base + np.uint64(10002))])
    labels = np.array([1, 2, 3, 3])
    assert minhash.with_partner(labels, np.ones(4, bool), sigs, 85).tolist() == [True, True, False, False]
    assert minhash.with_partner(labels, np.array([True, False, False, True]), sigs, 85).tolist() == [True, True, False, False]
    assert minhash.with_partner(np.ones(4), np.ones(4, bool), sigs, 85).tolist() == [False] * 4


def test_minhash_odd_tables(spark):
    assert minhash.minhash_components(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    rows = [(None, long), (None, None), (7, long), (7, "other words that are here"), (5, "other words that are here"), (2, long + " x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("component_id", F.lit("x"))
    found = sorted(minhash.minhash_components(df).select("doc_id", "component_id", "kept").collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(None, None, True), (7, 2, False), (5, 2, False), (2, 2, True), (9, 9, True)}
    assert len(found) == len(rows)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 163)]
    star = [(1, k) for k in range(2, 90)]
    edges = [*path, *star, (5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 164)}, **{k: 1 for k in range(1, 90)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows, keep):
    groups = {}
    for d, t in rows:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(norm, []).append(d)
    out = []
    for norm, ids in groups.items():
        known = [d for d in ids if d is not None]
        best = (max if keep == "max" else min)(known) if known else None
        left = True
        for d in ids:
            kept = d == best and left
            left = left and not kept
            out.append((d, best, len(ids), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


EXACT = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300000), (9, "X" * 300000), (9, "x" * 300000), (9, "X" * 300000), (None, "abc"), (None, "only"), (None, "only"), (2, "aBC")]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("bits", [128, 1])
def test_exact_equals_brute_force(spark, keep, bits):
    """With a hash of one bit nearly all texts collide, and the comparison of bytes has to tell them apart."""
    content_hash = F.md5 if bits == 128 else lambda c: F.pmod(F.length(c), F.lit(2)).cast("string")
    df = spark.createDataFrame(EXACT, "doc_id long, text string").withColumn("kept", F.lit(5)).withColumn("lang", F.lit(None).cast("string"))
    got = exact.exact_dedup(df, keep=keep, content_hash=content_hash)
    assert got.columns == ["doc_id", "text", "lang", "keep_id", "group_size", "kept", "norm_sha256"]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.norm_sha256) for r in got.collect()), key=str) == brute_exact(EXACT, keep)


def test_exact_hot_group_is_salted(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(6000)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.norm_sha256) for r in got.collect()), key=str) == brute_exact(rows, "min")


def test_exact_empty(spark):
    assert exact.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []
