import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import esais, suffix
from lexaudit.llm import queries as Q


def brute_order(text, limit):
    text = text.tolist()
    order = sorted(range(len(text)), key=lambda i: text[i:])

    def common(a, b):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k] and k < limit:
            k += 1
        return k

    return order, [0, *(common(a, b) for a, b in zip(order, order[1:]))][: len(text)]


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_suffix_order_equals_brute_force(monkeypatch, block):
    monkeypatch.setattr(esais, "BLOCK", block)
    monkeypatch.setattr(esais, "HELD", block * 4)
    monkeypatch.setattr(esais, "IN_MEMORY", 64)
    rng = np.random.default_rng(2)
    for it in range(250):
        text = rng.integers(0, rng.choice([1, 2, 3, 257]), rng.integers(0, 50)).astype(np.int16)
        text = np.concatenate([text, text[: len(text) // 2], text]) if it % 3 == 0 else text
        limit = int(rng.choice([3, 7, 1000]))
        order, prefix = esais.suffix_order(text, limit)
        want, common = brute_order(text, limit)
        assert prefix.tolist() == common and sorted(order) == sorted(want)
        assert [text[i : i + limit].tolist() for i in order] == [text[i : i + limit].tolist() for i in want]


def brute_remove(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows(length):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdeé\x00 ") for _ in range(k))
    shared = [word(rng.choice([length - 1, length, length + 1, 3 * length])) for _ in range(12)]
    out = [word(rng.randint(0, 4 * length)) + rng.choice(shared) + word(rng.randint(0, length)) + rng.choice(["", rng.choice(shared)]) for _ in range(60)]
    base = word(5 * length)
    out += [base[:k] + "#" + base[k + 1 :] for k in range(0, 5 * length, length // 2)]  # near copies
    out += ["z" * (length - 1), "z" * length, "z" * (length + 7), "xy" * length * 2, None, "", *out[:3], out[0], word(40 * length)]
    return [(None if i == 5 else i % 70, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("length", "gram", "shard"), [(40, 8, 4_000_000), (40, 8, 3000), (24, 16, 1_000)])
def test_removal_equals_brute_force(spark, length, gram, shard):
    docs = spark.createDataFrame(rows(length), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("removed", F.lit("x"))
    got = suffix.remove_repeats(docs, length, gram=gram, shard_bytes=shard).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(x.end - x.begin for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute_remove(rows(length), length)


def test_planted_passages_go_and_clean_texts_stay(spark, tmp_path):
    """op8_suffix itself, at its 400 bytes: passages of 400 bytes and more that several documents hold, and copies."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in (70, 90, 120, 300)]
    assert min(map(len, passages)) >= 400
    clean = [(i, words(rng.choice([40, 200, 900]))) for i in range(60)]
    planted = [(100 + i, " ".join([words(rng.randint(0, 150)), passages[i % 4], words(rng.randint(0, 150))])) for i in range(40)]
    copies = [(200 + i, planted[3][1]) for i in range(30)]
    rows = clean + planted + copies + [(300, None), (None, "x" * 399), (301, "x" * 400 + "y")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.op8_suffix(spark, str(tmp_path)).collect()}
    assert sorted(((d, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()), key=str) == brute_remove(rows, 400)
    assert all(got[d].n_removed == 0 and got[d].text == t for d, t in clean)
    assert all(got[d].n_removed >= len(passages[d % 4]) for d, _ in planted)
    assert all(got[d].n_removed == len(t) == got[d].n_bytes for d, t in copies)


@pytest.mark.parametrize(("length", "gram"), [(40, 8), (24, 16), (17, 16), (16, 16), (9, 4)])
def test_equal_strings_share_a_side(length, gram):
    rng = np.random.default_rng(length)
    seen = {}
    base = rng.integers(97, 101, 4000).astype(np.uint8)
    for k in range(30):
        text = np.concatenate([rng.integers(97, 101, rng.integers(0, 200)), base[k * 100 : k * 100 + 350], rng.integers(97, 101, 60)]).astype(np.uint8)
        found = suffix.segments(text, length, gram)
        assert found.first[0] == 0 and (found.first[1:] == found.last[:-1] + 1).all() and found.last[-1] == len(text) - length
        for i in range(len(found.key)):
            for s in range(found.first[i], found.last[i] + 1):
                sides = {(c, int(getattr(found, c)[i])) for c in ("left", "right") if getattr(found, "with_" + c)[i]}
                seen.setdefault(text[s : s + length].tobytes(), []).append((int(found.key[i]), int(found.times[i]), sides))
    repeated = [v for v in seen.values() if len(v) > 1]
    assert len(repeated) > 1000
    for v in repeated:
        assert len({k for k, _, _ in v}) == 1
        if all(t == 1 for _, t, _ in v):
            assert set.intersection(*(sides for _, _, sides in v))


def test_removal_of_nothing(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
