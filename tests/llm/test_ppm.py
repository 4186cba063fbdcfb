import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import ppm


def train_of(c):
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5)) != 1


def texts(n=120, seed=3):
    rng = random.Random(seed)
    part = ["th", "he", "ing", "er", "on", "ça", "é", "A", "st", "x9"]
    words = ["".join(rng.choice(part) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    out = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Unseen-Zzz 東京\x00"), (None, "the thing"), (3, out[3][1]), (n + 4, "on " * 30000)]


class BruteTrie:
    """The documented estimate, one dictionary for each context."""

    def __init__(self, docs, least):
        self.seen = [{} for _ in range(ppm.ORDER + 1)]
        for d in docs:
            data = b"\n" * ppm.ORDER + ppm.normal_bytes(d)[0]
            for i in range(ppm.ORDER, len(data)):
                for n in range(ppm.ORDER + 1):
                    self.seen[n].setdefault(data[i - n : i], Counter())[data[i]] += 1
        self.least = least

    def kept(self, ctx):
        c = self.seen[len(ctx)].get(ctx, {})
        if len(ctx) > 1 and sum(c.values()) < ppm.MIN_TOTAL:
            return {}
        return {s: k for s, k in c.items() if k >= self.least}

    def log(self, ctx, s):
        out, gone = 0.0, set()
        for n in range(len(ctx), -1, -1):
            kept = self.kept(ctx[len(ctx) - n :])
            if not kept:
                continue
            every = self.seen[n][ctx[len(ctx) - n :]]
            total = sum(every.values()) - sum(every[x] for x in gone)
            left = {x: k for x, k in kept.items() if x not in gone}
            if s in left:
                return out + math.log10((left[s] - ppm.DISCOUNT) / total)
            if total > 0:
                out += math.log10((total - sum(left.values()) + ppm.DISCOUNT * len(left)) / total)
            gone |= set(kept)
        return out - math.log10(max(256 - len(gone), 1))

    def score(self, text):
        data = b"\n" * ppm.ORDER + ppm.normal_bytes(text)[0]
        return sum(self.log(data[i - ppm.ORDER : i], data[i]) for i in range(ppm.ORDER, len(data)))


@pytest.mark.parametrize(("max_words", "parts"), [(1 << 20, 5), (20, 16)])
def test_scores_equal_brute_force(spark, max_words, parts):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("clash"))
    got = ppm.score(docs, train_of("doc_id"), max_words=max_words, parts=parts).collect()
    learned = [(t or "").encode() for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    words = Counter(w for t in learned for w in t.lower().split())
    n, v = sum(words.values()) + len(learned), len(words) + 1
    trie = BruteTrie(learned, ppm.MIN_COUNT)
    want = {}
    for d, t in rows:
        mine = (t or "").encode().lower().split()
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(words[w] for w in mine), len(learned)])
        want.setdefault(d, []).append((len(mine) + 1, 1 + sum(w in words for w in mine), n, base, trie.score((t or "").encode())))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][0][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][0][3], rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id][0][4], rel=1e-6)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    data = np.frombuffer(ppm.normal_bytes(b" ".join(t.encode() for _, t in texts() if t))[0], np.uint8)
    grams, counts = ppm.counted(ppm.packed(data, ppm.ORDER + 1))
    orders = []
    for n in range(ppm.ORDER, -1, -1):
        orders.insert(0, ppm.build_order(grams, counts, 3, n))
        grams, counts = ppm.shorter(grams, counts, max(n, 1))
    trie = ppm.Trie([ppm.level(o, orders[n - 1] if n else None, n) for n, o in enumerate(orders)])
    for at in rng.integers(0, len(data), 40):
        ctx = int(ppm.packed(data, ppm.ORDER)[at]) if at % 4 else int(rng.integers(0, 2**48))
        every = np.arange(256, dtype=np.uint64) | np.uint64(ctx << 8)
        logs, miss = trie.look_up(every)
        logs[miss] = trie.escape_down(every[miss])
        assert (10.0**logs).sum() == pytest.approx(1, rel=1e-5)


def test_bounded_trie_and_nothing_to_learn(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    small = ppm.score(docs, train_of("doc_id"), max_grams=50).agg(F.sum("score")).first()[0]
    assert ppm.score(docs, train_of("doc_id")).agg(F.sum("score")).first()[0] > small
    none = ppm.score(docs.where("doc_id < 4"), F.lit(False)).collect()
    for r in none:
        assert r.train_tokens == 0 and r.n_known == 0
    assert ppm.score(docs.where("false"), F.lit(True)).count() == 0


def test_no_counted_gram_is_pruned(spark):
    rng = np.random.default_rng(7)
    noise = [bytes(rng.integers(97, 113, 100_000, dtype=np.uint8)).decode() for _ in range(17)]
    rows = [(i, x) for i, x in enumerate([*noise, *noise, *["zzzzzzy"] * 40, *["zzzzzzw"] * 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = lambda **most: ppm.score(docs, F.lit(True), **most).where("doc_id >= 34").agg(F.sum("score")).first()[0]
    every = total()
    assert every == pytest.approx(total(max_grams=1 << 40), rel=1e-9)
    assert every > total(max_grams=3 << 19) + 1


def test_chunks_and_parts_do_not_change_scores(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    score = lambda **how: sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in ppm.score(docs, train_of("doc_id"), **how).collect())
    want = score()
    monkeypatch.setattr(ppm, "BATCH_BYTES", 700)
    assert score(parts=3) == want
    monkeypatch.setattr(ppm, "PIECE_BYTES", 5)
    monkeypatch.setattr(ppm, "SORTED", 40)
    monkeypatch.setattr(ppm, "HELD", 60)
    assert score(parts=3) == want


def test_pieces_have_the_grams_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(5)
    for size in (1, 3, 6, 7, 50):
        monkeypatch.setattr(ppm, "PIECE_BYTES", size)
        texts_ = [rng.integers(0, 256, rng.integers(1, 30)).astype(np.uint8) for _ in range(40)]
        begins = np.cumsum([0, *map(len, texts_[:-1])])
        got = list(ppm.grams_of(np.concatenate(texts_), begins))
        assert np.concatenate([g for _, g in got]).tolist() == np.concatenate([ppm.packed(t, ppm.ORDER + 1) for t in texts_]).tolist()
        assert [a for a, _ in got] == list(range(0, sum(map(len, texts_)), size))


def test_few_keys_pass_however_large_their_counts(spark):
    keys = np.arange(1000, dtype=np.uint64)
    for counts in (np.full(1000, 70000), 70000 + np.arange(1000), np.arange(1, 1001), np.array([1] * 995 + [1 << 40] * 5)):
        merged = spark.createDataFrame([(ppm.WORD_KIND, bytearray(ppm.squeeze(keys, counts)))], "kind int, data binary")
        for most in (0, 1, 10, 999, 1000):
            least = ppm.least_count(merged, ppm.WORD_KIND, most)
            n = int((counts >= least).sum())
            assert n <= most
            if len(set(counts.tolist())) == 1000 and counts.max() <= 1000:
                assert n == most


def test_squeeze_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 600, len(keys))
    k, c = ppm.unsqueeze(ppm.squeeze(keys, counts))
    assert (k == keys).all() and (c == counts).all()
