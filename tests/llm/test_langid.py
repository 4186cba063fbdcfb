import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import langid

VOCAB = {
    "en": "the of and to in that was his with for had you not be her on at by which have".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который".split(),
    "el": "και το να του η της με που την από για τα είναι στο θα τον σε οι".split(),
}


def text(lang, n, rng):
    return " ".join(rng.choices(VOCAB[lang], k=n))


def best_path(scores, penalty):
    paths = itertools.product(range(scores.shape[1]), repeat=len(scores))
    return max(sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in paths)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        k = int(rng.integers(1, 4))
        sizes = rng.integers(0, 6, 5)
        scores = rng.integers(-9, 0, (int(sizes.sum()), k)).astype(np.float32)
        labels = langid.viterbi(scores, sizes, 3.0)
        at = 0
        for n in sizes:
            own, mine = scores[at : at + n], labels[at : at + n]
            if n:
                got = sum(own[i, x] for i, x in enumerate(mine)) - 3.0 * sum(a != b for a, b in zip(mine, mine[1:]))
                assert got == pytest.approx(best_path(own, 3.0))
            at += n


def test_spans_of_mixed_text(spark):
    rng = random.Random(2)
    train = [(i, text(lang, 60, rng), lang) for i, lang in enumerate(list(VOCAB) * 20)]
    a, b, c = text("en", 12, rng), text("ru", 9, rng), text("de", 15, rng)
    odd = [(900, f"12 {a}, {b}! {c}.", None), (901, None, "en"), (902, "", None), (903, "12 + 34 ²", None), (904, "東京", None), (905, "x" * 100000, None), (None, a, None), (907, a + " ...", None), (907, a, None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    rows = langid.identify(docs, F.col("doc_id") < 900).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(train) + len(odd)
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id is not None and r.doc_id < 900)
    mixed = got[900]
    assert [(s.lang, mixed.text[s.start : s.end]) for s in mixed.spans] == [("en", a), ("ru", b), ("de", c)]
    letters = {lang: sum(x.isalpha() for x in t) for lang, t in (("en", a), ("ru", b), ("de", c))}
    assert mixed.lang_pred == max(letters, key=letters.get) and mixed.score == pytest.approx(max(letters.values()) / sum(letters.values()))
    for d in (901, 902, 903):
        assert (got[d].lang_pred, got[d].score, got[d].spans) == ("und", 0.0, [])
    assert got[904].lang_pred in VOCAB and got[905].spans[0].end == 100000 and got[907].spans[0].end == len(a)
    assert got[None].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[3:5] for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.where("false")).count() == 0


class BruteModel:
    """The documented estimates, word by word and character by character."""

    def __init__(self, sample):
        self.langs = sorted({lang for lang, _ in sample})
        self.seen = {lang: {} for lang in self.langs}
        letters = {lang: {} for lang in self.langs}
        for lang, text_ in sample:
            for w in langid.WORDS.findall(text_):
                letters[lang][langid.script(w.lower())] = letters[lang].get(langid.script(w.lower()), 0) + len(w)
                padded = " " * (langid.ORDER - 1) + w.lower() + " "
                for i in range(langid.ORDER - 1, len(padded)):
                    for n in range(langid.ORDER):
                        c = self.seen[lang].setdefault(padded[i - n : i], {})
                        c[padded[i]] = c.get(padded[i], 0) + 1
        self.known = {c + x for s in self.seen.values() for c, after in s.items() for x in after}
        every = {s for x in letters.values() for s in x}
        self.scripts = {s: [x for x in self.langs if letters[x].get(s, 0) >= langid.SCRIPT_SHARE * sum(letters[x].values())] or self.langs for s in every}

    def p(self, lang, ctx, x):
        lower = self.p(lang, ctx[1:], x) if ctx else 1e-6
        after = self.seen[lang].get(ctx)
        if not after:
            return lower
        return (max(after.get(x, 0) - 0.5, 0) + 0.5 * len(after) * lower) / sum(after.values())

    def word(self, lang, w):
        padded, out = " " * (langid.ORDER - 1) + w.lower() + " ", 0.0
        for i in range(langid.ORDER - 1, len(padded)):
            n = next((n for n in range(langid.ORDER, 0, -1) if padded[i - n + 1 : i + 1] in self.known), 0)
            out += math.log(max(self.p(lang, padded[i - n + 1 : i], padded[i]), 1e-9)) - langid.BACK_OFF * (langid.ORDER - n) if n else langid.UNSEEN
        return out + (0 if lang in self.scripts.get(langid.script(w), self.langs) else langid.RULED_OUT)

    def label(self, text_):
        words = langid.WORDS.findall(text_)
        if not words or not self.langs:
            return "und", 0.0
        value, back = [self.word(x, words[0]) for x in self.langs], []
        for w in words[1:]:
            best = max(range(len(value)), key=lambda k: (value[k], -k))
            came = [best if value[k] < value[best] - langid.SWITCH else k for k in range(len(value))]
            value = [max(value[k], value[best] - langid.SWITCH) + self.word(x, w) for k, x in enumerate(self.langs)]
            back.append(came)
        at = max(range(len(value)), key=lambda k: (value[k], -k))
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        share = dict.fromkeys(self.langs, 0)
        for w, k in zip(words, reversed(path)):
            share[self.langs[k]] += len(w)
        best = max(self.langs, key=lambda x: (share[x], [-ord(c) for c in x]))
        return best, share[best] / sum(share.values())


def test_identify_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, text(lang, rng.randint(1, 30), rng), lang) for i, lang in enumerate(list(VOCAB) * 15)]
    odd = ["the der und of auch", "что that και", "the THE Der ÜBER über", "東京 the", "x", "zzz qqq", "of 12 and 3 " + text("ru", 3, rng), "İstanbul", "naïve cœur", text("en", 4, rng) + " " + text("de", 4, rng) + " " + text("el", 2, rng)]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)] + [(2000 + i, text(a, 3, rng) + ". " + text(b, 3, rng), None) for i, (a, b) in enumerate(itertools.permutations(VOCAB, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    brute = BruteModel([(lang, t) for _, t, lang in rows if lang])
    for d, t, _ in rows:
        want = brute.label(t)
        assert got[d][0] == want[0] and got[d][1] == pytest.approx(want[1]), t


def test_few_labels_are_learned(spark):
    rows = [(i, f"word{i % 9}", f"l{i % 7}" if i % 2 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample_of(docs, F.lit(True), "doc_id", "text", "lang", 50, max_langs=3)
    assert {lang for lang, _ in got} == {"en", "l0", "l1"}


def test_sample_is_bounded_and_ignores_held_out(spark):
    rows = [(i, f"word{i}", "en" if i % 5 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    sample = langid.sample_of(docs, fold, "doc_id", "text", "lang", 50)
    assert 80 <= len(sample) <= 200
    assert all(zlib.crc32(t[4:].encode()) % 3 != 1 for _, t in sample)
