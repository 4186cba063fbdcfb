import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexaudit.functions import arrays as A
from lexaudit.functions import text as T
from lexaudit.functions import vectorised as V
from lexaudit.operators import construction as C
from lexaudit.operators import evaluate as E
from lexaudit.operators import membership as M
from lexaudit.operators import resampling as R
from lexaudit.operators import methods, reports, scoring, signals
from lexaudit.operators.running import running_totals
from lexaudit.sources import records
from lexaudit.streaming import windows


def brute_auc(rows):
    pos, neg = [s for m, s in rows if m], [s for m, s in rows if not m]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def score_frame(spark, rows):
    return spark.createDataFrame(rows, "member boolean, score double")


@pytest.mark.parametrize("seed", range(4))
def test_auc_properties(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.4, float(rng.choice([rng.gauss(0, 1), rng.randint(0, 3)]))) for _ in range(120)]
    one = lambda r: E.auc(E.tally(score_frame(spark, r))).first().auc
    want = brute_auc(rows)
    assert one(rows) == pytest.approx(want)
    assert one([(m, -s) for m, s in rows]) == pytest.approx(1 - want)
    assert one([(m, math.exp(s)) for m, s in rows]) == pytest.approx(want)


def test_auc_of_odd_inputs(spark):
    one = lambda r: E.auc(E.tally(score_frame(spark, r))).collect()
    assert one([(True, 1.0), (True, 2.0)])[0].auc is None
    assert one([(True, 1.0), (False, 1.0)])[0].auc == 0.5
    assert one([(True, float("nan")), (False, float("inf")), (True, None), (True, 3.0), (False, 2.0)])[0].auc == 1.0
    assert one([(None, 1.0)])[0].auc is None


def test_tpr_at_fpr(spark):
    t = lambda r, at: E.tpr_at_fpr(E.tally(score_frame(spark, r)), at).first().tpr
    assert t([(True, 1.0)] * 5 + [(False, 1.0)] * 5, 0.05) == pytest.approx(0.05)
    assert t([(True, 2.0)] * 5 + [(False, 1.0)] * 5, 0.05) == pytest.approx(1.0)
    rows = [(True, 9.0), (False, 8.0), (True, 7.0), (False, 6.0)]
    assert t(rows, 0.25) == pytest.approx(0.5)


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [("a" if i % 2 else None, float(i), rng.randint(0, 5)) for i in range(300)]
    got = running_totals(spark.createDataFrame(rows, "g string, o double, v int").repartition(5), ["g"], "o", ["v"]).collect()
    for r in got:
        assert r.v_before == sum(v for g, o, v in rows if g == r.g and o < r.o)


def test_arrays(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(x)) for x in (-1, -2, -3, -4, -10)]).alias("lp"), F.array().cast("array<double>").alias("none"))
    mu, var = F.transform("lp", lambda x: F.lit(-3.0)), F.transform("lp", lambda x: F.lit(4.0))
    r = df.select(
        A.mean(F.col("lp")).alias("mean"), A.mean(F.col("none")).alias("no_mean"), A.min_k(F.col("lp"), 0.4).alias("mink"), A.min_k(F.col("none")).alias("no_mink"), A.min_k_plus(F.col("lp"), mu, var, 0.2).alias("pp"),
        A.polarised(F.col("lp"), 0.2, 0.4).alias("pd"), A.polarised(F.col("none")).alias("no_pd"), A.penalised_cosine(F.col("lp"), F.slice("lp", 1, 2)).alias("cos"), A.penalised_cosine(F.col("lp"), F.col("none")).alias("no_cos"),
        A.count_above_mean(F.col("lp")).alias("above"), A.kappa(F.lit(0.5), F.lit(1.0)).alias("kappa"), A.cut_at(F.col("lp"), F.lit(-3.0)).alias("cut"), A.prefix_ratio(F.lit(1.0), F.lit(0.0)).alias("ratio"),
    ).first()
    assert (r["mean"], r.no_mean, r.mink, r.no_mink, r.no_pd, r.no_cos, r.above, r.kappa, r.cut, r.ratio) == (-4.0, None, -7.0, None, 0.0, 0.0, 3, -500.0, [-1.0, -2.0], None)
    assert r.pp == pytest.approx(-3.5) and r.pd == pytest.approx(-1 + 7)
    assert r.cos == pytest.approx(5 / (math.sqrt(130) * math.sqrt(5)) * 2 / 5)


def test_text(spark):
    df = spark.createDataFrame([("\t a\n", " ", None)], "a string, b string, c string")
    r = df.select(T.extract_text(F.col("c"), F.col("b"), F.col("a")).alias("t"), T.safe_name(F.lit("__a b/é__")).alias("s"), T.safe_name(F.lit("///")).alias("u"), T.day_number(F.lit("2020-01-02T12:00:00Z")).alias("d"), T.day_number(F.lit("7.5")).alias("n"), T.day_number(F.lit("x")).alias("x"), T.marked_words(F.lit("été a_b !?")).alias("w")).first()
    assert tuple(r) == ("a", "a_b", "unknown", 737426.5, 7.5, None, ["été", "a_b", "!?"])


def test_vectorised():
    rng = random.Random(2)

    def slow(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        assert V.edit_distance(a, b) == slow(a, b)
        assert V.common_subsequence(a, b) == (len(a) + len(b) - min(len(a) + len(b) - 2 * k for k in [V.common_subsequence(a, b)])) // 2
    assert V.common_subsequence(list("abcde"), list("axcye")) == 3
    assert V.phrases([0, 0, 0, 0]) == 2 and V.phrases([0, 0, 0]) == 2 and V.phrases([]) == 0 and V.approximate_entropy(np.ones(5)) == 0.0
    assert V.swapped("a b c d e", "k") == V.swapped("a b c d e", "k") and sorted(V.swapped("a b c d", "k").split()) == list("abcd")
    assert "<extra_id_0>" in V.masked("w " * 40, "k")


def test_planted_overlap(spark):
    words = [[f"w{i}_{j}" for j in range(30)] for i in range(3)]
    corpus = spark.createDataFrame(list(enumerate(words)), "id long, w array<string>")
    queries = spark.createDataFrame([(7, words[1]), (8, [f"v{j}" for j in range(20)]), (9, words[0][:12]), (10, words[2][:20] + [f"v{j}" for j in range(20)])], "id long, w array<string>")
    got = {r.id: (r.n_grams, r.hits, r.overlap) for r in C.overlap(queries, corpus).collect()}
    assert got == {7: (18, 18, 1.0), 8: (8, 0, 0.0), 10: (28, 8, 8 / 28)}
    assert [(r.id, r.source, r.hits) for r in C.top_sources(queries, corpus).orderBy("id").collect()] == [(7, 1, 18), (10, 2, 8)]


def test_divergence_and_annealing(spark):
    a, b = Counter("aabbc"), Counter("abc")
    assert C.jensen_shannon(a, a) == pytest.approx(0) and C.jensen_shannon(Counter("a"), Counter("b")) == pytest.approx(1)
    counts = spark.createDataFrame([("x", "a", 2), ("x", "b", 2), ("x", "c", 1), ("y", "a", 1), ("y", "b", 1), ("y", "d", 1)], "g string, tok string, n long")
    got = {r.g: r.jsd for r in C.divergence(counts, "g").collect()}
    want = C.jensen_shannon(Counter(a=2, b=2, c=1), Counter(a=1, b=1, d=1))
    assert got["x"] == pytest.approx(want) and got["y"] == pytest.approx(want)
    pool = spark.createDataFrame([(i, ["a"] if i < 10 else ["b"], float(i % 2)) for i in range(20)], "id long, w array<string>, day double")
    target = spark.createDataFrame([(i, ["a"] if i % 2 else ["b"], float(i < 3)) for i in range(6)], "id long, w array<string>, day double")
    got = C.matched_sample(pool, target, restarts=2, steps=400, margin=0).collect()
    for k in range(2):
        mine = [r for r in got if r.restart == k]
        assert len(mine) == 6 and sum(r.id < 10 for r in mine) == 3 and sum(r.id % 2 for r in mine) == 3 and all(r.tokens == 6 and r.loss == 0 for r in mine)
    long = spark.createDataFrame([(i, ["a"] * 50) for i in range(5)], "id long, w array<string>")
    with pytest.raises(Exception, match="off the aim"):
        C.matched_sample(long, target.drop("day"), 3, restarts=1, steps=10, margin=5).collect()
    with pytest.raises(ValueError):
        C.matched_sample(target, pool)


def test_annealing_keeps_the_margin():
    rng = np.random.default_rng(3)
    items = [(np.array([0, 1 + i % 3]), np.array([float(rng.integers(1, 20)), float(rng.integers(1, 20))])) for i in range(60)]
    aim = C.Matching(np.array([100.0, 60.0, 60.0, 60.0]), margin=8)
    chosen = C.anneal(items, aim, 15, 4000)
    assert len(set(chosen)) == 15 and abs(sum(items[i][1].sum() for i in chosen) - 280) <= 8
    assert aim.loss(np.array([1.0, 0, 0, 0]), np.empty(0)) > aim.loss(aim.histogram, np.empty(0)) == 0
    assert C.Matching(np.ones(2), days=np.array([1.0, 3.0])).loss(np.ones(2), np.array([4.0, 4.0])) == pytest.approx(2 + 1)


def test_resampling(spark, monkeypatch):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.p_holm, 6) for r in R.holm(tests, "k", "p").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    pairs = spark.createDataFrame([(1, x) for x in (1.0, -2.0, 3.0, 3.0, 0.0)], "g int, d double")
    r = R.wilcoxon(pairs, ["g"], "d").first()
    assert (r.n, r.w) == (4, 8.0)
    rows = spark.createDataFrame([(i, "l", i % 2 == 0, float(i % 7)) for i in range(60)], "doc_id int, lang string, member boolean, score double")
    a, b = (R.bootstrap_interval(x, ["lang"], "doc_id", 50, "s").first() for x in (rows, rows.repartition(6)))
    assert a == b and 0 <= a.lo <= a.hi <= 1
    monkeypatch.setattr(R, "CELL_ROWS", 10)
    assert tuple(R.bootstrap_interval(rows, ["lang"], "doc_id", 50, "s").first()) == pytest.approx(tuple(a)[:1] + tuple(a)[1:])


def brute_parse(x, bins):
    edges = [min(x) * (1 - k / 99) for k in range(99)] + [0.0]
    fine = [sum(e < v for e in edges) for v in x]
    cuts = np.linspace(min(fine), max(fine), bins + 1)[1:]
    seq, seen, i, n = [sum(c < v for c in cuts) for v in fine], set(), 0, 1
    while i + n <= len(seq):
        if tuple(seq[i : i + n]) in seen:
            n += 1
        else:
            seen.add(tuple(seq[i : i + n]))
            i, n = i + n, 1
    return len(seen) / len(x)


def brute_entropy(x, m, r):
    def phi(k):
        w = [x[i : i + k] for i in range(len(x) - k + 1)]
        return sum(math.log(sum(max(abs(a - b) for a, b in zip(u, v)) <= r * np.std(x) for v in w) / len(w)) for u in w) / len(w)

    return abs(phi(m) - phi(m + 1)) if len(x) > m + 1 and np.std(x) > 0 else 0.0


def brute_occurrences(b, rep):
    while len(b) >= 3:
        found = [s for s in range(len(rep) - len(b) + 1) if rep[s : s + len(b)] == b]
        if len(found) >= 3:
            return found[:3], len(b)
        b = b[1:]
    return None


def test_regularity_and_occurrences():
    rng = np.random.default_rng(6)
    for n in (1, 7, 12, 40):
        for _ in range(8):
            x = -np.round(rng.exponential(2, n), 1) - 0.05
            for bins in (3, 4, 5):
                assert V.parse_complexity(x, bins) == pytest.approx(brute_parse(x.tolist(), bins))
            assert V.approximate_entropy(x, 2, 0.8) == pytest.approx(brute_entropy(x, 2, 0.8), abs=1e-12)
            b = rng.integers(0, 3, n % 9 + 1)
            rep = np.concatenate([b, *[np.concatenate([[9], b[1:]]) for _ in range(int(rng.integers(0, 5)))], rng.integers(0, 3, 5)])
            got = V.occurrences(b, rep)
            assert (None if got is None else (got[0].tolist(), got[1])) == brute_occurrences(b.tolist(), rep.tolist())
    assert V.approximate_entropy(np.zeros(50)) == 0 and math.isnan(V.parse_complexity(np.empty(0), 3))


def test_signals_of_a_record(spark):
    lp = [-1.0, -3.0, -2.0, -0.5]
    stats = spark.createDataFrame([(1, ["a", "b", "a", "c"], lp), (2, ["a"], [-1.0]), (3, [], [])], "id long, ids array<string>, lp array<double>")
    rows = signals.signals(signals.repeat(stats, 3)).collect()
    got = {(r.id, r.signal, r.variation): r.value for r in rows}
    assert {r.id for r in rows} == {1, 2}
    assert got[1, "loss", 0] == -2.0 and got[1, "loss", 1] == -1.625 and got[1, "ppl", 0] == pytest.approx(math.exp(2)) and got[1, "token_diversity", 0] == pytest.approx(2 / 3)
    assert got[1, "calibrated_loss", 1] == pytest.approx(-1.625 / 0.75) and got[1, "count_mean", 1] == 2 and got[1, "count_above", 0] == 0.5 and got[1, "count_above_pre", 0] == pytest.approx(1 / 3)
    second, third = (np.minimum(np.array(lp) + math.log(k), 0) for k in (2, 3))
    assert got[1, "overall_diff_1_loss", 1] == pytest.approx(-1.625 - second.mean()) and got[1, "overall_diff_2_loss", 0] == pytest.approx(-2 - third[:-1].mean())
    assert got[1, "slope", 2] == pytest.approx(np.polyfit(np.arange(12), np.concatenate([lp, second, third]), 1)[0])
    assert math.isnan(got[2, "loss", 0]) and got[2, "loss", 1] == -1.0 and math.isnan(got[2, "count_above_pre", 0]) and (2, "overall_diff_1_loss", 0) not in got
    wide = {r.id: r for r in signals.matrix(signals.signals(stats), [("loss", 1), ("slope", 0)]).collect()}
    assert wide[1].loss_1 == -1.625 and math.isnan(wide[1].slope_0)


def test_p_values_and_their_combination(spark):
    rows = [(i, "s", 0, float(v), i % 2 == 0) for i, v in enumerate([5, 1, 6, 2, 7, 2, float("nan"), 3])] + [(0, "only", 0, 1.0, True), (2, "t", 1, 1.0, True), (1, "t", 1, 1.0, False)]
    df = spark.createDataFrame(rows, "id long, signal string, variation int, value double, member boolean")
    signs = signals.directions(df)
    assert {r.signal: r.sign for r in signs.collect()} == {"s": -1, "t": 1, "only": 1}
    p = signals.p_values(df, df.where("not member"), signs)
    got = {(r.id, r.signal): r.p for r in p.collect()}
    assert got[0, "s"] == 0.0 and got[3, "s"] == pytest.approx((1 + 2 / 2) / 4) and got[6, "s"] == 0.5 and got[2, "t"] == 0.5 and (0, "only") not in got
    ps = {1: [0.1, 0.5, 0.9], 2: [0.0, 0.001], 3: [0.5]}
    c = {r.id: r for r in signals.combine(spark.createDataFrame([(k, v) for k, x in ps.items() for v in x], "id long, p double")).collect()}
    assert c[1].edgington == pytest.approx(-0.5)
    # by numerical integration of the densities
    for k, x in ps.items():
        x, n = np.clip(x, 1e-10, 1 - 1e-10), len(x)
        grid = np.linspace(0, 400, 400001)
        chi = np.exp((n - 1) * np.log(np.maximum(grid, 1e-300)) - grid / 2 - math.lgamma(n) - n * math.log(2)) if n > 1 else np.exp(-grid / 2) / 2
        above = lambda t, chi=chi, grid=grid: float(np.trapezoid(np.where(grid >= t, chi, 0), grid))
        assert c[k].fisher == pytest.approx(-above(-2 * np.log(x).sum()), abs=1e-3)
        assert c[k].pearson == pytest.approx(-(1 - above(-2 * np.log(1 - x).sum())), abs=1e-3)
        nu = 5 * n + 4
        t = (np.log(1 - x).sum() - np.log(x).sum()) * math.sqrt(3 / n) / math.pi * math.sqrt(nu / (nu - 2))
        line = np.linspace(-200, 200, 800001)
        student = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + line**2 / nu) ** (-(nu + 1) / 2)
        assert c[k].george == pytest.approx(-float(np.trapezoid(np.where(line >= t, student, 0), line)), abs=1e-3)


def test_membership(spark):
    ratios = spark.createDataFrame([(p, t, float((p * t) % 5)) for p in range(6) for t in range(6) if p != t], "prefix int, target int, ratio double")
    init = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, m double")
    m = {r.id: r.m for r in M.iterate_membership(ratios, init, 2).collect()}

    def brute(m):
        half = float(np.median(list(m.values())))
        return {p: -(brute_auc([(m[t] > half, float((p * t) % 5)) for t in range(6) if t != p]) or 0.0) for p in range(6)}

    assert m == pytest.approx(brute(brute({i: float(i) for i in range(6)})))


def test_em_membership_scores_every_vector(spark, tmp_path):
    from lexaudit.plans.evaluation import em_membership

    rng = np.random.default_rng(2)
    x = {i: [float(v) for v in rng.normal(size=3)] for i in range(90)}
    spark.createDataFrame(list(x.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: r.m for r in em_membership(spark, str(tmp_path)).collect()}
    x = {i: np.array(v, np.float32).astype(float) for i, v in x.items()}
    pool = sorted(x, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:40]
    m = {i: v[0] for i, v in x.items()}
    for _ in range(10):
        half = float(np.median(list(m.values())))
        m = {p: -(brute_auc([(m[t] > half, sum(a * b for a, b in zip(x[p], x[t]))) for t in pool if t != p]) or 0.0) for p in x}
    assert got == pytest.approx(m)


def test_registry():
    assert [m.name for m in methods.METHODS.resolve(["minkpp", "minkprob", " Perplexity", "zlib"])] == ["minkprob", "loss_zlib_lowercase"]
    with pytest.raises(KeyError):
        methods.METHODS.resolve(["none"])
    assert len(methods.METHODS.methods) == 15 and len(methods.SCORES) == 27 and set(methods.METHODS.aliases.values()) <= set(methods.METHODS.methods)
    assert all(m in methods.METHODS.methods for m, _ in methods.SCORES.values()) and set(methods.SCORE_ALIASES.values()) <= set(methods.SCORES)
    assert methods.score_column("Min-K++") == ("minkprob", "min_k_pp_score") and methods.parameters("cdd", "7B")["alpha"] == 0.075 and methods.parameters("recall", "3b") == {"n": 5}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "id": "1"}\n\n  \n{"text": null}\n')
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n{oops\n')
    (tmp_path / "b.json").write_text(json.dumps([{"text": "y"}, {"text": "z"}]))
    schema = "text string, id string"
    assert [r.text for r in records.read_records(spark, str(tmp_path / "a.jsonl"), schema).collect()] == ["x", None]
    assert records.read_json_lines(spark, str(tmp_path / "bad.jsonl"), schema, strict=False).count() == 1
    with pytest.raises(Exception):
        records.read_json_lines(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    assert records.read_records(spark, str(tmp_path / "b.json"), schema).count() == 2
    assert records.read_tree(spark, str(tmp_path), schema).where("text is not null").count() >= 2
    (tmp_path / "s.json").write_text(json.dumps({"result": {"samples": [{"record_index": 0, "sample_id": "a", "pac_score": 0.5}, {"record_index": 1, "sample_id": "b", "pac_score": None}]}}))
    files = spark.read.option("multiLine", True).json(str(tmp_path / "s.json"))
    assert [(r.sample_id, r.score) for r in records.explode_scores(files, "pac_score").collect()] == [("a", 0.5)]
    old = spark.createDataFrame([("x ",)], "text string")
    records.append_new(spark.createDataFrame([("x",), ("new",)], "text string"), old, str(tmp_path / "out"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["new"]
    newest = records.newest(spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], "k int, t int, v string"), ["k"], "t")
    assert sorted(tuple(r) for r in newest.select("k", "v").collect()) == [(1, "b"), (2, "c")]


def test_record_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "id": "1"}\n\n7\n"s"\n')
    schema = "text string, id string, value string"
    assert [(r.text, r.value) for r in records.read_records(spark, str(tmp_path / "a.jsonl"), schema).collect()] == [("x", None), (None, "7"), (None, "s")]
    assert [(r.line, r.value) for r in records.read_numbered_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()] == [(1, None), (3, "7"), (4, "s")]
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n\n{oops\n')
    with pytest.raises(Exception, match=r"bad\.jsonl:3"):
        records.read_numbered_lines(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    for name, content, want in (("l.json", '[{"text": "y"}, 3]', [("y", None), (None, "3")]), ("o.json", ' {"text": "z"}', [("z", None)]), ("n.json", "12", [(None, "12")]), ("odd", '{"text":\n "w"}', [("w", None)]), ("lines", '{"text": "u"}\n5\n', [("u", None), (None, "5")])):
        (tmp_path / name).write_text(content)
        assert [(r.text, r.value) for r in records.read_records(spark, str(tmp_path / name), schema).collect()] == want, name
    both = records.read_records(spark, [str(tmp_path / "o.json"), str(tmp_path / "a.jsonl")], schema)
    assert both.count() == 4
    table = pa.table({"text": ["p", "q"], "n": [1, 2], "more": [0, 0]})
    with pa.ipc.new_file(str(tmp_path / "f.arrow"), table.schema) as out:
        out.write_table(table)
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), table.schema) as out:
        out.write_table(table)
    for name in ("f.arrow", "s.arrow"):
        assert [tuple(r) for r in records.read_records(spark, str(tmp_path / name), "text string, n long").collect()] == [("p", 1), ("q", 2)]
    (tmp_path / "t.jsonl").write_text('{"text": "  "}\n{"value": " v "}\n{"metadata": {"text": "m"}}\n{"text": "t"}\n')
    texts = records.load_texts(spark, str(tmp_path / "t.jsonl"), "text string, value string, metadata struct<text:string>", 2)
    assert [tuple(r) for r in texts.collect()] == [(2, "v"), (3, "m")]
    (tmp_path / "d").mkdir()
    for k in range(7):
        (tmp_path / "d" / f"dump{k}.txt").write_text("x" * (k + 1))
    files = [records.list_files(spark, str(tmp_path / "d"), ["dump5", "dump2"], 3, s).orderBy("place").collect() for s in range(3)]
    assert sorted(r.place for x in files for r in x) == list(range(7)) and files[0][0].path.endswith("dump5.txt") and files[1][0].path.endswith("dump2.txt")
    every = records.list_files(spark, str(tmp_path / "d"))
    assert records.pending(every, every.where("length > 3")).count() == 3
    assert records.typed_empty(spark, "id long, score double").dtypes == [("id", "bigint"), ("score", "double")]


def test_sinks_and_caches(spark, tmp_path):
    scores = spark.createDataFrame([("l1", "m", "loss", 0, "a", 0.5), ("l1", "m", "loss", 1, "b", float("inf")), ("l1", "m", "side", 0, "a", float("nan"))], "leaf string, model string, method string, record_index int, sample_id string, score double")
    runs = spark.createDataFrame([("l1", "m", "loss", 1.5), ("l1", "m", "side", 1.5), ("l2", "m", "loss", 2.0)], "leaf string, model string, method string, elapsed_seconds double")
    records.write_results(scores, runs, str(tmp_path / "r"))
    back = {(r.leaf, r.method): r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert [s.score for s in back["l1", "loss"].result.samples] == ["0.5", "Infinity"] and back["l1", "loss"].elapsed_seconds == 1.5
    assert [s.sample_id for s in back["l1", "side"].result.samples] == ["a"] and not back["l2", "loss"].result.samples
    records.write_manifest(runs, {"seed": 42, "models": ["m"]}, str(tmp_path / "manifest"))
    m = spark.read.json(str(tmp_path / "manifest")).first()
    assert m.config.seed == 42 and len(m.results) == 3 and m.created_at_utc.endswith("Z")
    (tmp_path / "s.json").write_text(json.dumps({"result": {"samples": [{"record_index": 0, "sample_id": "a", "pac_score": 0.5}, {"record_index": 1, "sample_id": "b", "pac_score": None}, {"record_index": 2, "sample_id": "c", "pac_score": "Infinity"}]}}))
    expected = spark.createDataFrame([("l1", "m", "pac", str(tmp_path / "s.json")), ("l2", "m", "pac", str(tmp_path / "none.json"))], "leaf string, model string, method string, path string")
    schema = "result struct<samples array<struct<record_index int, sample_id string, pac_score string>>>"
    got = sorted(((r.leaf, r.sample_id, r.score) for r in records.read_scores(spark, expected, schema, "pac_score").collect()), key=str)
    assert got == [("l1", "a", 0.5), ("l1", "c", float("inf")), ("l2", None, None)]
    asked = []

    def compute(keys):
        asked.append(sorted(r.k for r in keys.collect()))
        return keys.withColumn("v", F.upper("k"))

    first = records.with_cache(spark, spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int"), ["k"], str(tmp_path / "cache"), compute)
    assert sorted(tuple(r) for r in first.collect()) == [("a", 1, "A"), ("a", 3, "A"), ("b", 2, "B")]
    again = records.with_cache(spark, spark.createDataFrame([("b", 1), ("c", 2)], "k string, n int"), ["k"], str(tmp_path / "cache"), compute)
    assert sorted(tuple(r) for r in again.collect()) == [("b", 1, "B"), ("c", 2, "C")] and asked == [["a", "b"], ["c"]]
    shards = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert records.merge_shards(shards, spark.createDataFrame([(1,), (2,)], "k int"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="3"):
        records.merge_shards(shards, spark.createDataFrame([(1,), (3,)], "k int"), ["k"])
    counts = spark.createDataFrame([("t", 1)], "tok string, c long")
    for c in (counts, counts.withColumn("c", F.lit(9))):
        assert records.export_frequencies(c, str(tmp_path / "freq")).first().c == 1


def test_thresholds(spark):
    def brute(rows):
        kinds = sorted({s for _, s in rows}, reverse=True)
        cuts = [float("inf"), *((a + b) / 2 for a, b in zip(kinds, kinds[1:])), float("-inf")]
        return max(((sum((s >= t) == m for m, s in rows) / len(rows), t) for t in cuts))

    rng = random.Random(5)
    for case in ([(False, 1.0), (False, 2.0)], [(True, 1.0), (True, 2.0)], [(True, 1.0), (False, 2.0)], [(True, 3.0), (False, 1.0), (True, 1.0)], [(rng.random() < 0.5, float(rng.randint(0, 9))) for _ in range(60)]):
        r = E.best_threshold(E.tally(score_frame(spark, case))).first()
        assert (r.accuracy, r.threshold) == pytest.approx(brute(case))
        cut = E.best_cut(E.tally(score_frame(spark, case))).first()
        best = max(sum((s > t) == m for m, s in case) for t in {s for _, s in case})
        assert cut.accuracy == pytest.approx(best / len(case)) and cut.threshold == min(t for t in {s for _, s in case} if sum((s > t) == m for m, s in case) == best)


def test_quantiles_and_rank_tests(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=400), 1)
    values = spark.createDataFrame([(float(v),) for v in x], "value double").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    for q in (0.0, 0.05, 0.5, 0.777, 1.0):
        assert E.quantile(values, q).first().quantile == pytest.approx(np.quantile(x, q))
    # exact p by enumeration of all signs
    d = [1.5, -0.5, 2.5, 3.5, -4.5]
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = sum(r for r, v in zip(ranks, d) if v > 0)
    every = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=5)]
    p = {s: R.wilcoxon(spark.createDataFrame([(v,) for v in d], "d double"), [], "d", s).first() for s in ("two-sided", "greater")}
    assert p["greater"].p == pytest.approx(sum(x >= w for x in every) / 32)
    assert p["two-sided"].p == pytest.approx(min(1, 2 * min(sum(x >= w for x in every), sum(x <= w for x in every)) / 32))
    many = R.wilcoxon(spark.createDataFrame([(float(v),) for v in x + 0.1], "d double"), [], "d").first()
    assert many.p == pytest.approx(math.erfc(abs(many.z) / math.sqrt(2)))
    tests = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.round(rng.random(200) ** 3, 2))], "k int, p double")
    ordered = sorted((r.p, r.k) for r in tests.collect())
    want, top = {}, 0.0
    for i, (v, k) in enumerate(ordered):
        top = max(top, min(1.0, (len(ordered) - i) * v))
        want[k] = top
    assert {r.k: r.p_holm for r in R.holm(tests, "k", "p").collect()} == pytest.approx(want)


def test_many_words_are_joined(spark):
    rows = [(i, [f"w{(i * j) % 17}" for j in range(i % 9)]) for i in range(40)]
    t = spark.createDataFrame(rows, "id long, w array<string>")
    counts = scoring.token_counts(t).where("tok <> 'w3'")
    few, many = scoring.Frequencies(counts), scoring.Frequencies(counts, 2)
    assert few.fits and not many.fits and few.moments() == pytest.approx(many.moments())
    a, b = ({r.id: (r.w, r.lp) for r in f.log_frequencies(t).collect()} for f in (few, many))
    assert a == b


def test_reports(spark):
    cells = spark.createDataFrame([("matched", m, z, s, d, f"{d}{k}", v, True, sup) for m, z, s, d, k, v, sup in [
        ("a", "1b", "pre", "X", 0, 0.5, False), ("a", "1b", "pre", "X", 1, 0.7, False), ("a", "1b", "post", "Y", 0, 1.0, False), ("a", "7b", "pre", "X", 0, 0.4, False), ("b", "1b", "pre", "X", 0, 0.9, False), ("b", "1b", "pre", "X", 1, None, False),
    ]], "setting string, method string, size string, stage string, domain string, subset string, value double, complete boolean, supervised boolean")
    got = {(r.row, r.column): r for r in reports.long_table(cells, "unsupervised").collect()}
    assert got["a", "1b | pre"].value == pytest.approx(0.6) and got["a", "1b | all"].value == pytest.approx(0.8) and got["a", "Model-Avg | pre"].value == pytest.approx(0.5)
    assert got["b", "1b | pre"].best and not got["b", "1b | pre"].complete and got["Method-Avg", "1b | all"].value == pytest.approx(0.85)
    assert "**0.90***" in reports.text_table(reports.long_table(cells, "unsupervised")) and "textbf" in reports.text_table(reports.long_table(cells, "domains"), "latex")
    for name in reports.TABLES:
        reports.long_table(cells, name).count()
    tuned = spark.createDataFrame([("in_domain", m, "1b", "pre", "X", "X0", v, True, True) for m, v in (("base_mink", 0.5), ("fsd_mink", 0.75), ("base_zlib", 0.1))], cells.schema)
    assert [(r.row, r.value) for r in reports.long_table(tuned, "tuned_gain").where("column = '1b'").collect()] == [("in_domain | fsd_mink", 0.25)]


def test_options_and_days(spark):
    df = spark.createDataFrame([("A) one B) two **C)** three\nD)\nfour\nB) last",), ("no (A) xB) C)",), (None,)], "t string")
    got = [r.o for r in df.select(T.options(F.col("t")).alias("o")).collect()]
    assert got[0] == {"A": "one", "B": "last", "C": "three", "D": "four"} and got[1]["A"] == "xB)" and set(got[2].values()) == {""}
    days = [("2021-06-22T02:00:35Z", 737963 + 7235 / 86400), ("2021-06-22T02:00:35+05:00", 737963 + 7235 / 86400), ("2021-06-22", 737963), ("2021/6/2", 737943), ("20210622", 737963), ("Tue, 22 Jun 2021 10:00:00", 737963), ("22 Jun 2021", 737963), ("7.5", 7.5), ("soon", None), (" ", None)]
    got = [r.d for r in spark.createDataFrame([(d,) for d, _ in days], "t string").coalesce(1).select(T.day_number(F.col("t")).alias("d")).collect()]
    assert got == pytest.approx([x for _, x in days])


def test_kind_of_path_is_strict(spark):
    df = spark.createDataFrame([("a/PRETRAINING/x",), ("nothing",)], "p string")
    assert [r.k for r in df.select(T.kind_of_path(F.col("p")).alias("k")).collect()] == ["paragraph", None]
    with pytest.raises(Exception, match="nothing"):
        df.select(T.kind_of_path(F.col("p"), strict=True).alias("k")).collect()


def test_stream_of_windows(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", "a", float(i)) for i in range(12)]
    events = spark.createDataFrame(rows, "user_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"), events.schema), late="1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").select("start", "n", "total").collect())) == sorted(map(tuple, windows.tumbling(events).select("start", "n", "total").collect()))


def test_mink_sweep_sorts_each_text_once(spark, monkeypatch):
    rng, shares = random.Random(5), methods.GRIDS["minkprob"]["k"]
    lps = [[-rng.randint(0, 40) / 8 for _ in range(n)] for n in (1, 2, 7, 30)] + [[-1.0, None, -3.0], [float("nan"), -2.0], [], None]
    rows = [(i, lp, lp and [-1.0] * len(lp), lp and [2.0] * len(lp)) for i, lp in enumerate(lps)]
    table = spark.createDataFrame(rows, "id int, lp array<double>, mu array<double>, sigma array<double>")
    lp, kinds = F.col("lp"), (("mink", A.min_k), ("minkpp", lambda x, k: A.min_k_plus(x, F.col("mu"), F.col("sigma"), k)))
    slow = table.select("id", F.explode(F.array(*[F.struct(F.lit(f"{name}={k:g}").alias("setting"), f(lp, k).alias("score")) for name, f in kinds for k in shares])).alias("c")).select("id", "c.*")
    plain = lambda df: sorted((r.id, r.setting, str(r.score)) for r in df.collect())
    assert plain(methods.swept("minkprob", table)) == plain(slow)
    only = methods.swept("minkprob", table, ["mink"])
    assert plain(only) == [r for r in plain(slow) if r[1].startswith("mink=")]
    assert "array_sort" not in only._jdf.queryExecution().toString()


def test_pac_sweep_sorts_each_text_once(spark):
    rng = random.Random(8)
    lp = lambda n: [-rng.randint(0, 40) / 8 for _ in range(n)]
    rows = [(0, lp(30), [lp(9), lp(40)]), (1, lp(1), [lp(1)]), (2, lp(5), []), (3, [], [lp(3), None, []]), (4, None, [lp(3)]), (5, lp(4), None), (6, [-1.0, None], [lp(2)]), (7, lp(4), [[None, -1.0]]), (8, [float("nan"), -1.0], [lp(2)])]
    table = spark.createDataFrame(rows, "id int, own array<double>, copies array<array<double>>")
    grid = methods.GRIDS["pac"]
    gap = lambda a, b: A.mean(F.transform("copies", lambda c: A.polarised(c, a, b))) - A.polarised(F.col("own"), a, b)
    slow = table.select("id", F.explode(F.array(*[F.struct(F.lit(f"far={a:g},near={b:g}").alias("setting"), gap(a, b).alias("score")) for a in grid["far"] for b in grid["near"]])).alias("c")).select("id", "c.*")
    got = methods.swept("pac", table)
    plain = lambda df: sorted((r.id, r.setting, str(r.score)) for r in df.collect())
    assert plain(got) == plain(slow)
    assert "array_sort" not in got._jdf.queryExecution().toString()


def test_numbered_hashes_are_md5():
    draws = lambda text, n: [int(hashlib.md5(f"{text}{i}".encode()).hexdigest()[:8], 16) for i in range(n)]
    for n in (0, 1, 10, 11, 1002, 12_000):
        hashes = V.NumberedHashes(n)
        for text in ("", "a", "ci:en/true:7:", "ci:en/false:1999:", "ü" * 30, "x" * 50):
            assert hashes(text).tolist() == draws(text, n)


def test_bootstrap_of_a_large_cell_shuffles_no_drawn_row(spark, monkeypatch):
    rows = spark.range(120_001).select(F.col("id").alias("doc_id"), F.lit("l").alias("lang"), (F.col("id") % 5 > 0).alias("member"), (F.col("id") % 97).cast("double").alias("score"))
    monkeypatch.setattr(R, "resampled", lambda *_: pytest.fail("drawn rows are shuffled"))
    r = R.bootstrap_interval(rows, ["lang"], "doc_id", 5, "s").first()
    assert 0.49 < r.lo < r.hi < 0.51


def test_large_cells_shuffle_no_drawn_row(spark, monkeypatch):
    # above the 100,000 rows from which each drawn row was shuffled: 2.4 million for 20 rounds
    rows = spark.range(120_001).select(F.col("id").alias("doc_id"), F.lit("l").alias("lang"), (F.col("id") % 5 > 0).alias("member"), (F.col("id") % 97).cast("double").alias("score_a"), (F.col("id") % 89).cast("double").alias("score_b"))
    monkeypatch.setattr(R, "resampled", lambda *_: pytest.fail("drawn rows are shuffled"))
    r = R.paired_interval(rows, ["lang"], "doc_id", 20, "s").first()
    n, member, aucs = 120_001, np.arange(120_001) % 5 > 0, {"a": [], "b": []}
    at = {"true": np.flatnonzero(member), "false": np.flatnonzero(~member)}
    for b in range(20):
        picked = {side: x[V.NumberedHashes(len(x))(f"s:l/{side}:{b}:") % len(x)] for side, x in at.items()}
        for name, k in (("a", 97), ("b", 89)):
            pos, neg = (np.bincount(picked[side] % k, minlength=k) for side in ("true", "false"))
            aucs[name].append(float((pos * (np.cumsum(neg) - neg / 2)).sum()) / (len(at["true"]) * (n - len(at["true"]))))
    d = np.array(aucs["a"]) - np.array(aucs["b"])
    assert (r.delta, r.lo, r.hi) == pytest.approx((d.mean(), np.quantile(d, 0.025), np.quantile(d, 0.975)), abs=1e-12)
