import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import chat, mixing, packing, urlfilter
from lexaudit.llm import queries as Q

tokenizers = pytest.importorskip("tokenizers")


def test_packing_round_trip(spark):
    words = "Thé quick\u00a0brown 'fox's 東京 ﬁ <|endoftext|> a1b2 ... \u0301x \x1c y\r\nz".split(" ")
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 700, 4000])))) for i in range(40)] + [(None, None), (7, ""), (7, "\n\t "), (99, "lo ng  gap\n\n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("length", F.lit("x"))
    path = Q.tokenizer_path(packing.TOKENIZER)
    pieces = packing.pack(docs, path).collect()
    tok = tokenizers.Tokenizer.from_file(path)
    want = sorted(((d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows), key=str)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for p in pieces:
        assert p.length == len(p.ids) // 4 <= 2048 and p.length & (p.length - 1) == 0 and p.offset == 0
    # of one id's texts, pieces of equal start come in the order of the texts' pieces of length
    back = {}
    for p in pieces:
        back.setdefault((p.doc_id, p.doc_tokens), {}).setdefault(p.start, []).append(np.frombuffer(p.ids, "<u4").tolist())
    assert {k: len(v[0]) for k, v in back.items()} == Counter((d, len(x)) for d, x in want)
    docs_back = [(d, [t for s in sorted(v) for t in v[s][k]]) for (d, _), v in back.items() for k in range(len(v[0]))]
    assert sorted(docs_back, key=str) == want
    assert packing.pack(docs.where("false"), path).count() == 0


def test_packing_cache_starts_anew(spark, monkeypatch):
    encoder = packing.WordEncoder(Q.tokenizer_path(packing.TOKENIZER), 1)
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    for text in ("a b c d e", "f g h", "a b", "a b z.", ""):
        ids, n = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] and n.tolist() == [len(ids)]


def test_words_split_as_the_tokenizer_splits():
    encoder = packing.WordEncoder(Q.tokenizer_path(packing.TOKENIZER), 1)
    assert encoder.splits
    rng = random.Random(8)
    letters = [*"abcXYZ09''.,*<|>-_\\\"", "'s", "'ll", "é", "É", "ß", "ª", "²", "½", "\xad", "\xa0", "\x85", "\u0130", "ŉ", "Σ", "\u0301", "東", "<|endoftext|>", " ", "\n", "\x1f"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        assert encoder.encode(pa.array([text]))[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a b": 5, "a": 6, "?": 0}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    tokenizer.save(str(tmp_path / "t.json"))
    encoder = packing.WordEncoder(str(tmp_path / "t.json"), 1)
    assert not encoder.splits
    ids, counts = encoder.encode(pa.array(["a b|a", "", "a b"]))
    assert ids.tolist() == [5, 6, 1, 1, 5, 1] and counts.tolist() == [3, 1, 2]


def test_op1_rows(spark, tmp_path):
    rows = [(i, "Say it again. " * n) for i, n in enumerate([0, 1, 3, 700, 1500])] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op1_pack(spark, str(tmp_path)).collect()
    tok = tokenizers.Tokenizer.from_file(Q.tokenizer_path(packing.TOKENIZER))
    want = []
    for d, t in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for n in packing.decompose(len(ids), 2048):
            want.append((d, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), 0))
            at += n
    assert sorted((tuple(r)[:5] + (r.offset,) for r in got), key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in got}) == len(got)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 300)) for i in range(200)] + [(None, None)], "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(3)
    pieces = packing.pack(docs, Q.tokenizer_path(packing.TOKENIZER))
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(r.length for r in back.select("length").collect()) == sorted(r.length for r in pieces.select("length").collect())
    assert back.where(F.length("ids") != 4 * F.col("length")).count() == 0
    order = pieces.select("length", F.spark_partition_id().alias("p")).collect()
    assert all(a.length <= b.length for a, b in zip(order, order[1:]) if a.p == b.p)
    packing.write_buckets(pieces.where("false"), str(tmp_path / "none"))


def test_decompose():
    for n in range(1, 9000, 7):
        got = packing.decompose(n, 2048)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)


NASTY = ["<|reserved_special_token_0|><|fim-middle|>", "</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<|turn|>user<|body|>", "<\\/s>", "a\\</s>", "<<SYS>> [[INST]", "", None, "\n\n", "é<|im_start|>😀<|im_end|>", "<|", "<s", "$1 \\1", "<start_of_turn>[TOOL_CALLS]", "<</SYS>>\\n"]


def test_chat_is_reversible(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>", "we\\ird\n", None]), rng.choice(NASTY) if rng.random() < 0.7 else "".join(map(str, rng.choices(NASTY, k=3)))) for c in range(60) for t in range(rng.randint(1, 8))]
    rows += [(1000, t, "assistant", "x" * 20) for t in range(3000)] + [(2000, 0, "user", "long " * 100000)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumn("msg_id", F.col("seq")).withColumn("kind", F.lit(None).cast("string")).withColumn("turns", F.lit(0))
    out = chat.render(chat.fold_events(log))
    got = {r.conv_id: r for r in chat.read_back(out).join(out.select("conv_id", "loss_spans"), "conv_id").collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.loss_text == "".join(t for role, t in want[c] if role == "assistant")
        bare = re.sub(r"<\|(?:turn|body|end)\|>", "", r.formatted)
        assert not re.search(chat.CONTROLS, bare) or not re.search(chat.CONTROLS, re.sub(r"<\|(?:turn|body|end)\|>", "\n", r.formatted))
        assert r.formatted.count(chat.END) == len(want[c])


def test_chat_folds_events(spark):
    events = [
        (1, 1, "a", "message", "user", "hi"), (1, 2, "b", "delta", "assistant", "He"), (1, 3, "b", "delta", None, "llo"), (1, 4, "b", "regenerate", None, None),
        (1, 5, "b", "delta", None, "Bye"), (1, 6, "a", "edit", None, "hey"), (1, 7, "c", "message", "user", "gone"), (1, 8, "c", "delete", None, None),
        (2, 1, None, None, None, None), (2, 2, None, "message", "user", "x"), (None, 1, "z", "message", "user", "n"),
        (3, 1, "d", "delete", None, None), (3, 2, "d", "delta", None, "still gone"), (3, 3, "d", "edit", "user", "back"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, msg_id string, kind string, role string, text string")
    got = {}
    for r in chat.fold_events(df).orderBy("conv_id", "pos").collect():
        got.setdefault(r.conv_id, []).append((r.pos, r.role, r.text))
    assert got == {1: [(1, "user", "hey"), (2, "assistant", "Bye")], 2: [(1, None, ""), (2, "user", "x")], None: [(1, "user", "n")], 3: [(1, "user", "back")]}
    assert chat.read_back(chat.render(chat.fold_events(df.where("false")))).count() == 0
    same = spark.createDataFrame([(None, None, "m", "user", "b"), (None, None, "m", "user", "a"), (None, 1, "m", None, None)], "conv_id long, pos long, msg_id string, role string, text string")
    (one,) = chat.read_back(chat.render(same)).collect()
    assert one.conv_id is None and [tuple(t) for t in one.turns] == [("user", "a"), ("user", "b"), ("", "")]


def test_chat_keeps_every_row_of_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, None, "assistant", "z"), (1, None, "user", "y"), (1, None, "user", "y")]
    rows += [(2, t, "assistant", str(t)) for t in range(12)] + [(2, 3, None, "tie"), (3, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in Q.op3_chat(spark, str(tmp_path)).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.TURN + role + chat.BODY + t + chat.END) for role, t in turns)


def test_mixing_follows_the_weights(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(1, 30), rng.choice(["a"] * 8 + ["b", None])) for i in range(9000)] + [(None, None, "c"), (5, "yy", "a"), (5, "yy", "a"), (9001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9))
    out = mixing.mix(docs, {"a": 1.0, "b": 1.0, "": 2.0}, epochs=2.0).collect()
    size = {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + len(r.text or "")
    total = sum(len(t or "") for _, t, _ in rows)
    assert size.keys() == {"a", "b", None}
    for s, w in (("a", 0.25), ("b", 0.25), (None, 0.5)):
        assert size[s] == pytest.approx(2 * total * w, rel=0.06)
    assert sorted((r.doc_id, r.copy) for r in out if r.doc_id == 5) == sorted(2 * [(5, k) for k in range(next((r.copies for r in out if r.doc_id == 5), 0))] + [(r.doc_id, r.copy) for r in out if r.doc_id == 5 and r.text != "yy"])
    again = mixing.mix(docs.repartition(7), {"a": 1.0, "b": 1.0, "": 2.0}, epochs=2.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("source = 'empty'")).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 900.0])
def test_poisson_distribution(spark, rate):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first().c
    p = np.diff([0, *cdf])
    assert cdf[-1] == pytest.approx(1) and (p * np.arange(len(p))).sum() == pytest.approx(rate, abs=1e-6)


def brute_judge(url, patterns, hosts):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    host = low(host)
    fits = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    verdict = "allow"
    for p in patterns:
        if re.search(p.pattern, low(url)):
            verdict = p.verdict
    return host, path, None, verdict


URLS = [
    "http://a.example.com/en/71?x", "https://EXAMPLE.com/en/5", "http://example.com/en/7", "http://notexample.org/es/1", "http://x.example.net/de/8", "http://net/de/9#t", "ftp://h?q", "no scheme", "", None, "://", "a://b://c/d",
    "https://blog.q.io/x?utm_source=feed", "https://m.q.io/x?utm_source=feed", "http://q.io/5?page=2&ref=x", "http://porn.q.io/", "http://q.io/casino/", "http://ad.q.io/", "http://q.io/12.html#top", "http://com/en/", "http://ÉX.com/EN/", "http://q.io/5?page=2&ref=x",
]


def test_hot_urls_are_judged_once(spark):
    hot = "http://q.io/casino/"
    rows = [(i, [hot, None, "http://q.io/plain", "http://com/en/5"][i % 4]) for i in range(4000)] + [(9000 + i, f"http://q.io/{i}/casino/") for i in range(50)]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), Q.HOST_RULES).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *brute_judge(u, urlfilter.PATTERNS, Q.HOST_RULES)) for i, u in rows)


def test_urls_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3])] + [(100, "http://h.io/" + "casino " * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urlfilter.judge_urls(pages, Q.HOST_RULES).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((i, *brute_judge(u, urlfilter.PATTERNS, Q.HOST_RULES)) for i, u in rows), key=str)
    assert urlfilter.judge_urls(pages.where("false"), Q.HOST_RULES).count() == 0
    assert urlfilter.judge_urls(pages, (), ()).where("verdict <> 'allow'").count() == 0


@pytest.mark.parametrize("url", ["http://q.io/x?utm_source=feedburner", "https://blog.q.io/x?utm_source=feed9", "http://q.io/?a&utm_source=feeds_x", "http://q.io/a0page?page=2&ref=x9", "http://q.io/xcasino/casino.x", "http://q.io/?sessionid=a1", "http://q.io/9.html#html5"])
def test_url_tokens_are_in_every_match(spark, url):
    hit = [p for p in urlfilter.PATTERNS if re.search(p.pattern, url)]
    assert hit and all(set(p.tokens) <= set(re.findall(urlfilter.TOKEN, url)) for p in hit)
    # other URLs make utm and source frequent, so a rule would stand under its rarest token
    pages = spark.createDataFrame([(0, url)] + [(k, f"http://q.io/utm/source/page/ref?{k}") for k in range(1, 4)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, Q.HOST_RULES).collect()}
    assert got[0] == brute_judge(url, urlfilter.PATTERNS, Q.HOST_RULES)[3]
