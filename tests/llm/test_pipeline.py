import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexaudit.llm import langid, mixing, packing
from lexaudit.llm import queries as Q
from tests.llm.test_dedup import brute_components
from tests.llm.test_langid import text

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de", "ru"])
        t = text(lang, rng.choice([6, 40, 200]), rng)
        rows.append((i, t, lang, rng.choice(["a", "a", "a", "b", None])))
    rows += [(200 + i, rows[i][1].upper() if i % 2 and rows[i][2] == "en" else rows[i][1], rows[i][2], "b") for i in range(20)]
    for i in range(20):
        words = rows[i][1].split()
        rows.append((300 + i, " ".join([*words[:-1], "changed"]), rows[i][2], "a"))
    rows += [(400, None, "en", "a"), (401, "123 456", "en", "a"), (402, "", None, None), (403, "the " * 40000, "en", "b"), (404, "+++ --- 1 2 3 4 5 6 7 8 9 x", "en", "a")]
    return [(*r, len(r[1] or "")) for r in rows]


def brute_copies(rows):
    """doc_id and text once for each copy, by the Poisson distribution at the rates of the sources."""
    size = {}
    for r in rows:
        size[r[3] or ""] = size.get(r[3] or "", 0) + len(r[1] or "")
    total, weights = sum(size.values()), sum(n**mixing.TEMPERATURE for n in size.values() if n)
    out = []
    for r in rows:
        n = size[r[3] or ""]
        rate = total * n**mixing.TEMPERATURE / (weights * n) if n else 0.0
        u = (int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
        k, below = 0, math.exp(-rate)
        while below < u:
            k += 1
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out += [(r[0], r[1])] * k
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()

    # language: nothing without letters, or hardly any
    share = lambda t: sum(c.isalpha() for c in t) / max(1, len("".join(t.split())))
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and share(r[1]) >= P.LEAST_LETTERS]
    assert {r[0] for r in rows} - {r[0] for r in left} == {400, 401, 402, 404}
    # exact copies, A-Z lower-cased: the smallest id stays
    first = {}
    for r in left:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        first[key] = min(first.get(key, r[0]), r[0])
    left = [r for r in left if r[0] in first.values()]
    component = brute_components([(r[0], r[1]) for r in left], 5, 80)
    left = [r for r in left if component[r[0]] == r[0]]
    mixed = brute_copies(left)
    assert {d for d, _ in mixed} < {r[0] for r in left} and len(mixed) > len({d for d, _ in mixed})
    tok = tokenizers.Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in mixed:
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for n in packing.decompose(len(ids), 2048):
            want.append((d, at, n, len(ids), tuple(ids[at : at + n])))
            at += n
    assert sorted((p.doc_id, p.start, p.length, p.doc_tokens, tuple(np.frombuffer(p.ids, "<u4").tolist())) for p in got) == sorted(want)
    assert len({p.sequence_id for p in got}) == len(got)


def test_language_labels_what_it_keeps(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([*((d, t, None if d % 4 == 0 else lang, s, n) for d, t, lang, s, n in rows), (None, "the of and to", None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in P.language(spark, docs, "").collect()}
    assert got[None].lang == "en"
    assert all(got[d].lang == lang and got[d].text == t for d, t, lang, _, _ in rows if d in got and d != 404)
    assert {r[0] for r in rows} - set(got) == {400, 401, 402, 404}
    # English words among Russian ones: English has too few of the letters, Russian enough
    mixed = spark.createDataFrame([*rows, (500, text("ru", 60, random.Random(1)) + " 7" * 300 + " the of and", "en", "a", 9)], SCHEMA)
    assert {r.lang for r in P.language(spark, mixed, "").where("doc_id = 500").collect()} <= {"ru"}


def test_language_keeps_an_unlabelled_corpus(spark):
    rows = [(*r[:2], None, *r[3:]) for r in documents()]
    got = P.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r[0] for r in rows} - {r.doc_id for r in got} == {400, 401, 402, 404} and all(r.lang is None for r in got)


def test_stages_with_odd_rows(spark):
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (1, "", "en", "a", 0), (2, "the of", "en", None, 6), (2, "the of", "en", None, 6), (3, "The OF", None, "a", 6), (None, "the of", "en", "b", 6)]
    docs = spark.createDataFrame(odd, SCHEMA).withColumn("kept", F.lit("clash")).withColumn("copies", F.lit(7)).withColumn("score", F.lit(1))
    ids = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)
    assert ids(P.language(spark, docs, "")) == [("2", "the of"), ("2", "the of"), ("3", "The OF"), ("None", "the of")]
    assert ids(P.exact_copies(spark, docs, ""))[:2] == [("1", ""), ("2", "the of")] and P.exact_copies(spark, docs, "").count() == 2
    assert ids(P.near_copies(spark, docs, "")) == sorted([("None", None), ("None", ""), ("1", ""), ("2", "the of"), ("2", "the of"), ("None", "the of")], key=str)
    assert P.mixture(spark, docs, "").columns == P.COLUMNS
    assert sorted((str(r.doc_id), r.length) for r in P.sequences(spark, docs, "").where("doc_tokens = 1").collect()) == [("1", 1), ("None", 1), ("None", 1)]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_held_out_languages_are_right(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, 30, rng), lang) for i, lang in enumerate(["en", "de", "ru", "el"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, Q.id_fold(3) != 1).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 20 and all(r.lang_pred == r.lang for r in held)
    assert docs.select(Q.id_fold(3).alias("f")).where(F.col("f") > 2).count() == 0
