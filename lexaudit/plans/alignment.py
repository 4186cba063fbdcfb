"""Queries that bring scores, prompts and jobs together: keys, verification, unions, templates, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import prompts as P
from lexaudit.functions import text as T
from lexaudit.operators import alignment as A
from lexaudit.operators import jobs as J
from lexaudit.operators import methods as M
from lexaudit.sources.tables import read_table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def md5_share(*parts: Column) -> Column:
    """A number from 0 on, below 1, in thousandths, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 6), 16, 10).cast("long") % 1000 / F.lit(1000.0)


SHARE = "(('0x' || substr(md5({}), 1, 6))::BIGINT % 1000) / 1000.0"


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS leaf, l_linenumber % 2 AS size, l_orderkey AS key FROM lineitem), p AS (SELECT leaf, count(DISTINCT size) AS parts FROM s GROUP BY leaf), k AS (SELECT leaf, key, count(*) AS held FROM s GROUP BY leaf, key)
SELECT s.* FROM s JOIN p USING (leaf) JOIN k USING (leaf, key) WHERE held = parts""")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that every size of a leaf has scored."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("leaf"), (F.col("l_linenumber") % 2).alias("size"), F.col("l_orderkey").alias("key")).distinct()
    return A.common_keys(rows, ["leaf"], "key", "size").select("leaf", "size", "key")


@query("""WITH i AS (SELECT source, doc_id, substr(sha1(trim(text, chr(10) || ' ' || chr(9) || chr(13))), 1, 20) AS tk, 'd' || doc_id AS sample_id FROM documents), c AS (SELECT source, tk, sample_id, doc_id * 1.0 AS score, substr(source, length(source)) IN ('1', '3', '5', '7', '9') AS texts FROM i WHERE doc_id % 3 > 0),
k AS (SELECT source, texts, CASE WHEN texts THEN tk ELSE sample_id END AS key, max(score) AS score FROM c GROUP BY ALL), s AS (SELECT DISTINCT source, texts FROM c)
SELECT i.doc_id, k.score::DOUBLE AS score FROM i LEFT JOIN s USING (source) LEFT JOIN k ON k.source = i.source AND k.key = CASE WHEN s.texts THEN i.tk ELSE i.sample_id END""")
def text_or_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores found by text in sources whose score files carry texts, by sample id in the others."""
    i = read_table(spark, sf_dir, "documents").select("source", "doc_id", T.text_key(F.col("text")).alias("text_key"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"))
    texts = F.substring("source", -1, 1).isin("1", "3", "5", "7", "9")
    c = i.where("doc_id % 3 > 0").select("source", F.when(texts, F.col("text_key")).alias("text_key"), "sample_id", F.col("doc_id").cast("double").alias("score"))
    return A.by_text_or_id(i, c, ["source"]).select("doc_id", "score")


@query("""WITH f AS (SELECT event_type AS leaf, 'm' || (user_id % 2) AS model, CASE event_id % 4 WHEN 0 THEN 'raw' || (event_id % 50) WHEN 1 THEN 'fmt' || (event_id % 50) ELSE 'none' END AS tk, CASE event_id % 4 WHEN 2 THEN 'id' || (event_id % 50) ELSE 'x' END AS sid, ts, event_id, value FROM events),
m AS (SELECT *, CASE WHEN tk LIKE 'raw%' THEN substr(tk, 4)::INT WHEN tk LIKE 'fmt%' THEN substr(tk, 4)::INT WHEN sid LIKE 'id%' THEN substr(sid, 3)::INT END AS i FROM f)
SELECT leaf, model, 'raw' || i AS instance, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY leaf, model, i ORDER BY ts DESC, event_id DESC) AS n FROM m WHERE i < 30) WHERE n = 1""")
def instance_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest result of each current instance, told by its text, its formatted text or its id; results of instances that are gone drop out."""
    e, k, n = read_table(spark, sf_dir, "events"), F.col("event_id") % 4, (F.col("event_id") % 50).cast("string")
    named = lambda name: F.concat(F.lit(name), n)
    results = e.select(F.col("event_type").alias("leaf"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"), F.lit("loss").alias("method"), F.when(k == 0, named("raw")).when(k == 1, named("fmt")).otherwise("none").alias("text_key"), F.when(k == 2, named("id")).otherwise("x").alias("sample_id"), F.col("ts").alias("mtime"), "event_id", "value")
    numbers = spark.range(30).select(F.col("id").cast("string").alias("i"))
    current = e.select(F.col("event_type").alias("leaf")).distinct().crossJoin(numbers).select("leaf", *[F.concat(F.lit(p), "i").alias(c) for p, c in (("raw", "instance"), ("fmt", "formatted_key"), ("id", "sample_id"))])
    return A.current_instances(results, current).select("leaf", "model", "instance", "event_id", F.round("value", 4).alias("value"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN round(exp(-1.0) + exp(-2.0), 6) WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.5 END::DOUBLE AS p_yes FROM supplier""")
def judged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's probabilities of yes, from log-probabilities or from the answer's text; some records were not judged."""
    s, k = read_table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 5
    pair = lambda t, x: F.struct(F.lit(t).alias("token"), F.lit(x).alias("logprob"))
    none = F.array().cast("array<struct<token:string,logprob:double>>")
    top = F.when(k == 0, F.array(pair(" Yes", -1.0), pair("no", -0.5), pair("yes", -2.0))).otherwise(none)
    judged = s.where("s_suppkey % 5 < 4").select("s_suppkey", top.alias("top"), F.when(k == 1, " Yes, it is").when(k == 2, "No.").otherwise("maybe").alias("answer"))
    return A.with_judgement(s.select("s_suppkey"), judged, "s_suppkey").select("s_suppkey", F.round("p_yes", 6).alias("p_yes"))


@query("SELECT c_custkey AS id, 'o' || c_custkey AS b FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 3 > 0 AND c_custkey % 2 = 0")
def option_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a text and four options that are not empty."""
    c, k = read_table(spark, sf_dir, "customer"), F.col("c_custkey")
    records = c.where(k % 4 < 3).select(k.alias("id"), F.when(k % 3 > 0, F.col("c_name")).otherwise("").alias("text"))
    letters = F.create_map(F.lit("A"), F.col("c_name"), F.lit("B"), F.concat(F.lit("o"), k.cast("string")), F.lit("C"), F.when(k % 2 == 0, "c"), F.lit("D"), F.lit("d"))
    return A.with_options(records, c.select(k.alias("id"), letters.alias("options"))).select("id", F.col("options")["B"].alias("b"))


@query("""WITH c AS (SELECT p_brand, p_size % 4 AS size, p_partkey % 2 = 0 AS cot, avg(p_retailprice) AS v FROM part GROUP BY ALL) SELECT a.p_brand, a.size, round(a.v - b.v, 6) AS difference FROM c a JOIN c b USING (p_brand, size) WHERE a.cot AND NOT b.cot""")
def cot_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells with and without a trait."""
    cells = read_table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 4).alias("size"), (F.col("p_partkey") % 2 == 0).alias("cot")).agg(F.avg("p_retailprice").alias("v"))
    return A.ablation(cells, ["p_brand", "size"], "cot", "v").select("p_brand", "size", F.round("difference", 6).alias("difference"))


@query("""SELECT s_suppkey AS id, s_acctbal AS a, NULL::DOUBLE AS b FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE FROM customer""")
def signal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of two tables, one of which lacks one."""
    one = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"))
    two = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return A.union_of_signals([one, two]).select("id", "a", "b")


@query("""WITH s AS (SELECT 'member_dpo_' || CASE o_orderkey % 3 WHEN 0 THEN 'chosen_matched' WHEN 1 THEN 'rejected_matched' ELSE 'pair' END AS leaf, o_totalprice AS score FROM orders)
SELECT regexp_replace(leaf, '_(chosen|rejected)_', '_') AS leaf, count(*) AS n, round(sum(score), 2) AS total FROM s GROUP BY 1""")
def pooled_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the chosen and the rejected answers as one bag."""
    k = F.col("o_orderkey") % 3
    leaf = F.concat(F.lit("member_dpo_"), F.when(k == 0, "chosen_matched").when(k == 1, "rejected_matched").otherwise("pair"))
    pooled = A.pooled_sides(read_table(spark, sf_dir, "orders").select(leaf.alias("leaf"), F.col("o_totalprice").alias("score")), "leaf")
    return pooled.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("""WITH u AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id % 3 > 0)
SELECT lang, doc_id, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS ordinal FROM u WHERE n <= 5""")
def first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five usable texts of each language (the limit is the feature), with the place of the language in a stated order."""
    docs = read_table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(" "))
    return A.in_order(A.first_usable(docs, "text", ["doc_id"], 5, ["lang"]), "lang", ["fr", "en"]).select("lang", "doc_id", "ordinal")


@query("SELECT source, count(*) AS num_total, count_if(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)) AS num_scored, count_if(doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)) AS num_skipped FROM documents GROUP BY source")
def scored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, those with a score and those without."""
    scores = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, 1.0).alias("score"))
    return M.counted(scores, read_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id")), ["source"])


PROMPT = "'Tell ' || c_name || ' of {b} and {a} in ' || c_mktsegment || '.'"


@query(f"""SELECT c_custkey, {PROMPT} AS prompt, CASE c_custkey % 3 WHEN 0 THEN 'StarCoder' WHEN 1 THEN 'Stack Exchange' ELSE 'the training corpus' END AS hint,
sha256('INSTRUCTION:' || chr(10) || 'Finish the SECOND PIECE based on the FIRST PIECE, such that these two pieces become a coherent passage.' || chr(10) || chr(10) || 'FIRST PIECE:' || chr(10) || c_name || chr(10) || chr(10) || 'SECOND PIECE:' || chr(10)) AS general FROM customer""")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled in (braces of a value stay), names of sources by path, and one stated prompt."""
    k = F.col("c_custkey") % 3
    path = F.when(k == 0, "a/StarCoder/java/x.jsonl").when(k == 1, "b\\stackexchange\\y").otherwise("sft_z/starcoder_java")
    prompt = P.fill("Tell {a} of {b} in {c}.", a=F.col("c_name"), b=F.lit("{b} and {a}"), c=F.col("c_mktsegment"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", prompt.alias("prompt"), P.source_hint(path).alias("hint"), F.sha2(P.fill(P.GENERAL, first_piece=F.col("c_name")), 256).alias("general"))


@query("""SELECT s_suppkey, 2 AS masks, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'the ' || s_name || ' saw two birds' END AS filled, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS fills FROM supplier""")
def mask_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks counted, fills read from a model's text and put in; too few fills give an empty text."""
    masked = F.lit("the <extra_id_0> saw <extra_id_1> birds")
    model = F.concat(F.lit("<pad><extra_id_0> "), F.col("s_name"), F.lit(" <extra_id_1> "), F.when(F.col("s_suppkey") % 3 == 0, "two").otherwise("two <extra_id_2>"), F.lit("</s>"))
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", masked.alias("m"), P.extract_fills(model).alias("f"))
    return rows.select("s_suppkey", P.count_masks(F.col("m")).alias("masks"), P.apply_fills(F.col("m"), F.col("f")).alias("filled"), F.size("f").alias("fills"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\s\x0B]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 300 THEN array_to_string(w[1:300], ' ') ELSE text END AS head, CASE WHEN len(w) > 300 THEN ' ' || array_to_string(w[301:], ' ') ELSE '' END AS tail, array_to_string(w[1:32], ' ') AS budget FROM w""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 words and the rest, and what an option's token budget leaves."""
    x = F.col("text")
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", T.head_and_tail(x, 300).alias("t"), words.alias("w"))
    return rows.select("doc_id", "t.head", "t.tail", F.array_join(P.fitted({"a": F.col("w")}, 200, 100)["a"], " ").alias("budget"))


LEAVES = "(VALUES ('1b', 19), ('7b', 19), ('13b', 19), ('32b', 19))"


@query(f"""WITH l AS (SELECT * FROM {LEAVES} AS t(size, n)), k AS (SELECT unnest(['minkprob', 'recall', 'dcq', 'mia_tuner']) AS method)
SELECT method, size, (2 * (7 + 1 + 2 + 4 + 2))::BIGINT AS jobs, CASE WHEN method IN ('recall', 'mia_tuner') THEN 32 ELSE 0 END::BIGINT AS with_dev, CASE method WHEN 'dcq' THEN 4096 ELSE 1024 END AS context FROM l, k""")
def job_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the matched split by method and size: every leaf of a size, members and non-members."""
    out = None
    for method in ("minkprob", "recall", "dcq", "mia_tuner"):
        rows = J.jobs_of(J.leaf_table(spark, "matched"), method).groupBy("method", "size").agg(F.count(F.lit(1)).alias("jobs"), F.count("dev").alias("with_dev"), F.max("context").alias("context"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'top/member/matched/test/member_pretraining_x_matched_test.jsonl' WHEN 1 THEN 'top/member/test/member_gsm8k_test.jsonl' WHEN 2 THEN 'top/non-member/test/non-member_dpo_7b_chosen_test.jsonl' ELSE 'Top/Shifted/member_se_test_shifted.jsonl' END AS path, page_id % 4 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'pretraining_x_matched' WHEN 1 THEN 'gsm8k_matched' WHEN 2 THEN 'non-member_dpo_7b_chosen_matched' ELSE 'se_shifted_matched' END AS tag,
CASE k WHEN 0 THEN 'top/member/matched/dev/member_pretraining_x_matched_dev.jsonl' WHEN 1 THEN 'top/member/dev/member_gsm8k_dev.jsonl' WHEN 2 THEN 'top/non-member/dev/non-member_dpo_7b_chosen_dev.jsonl' ELSE path END AS dev,
CASE k WHEN 0 THEN 'out/member_pretraining_x_matched/M_7B/loss.json' WHEN 1 THEN 'out/member_gsm8k/M_7B/loss.json' WHEN 2 THEN 'out/non-member_dpo_7b_chosen/M_7B/loss.json' ELSE 'out/member_se_shifted/M_7B/loss.json' END AS result,
k = 3 AS shifted, k = 2 AS non_member, '7b' AS size, k IN (0, 1) AS kept, sha256('loss' || chr(10) || '---' || chr(10) || path) AS cache FROM p""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names and paths of leaves stand for."""
    k = F.col("page_id") % 4
    path = F.when(k == 0, "top/member/matched/test/member_pretraining_x_matched_test.jsonl").when(k == 1, "top/member/test/member_gsm8k_test.jsonl").when(k == 2, "top/non-member/test/non-member_dpo_7b_chosen_test.jsonl").otherwise("Top/Shifted/member_se_test_shifted.jsonl")
    rows = read_table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select(
        "page_id", J.fleet_tag(p, "matched").alias("tag"), J.dev_path(p).alias("dev"), J.result_path("out", p, F.lit("models/M 7B"), F.lit("loss")).alias("result"), J.is_shifted(p).alias("shifted"),
        J.is_non_member(p).alias("non_member"), J.model_size(F.lit("some-7B-Instruct")).alias("size"), J.keep_path(p, ["TOP/"], ["dpo", "Shifted"]).alias("kept"), J.cache_key(F.lit("loss"), p).alias("cache"),
    )


@query()
def joint_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint runs over both sides of each leaf, on the development files."""
    return J.fleet(spark, dev=True)
