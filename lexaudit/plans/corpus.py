"""Queries on records and on building splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import text as T
from lexaudit.functions import vectorised as V
from lexaudit.operators import construction as C
from lexaudit.operators import scoring
from lexaudit.plans.inputs import tokens
from lexaudit.sources import records
from lexaudit.sources.tables import read_table, spread

QUERIES = {}
ORACLES = {}
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""SELECT conv_id, turn, coalesce(nullif({STRIP.format("text")}, ''), nullif({STRIP.format("role")}, '')) AS text FROM conversations""")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.extract_text(F.col("text"), F.col("role")).alias("text"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN source END), ''), 'sample_' || doc_id) AS sample_id FROM documents")
def sample_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return read_table(spark, sf_dir, "documents").select("doc_id", T.sample_id(given, F.col("doc_id")).alias("sample_id"))


PATHS = "CASE page_id % 7 WHEN 0 THEN 'Benchmark_DEV/dpo_x.jsonl' WHEN 1 THEN 'a/PreTraining/x' WHEN 2 THEN 'midtraining_dpo/y' WHEN 3 THEN 'PostTraining/dpo_chosen' WHEN 4 THEN 'posttraining/DPO/z' WHEN 5 THEN 'posttraining/sft_' || page_id ELSE 'other' END"


@query(f"""WITH p AS (SELECT page_id, lower({PATHS}) AS low FROM pages)
SELECT page_id, CASE WHEN contains(low, 'benchmark_dev') OR contains(low, 'pretraining') OR contains(low, 'midtraining') OR contains(low, 'chosen') OR contains(low, 'rejected') THEN 'paragraph'
WHEN contains(low, 'dpo') THEN 'dpo' WHEN contains(low, 'posttraining') THEN 'paragraph' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'auto' WHEN page_id % 3 = 1 THEN 'qa' ELSE 'other' END AS given FROM p""")
def dataset_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of data by path (null without a rule) and a given kind, normalised."""
    given = F.when(F.col("page_id") % 3 == 0, "  ").when(F.col("page_id") % 3 == 1, " QA\t").otherwise("Other")
    return read_table(spark, sf_dir, "pages").select("page_id", T.kind_of_path(F.expr(PATHS)).alias("kind"), T.normal_kind(given).alias("given"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS name,
regexp_replace(regexp_replace(regexp_replace('set_test_' || page_id || '_test_eval', '_eval$', ''), '_test_', '_', 'g'), '_test$', '') AS dataset FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("set_test_"), F.col("page_id").cast("string"), F.lit("_test_eval"))
    return read_table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.dataset_name(stem).alias("dataset"))


@query(f"SELECT doc_id, substr(sha1({STRIP.format('text')}), 1, 20) AS key FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.text_key(F.col("text")).alias("key"))


QA = """CASE c_custkey % 5 WHEN 0 THEN 'Question: ' || c_name || chr(10) || 'Reasoning: because' || chr(10) || 'Answer: ' || c_mktsegment WHEN 1 THEN 'Question: ' || c_name || ' with Answer: inline' || chr(10) || 'Answer: ' || c_mktsegment
WHEN 2 THEN 'no marks ' || c_name WHEN 3 THEN 'Question:   ' || c_name ELSE 'Answer: ' || c_mktsegment END"""
KIND = "CASE c_custkey % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'auto' ELSE 'paragraph' END"


@query(f"""WITH t AS (SELECT c_custkey, c_custkey % 5 AS k, c_name AS n, c_mktsegment AS m, {QA} AS x, {KIND} AS kind, c_custkey % 7 = 0 AS given FROM customer)
SELECT c_custkey, CASE WHEN kind = 'paragraph' THEN x WHEN given THEN 'given' WHEN k IN (0, 3) THEN n WHEN k = 1 THEN n || ' with Answer: inline' WHEN kind = 'auto' THEN x END AS question,
CASE WHEN kind = 'paragraph' THEN x WHEN k IN (0, 4) THEN m WHEN k = 1 THEN 'inline' || chr(10) || 'Answer: ' || m WHEN kind = 'auto' THEN x END AS answer,
CASE WHEN k = 0 THEN 'ask ' || n WHEN k <> 4 THEN x END AS critique FROM t""")
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers by the kind of data and a given field, and what a critique asks: of preference data (here every fifth row) the prompt."""
    x, kind = F.expr(QA), F.expr(KIND)
    given = F.when(F.col("c_custkey") % 7 == 0, F.lit(" given "))
    prompt = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("ask "), "c_name"))
    asked = T.critique_question(prompt, x, F.when(F.col("c_custkey") % 5 == 0, "dpo").when(F.col("c_custkey") % 5 == 4, "dpo").otherwise("qa"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", T.question_of(x, given, kind).alias("question"), T.answer_of(x, None, kind).alias("answer"), asked.alias("critique"))


@query("""SELECT event_id, CASE WHEN isnan(x) THEN NULL WHEN x = 'inf'::DOUBLE THEN 'Infinity' WHEN x = '-inf'::DOUBLE THEN '-Infinity' ELSE 'finite' END AS encoded
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS x FROM events)""")
def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    code = records.json_safe(x)
    return read_table(spark, sf_dir, "events").select("event_id", F.when(code.isNull() | code.isin("Infinity", "-Infinity"), code).otherwise("finite").alias("encoded"))


@query("SELECT o_orderkey, (datediff('day', DATE '0001-01-01', o_orderdate::DATE) + 1 + (hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)) / 86400.0)::DOUBLE AS day FROM orders")
def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", T.day_number(iso).alias("day"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.lit(0.25) + (k % 7) / F.lit(100.0), 4).alias("t1"), F.round(F.lit(0.15) + (k % 11) * F.lit(0.01), 4).alias("t2"),
        (F.col("p_size") % 5).alias("stars"), (F.col("p_size") % 5).alias("q"), (k % 7).cast("int").alias("a"),
    )


BAND = """WITH v AS (SELECT p_partkey, round(0.25 + (p_partkey % 7) / 100.0, 4)::DOUBLE AS t1, round(0.15 + (p_partkey % 11) * 0.01, 4)::DOUBLE AS t2, p_size % 5 AS stars, p_size % 5 AS q, (p_partkey % 7)::INT AS a FROM part)
SELECT p_partkey, {} AS code, {} AS answers, {} AS web FROM v"""


@query(BAND.format("stars >= 2 AND ((t1 <= 0.3 AND t1 + t2 > 0.5 AND t1 + t2 < 0.51) OR (t1 > 0.3 AND t1 < 0.31 AND t1 + t2 <= 0.5))", "(q = 2 AND a >= 5) OR (q >= 3 AND a = 4)", "t1 / 15 >= 0.018"))
def quality_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    t1, t2 = F.col("t1"), F.col("t2")
    return _bands(spark, sf_dir).select("p_partkey", C.code_band(t1, t2, F.col("stars")).alias("code"), C.answer_band(F.col("q"), F.col("a")).alias("answers"), C.web_band(t1 / 15).alias("web"))


@query(BAND.format("t1 >= 0.28 OR t1 + t2 >= 0.48", "q = 3 OR a = 5", "t1 / 15 < 0.0181122"))
def candidate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    t1, t2 = F.col("t1"), F.col("t2")
    return _bands(spark, sf_dir).select("p_partkey", C.code_candidate(t1, t2).alias("code"), C.answer_candidate(F.col("q"), F.col("a")).alias("answers"), C.web_candidate(t1 / 15).alias("web"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)')) AS tok, generate_subscripts(regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)'), 1) AS pos FROM documents),
c AS (SELECT doc_id, tok, count(*) AS c, min(pos) AS p FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, p) AS k, sum(c) OVER (PARTITION BY doc_id) AS n FROM c)
SELECT doc_id, max(tok) FILTER (k = 1) AS w1, round(max(c / n) FILTER (k = 1), 9) AS s1, max(tok) FILTER (k = 2) AS w2, round(max(c / n) FILTER (k = 2), 9) AS s2 FROM r WHERE k <= 2 GROUP BY doc_id HAVING count(*) = 2""")
def top2_word_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top2_share(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "w1", F.round("s1", 9).alias("s1"), "w2", F.round("s2", 9).alias("s2"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_seen(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("text"), "doc_id").select("doc_id", "source")


@query("SELECT source, count(DISTINCT text) AS unique_texts, count(*) AS n FROM documents GROUP BY source")
def unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return docs.groupBy("source").agg(F.count_distinct("h").alias("unique_texts"), F.count(F.lit(1)).alias("n"))


GRAMS = f"""WITH q AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), c AS (SELECT item_id AS id, {TOKENS} AS w FROM benchmark),
qg AS (SELECT id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM q WHERE len(w) >= 13)),
cg AS (SELECT DISTINCT id AS source, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM c WHERE len(w) >= 13)),
o AS (SELECT id, count(*) AS n_grams, count(*) FILTER (g IN (SELECT g FROM cg)) AS hits FROM qg GROUP BY id)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tokens(spark, sf_dir), tokens(spark, sf_dir, "benchmark", "item_id")


@query(GRAMS + "SELECT id, n_grams, hits, round(hits / n_grams, 9) AS overlap FROM o")
def ngram13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlap(*_sides(spark, sf_dir)).select("id", "n_grams", "hits", F.round("overlap", 9).alias("overlap"))


@query(GRAMS + "SELECT id, CASE WHEN hits / n_grams >= 0.2 THEN 1.0 ELSE round(hits / n_grams, 9) END AS reported, hits / n_grams >= 0.2 AS discard FROM o UNION ALL SELECT id, 1.0, true FROM q WHERE len(w) < 13")
def ngram13_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts shorter than 13 tokens count as overlapping in full."""
    q, c = _sides(spark, sf_dir)
    short = q.where(F.size("w") < C.GRAM).select("id", F.lit(1.0).alias("reported"), F.lit(True).alias("discard"))
    return C.contaminated(C.overlap(q, c)).select("id", F.round("reported", 9).alias("reported"), "discard").unionByName(short)


@query(GRAMS + "SELECT count_if(hits > 0) AS above_zero, count_if(hits / n_grams > 0.2) AS above_cut, count(*) AS scanned FROM o")
def ngram13_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.overlap(*_sides(spark, sf_dir))
    return o.agg(F.count_if(F.col("hits") > 0).alias("above_zero"), F.count_if(F.col("overlap") > 0.2).alias("above_cut"), F.count(F.lit(1)).alias("scanned"))


@query(GRAMS + "SELECT id, source, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, source) AS rank FROM (SELECT qg.id, source, count(DISTINCT i) AS hits FROM qg JOIN cg USING (g) GROUP BY ALL)) WHERE rank <= 10")
def ngram13_topdocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_sources(*_sides(spark, sf_dir)).select("id", "source", "hits", "rank")


@query("""WITH h AS (SELECT l_orderkey AS id, l_partkey * 10 AS place, l_linenumber AS length FROM lineitem),
w AS (SELECT id, greatest(place - 400, 0) AS b, place + length + 400 AS e FROM h),
n AS (SELECT *, CASE WHEN b > coalesce(max(e) OVER (PARTITION BY id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM w),
i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT id, min(b) AS "begin", max(e) AS "end" FROM i GROUP BY id, k""")
def window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 10).alias("at"), F.col("l_linenumber").alias("length"))
    return C.merged_windows(hits)


COUNTS = f"t AS (SELECT doc_id, source, {TOKENS} AS w FROM documents), c AS (SELECT tok, count(*) AS c FROM (SELECT unnest(w) AS tok FROM t) GROUP BY tok)"


@query(f"WITH {COUNTS} SELECT tok, c FROM c")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.token_counts(tokens(spark, sf_dir))


@query(f"WITH {COUNTS}, f AS (SELECT tok, count(*) AS c FROM (SELECT unnest(w[1:4096]) AS tok FROM t) GROUP BY tok) SELECT tok, c, round((c + 1) / ((SELECT sum(c) FROM f) + (SELECT count(*) FROM f)), 12)::DOUBLE AS p FROM f")
def laplace_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies from the first 4096 tokens of each document (the truncation is the feature)."""
    counts = scoring.token_counts(tokens(spark, sf_dir), first=4096)
    sizes = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    return counts.crossJoin(sizes).select("tok", "c", F.round((F.col("c") + 1) / (F.col("n") + F.col("v")), 12).alias("p"))


@query(f"""WITH {COUNTS}, a AS (SELECT tok, count(*) AS n FROM (SELECT unnest(w) AS tok FROM t WHERE source = 'src0') GROUP BY tok)
SELECT tok FROM (SELECT tok, c AS n FROM c EXCEPT ALL SELECT tok, n FROM a) UNION ALL SELECT tok FROM (SELECT tok, n FROM a EXCEPT ALL SELECT tok, c FROM c)""")
def frequency_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose counts differ between all documents and one source, either way."""
    docs = read_table(spark, sf_dir, "documents")
    one, every = (scoring.token_counts(scoring.tokens_of(d, "doc_id", F.col("text"))) for d in (docs.where("source = 'src0'"), docs))
    return every.exceptAll(one).select("tok").unionAll(one.exceptAll(every).select("tok"))


@query(f"""WITH {COUNTS}, s AS (SELECT source, tok, count(*) AS n FROM (SELECT source, unnest(w) AS tok FROM t) GROUP BY ALL), z AS (SELECT source, sum(n) AS size FROM s GROUP BY source),
r AS (SELECT source, n / size AS p, (c - n) / ((SELECT sum(c) FROM c) - size) AS q FROM s JOIN z USING (source) JOIN c USING (tok))
SELECT source, round(sum(0.5 * p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END) + 0.5 * (1 - sum(q)), 6) AS jsd FROM r GROUP BY source""")
def jsd_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("source", "text")).select("source", F.explode(T.words(F.col("text"))).alias("tok"))
    return C.divergence(docs.groupBy("source", "tok").agg(F.count(F.lit(1)).alias("n")), "source").select("source", F.round("jsd", 6).alias("jsd"))


@query("""WITH d AS (SELECT o_orderpriority AS grp, datediff('day', DATE '0001-01-01', o_orderdate::DATE) + 1 AS day FROM orders), e AS (SELECT avg(day) AS m, stddev_pop(day) AS s FROM d)
SELECT grp, round((abs(avg(day) - any_value(m)) + abs(stddev_pop(day) - any_value(s))) / CASE WHEN any_value(s) = 0 THEN 1 ELSE any_value(s) END, 6) AS drift FROM d, e GROUP BY grp""")
def temporal_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), (F.unix_date(F.to_date("o_orderdate")) + 719163).cast("double").alias("day"))
    return C.drift(rows, "grp", "day").select("grp", F.round("drift", 6).alias("drift"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?]\s+[A-Z"'']')) + 1 AS n_sentences, array_to_string(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')[1:300], ' ') AS head, text || ' ' || text AS twice FROM documents""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence counts, 300-word heads and repetition."""
    x = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(x)).cast("long").alias("n_sentences"), T.first_words(x, 300).alias("head"), T.repeated(x, 2).alias("twice"))


@query("""SELECT n_nationkey, slot, CASE WHEN slot = letter THEN 'original' ELSE 'option ' || slot END AS shown FROM (SELECT n_nationkey, ['A', 'B', 'C', 'D'][n_nationkey % 4 + 1] AS letter, unnest(['A', 'B', 'C', 'D']) AS slot FROM nation)""")
def quiz_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").withColumn("letters", F.array(*map(F.lit, "ABCD")))
    rows = nation.select("n_nationkey", F.element_at("letters", F.col("n_nationkey") % 4 + 1).alias("letter"), F.explode("letters").alias("slot"))
    return rows.select("n_nationkey", "slot", F.when(F.col("slot") == F.col("letter"), "original").otherwise(F.concat(F.lit("option "), F.col("slot"))).alias("shown"))


@query("SELECT c_custkey, 'first ' || c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN 'late' ELSE 'early' || chr(10) || 'two lines' END AS b, CASE WHEN c_custkey % 3 = 0 THEN 'xB) and inline' ELSE '' END AS d FROM customer")
def option_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a letter given twice the last counts; a missing one is empty; options may stand in bold and in one line, but not inside a word."""
    inline = F.when(F.col("c_custkey") % 3 == 0, " **D)** xB) and inline").otherwise("")
    text = F.concat(F.lit("A) first "), F.col("c_name"), F.lit("\nB)\nearly\ntwo lines\n"), F.when(F.col("c_custkey") % 2 == 0, "**B)** late\n").otherwise(""), inline)
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", T.options(text).alias("o"))
    return rows.select("c_custkey", F.col("o")["A"].alias("a"), F.col("o")["B"].alias("b"), F.col("o")["D"].alias("d"))


@query()
def perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word swaps, span masks and random splits, seeded by document, so that the order of rows has no part in them."""
    key = F.concat_ws(":", F.lit("perturb"), F.col("doc_id").cast("string"))
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", V.swap_words("text", key).alias("swapped"), V.mask_spans("text", key).alias("masked"), V.split_randomly("text", key).alias("split"))


MODELS = {"small": {"s0": 1, "s1": 2}, "large": {"s1": 3, "s2": 1}}
TAGGED = rf"""WITH q AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), b AS (SELECT 's' || (item_id % 3) AS source, {TOKENS} AS w FROM benchmark),
c AS (SELECT source, CASE WHEN source = 's1' THEN list_concat([chr(9601) || w[1]], w[2:]) ELSE w END AS w FROM b WHERE len(w) > 0),
cg AS (SELECT DISTINCT source, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT source, w, unnest(generate_series(1, len(w) - 12)) AS i FROM c WHERE len(w) >= 13)),
qg AS (SELECT id, array_to_string(w[i:i+12], ' ') AS g, CASE WHEN NOT regexp_full_match(w[i], '\p{{Nd}}+') THEN chr(9601) END AS mark FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM q WHERE len(w) >= 13)),
o AS (SELECT id, avg((g IN (SELECT g FROM cg WHERE source IN ('s0', 's1')) OR coalesce(mark || g IN (SELECT g FROM cg WHERE source IN ('s1')), false))::INT) AS small,
avg((g IN (SELECT g FROM cg WHERE source IN ('s1', 's2')) OR coalesce(mark || g IN (SELECT g FROM cg WHERE source IN ('s1', 's2')), false))::INT) AS large FROM qg GROUP BY id),
a AS (SELECT * FROM o UNION ALL SELECT id, 1.0, 1.0 FROM q WHERE len(w) < 13)
"""


@query(TAGGED + "SELECT id, round(small, 9) AS small, round(large, 9) AS large, greatest(small, large) < 0.2 AS kept FROM a")
def ngram13_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap with each model's sources, first-token variants included; a text stays if it is below the cut for every model. Source s1 marks its texts' first words, s0 is searched as text."""
    b = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("s"), F.col("item_id") % 3).alias("source"), F.col("item_id").alias("id"), T.words(F.col("text")).alias("w"))
    marked = F.when(F.col("source") == "s1", F.concat(F.array(F.concat(F.lit(C.WORD_MARK), F.get("w", F.lit(0)))), F.slice("w", F.lit(2), F.size("w")))).otherwise(F.col("w"))
    corpora = b.where(F.size("w") > 0).select("source", "id", marked.alias("w"))
    o = C.overlap_of_models(tokens(spark, sf_dir), corpora, MODELS, raw=["s0"])
    kept = C.kept_by_all(o, list(MODELS)).select("id", F.lit(True).alias("kept"))
    return o.join(kept, "id", "left").select("id", F.round("small", 9).alias("small"), F.round("large", 9).alias("large"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query()
def annealed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that match the tokens of the benchmark's shorter half, half as many as there are, in several restarts (the target of a sample is given; here it is made from the table)."""
    items = tokens(spark, sf_dir, "benchmark", "item_id")
    half = items.agg(F.percentile_approx(F.size("w"), 0.5).alias("half"))
    return C.matched_sample(items, items.crossJoin(half).where(F.size("w") <= F.col("half")).drop("half"), margin=250)
