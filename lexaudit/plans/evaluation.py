"""Queries on membership scores: the labels' quality flag stands for membership, text lengths for scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions.text import shifted_name
from lexaudit.operators import evaluate as E
from lexaudit.operators import membership as M
from lexaudit.operators import reports
from lexaudit.operators import resampling as R
from lexaudit.plans.inputs import scores
from lexaudit.sources import records
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


S = """WITH s AS (SELECT doc_id, lang, source, quality = 1 AS member, n_chars::DOUBLE AS score, length(split_part(text, chr(10), 1))::DOUBLE AS other FROM documents JOIN labels USING (doc_id))
"""


def auc_sql(rows: str, by: str, score: str = "score") -> str:
    """Mean-rank AUC of the rows of a subquery, by a list of columns."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}count_if(member) AS n_pos, count_if(NOT member) AS n_neg, CASE WHEN count_if(member) > 0 AND count_if(NOT member) > 0 THEN
(sum(CASE WHEN member THEN r ELSE 0 END) - count_if(member) * (count_if(member) + 1) / 2.0) / (count_if(member) * count_if(NOT member)) END AS auc
FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}{score}) - 1) / 2.0 AS r FROM {rows}) {group}"""


@query(S + f"SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 9) AS auc FROM ({auc_sql('s', '')})")
def auc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.auc(E.tally(scores(spark, sf_dir))).select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


CUBE = S + ", x AS (SELECT lang, source, member, score FROM s UNION ALL SELECT lang, NULL, member, score FROM s UNION ALL SELECT NULL, NULL, member, score FROM s)\n"


@query(CUBE + f"SELECT lang, source, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 9) AS auc FROM ({auc_sql('x', 'lang, source')})")
def auc_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by language, and by language and source, in one pass of grouping sets."""
    by = ["lang", "source"]
    t = E.tally(scores(spark, sf_dir), by, [["lang", "source"], ["lang"], []])
    return E.auc(t, by).select(*by, "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query(S + """, t AS (SELECT score, count_if(member) AS p, count_if(NOT member) AS n FROM s GROUP BY score),
c AS (SELECT score, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr FROM t WINDOW w AS (ORDER BY score DESC)),
lo AS (SELECT fpr, tpr FROM (SELECT fpr, tpr FROM c WHERE fpr <= 0.05 UNION ALL SELECT 0.0, 0.0) ORDER BY fpr DESC, tpr DESC LIMIT 1), hi AS (SELECT fpr, tpr FROM c WHERE fpr > 0.05 ORDER BY fpr, tpr LIMIT 1)
SELECT round(lo.tpr + (hi.tpr - lo.tpr) * (0.05 - lo.fpr) / (hi.fpr - lo.fpr), 6) AS tpr FROM lo, hi""")
def tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tpr_at_fpr(E.tally(scores(spark, sf_dir))).select(F.round("tpr", 6).alias("tpr"))


@query(S + ", q AS (SELECT lang, quantile_cont(score, 0.95) AS threshold FROM s WHERE NOT member GROUP BY lang) SELECT lang, round(threshold, 6) AS threshold, round(avg((score > threshold)::INT), 6) AS tpr FROM s JOIN q USING (lang) WHERE member GROUP BY lang, threshold")
def tpr_over_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tpr_over_quantile(scores(spark, sf_dir), by=["lang"]).select("lang", F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"))


@query(S + f""", a AS ({auc_sql('s', 'lang, source')}), l AS (SELECT lang, avg(auc) AS v, bool_and(auc IS NOT NULL) AS c FROM a GROUP BY lang)
SELECT 'all' AS level, 'all' AS name, round(avg(v), 6) AS value, bool_and(c) AS complete FROM l UNION ALL SELECT 'lang', lang, round(v, 6), c FROM l UNION ALL SELECT 'source', lang || '/' || source, round(auc, 6), auc IS NOT NULL FROM a""")
def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["lang", "source"]
    cells = E.auc(E.tally(scores(spark, sf_dir), by), by)
    return E.macro_means(cells, by).select("level", "name", F.round("value", 6).alias("value"), "complete")


BEST = """, t AS (SELECT held_out, score, count_if(member) AS p, count_if(NOT member) AS n FROM r GROUP BY ALL),
c AS (SELECT held_out, score, lead(score) OVER w AS below, (sum(p) OVER w + sum(n) OVER (PARTITION BY held_out) - sum(n) OVER w) / (sum(p) OVER (PARTITION BY held_out) + sum(n) OVER (PARTITION BY held_out)) AS acc FROM t WINDOW w AS (PARTITION BY held_out ORDER BY score DESC)),
a AS (SELECT held_out, score, below, acc, 0 AS none FROM c UNION ALL SELECT held_out, 0, NULL, sum(n) / (sum(p) + sum(n)), 1 FROM t GROUP BY held_out),
b AS (SELECT held_out, CASE WHEN none = 1 THEN 'inf'::DOUBLE WHEN below IS NULL THEN '-inf'::DOUBLE ELSE (score + below) / 2 END AS threshold, acc AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY acc DESC, none DESC, score DESC) AS k FROM a) WHERE k = 1)
"""
SHOWN = "CASE WHEN isinf(threshold) THEN NULL ELSE threshold END AS threshold, CASE WHEN threshold = 'inf'::DOUBLE THEN 'none' WHEN threshold = '-inf'::DOUBLE THEN 'all' ELSE 'some' END AS members"


def shown(name: str = "threshold") -> list:
    """A threshold, null if it is infinite, and whom it makes members."""
    t, inf = F.col(name), float("inf")
    return [F.when(F.abs(t) < inf, t).alias(name), F.when(t == inf, "none").when(t == -inf, "all").otherwise("some").alias("members")]


@query(S + ", r AS (SELECT lang AS held_out, member, score FROM s UNION ALL SELECT 'flipped', NOT member, score FROM s)" + BEST + f"SELECT held_out AS lang, {SHOWN}, round(accuracy, 9) AS accuracy FROM b")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds between scores or beyond all, by language; and of all with members and non-members exchanged."""
    rows = scores(spark, sf_dir).select("lang", "member", "score")
    rows = rows.unionByName(rows.select(F.lit("flipped").alias("lang"), (~F.col("member")).alias("member"), "score"))
    return E.best_threshold(E.tally(rows, ["lang"]), ["lang"]).select("lang", *shown(), F.round("accuracy", 9).alias("accuracy"))


@query(S + """, t AS (SELECT lang, score, count_if(member) AS p, count_if(NOT member) AS n FROM s GROUP BY ALL),
c AS (SELECT lang, score, (sum(p) OVER (PARTITION BY lang) - sum(p) OVER w + sum(n) OVER w) / (sum(p) OVER (PARTITION BY lang) + sum(n) OVER (PARTITION BY lang)) AS acc FROM t WINDOW w AS (PARTITION BY lang ORDER BY score))
SELECT lang, score AS threshold, round(acc, 9) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY acc DESC, score) AS k FROM c) WHERE k = 1""")
def best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rule: cuts at scores, members strictly above."""
    return E.best_cut(E.tally(scores(spark, sf_dir), ["lang"]), ["lang"]).select("lang", "threshold", F.round("accuracy", 9).alias("accuracy"))


@query(S + ", f AS (SELECT DISTINCT source AS held_out FROM s), r AS (SELECT held_out, member, score FROM s JOIN f ON source <> held_out)" + BEST + f"SELECT held_out, {SHOWN}, accuracy, n FROM (SELECT held_out, threshold, round(avg(((score >= threshold) = member)::INT), 9) AS accuracy, count(*) AS n FROM b JOIN s ON source = held_out GROUP BY held_out, threshold)")
def lodo_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.leave_one_out_accuracy(scores(spark, sf_dir), "source").select("held_out", *shown(), F.round("accuracy", 9).alias("accuracy"), "n")


@query(S + f", g AS (SELECT k, member, score % k AS score FROM s, (SELECT unnest([7, 50, 400, 3000]) AS k)), a AS ({auc_sql('g', 'k')}) SELECT k, round(auc, 9) AS auc FROM a ORDER BY a.auc DESC, k LIMIT 1")
def grid_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cell of a grid of score variants, here of lengths modulo k."""
    grid = scores(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (7, 50, 400, 3000))))).withColumn("score", F.col("score") % F.col("k"))
    return E.grid_best(grid, ["k"]).select("k", F.round("auc", 9).alias("auc"))


#: Rounds of the instance, paired and cluster bootstrap.
ROUNDS, PAIRED_ROUNDS, CLUSTER_ROUNDS = 2000, 1000, 10_000
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
BOOT = f""", n AS (SELECT *, row_number() OVER (PARTITION BY {{by}}, member ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY {{by}}, member) AS size FROM s),
k AS (SELECT {{by}}, member, b, {DRAW.format("'{seed}:' || {name} || '/' || CASE WHEN member THEN 'true' ELSE 'false' END || ':' || b || ':' || i")} % size AS i FROM n, (SELECT unnest(range({{rounds}})) AS b)),
d AS (SELECT k.b, n.* FROM k JOIN n ON n.{{by}} = k.{{by}} AND n.member = k.member AND n.i = k.i)
"""


def boot(by: str, name: str, seed: str, rounds: int) -> str:
    return BOOT.replace("{by}", by).replace("{name}", name).replace("{seed}", seed).replace("{rounds}", str(rounds))


@query(S + boot("lang", "lang", "ci", ROUNDS) + f", a AS ({auc_sql('d', 'lang, b')}) SELECT lang, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a GROUP BY lang")
def bootstrap_auc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.bootstrap_interval(scores(spark, sf_dir), ["lang"], "doc_id", ROUNDS, "ci")
    return out.select("lang", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(S + boot("lang", "lang", "pair", PAIRED_ROUNDS) + f""", a AS ({auc_sql('d', 'lang, b')}), c AS ({auc_sql('d', 'lang, b', 'other')}), z AS (SELECT lang, a.auc - c.auc AS d FROM a JOIN c USING (lang, b))
SELECT lang, round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, CASE WHEN count(d) > 0 THEN round(least(2 * least(count_if(d <= 0) + 1, count_if(d >= 0) + 1) / (count(d) + 1), 1), 6) END AS p FROM z GROUP BY lang""")
def paired_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("doc_id", "lang", "member", F.col("score").alias("score_a"), F.col("other").alias("score_b"))
    return R.paired_interval(rows, ["lang"], "doc_id", PAIRED_ROUNDS, "pair").select("lang", *[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi", "p")])


@query(S + f""", a AS ({auc_sql('s', 'source')}), n AS (SELECT source, auc, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS size FROM a WHERE auc IS NOT NULL),
k AS (SELECT b, {DRAW.format("'cl:all:' || b || ':' || i")} % size AS i FROM n, (SELECT unnest(range({CLUSTER_ROUNDS})) AS b)), m AS (SELECT b, avg(auc) AS m FROM k JOIN n USING (i) GROUP BY b)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, CASE WHEN quantile_cont(m, 0.975) - 0.5 < 0 THEN 'degraded' WHEN quantile_cont(m, 0.025) - 0.5 > 0 THEN 'inflated' WHEN quantile_cont(m, 0.025) - 0.5 > -0.05 AND quantile_cont(m, 0.975) - 0.5 < 0.05 THEN 'robust' ELSE 'inconclusive' END AS verdict FROM m""")
def cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = E.auc(E.tally(scores(spark, sf_dir), ["source"]), ["source"]).where("auc is not null")
    out = R.cluster_interval(cells, "source", "auc", CLUSTER_ROUNDS, "cl")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], R.classify(F.col("lo") - 0.5, F.col("hi") - 0.5).alias("verdict"))


@query("""WITH t AS (SELECT s_suppkey, s_suppkey * 37 % 101 / 2000.0 AS p FROM supplier), o AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, s_suppkey) + 1) * p, 1) AS s FROM t)
SELECT s_suppkey, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM o""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = read_table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 101 / F.lit(2000.0)).alias("p"))
    return R.holm(tests, "s_suppkey", "p").select("s_suppkey", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(f"WITH e AS (SELECT c_custkey, unnest([0, 1, 2]) AS seed FROM customer), x AS (SELECT *, unnest([0.1, 0.3, 0.5]) AS share FROM e) SELECT c_custkey, seed, share::DOUBLE AS share FROM x WHERE {DRAW.format(chr(39) + 'nest:' + chr(39) + ' || seed || ' + chr(39) + ':' + chr(39) + ' || c_custkey')} / 4294967296.0 < share")
def nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nested_subsets(read_table(spark, sf_dir, "customer"), "c_custkey", [0.1, 0.3, 0.5], 3)


@query(f"WITH e AS (SELECT lang, doc_id, b, {DRAW.format(chr(39) + 'class:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || doc_id')} AS d FROM documents, (SELECT unnest([0, 1, 2]) AS b)) SELECT b, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY b, lang ORDER BY d, doc_id) AS n FROM e) WHERE n <= 20")
def balanced_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of each language without replacement, three times (the sample is the feature)."""
    return R.class_draws(read_table(spark, sf_dir, "documents"), "lang", "doc_id", 20, 3)


@query()
def em_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of pseudo-labels from ratios of all vectors, as prefixes, to a reference pool of 40 targets; the start is the first component."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pool = e.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(40)
    pairs = e.select(F.col("vec_id").alias("prefix"), F.col("x").alias("y")).crossJoin(F.broadcast(pool.select(F.col("vec_id").alias("target"), "x")))
    ratios = pairs.where("prefix <> target").select("prefix", "target", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("ratio"))
    return M.iterate_membership(ratios, e.select(F.col("vec_id").alias("id"), F.col("x")[0].alias("m")))


@query()
def supervised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on two signals, fitted on even documents, applied to odd ones."""
    rows = scores(spark, sf_dir).withColumn("label", F.col("member").cast("double"))
    model = M.fit_logistic(rows.where("doc_id % 2 = 0"), ["score", "other"])
    return M.logistic_scores(model, rows.where("doc_id % 2 = 1"), "p").select("doc_id", "member", "p")


@query(S + "SELECT source, count(*) AS n, round(stddev_pop(score), 4) AS spread, count(DISTINCT round(score, 6)) AS kinds, stddev_pop(score) < 1e-6 OR count(DISTINCT round(score, 6)) <= 2 AS suspicious FROM s GROUP BY source")
def constant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.constant_scores(scores(spark, sf_dir), ["source"]).select("source", "n", F.round("spread", 4).alias("spread"), "kinds", "suspicious")


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pac' ELSE 'loss' END AS method FROM labels), w AS (SELECT source, count(DISTINCT doc_id) AS expected FROM documents GROUP BY source),
h AS (SELECT source, method, count(DISTINCT doc_id) AS covered FROM m JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, method, coalesce(covered, 0) AS covered, expected FROM w CROSS JOIN (SELECT DISTINCT method FROM m) LEFT JOIN h USING (source, method)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id")
    done = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "pac").otherwise("loss").alias("method")).join(docs, "doc_id")
    return E.coverage(docs, done, ["source"], "doc_id", "method")


@query("SELECT c_custkey AS key, a AS left_value, b AS right_value FROM (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 3 > 0) WHERE a <> b")
def config_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    left = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    right = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 10 == 0, "X").otherwise(F.col("c_mktsegment")).alias("v"))
    return E.config_differences(left, right, "key", "v")


@query("SELECT user_id, event_type, value, ts FROM (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS n FROM events) WHERE n = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", F.col("ts").alias("seen"))
    return records.newest(rows, ["user_id", "event_type"], "ts").select("user_id", "event_type", "value", F.col("seen").alias("ts"))


@query("""WITH l AS (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '_matched' ELSE '_only' END AS leaf FROM customer)
SELECT leaf, replace(leaf, '_matched', '_shifted') AS shifted, count(*) AS n FROM l WHERE leaf LIKE '%\\_matched%' ESCAPE '\\' GROUP BY leaf""".replace("\\\\", "\\"))
def shifted_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with a shifted counterpart; the others drop out on both sides."""
    leaf = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "_matched").otherwise("_only"))
    rows = read_table(spark, sf_dir, "customer").select(leaf.alias("leaf"))
    return rows.withColumn("shifted", shifted_name(F.col("leaf"))).where("shifted is not null").groupBy("leaf", "shifted").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (10, 11, 18, 25, 66, 106, 112, 118)")
def excluded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    #: Ids of records that are excluded.
    gone = spark.createDataFrame([(k,) for k in (10, 11, 18, 25, 66, 106, 112, 118)], "n_nationkey int")
    return read_table(spark, sf_dir, "nation").join(F.broadcast(gone), "n_nationkey", "left_anti").select("n_nationkey", "n_name")


LANGS = ("de", "en", "es", "fr")


@query(S + f", a AS ({auc_sql('s', 'lang, source')}) SELECT source, {', '.join(f"round(max(auc) FILTER (lang = '{x}'), 6) AS {x}" for x in LANGS)}, round(avg(auc), 6) AS mean FROM a GROUP BY source")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report table: one row for each source, languages as columns, mean over those that have a value."""
    by = ["lang", "source"]
    cells = E.auc(E.tally(scores(spark, sf_dir), by), by)
    wide = reports.wide(cells, ["source"], "lang", LANGS, "auc")
    means = cells.groupBy("source").agg(F.avg("auc").alias("mean"))
    return wide.join(means, "source").select("source", *[F.round(c, 6).alias(c) for c in (*LANGS, "mean")])


@query("""WITH j AS (SELECT r_name, n_name, size FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 7, 13, 32]) AS size) WHERE NOT (r_name = 'ASIA' AND size = 32))
SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_name = j.n_name AND n.n_nationkey % 3 = 0 AND j.size = 7)""")
def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by sizes under a rule, less those already done."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    leaves = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    sizes = spark.createDataFrame([(k,) for k in (1, 7, 13, 32)], "size int")
    jobs = reports.job_matrix(leaves, sizes, ~((F.col("r_name") == "ASIA") & (F.col("size") == 32)))
    done = nation.where("n_nationkey % 3 = 0").select("n_name", F.lit(7).alias("size"))
    return records.missing_jobs(jobs, done, ["n_name", "size"]).select("r_name", "n_name", "size")


@query(S + f", a AS ({auc_sql('s', 'source, lang')}), m AS (SELECT source, avg(auc) AS mean, count(auc) AS present FROM a GROUP BY source) SELECT source, round(mean, 6) AS mean, present, mean = (SELECT max(mean) FROM m) AS best FROM m")
def method_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["source", "lang"]
    out = reports.averages(E.auc(E.tally(scores(spark, sf_dir), by), by), ["source"], "lang", "auc")
    return out.select("source", F.round("mean", 6).alias("mean"), "present", "best")


@query(S + "SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN score - other END AS gain FROM s")
def tuned_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    base = rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("other")).alias("x"))
    return reports.gain(base, rows.select("doc_id", F.col("score").alias("x")), ["doc_id"], "x")


@query("SELECT event_id, round(exp(-1.0) * (event_id % 2) + exp(-2.0), 6) AS p_yes FROM events")
def judge_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda token, lp: F.struct(token.alias("token"), F.lit(lp).alias("logprob"))
    top = F.array(pair(F.when(F.col("event_id") % 2 == 1, " Yes").otherwise("no"), -1.0), pair(F.lit("YES "), -2.0), pair(F.lit("maybe"), -3.0))
    return read_table(spark, sf_dir, "events").select("event_id", F.round(reports.yes_probability(top), 6).alias("p_yes"))


@query(S + f", g AS (SELECT lang, k, member, score % k AS score FROM s, (SELECT unnest([7, 50, 400]) AS k)), a AS ({auc_sql('g', 'lang, k')}), c AS (SELECT lang, k, auc FROM a WHERE auc IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY auc DESC, k) AS n FROM c) SELECT b.lang, round(b.auc - c.auc, 6) + 0.0 AS cost FROM b JOIN c ON b.lang = c.lang WHERE n = 1 AND c.k = (SELECT k FROM b WHERE lang = 'en' AND n = 1)")
def reuse_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each language loses by the setting that is best for English."""
    grid = scores(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (7, 50, 400))))).withColumn("score", F.col("score") % F.col("k"))
    cells = E.auc(E.tally(grid, ["lang", "k"]), ["lang", "k"]).where("auc is not null")
    return reports.reuse_cost(cells, "lang", "k", "auc", "en").select("lang", (F.round("cost", 6) + F.lit(0.0)).alias("cost"))


HALF = DRAW.format("'half:' || doc_id") + " % 2"


@query(S + f", r AS (SELECT ({HALF})::VARCHAR AS held_out, member, score FROM s)" + BEST + f"SELECT judged, {SHOWN}, accuracy FROM (SELECT (1 - held_out::INT)::VARCHAR AS judged, threshold, round(avg(((s.score >= threshold) = member)::INT), 9) AS accuracy FROM b JOIN s ON ({HALF}) = 1 - held_out::INT GROUP BY ALL)")
def two_fold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves by a hash; each is judged by the other's best threshold."""
    rows = scores(spark, sf_dir).withColumn("half", F.pmod(R.draw(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("string"))
    return E.leave_one_out_accuracy(rows, "half").select(F.col("held_out").alias("judged"), *shown(), F.round("accuracy", 9).alias("accuracy"))


#: Cells of a report: every language a stage, every source a domain with two subsets, score variants as methods and sizes.
CELLS = S + f""", v AS (SELECT lang AS stage, source AS domain, source || '_' || (doc_id % 2) AS subset, member, 'length' AS method, '1b' AS size, score AS x FROM s UNION ALL SELECT lang, source, source || '_' || (doc_id % 2), member, 'length', '7b', score % 400 FROM s
UNION ALL SELECT lang, source, source || '_' || (doc_id % 2), member, 'line', '1b', other FROM s), a AS ({auc_sql('v', 'stage, domain, subset, method, size', 'x')}),
d AS (SELECT method, size, stage, domain, avg(auc) AS v, bool_and(auc IS NOT NULL) AS c FROM a GROUP BY ALL), g AS (SELECT method, size, stage, avg(v) AS v, bool_and(c) AS c FROM d GROUP BY ALL),
w AS (SELECT method, size, stage AS scope, v, c FROM g UNION ALL SELECT method, size, 'all', avg(v), bool_and(c) FROM g GROUP BY ALL)
"""


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """setting, method, size, stage, domain, subset, value, complete, supervised."""
    s = scores(spark, sf_dir).select(F.col("lang").alias("stage"), F.col("source").alias("domain"), F.concat("source", F.lit("_"), (F.col("doc_id") % 2).cast("string")).alias("subset"), "member", "score", "other")
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(z).alias("size"), x.cast("double").alias("score")) for m, z, x in (("length", "1b", F.col("score")), ("length", "7b", F.col("score") % 400), ("line", "1b", F.col("other")))])
    rows = s.select("stage", "domain", "subset", "member", F.explode(kinds).alias("k")).select("stage", "domain", "subset", "member", "k.*")
    by = ["stage", "domain", "subset", "method", "size"]
    return E.auc(E.tally(rows, by), by).select(F.lit("matched").alias("setting"), *by, F.col("auc").alias("value"), F.col("auc").isNotNull().alias("complete"), F.lit(False).alias("supervised"))


@query(CELLS + """, m AS (SELECT method, size, scope, v, c FROM w UNION ALL SELECT method, 'Model-Avg', scope, avg(v), bool_and(c) FROM w WHERE v IS NOT NULL GROUP BY method, scope),
e AS (SELECT method AS "row", size || ' | ' || scope AS "column", v, c FROM m WHERE v IS NOT NULL UNION ALL SELECT 'Method-Avg', size || ' | ' || scope, avg(v), bool_and(c) FROM m WHERE v IS NOT NULL GROUP BY ALL)
SELECT "row", "column", round(v, 6) AS value, c AS complete, "row" <> 'Method-Avg' AND v = max(v) FILTER ("row" <> 'Method-Avg') OVER (PARTITION BY "column") AS best FROM e""")
def report_unsupervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main table in long form: methods by sizes and scopes, with means over both, the best of a column marked."""
    return reports.long_table(report_cells(spark, sf_dir), "unsupervised").select("row", "column", F.round("value", 6).alias("value"), "complete", "best")


@query(CELLS + """, z AS (SELECT method, subset, avg(auc) AS v FROM a WHERE auc IS NOT NULL GROUP BY ALL) SELECT method, round(avg(v) FILTER (subset IN ('src0_0', 'src1_1')), 6) AS inside, round(avg(v) FILTER (subset NOT IN ('src0_0', 'src1_1')), 6) AS outside FROM z GROUP BY method HAVING count_if(subset IN ('src0_0', 'src1_1')) = 2""")
def subset_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated subsets against the others, means over sizes first."""
    return reports.contrast(report_cells(spark, sf_dir), "method", ["src0_0", "src1_1"]).select("method", F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))


@query(S + f""", z AS (SELECT lang, source, k, member, score % k AS score FROM s, (SELECT unnest([400, 3000]) AS k)), x AS (SELECT * FROM z UNION ALL SELECT lang, NULL, k, member, score FROM z UNION ALL SELECT NULL, NULL, k, member, score FROM z),
a AS ({auc_sql('x', 'lang, source, k')}) SELECT lang, source, round(avg(auc), 6) AS auc, count(auc) AS sizes FROM a GROUP BY lang, source HAVING count(auc) > 0""")
def pooled_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances pooled in every scope, then averaged over sizes (here moduli of the score)."""
    rows = scores(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(400), F.lit(3000)))).withColumn("score", F.col("score") % F.col("k"))
    return E.pooled_scopes(rows, ["lang", "source"], "k").select("lang", "source", F.round("auc", 6).alias("auc"), "sizes")


@query(S + f""", z AS (SELECT lang, source, CASE WHEN source = 'src1' THEN 5.0 WHEN source = 'src2' AND member THEN 1e6 + score ELSE score END AS score, member FROM s), a AS ({auc_sql('z', 'source')}),
d AS (SELECT source, bool_or(c) AS constant FROM (SELECT source, member, stddev_pop(score) < 1e-6 OR count(DISTINCT round(score, 6)) <= 2 AS c FROM z GROUP BY source, member) GROUP BY source)
SELECT source, round(auc, 6) AS auc, auc <= 0.03 OR auc >= 0.97 AS extreme, constant FROM a JOIN d USING (source)""")
def score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with an AUC next to 0 or 1, or with constant scores on a side."""
    score = F.when(F.col("source") == "src1", 5.0).when((F.col("source") == "src2") & F.col("member"), F.col("score") + 1e6).otherwise(F.col("score"))
    out = E.audit(scores(spark, sf_dir).select("source", "member", score.alias("score")), ["source"])
    return out.select("source", F.round("auc", 6).alias("auc"), "extreme", "constant")


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' WHEN 3 THEN 'x' WHEN 4 THEN NULL ELSE value::VARCHAR END AS s FROM events)
SELECT event_id, event_id % 6 IN (1, 5) AS released, event_id % 6 IN (1, 2, 5) AS reported, event_id % 6 = 5 AS finite FROM v""")
def score_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules of what a score is: as released files are read, as tables read them, and finite."""
    k = F.col("event_id") % 6
    s = F.when(k == 0, "NaN").when(k == 1, "Infinity").when(k == 2, "-Infinity").when(k == 3, "x").when(k == 5, F.col("value").cast("string"))
    finite = F.coalesce(E.valid(s.try_cast("double")), F.lit(False))
    return read_table(spark, sf_dir, "events").select("event_id", F.coalesce(E.valid_text(s), F.lit(False)).alias("released"), F.coalesce(E.valid_text(s, True), F.lit(False)).alias("reported"), finite.alias("finite"))


SPAN = f"(({DRAW.format("'dir:' || s_suppkey || ':' || b")} % 2001) - 1000) / 1000.0 + CASE s_nationkey % 3 WHEN 0 THEN 3.0 WHEN 1 THEN -3.0 ELSE 0.0 END"


@query(f"""WITH d AS (SELECT 'm' || (s_suppkey % 2) AS method, s_nationkey, b, avg({SPAN}) AS m FROM supplier, (SELECT unnest(range(200)) AS b) GROUP BY ALL),
e AS (SELECT method, s_nationkey, quantile_cont(m, 0.025) AS l95, quantile_cont(m, 0.975) AS h95, quantile_cont(m, 0.005) AS l99, quantile_cont(m, 0.995) AS h99 FROM d GROUP BY ALL)
SELECT method, 0.95::DOUBLE AS level, count_if(l95 > 0) AS inflated, count_if(h95 < 0) AS degraded, count(*) AS n FROM e GROUP BY method UNION ALL SELECT method, 0.99::DOUBLE, count_if(l99 > 0), count_if(h99 < 0), count(*) FROM e GROUP BY method""")
def direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose interval lies above 0, and below, by method and level."""
    rows = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 2).cast("string")).alias("method"), "s_nationkey", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"))
    moved = (R.draw(F.lit("dir"), F.col("s_suppkey"), F.col("b")) % 2001 - 1000) / F.lit(1000.0) + F.when(F.col("s_nationkey") % 3 == 0, 3.0).when(F.col("s_nationkey") % 3 == 1, -3.0).otherwise(0.0)
    return R.direction_counts(rows.withColumn("v", moved), "method", "s_nationkey", "s_suppkey", "v")
