"""Queries on token statistics: every score of one record, from add-one unigram statistics of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import arrays as A
from lexaudit.functions import vectorised as V
from lexaudit.functions.text import words
from lexaudit.operators import resampling as R
from lexaudit.operators import methods, scoring, signals
from lexaudit.operators.methods import GRIDS as METHOD_GRIDS
from lexaudit.plans.corpus import TOKENS
from lexaudit.plans.inputs import lowered, tokens, unigram_stats
from lexaudit.sources.tables import read_table
from lexaudit.storage import settle

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: tokens of each document with place and log-probability
STATS = f"""WITH t AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), e AS (SELECT id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM t),
c AS (SELECT tok, count(*) AS c FROM e GROUP BY tok), z AS (SELECT sum(c) AS n, count(*) AS v FROM c),
p AS (SELECT tok, c, round(ln((c + 1) / (n + v)) * 1048576) / 1048576 AS lp FROM c, z), mo AS (SELECT sum(exp(lp) * lp) AS mu, sum(exp(lp) * lp * lp) - pow(sum(exp(lp) * lp), 2) AS sigma FROM p),
s AS (SELECT id, pos, tok, lp, c FROM e JOIN p USING (tok)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lp) AS r, count(*) OVER (PARTITION BY id) AS n FROM s)
"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("id", *[F.round(n, 6).alias(n) for n in names])


@query(STATS + "SELECT id, round(avg(lp), 6) AS loss, round(exp(-avg(lp)), 4) AS ppl FROM s GROUP BY id")
def loss_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = A.mean(F.col("lp"))
    return unigram_stats(spark, sf_dir).select("id", F.round(lp, 6).alias("loss"), F.round(F.exp(-lp), 4).alias("ppl"))


@query(STATS + "SELECT id, round(avg(lp), 6) AS mink FROM k WHERE r <= greatest(1, floor(n * 0.2)) GROUP BY id")
def mink_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(unigram_stats(spark, sf_dir).select("id", A.min_k(F.col("lp")).alias("mink")), "mink")


@query(STATS + "SELECT id, round(avg((lp - mu) / (sqrt(greatest(sigma, 1e-9)) + 1e-9)), 6) AS minkpp FROM k, mo WHERE r <= greatest(1, floor(n * 0.2)) GROUP BY id")
def minkpp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(unigram_stats(spark, sf_dir).select("id", A.min_k_plus(F.col("lp"), F.col("mu"), F.col("sigma")).alias("minkpp")), "minkpp")


@query(STATS + "SELECT id, round(avg(lp) FILTER (r > n - greatest(1, floor(n * 0.05))) - avg(lp) FILTER (r <= greatest(1, floor(n * 0.1))), 6) AS polarised FROM k GROUP BY id")
def polarised_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(unigram_stats(spark, sf_dir).select("id", A.polarised(F.col("lp")).alias("polarised")), "polarised")


@query(STATS + ", f AS (SELECT DISTINCT id, tok, c, lp FROM s) SELECT id, round(avg(least(exp(lp) * ln((n + v) / (c + 1)), 0.01)), 9) AS dcpdd FROM f, z GROUP BY id")
def dcpdd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, (0.01,)).select("id", F.round("dcpdd", 9).alias("dcpdd"))


def _calibrated(spark: SparkSession, sf_dir: str, ceilings) -> DataFrame:
    t = tokens(spark, sf_dir).where(F.size("w") > 0)
    known = scoring.Frequencies(scoring.token_counts(t))
    return scoring.calibrated_frequency(scoring.UnigramScorer(known).score(t), known, ceilings)


@query(STATS + f", f AS (SELECT DISTINCT id, tok, c, lp FROM s), g AS (SELECT unnest({list(METHOD_GRIDS['dcpdd']['alpha'])}) AS ceiling) SELECT id, ceiling::DOUBLE AS ceiling, round(avg(least(exp(lp) * ln((n + v) / (c + 1)), ceiling)), 9) AS dcpdd FROM f, z, g GROUP BY ALL")
def dcpdd_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score at every ceiling of the grid, from one look-up of the tokens."""
    return _calibrated(spark, sf_dir, METHOD_GRIDS["dcpdd"]["alpha"]).select("id", "ceiling", F.round("dcpdd", 9).alias("dcpdd"))


CASED = r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS low FROM documents),
c AS (SELECT tok, count(*) AS c FROM (SELECT unnest(w) AS tok FROM t) GROUP BY tok), z AS (SELECT sum(c) AS n, count(*) AS v FROM c),
a AS (SELECT id, avg(round(ln((coalesce(c, 0) + 1) / (n + v)) * 1048576) / 1048576) AS x FROM (SELECT id, unnest(w) AS tok FROM t) LEFT JOIN c USING (tok), z GROUP BY id),
b AS (SELECT id, avg(round(ln((coalesce(c, 0) + 1) / (n + v)) * 1048576) / 1048576) AS y FROM (SELECT id, unnest(low) AS tok FROM t) LEFT JOIN c USING (tok), z GROUP BY id)
"""


def _cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lowered(spark, sf_dir).where(F.size("w") > 0)
    scorer = scoring.UnigramScorer(scoring.Frequencies(scoring.token_counts(t.select("id", "w"))))
    one = scorer.score(t.select("id", "w")).select("id", A.mean(F.col("lp")).alias("x"))
    two = scorer.score(t.select("id", F.col("low").alias("w"))).select("id", A.mean(F.col("lp")).alias("y"))
    return one.join(two, "id")


@query(CASED + "SELECT id, round(x - y, 6) AS lowercase FROM a JOIN b USING (id)")
def lowercase_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cased(spark, sf_dir).select("id", F.round(F.col("x") - F.col("y"), 6).alias("lowercase"))


@query(CASED + "SELECT id, round(y / x, 6) AS ratio FROM a JOIN b USING (id)")
def recall_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio form on two variants of a text; a recorded conditional likelihood takes the place of the second."""
    return _cased(spark, sf_dir).select("id", F.round(A.prefix_ratio(F.col("y"), F.col("x")), 6).alias("ratio"))


@query()
def zlib_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), V.zlib_length("text").alias("bytes"))
    return unigram_stats(spark, sf_dir).select("id", A.total(F.col("lp")).alias("sum")).join(texts, "id").select("id", (F.col("sum") / F.col("bytes")).alias("zlib"))


@query()
def augmented_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarised distance less its mean over five word-swapped copies, negated; copies go through the same scorer."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    copies = docs.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"), "text").select("id", V.swap_words("text", F.concat_ws(":", "id", "k")).alias("text"), "k")
    t = tokens(spark, sf_dir).where(F.size("w") > 0)
    scorer = scoring.UnigramScorer(scoring.Frequencies(scoring.token_counts(t)))
    pd = lambda s, name: s.select("id", A.polarised(F.col("lp")).alias(name))
    own = pd(scorer.score(t), "own")
    numbered = copies.select(F.struct("id", "k").alias("id"), words(F.col("text")).alias("w"))
    swapped = pd(scorer.score(numbered), "d").groupBy(F.col("id.id").alias("id")).agg(F.avg("d").alias("mean"))
    return own.join(swapped, "id").select("id", (F.col("mean") - F.col("own")).alias("pac"))


@query("""WITH n AS (SELECT l_orderkey, avg(l_quantity) AS t, avg(l_discount) AS m, stddev_pop(l_discount) AS s, count(*) AS k FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(t - m, 6) AS d, round((t - m) / CASE WHEN k <= 1 OR s < 1e-9 THEN 1 ELSE s END, 4) AS z FROM n""")
def neighbour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("t"), F.sort_array(F.collect_list("l_discount")).alias("others"))
    d, z = A.neighbour_scores(F.col("t"), F.col("others"))
    m = A.total(F.transform("others", lambda x: F.when(x == F.col("others")[0], 0.0).otherwise(1.0)))
    return rows.select("l_orderkey", F.round(d, 6).alias("d"), F.round(F.when(m == 0, d).otherwise(z), 4).alias("z"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS letter, (c_custkey * 7919 % 1000) / 1000.0 AS p FROM customer),
e AS (SELECT c_nationkey, letter, avg(p) AS pe FROM p GROUP BY ALL)
SELECT c_custkey, round((p - pe) / greatest(0.001, 1 - pe), 6) AS kappa FROM p JOIN e USING (c_nationkey, letter)""")
def dcq_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.element_at(F.array(*map(F.lit, "ABCD")), (k % 4 + 1).cast("int")).alias("letter"), ((k * 7919 % 1000) / F.lit(1000.0)).alias("p"))
    chance = rows.groupBy("c_nationkey", "letter").agg(F.avg("p").alias("pe"))
    return rows.join(chance, ["c_nationkey", "letter"]).select("c_custkey", F.round(A.kappa(F.col("p"), F.col("pe")), 6).alias("kappa"))


@query("""WITH s AS (SELECT s_suppkey, s_name, unnest([s_name, reverse(s_name), replace(s_name, '0', 'x'), upper(s_name) || '!']) AS y FROM supplier)
SELECT s_suppkey, avg((levenshtein(s_name, y) <= 0.05 * greatest(length(s_name), length(y)))::INT)::DOUBLE AS peak FROM s GROUP BY s_suppkey""")
def levenshtein_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sampled completions within 5 % of the greedy one, by characters."""
    n = F.col("s_name")
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.array(n, F.reverse(n), F.replace(n, F.lit("0"), F.lit("x")), F.concat(F.upper(n), F.lit("!")))).alias("y"))
    near = F.levenshtein("s_name", "y") <= 0.05 * F.greatest(F.length("s_name"), F.length("y"))
    return rows.groupBy("s_suppkey").agg(F.avg(near.cast("int")).alias("peak"))


@query()
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token edit distance and ROUGE-L F1 between a user's words and the answer that follows."""
    c = read_table(spark, sf_dir, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", words(F.col("text")).alias("a"))
    say = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), words(F.col("text")).alias("b"))
    pairs = ask.join(say, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", V.token_edit_distance("a", "b").alias("distance"), V.rouge_l("a", "b").alias("rouge_l"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding[1:(vec_id % 64 + 1)], lambda x: -x::DOUBLE) AS b FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(a[1:len(b)], b), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) * len(b) / 64, 6) AS similarity FROM v""")
def penalised_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("embedding").cast("array<double>")
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"), F.transform(F.slice(a, F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")), lambda x: -x).alias("b"))
    return rows.select("vec_id", F.round(A.penalised_cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""WITH r AS (SELECT vec_id AS ref, embedding AS y FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY md5('ref:' || vec_id) LIMIT 10))
SELECT ref, vec_id, round(list_sum(list_transform(list_zip(embedding, y), lambda x: x[1]::DOUBLE * x[2])), 5) AS dot FROM embeddings, r""")
def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against a stated reference pool of ten; the pool is the feature, so the broadcast is bounded by it."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pool = e.orderBy(F.md5(F.concat(F.lit("ref:"), F.col("vec_id").cast("string")))).limit(10).select(F.col("vec_id").alias("ref"), F.col("x").alias("y"))
    return e.crossJoin(F.broadcast(pool)).select("ref", "vec_id", F.round(A.total(F.zip_with("x", "y", lambda a, b: a * b)), 5).alias("dot"))


CUT_WHERE = ("pos < n", "pos <= 200", "pos <= 300")


def _per_cut(template: str, name: str) -> str:
    """A template for each cut, under name_0, name_1, ..."""
    return ", ".join(f"{template.format(w=w, k=k)} AS {name}_{k}" for k, w in enumerate(CUT_WHERE))


BASE = STATS + f""", m AS (SELECT id, any_value(n) AS n, {_per_cut('avg(lp) FILTER ({w})', 'loss')}, {_per_cut('count(DISTINCT tok) FILTER ({w}) / count(*) FILTER ({w})', 'div')},
avg((lp >= -1)::INT) FILTER (pos <= 200) AS above_0, avg((lp >= -2)::INT) FILTER (pos <= 200) AS above_1, avg((lp >= -3)::INT) FILTER (pos <= 200) AS above_2 FROM k GROUP BY id),
h AS (SELECT k.id, {_per_cut('count_if(lp > loss_{k} AND ' + 'k.' + '{w}' + ')', 'high')} FROM k JOIN m USING (id) GROUP BY k.id)
""".replace("k.pos < n", "pos < k.n").replace("k.pos", "pos")


@query(BASE + f"SELECT id, {_per_cut('round(loss_{k}, 6)', 'loss')}, {_per_cut('round(exp(-loss_{k}), 3)', 'ppl')}, {_per_cut('round(div_{k}, 6)', 'token_diversity')}, {_per_cut('round(loss_{k} / div_{k}, 5)', 'calibrated_loss')}, {_per_cut('high_{k}::DOUBLE', 'count_mean')}, round(above_0, 6) AS count_above_0, round(above_1, 6) AS count_above_1, round(above_2, 6) AS count_above_2 FROM m JOIN h USING (id) WHERE n > 1")
def camia_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of a sequence on its own, at each cut and threshold."""
    digits = {"loss": 6, "ppl": 3, "token_diversity": 6, "calibrated_loss": 5, "count_mean": 0, "count_above": 6}
    rows = signals.signals(unigram_stats(spark, sf_dir).where(F.size("lp") > 1), ("base",))
    wide = signals.matrix(rows, [(s, v) for s in digits for v in range(3)])
    return wide.select("id", *[F.round(f"{s}_{v}", d).alias(f"{s}_{v}") for s, d in digits.items() for v in range(3)])


TRENDS = STATS + """, r AS (SELECT k.id, n, (j - 1) * n + pos AS place, least(lp + ln(j), 0) AS lp FROM k, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS j)),
ty AS (SELECT id, round(regr_slope(lp, place) FILTER (place <= 600), 6) + 0.0 AS slope_0, round(regr_slope(lp, place) FILTER (place <= 800), 6) + 0.0 AS slope_1, round(regr_slope(lp, place) FILTER (place <= 1000), 6) + 0.0 AS slope_2 FROM r GROUP BY id),
b AS (SELECT id, pos, lp > avg(lp) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM k),
u AS (SELECT id, round(avg(up::INT) FILTER (pos > 1), 6) AS count_above_pre_0, round(avg(up::INT) FILTER (pos BETWEEN 2 AND 200), 6) AS count_above_pre_1, round(avg(up::INT) FILTER (pos BETWEEN 2 AND 300), 6) AS count_above_pre_2 FROM b GROUP BY id)
"""


@query(TRENDS + "SELECT * FROM ty JOIN u USING (id)")
def camia_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the repeated sequence, and shares of tokens above the mean of those before them."""
    rows = signals.signals(signals.repeat(unigram_stats(spark, sf_dir)), ("before", "trend"))
    names = [(s, v) for s in ("slope", "count_above_pre") for v in range(3)]
    wide = signals.matrix(rows.where(~F.isnan("value")), names)
    return wide.select("id", *[(F.round(f"{s}_{v}", 6) + F.lit(0.0)).alias(f"{s}_{v}") for s, v in names])


REPEATS = STATS + """, o AS (SELECT id, n, pos, tok, least(lp, 0) AS a, least(lp + ln(2), 0) AS b, least(lp + ln(3), 0) AS c FROM k WHERE n >= 3),
d AS (SELECT id, avg(a) FILTER (pos <= 200) AS a, avg(b) FILTER (pos <= 200) AS b, avg(c) FILTER (pos <= 200) AS c, count(DISTINCT tok) FILTER (pos <= 200) / count(*) FILTER (pos <= 200) AS div,
avg((a >= -2)::INT) FILTER (pos <= 200) - avg((b >= -2)::INT) FILTER (pos <= 200) AS up FROM o GROUP BY id HAVING 4 * count(DISTINCT tok) >= count(*))
"""


@query(REPEATS + "SELECT id, round(a - b, 6) AS loss_1, round(a - c, 6) AS loss_2, round((a - b) / div, 5) AS calibrated_1, round(up, 6) + 0.0 AS above_1 FROM d")
def camia_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence's signals less those of the second and third, found in the repeated sequence by its tokens; documents of which less than a quarter are different words are left out, as occurrences of a text that repeats itself overlap."""
    stats = unigram_stats(spark, sf_dir).where((F.size("lp") >= 3) & (4 * F.size(F.array_distinct("ids")) >= F.size("ids")))
    rows = signals.signals(signals.repeat(stats), ("repetition",))
    names = [("overall_diff_1_loss", 1), ("overall_diff_2_loss", 1), ("overall_diff_1_calibrated_loss", 1), ("overall_diff_1_count_above", 1)]
    w = signals.matrix(rows, names)
    out = zip(names, (("loss_1", 6), ("loss_2", 6), ("calibrated_1", 5), ("above_1", 6)))
    return w.select("id", *[(F.round(f"{s}_{v}", d) + F.lit(0.0)).alias(c) for (s, v), (c, d) in out])


@query()
def camia_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase counts of the first 200 log-probabilities, and approximate entropy of the repeated sequence."""
    rows = signals.signals(signals.repeat(unigram_stats(spark, sf_dir)), ("parse", "entropy"))
    return signals.matrix(rows.where(~F.startswith("signal", F.lit("overall_"))), [(s, v) for s in ("lz_complexity", "approximate_entropy") for v in range(3)])


PV = STATS + """, g AS (SELECT id, count(DISTINCT tok) FILTER (pos <= 200) / count(*) FILTER (pos <= 200) AS value FROM s GROUP BY id), l AS (SELECT id, value, quality = 1 AS member FROM g JOIN labels ON doc_id = id),
sg AS (SELECT CASE WHEN avg(value) FILTER (member) > avg(value) FILTER (NOT member) THEN -1 ELSE 1 END AS sign FROM l), x AS (SELECT value * sign AS y FROM l, sg WHERE NOT member),
u AS (SELECT id, value * sign AS y FROM l, sg WHERE member)
"""


@query(PV + "SELECT id, round(((SELECT count(*) FROM x WHERE x.y < u.y) + 0.5 * (SELECT count(*) FROM x WHERE x.y = u.y)) / (SELECT count(*) FROM x), 6) AS p FROM u")
def camia_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir, unigram_stats(spark, sf_dir), ("base",)).where("signal = 'token_diversity' and variation = 1")
    p = signals.p_values(rows.where("member"), rows.where("not member"), signals.directions(rows))
    return p.select("id", F.round("p", 6).alias("p"))


def _labelled(spark: SparkSession, sf_dir: str, stats: DataFrame, groups) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("member"))
    return signals.signals(stats.join(labels.select("id"), "id", "left_semi"), groups).join(labels, "id").select("id", "signal", "variation", "value", "member")


@query()
def camia_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals but entropy, which is quadratic in the tokens, as p-values against the non-members, combined in each way."""
    rows = settle(_labelled(spark, sf_dir, signals.repeat(unigram_stats(spark, sf_dir)), ("base", "parse", "before", "repetition", "trend")))
    return signals.combine(signals.p_values(rows, rows.where("not member"), signals.directions(rows)))


@query()
def registered_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by alias, each on the kind of table it reads, in long form."""
    stats = settle(unigram_stats(spark, sf_dir))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    texts = stats.join(docs.select("id", V.zlib_length("text").alias("bytes")), "id").withColumn("low_lp", F.col("lp"))
    calibrated = _calibrated(spark, sf_dir, (methods.parameters("dcpdd", "")["alpha"],)).select("id", "dcpdd")
    halves = stats.select("id", F.slice("lp", 1, 200).alias("first"), F.slice("lp", 201, 200).alias("second"))
    tables = {
        "stats": stats, "stats_of_texts": texts, "calibrated": calibrated, "entropies": halves,
        "likelihoods": stats.select("id", A.mean(F.slice("lp", 1, 100)).alias("conditional"), A.mean(F.col("lp")).alias("plain")),
        "neighbours": stats.select("id", A.mean(F.col("lp")).alias("target"), F.slice("lp", 1, 25).alias("others")),
    }
    return methods.METHODS.apply(["perplexity", "zlib", "minkpp", "dcpdd", "recall", "neighborhood_attack", "selfcrit"], tables, {"*": {"k": 0.2, "unused": 1}, "neighborhood_attack": {"score_type": "z"}})


@query("""WITH w AS (SELECT o_orderpriority AS grp, o_totalprice - 150000 AS d FROM orders WHERE o_totalprice <> 150000), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2.0 AS r FROM w)
SELECT grp, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w, round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(sum(r * r) / 4.0), 6) AS z FROM r GROUP BY grp""")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") - 150000).alias("d"))
    return R.wilcoxon(rows, ["grp"], "d").select("grp", "n", "w", F.round("z", 6).alias("z"))
