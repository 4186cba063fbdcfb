"""Iterated membership from prefix ratios, and supervised classifiers of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions import arrays as A
from lexaudit.operators.evaluate import auc, quantile, tally
from lexaudit.storage import settle


def iterate_membership(ratios: DataFrame, init: DataFrame, rounds: int = 10) -> DataFrame:
    """id, m after ``rounds``: prefixes are judged by how well their ratios separate the current pseudo-members.

    ``ratios``: prefix, target, ratio; ``init``: id, m. Each round calls targets above the median of m members, scores a
    prefix by the AUC of its ratios against those, and sets m to less that score. Ranks of ratios inside a prefix do not
    change, so they are computed once; a round is a join and two sums.
    """
    w = Window.partitionBy("prefix").orderBy("ratio")
    ties = F.count(F.lit(1)).over(Window.partitionBy("prefix", "ratio"))
    ranks = settle(ratios.where("ratio is not null and not isnan(ratio)").select("prefix", "target", (F.rank().over(w) + (ties - 1) / 2.0).alias("r")))
    m = init.select("id", F.coalesce(F.nanvl("m", F.lit(0.0)), F.lit(0.0)).alias("m"))
    for _ in range(rounds):
        half = quantile(m.groupBy(F.col("m").alias("value")).agg(F.count(F.lit(1)).alias("n")), 0.5).withColumnRenamed("quantile", "half")
        pseudo = m.crossJoin(half).select(F.col("id").alias("target"), (F.col("m") > F.col("half")).alias("member"))
        p, n = F.count_if("member"), F.count_if(~F.col("member"))
        score = F.try_divide(F.sum(F.when(F.col("member"), F.col("r")).otherwise(0.0)) - p * (p + 1) / 2.0, (p * n).cast("double"))
        new = ranks.join(pseudo, "target").groupBy("prefix").agg((-score).alias("new"))
        m = settle(m.join(new, m.id == new.prefix, "left").select("id", F.coalesce("new", F.lit(0.0)).alias("m")))
    return m


#: The scores that iterations can start from.
INITS = ("loss", "zlib", "mink", "minkpp")


def starting_scores(stats: DataFrame, texts: DataFrame, k: float = 0.2) -> DataFrame:
    """id and INITS: mean log-probability, their sum for each compressed byte, and the means of the ``k`` smallest, plain and standardised. ``texts``: id, text."""
    from lexaudit.functions.vectorised import zlib_length

    lp = F.col("lp")
    rows = stats.join(texts.select("id", zlib_length("text").alias("__bytes")), "id")
    zlib = F.try_divide(A.total(lp), F.col("__bytes").cast("double"))
    return rows.select("id", A.mean(lp).alias("loss"), zlib.alias("zlib"), A.min_k(lp, k).alias("mink"), A.min_k_plus(lp, F.col("mu"), F.col("sigma"), k).alias("minkpp"))


def choose_start(dev: DataFrame, by: Sequence[str], inits: Sequence[str] = INITS) -> DataFrame:
    """by, init, auc: the start whose pooled development scores (member and a column for each of ``inits``) have the largest AUC; ties: the first of ``inits``."""
    place = F.create_map(*[x for k, name in enumerate(inits) for x in (F.lit(name), F.lit(-k))])
    long = dev.select(*by, "member", F.explode(F.map_from_arrays(F.array(*map(F.lit, inits)), F.array(*[F.col(c).cast("double") for c in inits]))).alias("init", "score"))
    cells = auc(tally(long, [*by, "init"]), [*by, "init"]).where("auc is not null")
    best = cells.groupBy(*by).agg(F.max(F.struct("auc", place[F.col("init")].alias("place"), "init")).alias("b"))
    return best.select(*by, "b.init", "b.auc")


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", components: int | None = None):
    """Median-imputed, min-max scaled features, optionally centred and projected, and an L2 logistic regression of unit strength.

    The intercept is penalised like any weight: it is a constant feature.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, Imputer, MinMaxScaler, SQLTransformer, StandardScaler, VectorAssembler

    names = [f"__i_{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=names), VectorAssembler(inputCols=names, outputCol="__raw"), MinMaxScaler(inputCol="__raw", outputCol="__scaled")]
    last = "__scaled"
    if components:
        stages += [StandardScaler(withMean=True, withStd=False, inputCol=last, outputCol="__centred"), PCA(k=min(components, len(features)), inputCol="__centred", outputCol="__pca")]
        last = "__pca"
    stages += [SQLTransformer(statement="SELECT *, 1.0 AS __one FROM __THIS__"), VectorAssembler(inputCols=[last, "__one"], outputCol="__all")]
    n = rows.count()
    stages.append(LogisticRegression(featuresCol="__all", labelCol=label, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, fitIntercept=False, probabilityCol="__p"))
    return Pipeline(stages=stages).fit(rows)


def logistic_scores(model, rows: DataFrame, name: str = "score") -> DataFrame:
    """rows with the fitted probability of the positive class under ``name``."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*rows.columns, vector_to_array("__p")[1].alias(name))
