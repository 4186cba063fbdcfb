"""Mixing sources to target weights by Poisson replication. Built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import cut, heavy_join

SEED = "mix-1"
#: Without given weights a source weighs its size to this power.
TEMPERATURE = 0.5
#: Entries of a block of the distribution function.
CDF_BLOCK = 256


def hash_number(*columns: Column | str) -> Column:
    """60 bits of the MD5 of the columns joined by ``:``, as a long."""
    text = F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, ... until far beyond any uniform number of 60 bits, as an array; built in blocks, so that its cost grows with its length."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = s["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    def block(s: Column, b: Column) -> Column:
        fresh = F.struct(s["log_p"].alias("log_p"), s["sum"].alias("sum"), F.array().cast("array<double>").alias("cdf"))
        end = F.aggregate(F.sequence(b * CDF_BLOCK + 1, F.least((b + 1) * CDF_BLOCK, last)), fresh, step)
        return F.struct(end["log_p"].alias("log_p"), end["sum"].alias("sum"), F.concat(s["cdf"], F.array(end["cdf"])).alias("cdf"))

    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.array(F.exp(-rate))).alias("cdf"))
    blocks = F.sequence(F.lit(0), F.ceil(last / CDF_BLOCK).cast("int") - 1)
    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.flatten(F.aggregate(blocks, start, block, lambda s: s["cdf"])))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, source_col: str, text_col: str, epochs: float) -> DataFrame:
    """source, n_docs, size (code points), rate: the mean number of copies that brings each source to its weight."""
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.coalesce(*[F.when(F.col("__source") == s, F.lit(float(w))) for s, w in sorted(weights.items())], F.lit(0.0))
    sized = cut(sizes.withColumn("__weight", F.when(F.col("size") > 0, weight).otherwise(0.0)))
    total, all_weights = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0.0))).first()
    share = F.lit(epochs * total / all_weights) if all_weights else F.lit(0.0)
    return sized.select("__source", "n_docs", "size", F.when(F.col("size") > 0, share * F.col("__weight") / F.col("size")).otherwise(0.0).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    epochs: float = 1.0,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` plus copy (from 0), copies, rate and mix_key, globally shuffled by mix_key.

    A source of ``size`` code points and weight w gets the rate ``epochs * total size * w / (sum of weights * size)``; each
    document the number of copies at which a Poisson distribution of that mean exceeds the uniform number hashed from seed
    and id, so expected sizes follow the weights exactly and any run gives the same copies. ``weights``: by source, 0 if
    not named; None: size to the power TEMPERATURE. Copies are dealt by ranges of a hash of seed, id and copy.

    Null source counts as source "". Null text has size 0; a source of size 0 has rate 0. Null ids hash alike; rows that
    repeat an id get the same number of copies. Columns named as the added ones are replaced. A source that holds most
    rows is no hot key: its rate comes by broadcast, that of small sources by a shuffled join.
    """
    added = ["copy", "copies", "rate", "mix_key"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {*added, "__source", "__cdf", "__place", "n_docs", "size"}])
    rates = source_rates(docs, weights, source_col, text_col, epochs)
    total = rates.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    ready = cut(rates.select("__source", "n_docs", "rate", poisson_cdf(F.col("rate")).alias("__cdf")))
    rows = heavy_join(docs.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))), ready, "__source", "n_docs", total, id_col)
    uniform = (hash_number(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))) + F.lit(0.5)) / F.lit(float(2**60))
    counted = rows.withColumn("copies", F.transform(F.array(uniform), lambda u: F.size(F.filter("__cdf", lambda c: c < u)))[0].cast("long")).where("copies > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    out = out.withColumn("mix_key", hash_number(F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy")))
    out = out.select(*docs.columns, *added)
    # ranges of a uniform number need no sample of it
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col("mix_key") / F.lit(float(2**60)) * n), F.lit(n - 1)).cast("int")
    return out.withColumn("__place", place).repartitionById(n, "__place").drop("__place").sortWithinPartitions("mix_key")
