"""Evaluation inputs built from the standard tables: labels stand for membership, documents for texts, the benchmark for a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions.text import words
from lexaudit.operators import scoring
from lexaudit.sources.tables import read_table, spread


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, member, score (length in characters), other (length of the first line)."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    # cut before the join, which so moves no texts
    docs = docs.select("doc_id", "lang", "source", "n_chars", F.length(F.substring_index("text", "\n", 1)).alias("first_line"))
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("member"), F.col("n_chars").cast("double").alias("score"), F.col("first_line").cast("double").alias("other"))


def tokens(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """id, w: lower-cased words."""
    return scoring.tokens_of(spread(read_table(spark, sf_dir, table).select(key, "text")), key, F.col("text"))


#: Labels up to which their ids are broadcast; more are joined.
MAX_LABELS = 2_000_000


def membership_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, member."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("member"))
    return F.broadcast(labels) if labels.count() <= MAX_LABELS else labels


def unigram_stats(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """id, ids, lp, mu, sigma under the frequencies of all documents, add-one; documents without words have no row. ``among``: ids of the only documents to score."""
    frequencies = scoring.token_counts(tokens(spark, sf_dir))
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    if among is not None:
        docs = docs.join(among.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    # by the size of lp: a test of the words themselves would split each text once more
    return scoring.UnigramScorer(frequencies).score(scoring.tokens_of(docs, "doc_id", F.col("text"))).where(F.size("lp") > 0)


def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, w, low: case-keeping words and lower-cased words."""
    text = F.col("text")
    kept = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), kept.alias("w"), words(text).alias("low"))
