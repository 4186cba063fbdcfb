"""From raw documents to packed training sequences: language, exact copies, near copies, mixture, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm import exact, langid, minhash, mixing, packing
from lexaudit.llm.common import drop_path, read_table, shared_dir
from lexaudit.llm.queries import id_fold, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected as no text of any language if letters in its language make up less of its non-blank characters.
LEAST_LETTERS = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language stay, and ``lang`` becomes the language found; those mostly of other characters than letters of it go.

    Null, empty and letterless texts go. Without a labelled text to learn from no language is told: documents stay by their
    letters alone and keep their ``lang``. Repeated rows are judged alike; other columns than COLUMNS are dropped.
    """
    docs = docs.select(*COLUMNS)
    train = id_fold(3) != 1
    bare = F.length(F.regexp_replace("text", r"\s", ""))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{M}]", ""))
    if docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).isEmpty():
        return docs.where((letters > 0) & (letters >= LEAST_LETTERS * bare))
    found = langid.identify(docs, train).where((F.col("lang_pred") != langid.UND) & (F.col("score") * letters >= LEAST_LETTERS * bare))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased) stays: the one with the smallest id.

    Null text counts as empty, so one of all null and empty texts stays. Null ids lose against any id; of rows that repeat
    the id that stays, one does. Other columns than COLUMNS are dropped.
    """
    return exact.exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id (five-word shingles, similarity 0.8 or more).

    Texts without words are linked with nothing and stay, and so do rows with a null id. Rows that repeat an id are one
    document: they stay or go together. Other columns than COLUMNS are dropped.
    """
    docs = docs.select(*COLUMNS)
    found = minhash.minhash_components(docs).where("not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight: documents repeated by Poisson counts, in global random order.

    Null source counts as source ""; a source without any character has rate 0, so its documents go. Rows that repeat an
    id, null ids too, get the same number of copies. Other columns than COLUMNS are dropped.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids; those of one length follow each other in each file.

    Null and empty texts give the end id alone. Copies of a document are packed one by one, under its id.
    """
    return packing.pack(docs, tokenizer_path(packing.TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Language spans, near-duplicate components and tokenizer ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and goes once the next one is there."""
    docs = read_table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if last:
            drop_path(spark, f"{top}/{last}")
        last = name
    return docs
