"""Jobs over leaves and model sizes: enumeration, names and paths, filters, cache keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions.text import dataset_name, safe_name

#: Model sizes, and the pairs of them that share a post-training mix.
SIZES = ("1b", "7b", "13b", "32b")
PAIRS = {"1b-32b": ("1b", "32b"), "7b-13b": ("7b", "13b")}
#: Leaves of all sizes (folder, name), of pairs, and those without a shifted variant.
PLAIN = (
    ("pretraining/dclm", "pretraining_dclm"), ("pretraining/pes2o", "pretraining_pes2o"), ("pretraining/openwebmath", "pretraining_openwebmath"),
    ("pretraining/starcoder", "pretraining_starcoder_java"), ("pretraining/starcoder", "pretraining_starcoder_python"),
    ("midtraining/stackexchange", "midtraining_stackexchange_math"), ("midtraining/stackexchange", "midtraining_stackexchange_stackoverflow"),
)
PAIRED = ("aya", "wildchat")
MATCHED_ONLY = (("midtraining/gsm8k", "midtraining_gsm8k"),)
REWARDED = ("cot-gsm8k", "gsm8k_no_cot", "cot-math", "math_no_cot")
#: Methods that need development data, and those that generate and so read longer contexts.
DEV_METHODS = ("recall", "camia", "camia_faithful", "camia_lr", "fsd")
GENERATING = ("neighborhood_attack", "dcq", "guided_instruction", "cdd", "selfcrit")
CONTEXTS = {True: 4096, False: 1024}


def leaf_table(spark: SparkSession, split: str, top: str = "benchmark", pairs_only: bool = False) -> DataFrame:
    """member, non_member, dev (paths below ``top``), sizes: the leaves of a split (matched or shifted).

    ``pairs_only``: of preference data the combined pair files, and of the rest the rewarded leaves only, for methods that
    compare answers; else chosen and rejected files on their own.
    """
    rows: list[tuple] = []

    def add(folder: str, name: str, sizes: Sequence[str], splits: bool) -> None:
        member, suffix = (f"member/{split}", f"_{split}") if splits else ("member", "")
        rows.append((f"{top}/{folder}/{member}/test/member_{name}{suffix}_test.jsonl", f"{top}/{folder}/non-member/test/non-member_{name}_test.jsonl", f"{top}/{folder}/non-member/dev/non-member_{name}_dev.jsonl", list(sizes)))

    if not pairs_only:
        for folder, name in PLAIN:
            add(folder, name, SIZES, True)
        for folder, name in MATCHED_ONLY if split == "matched" else ():
            add(folder, name, SIZES, False)
        for pair, sizes in PAIRS.items():
            for sub in PAIRED:
                add(f"posttraining/sft/{pair}", f"posttraining_sft_{pair}_{sub}", sizes, True)
    for sub in REWARDED if split == "matched" else ():
        add("posttraining/rlvr", f"posttraining_rlvr_{sub}", SIZES, False)
    for size in SIZES:
        for side in ("pair",) if pairs_only else ("chosen", "rejected"):
            add("posttraining/dpo", f"posttraining_dpo_{size}_{side}", (size,), True)
    return spark.createDataFrame(rows, "member string, non_member string, dev string, sizes array<string>")


def jobs_of(leaves: DataFrame, method: str, sizes: Sequence[str] = SIZES, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """data, size, is_member, method, dev, member_dev, context: one row for each file and size that a leaf allows."""
    sides = F.explode(F.array(F.struct(F.col("member").alias("data"), F.lit(True).alias("is_member")), F.struct(F.col("non_member").alias("data"), F.lit(False).alias("is_member")))).alias("f")
    rows = leaves.select(sides, F.explode("sizes").alias("size"), "dev", "member").select("f.*", "size", "dev", dev_path(F.col("member")).alias("member_dev")).where(F.col("size").isin(*sizes))
    return rows.where(keep_path(F.col("data"), include, exclude)).select("data", "size", "is_member", F.lit(method).alias("method"), F.when(F.lit(method in DEV_METHODS or method == "mia_tuner"), F.col("dev")).alias("dev"), F.when(F.lit(method == "mia_tuner"), F.col("member_dev")).alias("member_dev"), F.lit(CONTEXTS[method in GENERATING]).alias("context"))


def keep_path(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Paths that contain one of ``include`` (if any) and none of ``exclude``, in any case."""
    low = F.lower(path)
    has = lambda names: F.array_contains(F.array(*[F.contains(low, F.lit(n.lower())) for n in names]), F.lit(True))
    return (has(include) if include else F.lit(True)) & (~has(exclude) if exclude else F.lit(True))


def dev_path(path: Column) -> Column:
    """The development file that belongs to a test file."""
    return F.regexp_replace(F.replace(path, F.lit("/test/"), F.lit("/dev/")), r"_test\.jsonl$", "_dev.jsonl")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def result_path(top: str, data: Column, model: Column, method: Column) -> Column:
    """Where the scores of a file, model and method lie."""
    return F.concat_ws("/", F.lit(top), safe_name(dataset_name(stem_of(data))), safe_name(F.substring_index(model, "/", -1)), F.concat(safe_name(method), F.lit(".json")))


def fleet_tag(member_path: Column, split: str, dev: bool = False) -> Column:
    """The name of a leaf in one split: the member file's without ``member_`` and ``_test``, with the split if it lacks it."""
    bare = F.regexp_replace(stem_of(member_path), r"^member_", "")
    bare = F.regexp_replace(F.replace(bare, F.lit("_test_"), F.lit("_")), r"_test$", "")
    tag = F.when(F.contains(bare, F.lit(split)), bare).otherwise(F.concat(bare, F.lit(f"_{split}")))
    return F.concat(tag, F.lit("_dev")) if dev else tag


def fleet(spark: SparkSession, splits: Sequence[str] = ("matched", "shifted"), sizes: Sequence[str] = SIZES, keep: str = "", dev: bool = False) -> DataFrame:
    """split, size, tag, member, non_member: joint runs over both sides of each leaf, by tag."""
    out = None
    for split in splits:
        rows = leaf_table(spark, split).select(F.lit(split).alias("split"), F.explode("sizes").alias("size"), fleet_tag(F.col("member"), split, dev).alias("tag"), *[(dev_path(F.col(c)) if dev else F.col(c)).alias(c) for c in ("member", "non_member")])
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.col("size").isin(*sizes) & F.contains("tag", F.lit(keep)))


def model_size(model: Column) -> Column:
    """1b, 7b, ... as a model's name has it, else null."""
    return F.nullif(F.regexp_extract(F.lower(model), r"(?:^|[^0-9])(1b|7b|13b|32b)(?:[^0-9a-z]|$)", 1), F.lit(""))


def is_shifted(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("shifted"))


def is_non_member(path: Column) -> Column:
    return F.lower(path).rlike(r"non[-_]?member")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, with a line of dashes between them; null parts count as empty."""
    return F.sha2(F.concat_ws("\n---\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
