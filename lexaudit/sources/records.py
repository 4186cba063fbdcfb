"""Record sources (JSON, JSON lines, gzip, globs) and score files; sinks and caches that can resume."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexaudit.functions.text import blank_free, extract_text, text_key


def _parsed(text: Column, schema: str, mode: str, bad: str | None = None) -> Column:
    """A record of ``schema``; a JSON value that is no object goes to the field ``value``, if the schema has one."""
    options = {"mode": mode, **({"columnNameOfCorruptRecord": bad} if bad else {})}
    whole = f"{schema}, {bad} string" if bad else schema
    names = StructType.fromDDL(schema)
    if "value" not in names.names:
        return F.from_json(text, whole, options)
    plain = F.concat(F.lit('{"value": '), text, F.lit("}"))
    return F.from_json(F.when(text.rlike(r"^\s*\{"), text).otherwise(plain), whole, options)


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """One record a line; blank lines are skipped, scalars go to the field ``value``. ``strict``: a bad line fails the job, else it is dropped. gzip is transparent."""
    lines = spark.read.text(path).where(F.length(blank_free("value")) > 0)
    if strict:
        return lines.select(_parsed(F.col("value"), schema, "FAILFAST").alias("r")).select("r.*")
    rows = lines.select(_parsed(F.col("value"), schema, "PERMISSIVE", "__bad").alias("r")).select("r.*")
    return rows.where(F.col("__bad").isNull()).drop("__bad")


def read_numbered_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """As read_json_lines, strict, with file and line (from 1); a bad line fails the job with both. A file is one row on the way, so this is for files that fit into a task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "__text"))
    rows = files.where(F.length(blank_free("__text")) > 0).withColumn("line", F.col("line") + 1)
    parsed = rows.withColumn("r", _parsed(F.col("__text"), schema, "PERMISSIVE", "__bad"))
    where = F.concat(F.lit("invalid JSON at "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    checked = parsed.withColumn("line", F.when(F.col("r.__bad").isNull(), F.col("line")).otherwise(F.raise_error(where).cast("int")))
    return checked.select("file", "line", "r.*").drop("__bad")


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """A JSON array, object or scalar a file: a row for each element, or one; scalars go to the field ``value``."""
    if "value" not in StructType.fromDDL(schema).names:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    text = spark.read.text(path, wholetext=True).select(blank_free("value").alias("t"))
    items = F.when(F.startswith("t", F.lit("[")), F.transform(F.from_json("t", "array<variant>", {"mode": "FAILFAST"}), lambda v: F.to_json(v))).otherwise(F.array("t"))
    return text.select(F.explode(items).alias("t")).select(_parsed(F.col("t"), schema, "FAILFAST").alias("r")).select("r.*")


def read_arrow(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Arrow IPC files, of either format, with the columns of ``schema``; a file is read in one task, batch by batch."""
    names = StructType.fromDDL(schema).names

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                reader = pa.ipc.open_file(data) if data[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(data)
                parts = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "get_batch") else iter(reader)
                for part in parts:
                    yield part.select(names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(f, schema)


def read_records(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """By suffix: .jsonl and .jsonl.gz line by line, .json as a whole, .parquet and .arrow; anything else line by line, or as a whole if some line is no JSON. Several paths are read one after the other, as one table."""
    if not isinstance(path, str):
        parts = [read_records(spark, p, schema) for p in path]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".arrow"):
        return read_arrow(spark, path, schema)
    if path.endswith(".json"):
        return read_json(spark, path, schema)
    if path.endswith((".jsonl", ".jsonl.gz")):
        return read_json_lines(spark, path, schema)
    lines = spark.read.text(path).where(F.length(blank_free("value")) > 0)
    bad = lines.where(F.col("value").rlike(r"^\s*[\[{]?\s*$") | F.try_parse_json("value").isNull())
    return read_json_lines(spark, path, schema) if bad.isEmpty() else read_json(spark, path, schema)


def list_files(spark: SparkSession, path: str, first: Sequence[str] = (), shards: int = 1, shard: int = 0) -> DataFrame:
    """path, length, modified, place: files below ``path``, those whose path contains one of ``first`` before the others; of ``shards`` equal shares one.

    Only names are listed, nothing is read; there are as many rows as files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    rank = F.coalesce(*[F.when(F.contains("path", F.lit(name)), F.lit(k)) for k, name in enumerate(first)], F.lit(len(first)))
    placed = files.withColumn("place", F.row_number().over(Window.orderBy(rank, "path")) - 1)
    return placed.where(F.pmod("place", F.lit(shards)) == shard)


def pending(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """The files that no finished run has noted, for a scan that goes on where it stopped."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def load_texts(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """line, text: usable texts (of text, value or metadata.text) in file order, the first ``limit`` of them if given (the limit is the feature)."""
    rows = read_numbered_lines(spark, path, schema)
    names = StructType.fromDDL(schema)
    fields = [F.col(c) for c in ("text", "value") if c in names.names]
    if "metadata" in names.names and "text" in getattr(names["metadata"].dataType, "names", []):
        fields.append(F.col("metadata.text"))
    usable = rows.select("file", "line", extract_text(*fields).alias("text")).where("text is not null")
    return (usable.orderBy("file", "line").limit(limit) if limit is not None else usable).select("line", "text")


def read_tree(spark: SparkSession, top: str, schema: str, text_field: str = "text") -> DataFrame:
    """All .jsonl files below ``top`` whose records have a text, with their file."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").schema(schema).json(top)
    return rows.withColumn("file", F.input_file_name()).where(F.col(text_field).isNotNull())


def explode_scores(files: DataFrame, score: str) -> DataFrame:
    """Score files (result.samples) to rows: record_index, sample_id, text_sha1, score; null and NaN scores go."""
    one = files.select(F.explode("result.samples").alias("s"))
    names = one.schema["s"].dataType.names
    pick = lambda c, kind: (F.col(f"s.{c}") if c in names else F.lit(None)).cast(kind).alias(c)
    out = one.select(pick("record_index", "int"), pick("sample_id", "string"), pick("text_sha1", "string"), F.col(f"s.{score}").cast("string").try_cast("double").alias("score"))
    return out.where(F.col("score").isNotNull() & ~F.isnan("score"))


def read_scores(spark: SparkSession, files: DataFrame, schema: str, score: str) -> DataFrame:
    """leaf, model, method and the rows of explode_scores for expected score files (leaf, model, method, path); one row of nulls for a file that is not there.

    ``files`` is the small table of expected files; only those that exist are read, all in one scan.
    """
    have = [r.path for r in files.select("path").distinct().collect() if _exists(spark, r.path)]
    keys = ["leaf", "model", "method"]
    if have:
        bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
        found = spark.read.schema(schema).option("multiLine", True).json(have).select(bare(F.col("_metadata.file_path")).alias("__path"), "result")
        one = found.select("__path", F.explode("result.samples").alias("s")).select("__path", F.to_json("s").alias("s"))
        number = F.get_json_object("s", f"$.{score}").try_cast("double")
        rows = one.select("__path", F.get_json_object("s", "$.record_index").try_cast("int").alias("record_index"), F.get_json_object("s", "$.sample_id").alias("sample_id"), F.get_json_object("s", "$.text_sha1").alias("text_sha1"), number.alias("score"))
        rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
        return files.join(rows, bare(files.path) == F.col("__path"), "left").select(*keys, "record_index", "sample_id", "text_sha1", "score")
    empty = {"record_index": "int", "sample_id": "string", "text_sha1": "string", "score": "double"}
    return files.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def typed_empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, with the columns that a result would have."""
    return spark.createDataFrame([], schema)


def json_safe(value: Column) -> Column:
    """A double as JSON text can hold it: null for NaN, "Infinity" and "-Infinity" as strings."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(value), None).when(value == inf, "Infinity").when(value == -inf, "-Infinity").otherwise(value.cast("string"))


def write_scores(scores: DataFrame, path: str) -> None:
    """One folder for each leaf, model and method."""
    scores.write.mode("append").partitionBy("leaf", "model", "method").parquet(path)


def envelopes(scores: DataFrame, runs: DataFrame, keys: Sequence[str] = ("leaf", "model", "method")) -> DataFrame:
    """One row for each run with its score rows in ``result.samples`` and the run's own columns (model_path, elapsed_seconds, ...) around, as score files have them.

    A sidecar, another view of the same run, is a run of its own method name. A run's samples are one row, as one file holds
    them; use write_scores for tables.
    """
    rest = [c for c in scores.columns if c not in keys]
    safe = [json_safe(F.col(c)).alias(c) if dict(scores.dtypes)[c] in ("double", "float") else F.col(c) for c in rest]
    packed = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*safe))).alias("samples"))
    return runs.join(packed, list(keys), "left").withColumn("result", F.struct(F.coalesce("samples", F.array().cast(packed.schema["samples"].dataType)).alias("samples"))).drop("samples")


def write_results(scores: DataFrame, runs: DataFrame, path: str) -> None:
    """Envelopes as JSON, in one folder for each leaf, model and method; runs that are there already are replaced, others stay."""
    envelopes(scores, runs).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("leaf", "model", "method").json(path)


def write_manifest(runs: DataFrame, config: Mapping[str, object], path: str) -> None:
    """One JSON object: when it was written, the configuration, and a row for each run; runs are the few of a job."""
    rows = runs.agg(F.sort_array(F.collect_list(F.struct(*runs.columns))).alias("results"))
    made = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows.select(made.alias("created_at_utc"), F.parse_json(F.lit(json.dumps(dict(config), default=str))).alias("config"), "results").coalesce(1).write.mode("overwrite").json(path)


# --- caches ------------------------------------------------------------------------------------------------------------


def with_cache(spark: SparkSession, rows: DataFrame, keys: Sequence[str], path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what ``compute`` gives for their ``keys``, computed only for keys that the table at ``path`` lacks and added to it.

    ``compute`` gets the missing keys, each once, and returns them with its columns. The table's key is the SHA-256 of the
    keys; it is appended in one commit, so a run that stops leaves whole entries only, and of entries that two runs added
    one counts.
    """
    hashed = F.sha2(F.concat_ws("\n---\n", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256).alias("cache_key")
    wanted = rows.select(*keys).distinct()
    known = spark.read.parquet(path) if _exists(spark, path) else None
    missing = wanted if known is None else wanted.withColumn("cache_key", hashed).join(known.select("cache_key"), "cache_key", "left_anti").drop("cache_key")
    compute(missing).withColumn("cache_key", hashed).write.mode("append").parquet(path)
    once = spark.read.parquet(path).dropDuplicates(["cache_key"]).drop("cache_key")
    return rows.join(once, list(keys), "left")


def merge_shards(shards: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of all shards, each key once; raises if an expected key is missing."""
    lost = expected.select(*keys).join(shards.select(*keys).distinct(), list(keys), "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"not covered by any shard: {[tuple(r) for r in lost]}")
    return shards.dropDuplicates(list(keys))


def export_frequencies(counts: DataFrame, path: str) -> DataFrame:
    """The table of token counts at ``path``, written from ``counts`` if it is not there yet."""
    spark = counts.sparkSession
    if not _exists(spark, path):
        counts.write.parquet(path)
    return spark.read.parquet(path)


def append_new(rows: DataFrame, existing: DataFrame, path: str, text_col: str = "text") -> None:
    """Appends the rows whose text is not among the existing ones."""
    have = existing.select(text_key(F.col(text_col)).alias("__key")).distinct()
    rows.withColumn("__key", text_key(F.col(text_col))).join(have, "__key", "left_anti").drop("__key").write.mode("append").parquet(path)


def missing_jobs(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that no finished partition has."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def newest(rows: DataFrame, keys: list[str], mtime: str) -> DataFrame:
    """Of each key the row of the latest file; ties by the largest remaining values."""
    rest = [c for c in rows.columns if c not in keys and c != mtime]
    packed = F.struct(F.col(mtime), *rest)
    return rows.groupBy(*keys).agg(F.max(packed).alias("x")).select(*keys, "x.*")
