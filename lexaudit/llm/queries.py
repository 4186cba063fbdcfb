"""The queries of the training-data operators over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaudit.llm import ann, chat, exact, langid, minhash, mixing, packing, ppm, suffix, urlfilter
from lexaudit.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(packing.TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(read_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


PROBE = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    # each row is a message of its own, those of one turn too; null turns come last, as in the SQL
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    log = rows.unionByName(probe).select("conv_id", place.alias("seq"), place.alias("msg_id"), F.lit("message").alias("kind"), "role", "text")
    back = chat.read_back(chat.render(chat.fold_events(log)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs).select(*docs.columns, "copy", "copies", "mix_key")


def id_fold(n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.score(read_table(spark, sf_dir, "documents"), id_fold(5) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(100)) == 0)


HOST_RULES = (
    urlfilter.HostRule("block", "com", "/en/"),
    urlfilter.HostRule("allow", "example.com", "/en/7"),
    urlfilter.HostRule("block", "net", "/de/"),
    urlfilter.HostRule("block", "example.net", "/de/8"),
    urlfilter.HostRule("block", "org", "/es/"),
)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"), HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    # a span may begin or end inside a character: its other bytes show as the replacement character in ``text``
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left.alias("text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_fold(3) == 1
    found = langid.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("norm_sha256").alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_minhash": op2_minhash,
    "op3_chat": op3_chat,
    "op4_mix": op4_mix,
    "op5_ppm": op5_ppm,
    "op6_ann": op6_ann,
    "op7_urls": op7_urls,
    "op8_suffix": op8_suffix,
    "op9_language": op9_language,
    "op10_exact": op10_exact,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(regexp_split_to_array({LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
#: RE2 knows no lookahead: a control string is taken whole here, which is the same unless two of them overlap.
ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '([<\[])((?:/?s>|</?SYS>>|\|[A-Za-z0-9_.:-]+\|>|(?:start|end)_of_turn>)|/?(?:INST|SYSTEM_PROMPT|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\])', '\1\\\2', 'g')"
HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _urls_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    hosts = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda pick: " ".join(f"WHEN (host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}) THEN {quoted(pick(r))}" for r in hosts)
    patterns = " ".join(f"WHEN regexp_matches(low, {quoted(p.pattern)}) THEN {quoted(p.verdict)}" for p in reversed(urlfilter.PATTERNS))
    return f"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, {LOWER.format("coalesce(url, '')")} AS low FROM pages),
        r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT page_id, low, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, CASE {case(lambda r: r.name)} END AS rule, CASE {case(lambda r: r.verdict)} {patterns} ELSE 'allow' END AS verdict FROM h
    """


ORACLES: dict[str, str] = {
    "op2_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)
    """,
    "op3_chat": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
        a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
                     sum({len(chat.TURN) + len(chat.BODY) + len(chat.END)} + length({ESCAPED.format("role")}) + length({ESCAPED.format("text")})) AS chars FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM a
    """,
    "op4_mix": f"""
        WITH s AS (SELECT coalesce(source, '') AS src, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY 1),
        r AS (SELECT src, sum(size) OVER () * pow(size, {mixing.TEMPERATURE}) / (sum(CASE WHEN size > 0 THEN pow(size, {mixing.TEMPERATURE}) ELSE 0 END) OVER () * size) AS rate FROM s WHERE size > 0),
        p AS (SELECT src, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf FROM (SELECT src, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::INT)) AS k FROM r)),
        d AS (SELECT *, coalesce(source, '') AS src, ({HASH.format(f"'{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')")} + 0.5::DOUBLE) / 1152921504606846976::DOUBLE AS u FROM documents),
        c AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM p WHERE p.src = d.src AND cdf < u) AS copies FROM d),
        e AS (SELECT *, unnest(range(copies)) AS copy FROM c)
        SELECT doc_id, text, lang, source, n_chars, copy, copies, {HASH.format(f"'{mixing.SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy")} AS mix_key FROM e
    """,
    "op6_ann": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.x, v.x) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
    """,
    "op7_urls": _urls_sql(),
    "op10_exact": f"""
        WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
    """,
}
