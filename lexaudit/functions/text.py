"""Text expressions: stripping, fields, names, tokens, n-grams, keys, dates. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which name in a lower-cased path stands for which kind of data, in this order.
PATH_KINDS = (("benchmark_dev", "paragraph"), ("pretraining", "paragraph"), ("midtraining", "paragraph"), ("chosen", "paragraph"), ("rejected", "paragraph"), ("dpo", "dpo"), ("posttraining", "paragraph"))
#: Patterns of a question, an answer and the mark before a generated option.
QUESTION = r"(?Us)Question:\s*(.*?)(?:\nReasoning:|\nAnswer:|$)"
ANSWER = r"(?Us)Answer:\s*(.*)$"
OPTION = r"(?U)(?<![\w*])\**([A-D])\)\**[ \t]*\n?"


def blank_free(column: Column | str) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def extract_text(*fields: Column) -> Column:
    """The first field that is not blank, stripped."""
    return F.coalesce(*[blank_to_null(f) for f in fields])


def sample_id(given: Column, index: Column) -> Column:
    """The given string, stripped, or ``sample_<index>``."""
    return F.coalesce(F.nullif(blank_free(given), F.lit("")), F.concat(F.lit("sample_"), index.cast("string")))


def kind_of_path(path: Column, strict: bool = False) -> Column:
    """The kind of data that a path stands for; a path without a rule is null, or fails the job if ``strict``."""
    low = F.lower(path)
    out = F.raise_error(F.concat(F.lit("no kind of data for path "), path)).cast("string") if strict else F.lit(None).cast("string")
    for name, kind in reversed(PATH_KINDS):
        out = F.when(F.contains(low, F.lit(name)), kind).otherwise(out)
    return out


def normal_kind(kind: Column) -> Column:
    """Stripped and lower-cased; ``auto`` if null or blank."""
    return F.coalesce(blank_to_null(F.lower(kind)), F.lit("auto"))


def blank_to_null(column: Column | str) -> Column:
    return F.nullif(blank_free(column), F.lit(""))


def safe_name(name: Column) -> Column:
    """A file name: other characters than letters, digits, dot, dash to ``_``; ``unknown`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def dataset_name(stem: Column) -> Column:
    out = F.regexp_replace(stem, r"_eval$", "")
    return F.regexp_replace(F.regexp_replace(out, r"_test_", "_"), r"_test$", "")


def _found(text: Column, given: Column | None, kind: Column | str, pattern: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    from_text = F.when(text.rlike(pattern), blank_to_null(F.regexp_extract(text, pattern, 1))).when(kind == "auto", text)
    return F.when(kind == "paragraph", text).otherwise(from_text if given is None else F.coalesce(blank_to_null(given), from_text))


def question_of(text: Column, given: Column | None = None, kind: Column | str = "auto") -> Column:
    """Of a stripped text: all of it if ``kind`` is paragraph; else the ``given`` field, else what follows ``Question:``; without such a mark all of an auto text, null otherwise."""
    return _found(text, given, kind, QUESTION)


def answer_of(text: Column, given: Column | None = None, kind: Column | str = "auto") -> Column:
    """The same for what follows ``Answer:``."""
    return _found(text, given, kind, ANSWER)


def critique_question(prompt: Column, text: Column, kind: Column) -> Column:
    """The prompt of preference data, the text of any other."""
    return F.when(kind == "dpo", blank_to_null(prompt)).otherwise(text)


def text_key(text: Column) -> Column:
    """20 hex digits of the SHA-1 of the stripped text."""
    return F.substring(F.sha1(blank_free(text)), 1, 20)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def marked_words(text: Column) -> Column:
    r"""``\w+`` runs and runs of other non-blank characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams joined by a blank; none if there are fewer tokens. Give it a materialised column: it is used often."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'])")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")


def repeated(text: Column, copies: int) -> Column:
    return F.array_join(F.array_repeat(text, copies), " ")


def head_and_tail(text: Column, n: int) -> Column:
    """head: the first ``n`` words of a longer text, joined by blanks, else the text; tail: the rest with a blank before it, else empty."""
    w = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    long = F.size(w) > n
    head = F.when(long, F.array_join(F.slice(w, 1, n), " ")).otherwise(text)
    tail = F.when(long, F.concat(F.lit(" "), F.array_join(F.slice(w, F.lit(n + 1), F.size(w)), " "))).otherwise(F.lit(""))
    return F.struct(head.alias("head"), tail.alias("tail"))


def options(text: Column) -> Column:
    """Generated options ``A) ... D) ...``, on lines of their own or not, as a map; the last of a letter wins, missing ones are empty."""
    parts = F.split(F.regexp_replace(F.translate(text, "\x01\x02", ""), OPTION, "\x01$1\x02"), "\x01")
    pick = lambda letter: F.coalesce(blank_free(F.substring(F.try_element_at(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.startswith(p, F.lit(letter + "\x02"))), F.lit(-1)), 3, 1 << 30)), F.lit(""))
    return F.create_map(*[x for c in "ABCD" for x in (F.lit(c), pick(c))])


#: Date formats tried after ISO 8601; of these only the day counts.
DAY_FORMATS = ("yyyy/M/d", "yyyyMMdd", "d MMM yyyy HH:mm:ss", "d MMM yyyy")


def day_number(text: Column) -> Column:
    """ISO text as a fractional ordinal day (1 is the first day of year 1), its time as written, whatever its zone; days in DAY_FORMATS, with or without a weekday; plain numbers as they are; else null."""
    bare = blank_free(text)
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(F.regexp_replace(bare, r"(Z|[+-]\d{2}:?\d{2})$", "")))
    whole = F.coalesce(*[F.to_date(F.try_to_timestamp(F.regexp_replace(bare, r"^[A-Za-z]{3}, ", ""), F.lit(f))) for f in DAY_FORMATS])
    fraction = (F.hour(iso) * 3600 + F.minute(iso) * 60 + F.second(iso)) / F.lit(86400.0)
    return F.coalesce(F.unix_date(F.to_date(iso)) + 719163 + fraction, F.unix_date(whole) + F.lit(719163.0), bare.try_cast("double"))


def shifted_name(leaf: Column) -> Column:
    """The shifted counterpart of a matched leaf, null if it has none."""
    return F.when(F.contains(leaf, F.lit("_matched")), F.replace(leaf, F.lit("_matched"), F.lit("_shifted")))
