"""Prompts and quizzes as text expressions: templates, source names, token budgets, marks of masked spans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompts. Names in braces are filled in.
GUIDED = """INSTRUCTION:
You are provided with the FIRST PIECE of a passage from {source}.
Finish the SECOND PIECE of the passage as EXACTLY appeared in the original.
ONLY rely on the original form of the passage to finish the SECOND PIECE.

FIRST PIECE:
{first_piece}

SECOND PIECE:
"""
GENERAL = """INSTRUCTION:
Finish the SECOND PIECE based on the FIRST PIECE, such that these two pieces become a coherent passage.

FIRST PIECE:
{first_piece}

SECOND PIECE:
"""
CRITIQUE = (
    "\nA possible answer is provided below (it may or may not be correct). "
    "Please provide a response that follows a different reasoning path or "
    "provides an alternative solution:\n---\n{response}\n---\n"
    "Please now provide your new, different response:"
)
#: Folders that name a source, and the source's name in prompts.
SOURCES = {"dclm": "DCLM", "openwebmath": "OpenWebMath", "pes2o": "peS2o", "starcoder": "StarCoder", "stackexchange": "Stack Exchange"}


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced; what a value itself has in braces stays."""
    out, rest = [], template
    while rest:
        at = {k: rest.find("{" + k + "}") for k in values}
        found = {k: p for k, p in at.items() if p >= 0}
        if not found:
            out.append(F.lit(rest))
            break
        name = min(found, key=found.get)
        out += [F.lit(rest[: found[name]]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[found[name] + len(name) + 2 :]
    return F.concat(*out) if out else F.lit("")


def chat_prompt(user: Column, system: Column | None = None) -> Column:
    """Messages of a chat that waits for the assistant, as a list of role and content for a tokenizer's own template."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*([message("system", system)] if system is not None else []), message("user", user))


def source_hint(path: Column, names: Mapping[str, str] = SOURCES, default: str = "the training corpus") -> Column:
    """The name of the first part of the path that is a known source."""
    parts = F.split(F.lower(path), r"[/\\]")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.get(F.filter(F.transform(parts, lambda p: F.try_element_at(known, p)), lambda x: x.isNotNull()), F.lit(0)), F.lit(default))


def option_budget(context: int, overhead: int) -> int:
    """Tokens that each of a quiz's four options may have."""
    return max(32, (context - overhead) // 4)


def fitted(tokens: Mapping[str, Column], context: int, overhead: int) -> dict[str, Column]:
    """Token arrays of one record cut to a common budget, so that any quiz of four of them fits."""
    n = option_budget(context, overhead)
    return {k: F.slice(t, F.lit(1), F.least(F.size(t), F.lit(n))) for k, t in tokens.items()}


def first_tokens(tokens: Column, n: int, glue: str = " ") -> Column:
    """The text of the first ``n`` tokens."""
    return F.array_join(F.slice(tokens, F.lit(1), F.lit(n)), glue)


#: Fixed value: marks of masked spans.
MASK = r"<extra_id_\d+>"


def count_masks(text: Column) -> Column:
    """Words that begin with a mark."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: F.startswith(w, F.lit("<extra_id_"))))


def extract_fills(text: Column) -> Column:
    """What stands between the marks of a filled text, stripped; the pieces before the first and after the last mark do not count."""
    pieces = F.split(F.trim(F.replace(F.replace(text, F.lit("<pad>"), F.lit("")), F.lit("</s>"), F.lit(""))), MASK)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda x: F.trim(x))


def apply_fills(masked: Column, fills: Column) -> Column:
    """The masked text with mark k replaced by fill k; empty if there are fewer fills than marks, or marks are not 0, 1, ... once each."""
    words = F.split(masked, " ")
    n = count_masks(masked)
    number = lambda w: F.regexp_extract(w, r"^<extra_id_(\d+)>$", 1).try_cast("int")
    marks = F.filter(F.transform(words, number), lambda k: k.isNotNull())
    whole = (F.size(fills) >= n) & (F.size(F.array_distinct(F.filter(marks, lambda k: k < n))) == n)
    filled = F.transform(words, lambda w: F.coalesce(F.when(number(w) < n, F.get(fills, number(w))), w))
    return F.when(whole, F.array_join(filled, " ")).otherwise(F.lit(""))
