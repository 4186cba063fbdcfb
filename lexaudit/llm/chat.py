"""Chat logs as events, folded into final messages and rendered with a loss mask. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of this template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that steer common chat models; none may come out of a text unbroken.
CONTROLS = r"</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z0-9_.:-]+\|>|<(?:start|end)_of_turn>|\[/?(?:SYSTEM_PROMPT|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\]"
LOSS_ROLE = "assistant"

EVENTS = "conv_id, seq, msg_id, kind (message, delta, edit, regenerate or delete), role, text"


def escape(text: Column) -> Column:
    r"""Doubles every ``\`` and puts one after the first character of every control string; ``unescape`` undoes it."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?=(?<=<)(?:/?s>|</?SYS>>|\|[A-Za-z0-9_.:-]+\|>|(?:start|end)_of_turn>)|(?<=\[)/?(?:INST|SYSTEM_PROMPT|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, msg_id, kind, role, text) to final messages (conv_id, pos, msg_id, role, text).

    Events of a message are taken by seq: ``message`` and ``edit`` set its text, ``delta`` appends to it, ``regenerate``
    empties it for the deltas that follow, ``delete`` removes the message (a later event but a delta brings it back). A
    message stands where its first event stood; its role is the last non-null one. Ties of seq go by kind, role and text,
    so the result does not hang on the order of rows; exact repetitions of an event count again. Null text counts as empty,
    null role as none, null kind as ``message``. A null msg_id names each event's seq as its message.

    Events are grouped by conversation and message, so a long conversation is spread until its messages are final.
    """
    e = events.select(
        "conv_id", "seq",
        F.coalesce(F.col("msg_id").cast("string"), F.concat(F.lit("seq:"), F.col("seq").cast("string")), F.lit("seq:")).alias("msg_id"),
        F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    start = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("parts"), F.lit(True).alias("live"))

    def step(state: Column, x: Column) -> Column:
        parts = F.when(x["kind"] == "delta", F.concat(state["parts"], F.array(x["text"]))).when(x["kind"].isin("regenerate", "delete"), F.array().cast("array<string>")).otherwise(F.array(x["text"]))
        live = F.when(x["kind"] == "delta", state["live"]).otherwise(x["kind"] != "delete")
        return F.struct(F.coalesce(x["role"], state["role"]).alias("role"), parts.alias("parts"), live.alias("live"))

    folded = e.groupBy("conv_id", "msg_id").agg(log.alias("log")).select("conv_id", "msg_id", F.col("log")[0]["seq"].alias("pos"), F.aggregate("log", start, step).alias("end"))
    return folded.where("end.live").select("conv_id", "pos", "msg_id", F.col("end.role").alias("role"), F.array_join("end.parts", "").alias("text"))


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Messages (conv_id, pos, msg_id, role, text) to conv_id, formatted and loss_spans, one row for each conversation.

    A turn is TURN, role, BODY, text, END; role and text are escaped, so that no control string is in ``formatted`` but the
    template's own. ``loss_spans``: start and end (code points of ``formatted``) of the texts of ``loss_role``, in order,
    without the marks. A conversation comes out as one row, so one task builds it; nothing else is gathered.

    Turns stand by pos (null first), then msg_id, role and text; messages that repeat pos and msg_id all stay. Messages of
    a null conv_id are one conversation. Null role and null text count as empty; other columns are not read.
    """
    turn = F.struct("pos", "msg_id", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("role", F.lit(""))).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["head"], F.lit(BODY), t["body"], F.lit(END))), "")
    marks, tail = len(TURN) + len(BODY), len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + marks + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + tail).alias("at"), F.when(t["role"] == loss_role, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return turns.select("conv_id", text.alias("formatted"), F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text, as read from ``formatted`` and ``loss_spans`` alone.

    Row by row: null and repeated conv_ids stay as they are. A null ``formatted`` gives null turns and text.
    """
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    turns = F.transform(blocks, lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(TURN) + 1, F.length(x)), BODY, 1)).alias("role"), unescape(F.substring(x, F.locate(BODY, x) + len(BODY), F.length(x))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return rendered.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
