"""Chat formatting by event-sourced reconstruction.

A log has one row an event: (conv_id, message, seq, kind, role, text). Events
of a conversation are folded in order of ``seq``: ``delta`` appends to its
message, ``edit`` replaces the message's text, ``regenerate`` drops what the
message held and begins anew with its own text. The final messages are rendered
in order of ``message`` into one string with a mark for each turn, and the
spans of assistant text (the loss mask) are kept beside it.

Control strings inside roles and texts get one backslash after their first
character (more if they carry some already), which no real control string has;
taking one away again gives the text back exactly.

DataFrame expressions only. Events meet by (conversation, message) first;
a conversation's messages meet because they form one output value.

Defined results: a null text or role counts as empty; an unknown or null kind
counts as ``delta``; events with equal ``seq`` are folded in order of kind and
text; the role of a message is that of its last event that has one; a null
conversation id is a conversation of its own; an empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# The control strings of this template and of common others.
_TAIL = r"(/?(?:s>|INST\])|\|[A-Za-z_]+\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAIL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAIL}", r"$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of an event log."""
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    got = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role"))).alias("log"))
    # texts since the last event that starts the message anew, joined once
    start = F.aggregate("log", F.struct(F.lit(0).alias("at"), F.lit(0).alias("start")), lambda s, e: F.struct((s["at"] + 1).alias("at"), F.when(e["kind"].isin("edit", "regenerate"), s["at"]).otherwise(s["start"]).alias("start")), lambda s: s["start"])
    texts = F.transform(F.slice("log", start + 1, F.greatest(F.size("log"), F.lit(1))), lambda e: e["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return got.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (start, length in code points of the formatted string, assistant texts in order)."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    piece = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    length = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("message")
    before = F.coalesce(F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = piece.withColumn("start", before + F.length("head"))
    row = F.struct("message", F.concat("head", "body", F.lit(END)).alias("piece"), "start", F.length("body").alias("length"), (F.col("role") == "assistant").alias("loss"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts, formatted: read back from what ``render`` gives."""
    parts = F.split("formatted", r"<\|turn\|>")
    turns = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.split(F.regexp_replace(p, r"<\|end\|>$", ""), r"<\|text\|>"))
    said = F.transform(turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text")))
    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"])))
    return formatted.select("conv_id", said.alias("turns"), loss.alias("loss_texts"), "formatted")


def log_of(turns: DataFrame) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text): one delta a turn, ties by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return turns.select("conv_id", at.alias("message"), F.lit(0).cast("long").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def stream_of(turns: DataFrame, deltas: int = 16, least: int = 64) -> DataFrame:
    """An event log that leads to finished turns (conv_id, turn, role, text), as a chat writes it.

    A draft comes first and is regenerated; the text then arrives in up to
    ``deltas`` deltas of ``least`` characters or more. Every third message loses its
    last character on the way and is edited to its whole text at the end.
    """
    base = log_of(turns)
    text, edited = F.coalesce("text", F.lit("")), F.col("message") % 3 == 0
    length = F.length(text) - F.when(edited, F.least(F.length(text), F.lit(1))).otherwise(0)
    size = F.greatest(F.lit(least), F.ceil(length / deltas)).cast("int")

    def event(seq: Column, kind: str, said: Column, role: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"), role.cast("string").alias("role"))

    start = F.array(event(F.lit(0), "delta", F.lit("..."), F.col("role")), event(F.lit(1), "regenerate", F.lit(""), F.lit(None)))
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(length / size).cast("int") - 1, F.lit(0)))
    parts = F.transform(numbers, lambda k: event(k + 2, "delta", F.substring(text, k * size + 1, F.least(size, length - k * size)), F.lit(None)))
    end = F.when(edited, F.array(event(F.lit(deltas + 3), "edit", text, F.lit(None)))).otherwise(F.array_repeat(start[0], 0))
    return base.select("conv_id", "message", F.explode(F.concat(start, parts, end)).alias("event")).select("conv_id", "message", "event.seq", "event.kind", "event.role", "event.text")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))
