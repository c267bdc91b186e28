"""Conversations rebuilt from their event logs and rendered as training text, in DataFrame functions only.

A log has one row for each thing that happened: (conversation, seq, event, message, role, text), with
`seq` of any orderable type. Events:

    start       opens a message with its role
    delta       adds text to the end of a message
    edit        puts a text in place of all that the message held
    regenerate  empties a message, for new deltas, and takes away every message that was opened after
                this one and before the regeneration

`fold` gives the final messages. The log is dealt by (conversation, message), so that a long conversation is
spread over its messages; within one the last edit or regeneration bounds what counts, by a window
that spills, and only later text is gathered. Messages are then dealt by conversation and sorted by the seq of
their first event; a running maximum finds those taken away. `render` writes each message as

    ### role: text</turn>

where role and text are escaped by backslashes, so that no text holds `##` or `</` when it is written,
and no role `: ` either. The loss mask is a list of spans: the turn, and begin and end in it, of each text of a role that is
learned. `read_turns` and `read_loss` take the written text apart again.

Defined cases: a null text or role is an empty one; events that came twice (equal in all columns used) count once; of different events
with one seq the order is that of their texts; a message without `start` has the first role that it names; other
events than these four only open a message. Rows without a conversation form the conversation null, those without a message the message null. An
empty table gives an empty result. Other columns of the input are not used, whatever their names. A
conversation is one row of the result, and must fit into a string of Spark's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: Code points of text in one delta of `as_log`.
DELTA_CHARS = 200

_CONTROL = "\\\\|(?<=#)#|(?<=<)/"


def escape(text: Column) -> Column:
    """A text without `##` and `</`; every backslash is doubled."""
    return F.regexp_replace(text, _CONTROL, "\\\\$0")


def escape_role(role: Column) -> Column:
    """As `escape`, and without `: `."""
    return F.regexp_replace(role, _CONTROL + "|(?<=:) ", "\\\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _log_columns(log: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return log.select("conversation", "message", "seq", "event", F.col("role").cast("string").alias("role"), text.alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """(conversation, message, at, role, text): the messages that a log leaves; `at` is the seq of a message's first event."""
    own = Window.partitionBy("conversation", "message")
    cleared = F.max(F.when(F.col("event").isin("edit", "regenerate"), F.col("seq"))).over(own)
    rows = _log_columns(log).withColumns({
        "cleared": cleared,
        "again": F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).over(own),
        "at": F.min("seq").over(own),
        "role": F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(own),
    })
    # a row of the first event stays, for a message that is empty
    holds = F.col("cleared").isNull() | (F.col("seq") >= F.col("cleared"))
    told = F.when(holds & F.col("event").isin("delta", "edit"), F.struct("seq", "text"))
    messages = rows.filter(holds | (F.col("seq") == F.col("at"))).groupBy("conversation", "message").agg(
        F.first("at").alias("at"), F.first("again").alias("again"), F.coalesce(F.first("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_set(told)), lambda x: x["text"]), "").alias("text"),
    )
    before = Window.partitionBy("conversation").orderBy("at", "message").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.max("again").over(before) > F.col("at")
    return messages.withColumn("taken", F.coalesce(taken, F.lit(False))).filter(~F.col("taken")).select("conversation", "message", "at", "role", "text")


def render(messages: DataFrame, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conversation, formatted, mask): the text of each conversation, and array<struct<turn, begin, end>> of the spans that are learned.

    `turn` counts from 0; begin and end are code points from the beginning of the turn's own text."""
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))
    written = messages.select("conversation", "at", "message", F.col("role").isin(*learned).alias("on"), head.alias("head"), escape(F.col("text")).alias("body"))
    begin = F.length("head")
    turn = F.struct("at", "message", F.concat("head", "body", F.lit(END)).alias("s"), "on", begin.alias("b"), (begin + F.length("body")).alias("e"))
    turns = written.groupBy("conversation").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform("turns", lambda x, i: F.when(x["on"], F.struct(i.alias("turn"), x["b"].alias("begin"), x["e"].alias("end"))))
    return turns.select(
        "conversation", F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("mask")
    )


def _pieces(formatted: Column) -> Column:
    """What was written for each turn, without its end."""
    return F.filter(F.split(formatted, END, -1), lambda x: x != "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a conversation's written text."""

    def turn(x: Column) -> Column:
        at = F.instr(x, ": ")
        return F.struct(unescape(F.substring(x, F.lit(5), at - 5)).alias("role"), unescape(F.substring(x, at + 2, F.length(x))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """array<string> of the texts under the loss mask."""
    pieces = F.struct(_pieces(formatted).alias("p"))
    cut = lambda p: F.transform(mask, lambda m: unescape(F.substring(F.get(p["p"], m["turn"]), m["begin"] + 1, m["end"] - m["begin"])))
    return F.flatten(F.transform(F.array(pieces), cut))


def as_log(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """An event log that leads to the given rows (conv_id, turn, role, text), as a chat server would have kept it.

    Every text comes in deltas. By a hash of its place, a turn of eight was first sent in part and edited when the
    conversation was over; one answer of eight was first another one, was followed by a turn that is gone now, and was regenerated.
    Rows of one turn are ordered by role and text; equal rows stay apart by their number."""
    copies = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(copies)).withColumn("h", F.pmod(F.hash("conv_id", "turn", "copy"), F.lit(8)))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    nothing = F.lit(None).cast("string")

    def event(kind: str, text: Column, k: Column | int, late: int = 0, stray: Column | bool = False) -> Column:
        seq = F.struct(
            F.lit(late).alias("late"), F.col("turn").alias("turn"), F.col("copy").alias("copy"), (F.lit(k) if isinstance(k, int) else k).alias("k")
        )
        role = F.when(F.lit(stray) if isinstance(stray, bool) else stray, F.lit("user")).otherwise(F.col("role")) if kind == "start" else nothing
        name = F.struct(F.col("turn").alias("turn"), F.col("copy").alias("copy"), (F.lit(stray) if isinstance(stray, bool) else stray).alias("stray"))
        return F.struct(F.lit(kind).alias("event"), seq.alias("seq"), name.alias("message"), role.alias("role"), text.alias("text"))

    streamed = F.transform(chunks, lambda x, i: event("delta", x, i + 10))
    start = F.array(event("start", nothing, 0))
    plain = F.concat(start, streamed)
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    edited = F.concat(start, F.array(event("delta", half, 1), event("edit", F.col("text"), 2, late=1)))
    again = [
        event("delta", F.reverse("text"), 1), event("start", nothing, 2, stray=True), event("delta", F.lit("No, ask me again."), 3, stray=True),
        event("regenerate", nothing, 4),
    ]
    regenerated = F.concat(start, F.array(*again), streamed)
    events = F.when(F.col("h") == 1, edited).when((F.col("h") == 2) & (F.col("role") == "assistant"), regenerated).otherwise(plain)
    return rows.select(F.col("conv_id").alias("conversation"), F.explode(events).alias("e")).select("conversation", "e.*")


def format_log(log: DataFrame, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """The conversations of a log, folded and rendered."""
    return render(fold(log), learned)
