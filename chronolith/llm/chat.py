"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A conversation log holds events: a ``message`` opens a turn at its sequence number, and is
named by its ``target``, or by that number where it has none; a ``delta`` appends to the turn
named by its ``target``, an ``edit`` replaces its text, a ``regenerate`` starts its text anew.  Each turn's last event that sets its text counts,
followed by the deltas after it.  Turns in order of sequence then make one string:

* ``<s>`` text ``</s>`` for the assistant, whose text is under the loss mask,
* ``[INST]`` role, line feed, text ``[/INST]`` for every other role.

Inside texts these four strings are escaped by entities, which ``unescape`` undoes.

Defined results: null text is empty, null role is the empty role; messages with the
same sequence number are turns of their own, ordered by role and text, a null number first
(deltas and edits of a name that several have apply to the last of them); events on a target
without message, and events of another kind or none, count for nothing; a null conversation
id is a conversation of its own; an empty log has no conversations; other columns are not
read.  A conversation is one row of the result, so its events meet in one task: the bound is
the length of one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_ASSISTANT, CLOSE_ASSISTANT, OPEN_OTHER, CLOSE_OTHER = "<s>", "</s>", "[INST]", "[/INST]"
ASSISTANT = "assistant"
#: Control strings and what stands for them inside a text.  The ampersand comes first when escaping, last when undoing.
ESCAPES = [("&", "&amp;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]")]


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in (("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def messages_as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A log of finished turns as events, one ``message`` each."""
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.lit("message").alias("kind"), "role", "text", F.col(turn).alias("target"))


def streamed_log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The log that a chat server would have written of these turns.

    By a hash of conversation and turn a text came in two deltas, or was a draft that an edit
    replaced and deltas went on with, or was begun, regenerated and streamed anew.
    """
    text, null = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    n = F.length(text)
    head = lambda part: F.substring(text, F.lit(1), F.floor(n / part).cast("int"))
    tail = lambda part: F.substring(text, F.floor(n / part).cast("int") + 1, n)

    def event(seq: Column, kind: str, role: Column, said: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))

    opened = lambda said: event(F.col(turn), "message", F.col("role"), said)
    later = lambda k, kind, said: event(F.lit(k), kind, null, said)
    in_parts = F.array(opened(head(3)), later(1, "delta", tail(3)))
    edited = F.array(opened(F.lit("draft")), later(1, "delta", F.lit(" of a text")), later(2, "edit", head(2)), later(3, "delta", tail(2)))
    anew = F.array(opened(head(3)), later(1, "delta", F.lit("lost")), later(2, "regenerate", null), later(3, "delta", head(2)), later(4, "delta", tail(2)))
    life = F.pmod(F.xxhash64(conv, turn), F.lit(3))
    events = F.explode(F.when(life == 0, in_parts).when(life == 1, edited).otherwise(anew)).alias("e")
    return rows.withColumn("target", F.monotonically_increasing_id()).select(F.col(conv).alias("conv_id"), "target", events).select("conv_id", "e.*", "target")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, seq, kind, role, text, target) into final turns (conv_id, seq, role, text)."""
    kind = F.lower(F.col("kind"))
    order = F.when(kind == "message", 0).when(kind == "regenerate", 1).when(kind == "edit", 2).when(kind == "delta", 3)
    named = F.when(kind == "message", F.coalesce("target", "seq")).otherwise(F.col("target"))
    ev = events.where(order.isNotNull()).select(
        "conv_id",
        named.alias("at"),
        F.struct(F.col("seq").alias("seq"), order.alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"),
    )
    grouped = ev.groupBy("conv_id", "at").agg(F.sort_array(F.collect_list("e")).alias("events"))
    opened = F.filter("events", lambda e: e.k == 0)
    after = F.filter("events", lambda e: e.k != 0)
    grouped = grouped.withColumns({"opened": opened, "after": after}).where(F.size("opened") > 0)
    reset = F.array_max(F.transform(F.filter("after", lambda e: e.k <= 2), lambda e: F.struct(e.seq.alias("seq"), e.k.alias("k"), e.text.alias("text"))))
    grouped = grouped.withColumn("reset", reset)
    base = F.when(F.col("reset").isNull(), F.element_at("opened", -1).text).otherwise(F.col("reset.text"))
    deltas = F.filter("after", lambda e: (e.k == 3) & (F.col("reset").isNull() | (e.seq > F.col("reset.seq"))))
    last_text = F.concat(base, F.array_join(F.transform(deltas, lambda e: e.text), ""))
    count = F.size("opened")
    turns = F.transform(
        "opened",
        lambda e, i: F.struct(e.seq.alias("seq"), e.role.alias("role"), F.when((i == count - 1) & (F.size("after") > 0), last_text).otherwise(e.text).alias("text")),
    )
    return grouped.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.seq", "t.role", "t.text")


def format_chats(turns: DataFrame) -> DataFrame:
    """Render turns (conv_id, seq, role, text): one row per conversation.

    ``formatted``: the whole string; ``loss``: array of (start, length) in code points, from 0,
    of the parts under the loss mask, in order.
    """

    def rendered(t: Column) -> Column:
        mine, body = t.role == ASSISTANT, escape(t.text)
        role = F.replace(escape(t.role), F.lit("\n"), F.lit("&#10;"))
        said = F.when(mine, F.concat(F.lit(OPEN_ASSISTANT), body, F.lit(CLOSE_ASSISTANT))).otherwise(F.concat(F.lit(OPEN_OTHER), role, F.lit("\n"), body, F.lit(CLOSE_OTHER)))
        return F.struct(mine.alias("assistant"), said.alias("piece"))

    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("ts")).select("conv_id", F.transform("ts", rendered).alias("ps"))
    extra = len(OPEN_ASSISTANT) + len(CLOSE_ASSISTANT)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))
    sized = F.transform("ps", lambda p: F.struct(p.assistant.alias("assistant"), F.length(p.piece).cast("long").alias("n")))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc.at + len(OPEN_ASSISTANT)).alias("start"), (p.n - extra).alias("length"))
        return F.struct((acc.at + p.n).alias("at"), F.when(p.assistant, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    return grouped.select("conv_id", F.array_join(F.transform("ps", lambda p: p.piece), "").alias("formatted"), F.aggregate(sized, start, step, lambda a: a.spans).alias("loss"))


def parse(formatted: Column) -> Column:
    """Read turns back from a formatted string: array of (role, text)."""
    parts = F.split(formatted, r"</s>|\[/INST\]")
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        mine = part.startswith(OPEN_ASSISTANT)
        rest = F.substring(part, F.lit(len(OPEN_OTHER) + 1), F.length(part))
        cut = F.locate("\n", rest)
        return F.struct(
            F.when(mine, F.lit(ASSISTANT)).otherwise(unescape(F.substring(rest, F.lit(1), cut - 1))).alias("role"),
            unescape(F.when(mine, F.substring(part, F.lit(len(OPEN_ASSISTANT) + 1), F.length(part))).otherwise(F.substring(rest, cut + 1, F.length(rest)))).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
