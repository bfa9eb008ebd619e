"""Chat formatting: conversations are rebuilt from their event log, rendered by a template, and read back.

All steps are DataFrame expressions. One shuffle by conversation serves every window and group below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
#: Event kinds that begin a message's text anew; "delta" adds to it, "delete" removes the message.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """text without the pair that opens a control string: each < backslashes | gets one more backslash. Reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role on one line: backslash and line feed are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def log_of_rows(conversations: DataFrame) -> DataFrame:
    """Plain conversation rows (conv_id, turn, role, text) as an event log: each row is one complete message.

    Rows that share a turn stay separate messages, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).select("conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, position, role, text) of a log (conv_id, seq, message, kind, role, text).

    Kinds: message, edit and regenerate set a message's text anew, delta appends, delete removes the message.
    A message stands where its first event stood. A null text is empty, a null role is that of an earlier event or
    else empty, null keys form groups of their own; a very long text is taken whole; an empty log gives no rows; other columns,
    whatever they are called, are ignored. Events of one message with equal seq are taken by kind, role and text.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    at = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(0)))
    live = F.slice("log", at + 1, F.size("log"))
    return (
        grouped.where(F.element_at("log", -1)["kind"] != "delete")
        .select(
            "conv_id",
            F.col("log")[0]["seq"].alias("position"),
            "message",
            F.coalesce(F.get(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start, length in code points, of trained texts)."""
    turn = messages.select(
        "conv_id", "position", "message", "role",
        F.concat(F.lit(TURN_START), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    ).withColumn("n", F.char_length("head") + F.char_length("body") + len(TURN_END) + 1)
    before = Window.partitionBy("conv_id").orderBy("position", "message")
    placed = turn.withColumn("at", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    piece = F.struct(
        "at",
        F.concat("head", "body", F.lit(TURN_END + "\n")).alias("rendered"),
        F.col("role").isin(*train_on).alias("trained"),
        (F.col("at") + F.char_length("head")).alias("start"),
        F.char_length("body").cast("long").alias("length"),
    )
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"], t["length"])).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, len(TURN_START) + 1, 2**31 - 1))
    cut = F.transform(body, lambda b: F.struct(b.alias("b"), F.instr(b, "\n").alias("i")))
    return F.transform(
        cut,
        lambda c: F.struct(
            _unescape_role(F.substr(c["b"], F.lit(1), c["i"] - 1)).alias("role"),
            unescape(F.substr(c["b"], c["i"] + 1, F.char_length(c["b"]))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    cut = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")


def format_chats(events: DataFrame, train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted text and loss mask of each conversation in an event log; see fold_events and render.

    A conversation is one row, as its format asks for, so a group is as large as the conversation is. Rows without conv_id are one.
    """
    return render(fold_events(events), train_on)
