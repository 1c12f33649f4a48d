"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation arrives as a log of events, each with a sequence number and the message it
belongs to: ``delta`` appends text, ``edit`` replaces the text so far, ``regenerate`` clears
it.  The log is grouped by conversation and message, put in sequence, and folded: what
counts is the last edit or regeneration of a message and the deltas after it.  The final
messages are rendered in a ChatML-like template whose marks cannot occur in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Reversible: ``\\`` doubles and ``<|`` becomes ``<\\|``, so no mark is left in a text; in
    a role, which ends at a line feed, the line feed becomes ``\\n``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    if role:
        text = F.regexp_replace(text, r"(?s)(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """``events(conv_id, seq, message, role, kind, text)`` -> ``conv_id, message, role, text``.

    Per message, in order of ``seq`` (ties: kind, then text): the text of the last ``edit``
    (nothing for a ``regenerate``) and of the deltas after it.  The role is the first
    event's.  A null text adds nothing; events of other kinds change nothing.  Null
    conversation or message ids are ids of their own.
    """
    step = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(step)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))
    log = log.withColumn("from", F.coalesce(F.array_max(resets), F.lit(-1)))
    live = F.transform("log", lambda e, i: F.when(
        ((e["kind"] == "delta") & (i > F.col("from"))) | ((e["kind"] == "edit") & (i == F.col("from"))), e["text"]).otherwise(""))
    return log.select("conv_id", "message", F.col("log")[0]["role"].alias("role"), F.array_join(live, "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, segments, formatted``: one row per conversation.

    ``segments`` is the rendered text in order, ``array<struct<text, loss>>``; the loss mask is
    the segments with ``loss``: the escaped texts of ``loss_roles``.  ``formatted`` joins them.
    """
    parts = F.array(
        F.struct(F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), F.col("role").isin(*loss_roles).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    convs = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", parts.alias("parts")))).alias("m"))
    convs = convs.select("conv_id", F.flatten(F.transform("m", lambda x: x["parts"])).alias("segments"))
    return convs.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Events to rendered conversations: ``fold_events`` then ``render``.

    An empty log gives no rows; a message whose events leave no text is an empty turn.
    Other columns are ignored.  A conversation is one training sequence and ends up in one
    row; its events are folded per message before they meet.
    """
    return render(fold_events(events), loss_roles)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses rendered conversations: ``conv_id, turns array<struct<role, text>>, loss`` (the
    unescaped texts under the loss mask, in order) beside the columns given."""
    turns = F.transform(F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>"))),
                        lambda t: F.regexp_replace(t, r"(?s)<\|im_end\|>\n\z", ""))
    turns = F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(t, "\n", 1), True).alias("role"),
        unescape(F.regexp_replace(t, r"\A[^\n]*\n", "")).alias("text")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumns({"turns": turns, "loss": loss})


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered text: turn count and hashes."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
