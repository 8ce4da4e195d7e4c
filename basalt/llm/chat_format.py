"""Chat formatting: messages rebuilt from an event log, then rendered with a reversible template.

Events (conv_id, msg, seq, kind, role, text) are folded per message: `message` sets its text,
`delta` appends to it, `edit` replaces it and `regenerate` clears it for the deltas that follow.
A run of events folds to one (restarts, text) pair and such pairs combine associatively, so
the log is folded first by blocks of sequence numbers and then by message: no task sorts all
events of a message or conversation. The messages are rendered one by one and joined in
blocks before a conversation's blocks are joined.

Template: <|turn|> role <|text|> text <|end|> for every message. Within role and text a
backslash is doubled and "<|" becomes "<", backslash, "|", so no control string can occur
there and reading back gives the same text. Everything is a DataFrame expression.

Nulls, empties, ties: null roles and texts count as empty; null conversations form one group
of their own. Events of equal seq go by kind rank (message, edit, regenerate, delta), role and text;
messages of equal position by role and text; repeated rows are all kept. Extra
columns are ignored. An empty log gives no conversation. A rendered conversation is one cell,
so it is bounded by Spark's cell limit of 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Sequence numbers per block of the first fold, and messages per block of the first join.
BLOCK = 1024


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _fold(parts: Column) -> Column:
    """(restarts, role, text) of sorted parts: what stands before the last restart does not count."""
    last = F.aggregate(
        parts,
        F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("last")),
        lambda s, p: F.struct((s["i"] + 1).alias("i"), F.when(p["restarts"], s["i"] + 1).otherwise(s["last"]).alias("last")),
        lambda s: s["last"],
    )
    live = F.slice(parts, F.greatest(last, F.lit(0)) + 1, F.greatest(F.size(parts), F.lit(1)))
    return F.struct(
        (last >= 0).alias("restarts"),
        F.array_max(F.transform(parts, lambda p: p["role"])).alias("role"),
        F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log.

    events: conv_id, msg (the message's position, bigint), seq (bigint), kind, role, text, and
    optionally copy (bigint, tells messages of one position apart). An event without a role
    leaves the message's role as other events give it (the greatest, if they differ).
    """
    kind = F.coalesce(F.lower("kind"), F.lit("delta"))
    rank = F.when(kind == "message", 0).when(kind == "edit", 1).when(kind == "regenerate", 2).otherwise(3)
    rows = events.select(
        "conv_id",
        "msg",
        (F.col("copy") if "copy" in events.columns else F.lit(0)).cast("bigint").alias("copy"),
        F.floor(F.col("seq") / BLOCK).alias("block"),
        F.struct(
            F.col("seq").alias("seq"),
            rank.alias("rank"),
            (rank < 3).alias("restarts"),
            F.col("role").cast("string").alias("role"),
            F.when(rank == 2, "").otherwise(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        ).alias("e"),
    )
    blocks = rows.groupBy("conv_id", "msg", "copy", "block").agg(F.sort_array(F.collect_list("e")).alias("es"))
    blocks = blocks.select("conv_id", "msg", "copy", F.struct("block", _fold(F.col("es")).alias("f")).alias("b"))
    folded = blocks.groupBy("conv_id", "msg", "copy").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    done = _fold(F.transform("bs", lambda b: b["f"]))
    return folded.select("conv_id", "msg", "copy", done.alias("m")).select(
        "conv_id", "msg", "copy", F.coalesce("m.role", F.lit("")).alias("role"), F.col("m.text").alias("text")
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation from messages (conv_id, msg[, copy], role, text): conv_id, formatted, segments.

    segments are (text, loss) pieces whose concatenation is formatted; loss marks the texts of trained_role.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    copy = (F.col("copy") if "copy" in messages.columns else F.lit(0)).cast("bigint")
    rows = messages.select("conv_id", F.floor(F.col("msg") / BLOCK).alias("block"), F.struct(F.col("msg").alias("msg"), copy.alias("copy"), role.alias("role"), text.alias("text")).alias("m"))
    turn = lambda m: F.array(
        F.struct(F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(m["text"]).alias("text"), (m["role"] == trained_role).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    blocks = blocks.select("conv_id", F.struct("block", F.flatten(F.transform("ms", turn)).alias("s")).alias("b"))
    joined = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    segments = F.flatten(F.transform("bs", lambda b: b["s"]))
    return joined.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    part = lambda t, i: unescape(F.get(F.split(F.get(F.split(t, END.replace("|", "\\|")), F.lit(0)), TEXT.replace("|", "\\|")), F.lit(i)))
    turns = F.filter(F.split(formatted, TURN.replace("|", "\\|")), lambda x: x != "")
    return F.transform(turns, lambda t: F.struct(part(t, 0).alias("role"), part(t, 1).alias("text")))


def chat_format(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Conversations (conv_id, formatted, segments) of an event log: fold_events(), then render()."""
    return render(fold_events(events), trained_role)
