"""Chat formatting from event logs, with DataFrame operations alone.

A log has one row an event: conv_id, turn (the message it belongs to), seq (order in the conversation), kind, role,
text. ``message`` and ``edit`` replace the turn's text so far, ``delta`` appends to it, ``regenerate`` empties it and
discards every later turn that the conversation had before it. Folding the log gives the final messages; rendering
puts them between control strings and gives the character spans that a loss mask covers (assistant texts).

Inside roles and texts each ``<|`` gets a backslash between its two characters (and one more if it has some already),
so control strings appear only where the template put them, and taking one backslash out restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: percent signs and line feeds are written as %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of each conversation.

    Events of a turn count in the order of seq, then kind, role and text. A null kind is a message, a null text is
    empty, the role is the last that isn't null (else empty). Null conv_id, turn and seq are values like others and
    sort first. A regeneration of an earlier turn discards the events up to it; turns with no event left are left out.
    """
    kind = F.coalesce("kind", F.lit("message"))
    e = events.select("conv_id", "turn", F.struct(F.col("seq"), kind.alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    again = e.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("e.kind") == "regenerate", F.col("e.seq"))).alias("again"), F.max("e.seq").alias("last"), F.sort_array(F.collect_list("e")).alias("log"))
    cut = F.max("again").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    left = F.filter("log", lambda x: F.col("_cut").isNull() | F.col("last").isNull() | (x["seq"] > F.col("_cut")))
    turns = again.withColumn("_cut", cut).withColumn("log", left).filter(F.size("log") > 0)
    reset = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    parts = F.filter("log", lambda x, i: i >= F.col("reset"))
    text = F.array_join(F.transform(parts, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    turns = turns.withColumn("reset", reset).select("conv_id", "turn", text.alias("text"), F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"))
    return turns.select("conv_id", "turn", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation, from (conv_id, turn, role, text).

    loss_spans are the start and length in code points of each assistant text as it stands in ``formatted``. A null role or text is
    empty, null turns come first, rows that share a turn follow in the order of role and text, repeated rows are turns of their own, other
    columns are not looked at, and an empty table gives an empty result.
    """
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    pieces = messages.select("conv_id", "turn", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("before", before.cast("int"))
    turn = F.struct("before", "turn", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("before") + F.length("head")).alias("start"), F.length("body").alias("chars"), (F.col("role") == LOSS_ROLE).alias("loss"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars")))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped. Null is null, an empty text has no turns."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.locate("\n", piece)
        return F.struct(unescape_role(piece.substr(F.lit(len(START) + 1), at - len(START) - 1)).alias("role"), unescape(piece.substr(at + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["chars"]))), "")
