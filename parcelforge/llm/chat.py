"""Chat formatting by event-sourced reconstruction; DataFrame functions only.

A log holds events of conversations: ``message`` opens message ``turn`` with a role
and text, ``delta`` appends text to it, ``edit`` replaces its text, ``regenerate``
empties it and makes later deltas its new text.  Events are folded per message in
order of ``seq``; messages are rendered in order of ``turn``::

    <|role|>\\ntext<|end|>\\n

In roles and texts ``\\``, ``<``, ``[`` and ``|`` are written ``\\e``, ``\\l``,
``\\b`` and ``\\p``.  So no control string of this or of bracket templates can
occur inside a text, and the original returns by plain replacements.

The loss mask lists code-point spans (start, length) of the assistant texts.

Cases: null role or text is empty; rows without a ``conv_id`` are one conversation; null turns come first;
ties of ``turn`` are ordered by role and text, and equal rows are turns of their own; very long texts are kept whole;
an empty table gives no rows; other columns are ignored, whatever their names.  A conversation's own
messages meet in one row, as its rendered form is one string by definition; no
other group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is escaped, and by what. The back slash comes first; it is restored last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of a log ``conv_id, turn, seq, kind, role, text``.

    The last message/edit/regenerate event of a message starts its text (regenerate
    with nothing), and the deltas after it are appended in order; its role is that
    of the last event which names one.
    """
    item = [] if "item" not in events.columns else ["item"]
    message = ["conv_id", "turn", *item]
    one = Window.partitionBy(message).orderBy("seq")
    log = events.select(*message, "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    restarts = F.col("kind").isin("message", "edit", "regenerate")
    log = log.withColumn("era", F.sum(F.when(restarts, 1).otherwise(0)).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    log = log.withColumn("last", F.max("era").over(Window.partitionBy(message)))
    kept = F.when((F.col("era") == F.col("last")) & (F.col("kind") != "regenerate"), F.struct("seq", "text"))
    return log.groupBy(message).agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of final messages ``conv_id, turn, role, text``."""
    head = F.concat(F.lit("<|"), escaped(F.coalesce("role", F.lit(""))), F.lit("|>\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    parts = messages.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    parts = parts.withColumns({"n_head": F.length("head"), "n_body": F.length("body")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    parts = parts.withColumn("place", F.row_number().over(order))
    before = F.sum(F.col("n_head") + F.col("n_body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("n_head"))
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("part"), "start", "n_body", (F.col("role") == "assistant").alias("loss")))).alias("all"))
    spans = F.transform(F.filter("all", lambda x: F.coalesce(x["loss"], F.lit(False))), lambda x: F.struct(x["start"].cast("int").alias("start"), x["n_body"].cast("int").alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda x: x["part"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns (role, text), loss_texts`` from rendered rows only."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    turns = F.transform(parts, _turn)
    loss = F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def _turn(part: Column) -> Column:
    at = F.instr(part, "|>\n")
    return F.struct(unescaped(F.substring(part, F.lit(3), at - 3)).alias("role"), unescaped(F.substring(part, at + 3, F.length(part))).alias("text"))


def format_chats(rows: DataFrame) -> DataFrame:
    """Fold and render a table ``conv_id, turn, role, text`` in which each row is a ``message`` event of its own.

    The first window deals rows out by conversation; all later steps keep that dealing, so there is one shuffle.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("item"), F.lit("message").alias("kind"), F.lit(0).alias("seq"))
    return render(fold_events(events))
