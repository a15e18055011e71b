"""Chat formatting from event logs (native Spark): fold streamed deltas, edits and regenerations, then render.

Input events: conv_id, seq (order within the conversation), turn, role, kind, text. Kinds: ``message`` sets a turn's
text, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it and discards what was streamed
before. A turn's final text is its last set, edit or regenerate plus the deltas after it; its role is that of its
last event that names one. Turns are rendered in order of ``turn``.

Template: each turn is ``<s>[role]text</s>``. Inside roles and texts the characters ``\\ < [ ]`` are written as
``\\s \\l \\b \\e``, so no control string can occur in a text, and every backslash of the output starts an escape:
the rendering is reversible. The loss mask is a list of (start, length) spans of the formatted string, in code points.

Nulls: a null text or role is empty, a null conversation id or turn is a group of its own (null turns come first), a
null kind counts as ``message``; null sequence numbers sort first. Events with equal sequence numbers are applied in
order of kind and text. An empty log gives no rows; extra columns are ignored. One conversation is one output row, so
its final text must fit a row; deltas and superseded versions need not, they are folded per turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))
END = "</s>"


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def fold_turns(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final state of every turn."""
    e = events.select(
        "conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"),
        "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    item = F.struct("seq", "kind", "text", "role")
    last = F.array_max(F.transform("_log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1))))
    live = F.slice("_log", F.greatest(F.col("_last"), F.lit(0)) + 1, F.size("_log"))
    named = F.filter("_log", lambda x: x["role"].isNotNull())
    return (
        e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(item)).alias("_log"))
        .withColumn("_last", last)
        .select(
            "conv_id", "turn",
            F.coalesce(F.try_element_at(named, F.lit(-1))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "").alias("text"),
        )
    )


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): one row per conversation. Offsets are running sums over the turns."""
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]"))
    body = escape(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    pieces = turns.select("conv_id", "turn", "role", head.alias("_h"), body.alias("_b")).withColumn(
        "_at", F.coalesce(F.sum(F.length("_h") + F.length("_b") + len(END)).over(before), F.lit(0)) + F.length("_h") + 1
    )
    span = F.when(F.col("role") == "assistant", F.struct(F.col("_at").cast("long").alias("start"), F.length("_b").cast("long").alias("length")))
    return (
        pieces.groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            F.sort_array(F.collect_list(F.struct("turn", F.concat("_h", "_b", F.lit(END)).alias("p")))).alias("_p"),
            F.sort_array(F.collect_list(span)).alias("loss_spans"),
        )
        .select("conv_id", "n_turns", F.array_join(F.col("_p.p"), "").alias("formatted"), "loss_spans")
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render every conversation."""
    return render(fold_turns(events))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(5)), "]", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "]") + 1)).alias("text"),
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def conversation_events(conversations: DataFrame, delta_chars: int = 400) -> DataFrame:
    """An event log of a table of finished turns (conv_id, turn, role, text): user and system turns as one message,
    assistant turns as a regenerated draft and then deltas of ``delta_chars`` code points. Rows that repeat a turn
    number stay turns of their own, in order of role and text."""
    key = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    rows = conversations.select("conv_id", F.col("turn").alias("_turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("turn", F.row_number().over(key).cast("long"))
    ev = lambda seq, kind, text: F.struct(F.lit(seq).alias("k") if isinstance(seq, int) else seq.alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    n = F.ceil(F.length("text") / F.lit(delta_chars)).cast("int")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: ev(i + 1, "delta", F.substr(F.col("text"), (i - 1) * delta_chars + 1, F.lit(delta_chars)))))
    draft = F.array(ev(0, "delta", F.substring("text", 1, 20)), ev(1, "regenerate", F.lit("")))
    log = F.when(F.col("role") == "assistant", F.concat(draft, F.coalesce(deltas, F.array().cast("array<struct<k:int,kind:string,text:string>>")))).otherwise(
        F.array(ev(0, "message", F.col("text")))
    )
    return (
        rows.select("conv_id", "turn", "role", F.explode(log).alias("e"))
        .select("conv_id", "turn", "role", (F.col("turn") * 10_000_000 + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text"))
    )
