r"""Chat formatting with a grammar round trip.

Each turn is rendered, reparsed by a deterministic parser and compared with its
source. A text that comes back changed, or that holds a control string of the
template, is escaped: a backslash goes after the first character of every control
string in it, and one more into those that already have some. Unescaping takes one
out of each, so the escape is a bijection and the second reparse is identical. The
whole conversation is then reparsed once more from its rendered form.

Grammar (control strings never stand in a body unescaped):

    conversation := turn*
    turn := "[INST] " body " [/INST]"                        user
          | "<s>" body "</s>"                                assistant
          | "<<SYS>>\n" body "\n<</SYS>>\n"                  system
          | "<<ROLE:" name ">>\n" body "\n<</ROLE>>\n"       any other role, URL-encoded

Native column functions only. Null texts and null roles count as empty strings, a
null conversation id is a conversation of its own. Turns are ordered by turn, then
role, then text (ties, repeated rows); null turns come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.llm.common import whole_text

# FIXED VALUES: what opens and closes a turn.
USER, ASSISTANT, SYSTEM = ("[INST] ", " [/INST]"), ("<s>", "</s>"), ("<<SYS>>\n", "\n<</SYS>>\n")
OTHER = ("<<ROLE:", ">>\n", "\n<</ROLE>>\n")
TAILS = r"(/?s>|/?INST\]|</?SYS>>|</?ROLE[:>])"
CONTROL = r"[<\[]" + TAILS
ESCAPABLE = r"([<\[])(\\*)" + TAILS
ESCAPED = r"([<\[])\\(\\*)" + TAILS
BLOCK = 4096  # code points of a conversation among which the place of a span is counted off
TURN = (r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>\n.*?\n<</SYS>>\n"
        r"|<<ROLE:[^>]*>>\n.*?\n<</ROLE>>\n")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, ESCAPED, "$1$2$3")


def render_turn(role: Column, body: Column) -> Column:
    return (F.when(role == "user", F.concat(F.lit(USER[0]), body, F.lit(USER[1])))
            .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), body, F.lit(ASSISTANT[1])))
            .when(role == "system", F.concat(F.lit(SYSTEM[0]), body, F.lit(SYSTEM[1])))
            .otherwise(F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1]), body, F.lit(OTHER[2]))))


def body_of(turn: Column) -> Column:
    """What stands between a rendered turn's opening and closing."""
    def inner(head: Column, tail: int) -> Column:
        return turn.substr(head + 1, F.length(turn) - head - tail)

    named = F.instr(turn, ">>\n") + 2
    return (F.when(turn.startswith(USER[0]), inner(F.lit(len(USER[0])), len(USER[1])))
            .when(turn.startswith(ASSISTANT[0]), inner(F.lit(len(ASSISTANT[0])), len(ASSISTANT[1])))
            .when(turn.startswith(SYSTEM[0]), inner(F.lit(len(SYSTEM[0])), len(SYSTEM[1])))
            .otherwise(inner(named, len(OTHER[2]))))


def role_of(turn: Column) -> Column:
    return (F.when(turn.startswith(USER[0]), "user").when(turn.startswith(ASSISTANT[0]), "assistant")
            .when(turn.startswith(SYSTEM[0]), "system")
            .otherwise(F.url_decode(F.regexp_extract(turn, r"^<<ROLE:([^>]*)>>", 1))))


def parse(formatted: Column) -> Column:
    """Rendered text > array of (role, text); null where it isn't of the grammar."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), 0)
    covered = F.aggregate(turns, F.lit(0), lambda n, t: n + F.length(t)) == F.length(formatted)
    bare = F.exists(turns, lambda t: body_of(t).rlike(CONTROL))
    return F.when(covered & ~bare, F.transform(turns, lambda t: F.struct(
        role_of(t).alias("role"), unescape(body_of(t)).alias("text"))))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text > with ``rendered``, ``escaped`` and the place of the
    body in it (``body_start``, ``body_chars``)."""
    rows = conversations.select("conv_id", "turn", whole_text("role").alias("role"), whole_text("text").alias("text"))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("raw", render_turn(F.col("role"), F.col("text")))
    rows = rows.withColumn("escaped", ~F.coalesce(parse(F.col("raw")) == source, F.lit(False)))
    rows = rows.withColumn("body", F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")))
    rows = rows.withColumn("rendered", render_turn(F.col("role"), F.col("body")))
    head = (F.when(F.col("role") == "user", len(USER[0])).when(F.col("role") == "assistant", len(ASSISTANT[0]))
            .when(F.col("role") == "system", len(SYSTEM[0]))
            .otherwise(F.instr(F.col("rendered"), ">>\n") + 2))
    return rows.select("conv_id", "turn", "role", "text", "rendered", "escaped", head.alias("body_start"),
                       F.length("body").alias("body_chars"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, the loss mask as ``loss_spans`` (code
    points of the assistant bodies in it), ``turns`` as reparsed from it, ``n_escaped``
    and ``identical`` (the reparsed turns are the source's).

    A conversation's text is one string, so its turns meet in one row; the work on
    the texts is done per turn before that.
    """
    order = ["turn", "role", "text"]
    w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turns = format_turns(conversations).withColumn(
        "at", F.sum(F.length("rendered")).over(w) - F.length("rendered"))
    span = F.when(F.col("role") == "assistant", F.struct(
        (F.col("at") + F.col("body_start")).cast("long").alias("start"),
        (F.col("at") + F.col("body_start") + F.col("body_chars")).cast("long").alias("end")))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("source"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
        F.count_if("escaped").alias("n_escaped"))
    whole = whole.withColumn("formatted", F.array_join(F.col("source.rendered"), ""))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns") == F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", "formatted", "loss_spans", "turns", "n_escaped",
                        F.coalesce(same, F.lit(False)).alias("identical"))


def cut(text: Column, spans: Column, block: int = BLOCK) -> Column:
    """The pieces of text at ``spans`` (code points), in their order. Each is taken from the
    blocks it lies in, since finding a place in a string means counting from its start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), 0)

    def piece(b: Column, s: Column) -> Column:
        first = (s["start"] / block).cast("int")
        last = (s["end"] / block).cast("int")
        near = F.array_join(F.slice(b, first + 1, last - first + 1), "")
        return near.substr((s["start"] - first * block + 1).cast("int"), (s["end"] - s["start"]).cast("int"))

    # blocks as a lambda's variable are made once, not for every span
    return F.get(F.transform(F.array(blocks), lambda b: F.transform(spans, lambda s: piece(b, s))), 0)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, read off the formatted conversation and unescaped."""
    return F.array_join(F.transform(cut(formatted, loss_spans), unescape), "")
