"""Chat formatting with DataFrame functions only.

A finite-state machine over the roles validates the order of the turns; a declarative template says how a turn is
opened and closed and which roles bear loss.  A conversation becomes a list of segments (text, loss); their texts joined
are the formatted conversation.  Inside role names and texts the characters with which control strings begin are
escaped reversibly, so read_back() finds the turns again whatever the texts say.

Defined results: a null text or role is empty; turns are ordered by turn (null first), ties by role, then text, and
repeated rows stay; a null conv_id is a conversation of its own; an order that the machine rejects is formatted all the
same, with valid = false; an empty table gives no rows; further columns are ignored.  A conversation is one output row
and must fit into a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    begin: str = "<s>"
    open_left: str = "<|"
    open_right: str = "|>\n"
    close: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state>role -> state; the machine starts in "start" and must end in one of `accepting`
    moves: dict[str, str] = field(default_factory=lambda: {"start>system": "told", "start>user": "asked", "told>user": "asked", "asked>assistant": "answered", "answered>user": "asked"})
    accepting: tuple[str, ...] = ("answered",)
    #: what is escaped, and the letter that stands for it after a backslash; the backslash comes first
    escapes: tuple[tuple[str, str], ...] = (("\\", "e"), ("<", "l"), ("[", "b"), ("|", "p"))


def escape(text: Column, t: ChatTemplate) -> Column:
    for char, letter in t.escapes:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column, t: ChatTemplate) -> Column:
    """Every backslash of an escaped text begins an escape, so one kind after the other can be undone, itself last."""
    for char, letter in reversed(t.escapes):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def format_chats(df: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted) from rows (conv_id, turn, role, text)."""
    t = template or ChatTemplate()
    rows = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for move in t.moves.items() for x in move])
    state = F.aggregate("turns", F.lit("start"), lambda s, m: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), m["role"])), F.lit("rejected")))

    def segments(m: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        off = F.lit(False)
        return F.array(part(F.concat(F.lit(t.open_left), escape(m["role"], t), F.lit(t.open_right)), off), part(escape(m["text"], t), m["role"].isin(*t.loss_roles)), part(F.lit(t.close), off))

    begin = F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss")))
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*t.accepting).alias("valid"), F.concat(begin, F.flatten(F.transform("turns", segments))).alias("segments"))
    return out.withColumn("formatted", _joined(F.transform("segments", lambda s: s["text"])))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """format_chats()'s output with `turns` (role, text) parsed from the formatted text, and loss_text under the mask."""
    t = template or ChatTemplate()
    quoted = "".join("\\" + c if c in "|<>\\[" else c for c in t.close)
    body = F.substring(F.col("formatted"), F.lit(len(t.begin) + 1), F.length("formatted"))
    pieces = F.split(body, quoted)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))  # after the last close nothing is left

    def turn(p: Column) -> Column:
        at = F.instr(p, t.open_right)
        role = F.substring(p, F.lit(len(t.open_left) + 1), at - len(t.open_left) - 1)
        text = F.substring(p, at + len(t.open_right), F.length(p))
        return F.struct(unescape(role, t).alias("role"), unescape(text, t).alias("text"))

    # the mask as ranges of the formatted text: running lengths of the segments, kept where they bear loss
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), F.length(s["text"]).alias("n"))
        return F.struct((acc["at"] + own["n"]).alias("at"), F.when(s["loss"], F.concat(acc["kept"], F.array(own))).otherwise(acc["kept"]).alias("kept"))

    mask = F.aggregate("segments", start, step, lambda acc: acc["kept"])
    loss = F.transform(mask, lambda m: unescape(F.substring(F.col("formatted"), m["at"], m["n"]), t))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", _joined(loss))
