"""Conversations as training text: a state machine over roles and a declarative template.

A template gives each role its opening mark and says whether its text carries loss.  Marks
are control strings; the same strings inside a text get an escape sign after their first
character, and escape signs are doubled, so that a formatted text has marks only where the
template put them and every text can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks and rules of a chat format; every mark is a control string."""

    begin: str = "<s>"
    end: str = "</s>"
    #: role: (opening mark, loss)
    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS]", False), "user": ("[INST]", False), "assistant": ("[/INST]", True)})
    #: Any other role is written between these marks and carries no loss.
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    #: state: {role: next state}; a role that is not listed breaks the order.
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"}})

    def controls(self) -> list[str]:
        return [self.begin, self.end, *(mark for mark, _ in self.roles.values()), *self.other]


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.controls():
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, template: Template | None = None, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``n_turns``, ``valid``, ``segments`` and ``formatted`` of each conversation.

    ``segments`` are (text, loss) in order; ``formatted`` is all of them together.
    ``valid`` says that the roles follow the template's order and no turn number repeats;
    conversations that do not are formatted as well.  Rows go by turn (null first), then
    role and text, repeated rows stay.  Null texts and roles are empty; rows without
    ``conv_id`` form one conversation.  Other columns are left out; no rows give no rows.
    A conversation is one training text and one row.
    """
    template = template or Template()
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def opening(own: Column) -> Column:
        mark = F.concat(F.lit(template.other[0]), escape(own, template), F.lit(template.other[1]))
        for name, (start, _) in template.roles.items():
            mark = F.when(own == name, F.lit(start)).otherwise(mark)
        return mark

    def segments(t: Column) -> Column:
        loss = F.lit(False)
        for name, (_, carries) in template.roles.items():
            if carries:
                loss = loss | (t["role"] == name)
        return F.array(
            F.struct(opening(t["role"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))

    def step(state: Column, t: Column) -> Column:
        after = F.lit("broken")
        for name, ways in template.order.items():
            for own, then in ways.items():
                after = F.when((state == name) & (t["role"] == own), F.lit(then)).otherwise(after)
        return after

    first = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    made = turns.select(
        "conv_id", F.size("turns").alias("n_turns"),
        ((F.aggregate("turns", F.lit("start"), step) != "broken")
         & (F.size(F.array_distinct(F.transform("turns", lambda t: t["turn"]))) == F.size("turns"))).alias("valid"),
        F.concat(first, F.flatten(F.transform("turns", segments))).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Roles and texts, in order, read from a formatted conversation."""
    template = template or Template()
    body = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted))
    chunks = F.split(body, _literal(template.end))
    turns = F.slice(chunks, F.lit(1), F.size(chunks) - 1)

    def read(chunk: Column) -> Column:
        opened, closed = template.other
        inside = F.substring(chunk, F.lit(len(opened) + 1), F.length(chunk))
        at = F.locate(closed, inside)
        turn = F.struct(
            unescape(F.substring(inside, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(inside, at + len(closed), F.length(inside))).alias("text"))
        for name, (mark, _) in template.roles.items():
            turn = F.when(chunk.startswith(mark), F.struct(
                F.lit(name).alias("role"),
                unescape(F.substring(chunk, F.lit(len(mark) + 1), F.length(chunk))).alias("text"))).otherwise(turn)
        return turn

    return F.transform(turns, read)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, as the turns had it."""
    own = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(own, lambda s: unescape(s["text"])), "")


def _literal(mark: str) -> str:
    """A pattern that matches a control string itself."""
    return "".join(f"[{c}]" if c not in "^\\" else f"\\{c}" for c in mark)
