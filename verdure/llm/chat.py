"""Chat formatting: conversations as one training text each, with a loss mask, by Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns with one role are merged into one
message by array functions, the turns of a run parted by a mark; every message stands between the marks of its role.
Control strings inside texts are escaped, so the marks of the output are the template's own and the turns can be
read back (``read_turns``).

Output: ``formatted``, the text, and ``segments``, the same text cut into pieces, each with the flag ``loss``: true for
the texts of the roles that are learned, without any mark.

Defined results: a null text is empty, a null role is a role of its own.  Turns are ordered by number (null first), ties
by role, then text; repeated rows are turns like others.  Rows without a conversation id are one conversation, whose id
is null.  An empty table gives no rows.  Columns other than the four named ones are ignored.  Texts may be of any length
as long as a conversation fits a row (2 GB): the work is linear in it.

Scale: one shuffle, by conversation.  A conversation is one row of the result, hence of one task, by definition;
nothing else is grouped, so equal conversations or first turns gather nowhere.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of a chat format.  Every control string starts with a character that stands nowhere else in any of them,
    so a text and a mark can never form another control string where they meet."""

    begin: str = "<s>"
    #: (role, mark before its messages, mark after them)
    roles: tuple = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "[ANS]", "</s>"))
    #: marks of messages of any other role: before its name, between name and text, after the text
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    #: marks of messages without a role
    none: tuple = ("[NONE]", "[/NONE]")
    #: between the turns of one message
    next_turn: str = "[NEXT]"
    learned: tuple = ("assistant",)

    def __post_init__(self):
        marks = self.controls
        heads = {m[0] for m in marks}
        if any(h in m[1:] for h in heads for m in marks) or any(ESCAPE in m for m in marks):
            raise ValueError("a control string must not hold the first character of one inside, or the escape character")
        if any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(self.openings)) < len(self.openings):
            raise ValueError("control strings must not begin with one another, and opening marks must differ")

    @property
    def openings(self) -> list[str]:
        return [*(r[1] for r in self.roles), self.other[0], self.none[0]]

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, self.next_turn, *self.other, *self.none, *(m for r in self.roles for m in r[1:])})


def escape(text: Column, template: Template) -> Column:
    """``text`` with the escape character doubled, and one put after the first character of each control string."""
    heads = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in template.controls)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), heads, "$0" + ESCAPE * 2)


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments (array of text, loss): a row per conversation of ``turns`` (conv_id, turn, role, text)."""
    said = turns.select("conv_id", F.struct("turn", F.col("role").cast("string").alias("role"),
                                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    grouped = said.groupBy("conv_id").agg(F.collect_list("t").alias("t"))

    def opening(role: Column) -> Column:
        mark = F.when(role.isNull(), template.none[0])
        for name, before, _ in template.roles:
            mark = mark.when(role == name, before)
        return mark.otherwise(F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1])))

    def closing(role: Column) -> Column:
        mark = F.when(role.isNull(), template.none[1])
        for name, _, after in template.roles:
            mark = mark.when(role == name, after)
        return mark.otherwise(template.other[2])

    def message(run: Column) -> Column:
        """Segments of one run of turns: the mark before it, the texts with marks between, the mark after it."""
        role = run[0]["role"]
        learned = F.coalesce(role.isin(*template.learned), F.lit(False))

        def piece(text, loss):
            return F.struct(text.alias("text"), loss.alias("loss"))

        body = F.flatten(F.transform(run, lambda t, i: F.array(
            piece(F.when(i == 0, opening(t["role"])).otherwise(template.next_turn), F.lit(False)),
            piece(escape(t["text"], template), learned))))
        return F.concat(body, F.array(piece(closing(role), F.lit(False))))

    def merged(t: Column) -> Column:
        """Runs of turns with one role, in order: where they start, then the slices from start to start."""
        last = F.size(t) - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | ~t[i]["role"].eqNullSafe(t[F.greatest(i - 1, F.lit(0))]["role"]))
        return let(F.concat(starts, F.array(last + 1)), lambda s: F.transform(
            F.slice(s, 1, F.size(s) - 1), lambda at, k: F.slice(t, at + 1, s[k + 1] - at)))

    first = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    segments = let(F.array_sort("t"), lambda t: F.concat(first, F.flatten(F.transform(merged(t), message))))
    cut = grouped.select("conv_id", segments.alias("segments"))
    return cut.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (array of role, text) of a formatted conversation."""
    opens = "|".join(map(re.escape, template.openings))
    whole = F.substring(formatted, len(template.begin) + 1, F.length(formatted))

    def turns_of(m: Column) -> Column:
        def body(before, after):
            return F.substring(m, F.lit(len(before) + 1), F.length(m) - len(before) - len(after))

        mark, after, text = template.other
        role = F.when(m.startswith(template.none[0]), None)
        inner = F.when(m.startswith(template.none[0]), body(*template.none))
        for name, start, end in template.roles:
            role = role.when(m.startswith(start), name)
            inner = inner.when(m.startswith(start), body(start, end))
        role = role.otherwise(unescape(F.substring_index(body(mark, text), after, 1)))
        inner = inner.otherwise(F.element_at(F.split(body(mark, text), re.escape(after), 2), 2))
        return let(role, lambda r: F.transform(F.split(inner, re.escape(template.next_turn), -1),
                                               lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(F.split(whole, f"(?={opens})", -1), turns_of))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    turns = let(F.col("formatted"), lambda f: read_turns(f, template))
    back = formatted.select("conv_id", turns.alias("turns"), learned_text(F.col("segments")).alias("learned"),
                            F.length("formatted").cast("long").alias("formatted_chars"))
    said = let(F.col("turns"), lambda t: F.array_join(F.transform(
        t, lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n"))), ""))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars")
