"""Chat formatting with a role state machine, escaping and a loss mask (native).

A template says declaratively how turns are marked, which roles may follow which, and whose
text is trained on.  A conversation becomes a list of segments (marker or text) with a loss
flag each; their concatenation is the formatted text.  Texts are escaped so that no marker can
occur inside one, which makes the output readable back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_docs, let

STEP = 128  # elements to a step of a running sum
BLOCK = 1024  # code points to a block of a text that is read by spans


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``mid`` + text + ``close`` per turn.

    ``escapes`` maps characters of texts and roles to codes; every marker needs a character that
    is a key here (then no escaped text can hold it), and the escape character itself is one.
    ``transitions`` is the state machine: state -> {role: next state}.
    """

    open: str = "<turn "
    mid: str = ">\n"
    close: str = "</turn>\n"
    escapes: dict = field(default_factory=lambda: {"\\": "\\b", "<": "\\l", ">": "\\g"})
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    transitions: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple = ("assistant",)

    def __post_init__(self):
        codes = list(self.escapes.values())
        first = next(iter(self.escapes), "")
        if any(len(c) != 2 or c[0] != first for c in codes) or len(set(codes)) != len(codes) or any(c[1] in self.escapes for c in codes):
            raise ValueError("an escape code is the escape character and a plain character of its own")
        if any(not set(m) & (set(self.escapes) - {first}) for m in (self.open, self.mid, self.close)):
            raise ValueError("every marker needs an escaped character")

    def escape(self, text: Column) -> Column:
        for char, code in self.escapes.items():  # the escape character comes first
            text = F.replace(text, F.lit(char), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for char, code in reversed(self.escapes.items()):
            text = F.replace(text, F.lit(code), F.lit(char))
        return text

    def next_state(self, state: Column, role: Column) -> Column:
        out = None
        for s, moves in self.transitions.items():
            for r, to in moves.items():
                hit = (state == s) & (role == r)
                out = F.when(hit, F.lit(to)) if out is None else out.when(hit, F.lit(to))
        return out.otherwise(F.lit("error"))


def starts(sizes: Column) -> Column:
    """The running sum before every element of an array of numbers, in two levels of ``STEP`` elements.

    An aggregate that appends to an array copies it for each element; sums of slices don't.
    """
    def total(first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(sizes, first, n), F.lit(0), lambda a, x: a + x)

    # the sum before each step, from the sums of whole steps
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / STEP).cast("int")), lambda k: total(k * STEP + 1, F.lit(STEP)))
    return let(steps, lambda own: let(
        F.transform(own, lambda _, k: F.aggregate(F.slice(own, F.lit(1), k), F.lit(0), lambda a, x: a + x)),
        lambda base: F.transform(sizes, lambda _, i: F.get(base, F.floor(i / STEP).cast("int")) + total(i - i % STEP + 1, i % STEP))))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, bad_turn, segments, formatted, loss_spans.

    Turns are ordered by turn, null turns first; equal turn numbers by role and text.  ``segments``
    is an array of (text, is_text, role, loss) whose texts joined are ``formatted``; ``loss_spans``
    has (start, length) in code points of the segments under the loss.  ``valid`` says whether the
    role sequence runs through the state machine and ends in a final state; ``bad_turn`` is the
    index of the first turn that does not fit (null: none).  An invalid conversation is formatted
    all the same.  Null role or text: empty.  Rows with a null conv_id make one conversation.  An
    empty table gives no row.  A conversation is one row, as its format demands.
    """
    rows = as_docs(turns, "conv_id", "turn", "role", "text").withColumns(
        {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    is_loss = lambda role: role.isin(*template.loss_roles)

    def parts(t: Column) -> Column:
        def seg(text, is_text, loss):
            return F.struct(text.alias("text"), F.lit(is_text).alias("is_text"), t["role"].alias("role"), loss.alias("loss"))

        head = F.concat(F.lit(template.open), template.escape(t["role"]), F.lit(template.mid))
        return F.array(seg(head, False, F.lit(False)), seg(template.escape(t["text"]), True, is_loss(t["role"])),
                       seg(F.lit(template.close), False, F.lit(False)))

    walk = F.aggregate(
        "turns", F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad")),
        lambda a, t: let(template.next_state(a["state"], t["role"]), lambda s: F.struct(
            s.alias("state"), (a["i"] + 1).alias("i"),
            F.when(a["bad"].isNull() & (s == "error"), a["i"]).otherwise(a["bad"]).alias("bad"))))
    out = conv.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), walk.alias("walk"),
                      F.flatten(F.transform("turns", parts)).alias("segments"))
    spans = let(F.transform("segments", lambda s: F.length(s["text"])), lambda sizes: let(starts(sizes), lambda at: F.filter(
        F.transform("segments", lambda s, i: F.when(s["loss"], F.struct(F.get(at, i).alias("start"), F.get(sizes, i).alias("length")))),
        lambda span: span.isNotNull())))
    return out.select("conv_id", "n_turns", (F.col("walk.bad").isNull() & F.col("walk.state").isin(*template.final)).alias("valid"),
                      F.col("walk.bad").alias("bad_turn"), "segments",
                      F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) turns of a formatted text: the inverse of the format."""
    # the close marker cannot occur in an escaped text, so the last piece after it is empty
    pieces = F.filter(F.split(formatted, r"\Q" + template.close + r"\E", -1), lambda x: x != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.open) + 1))
        cut = F.instr(body, template.mid)
        return F.struct(template.unescape(F.substr(body, F.lit(1), cut - 1)).alias("role"),
                        template.unescape(F.substr(body, cut + len(template.mid))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The unescaped text under the loss mask, read from the formatted text by its spans.

    The text is cut once into blocks of ``BLOCK`` code points and a span reads its own blocks
    only; a substring of the whole text would count its code points from the start for each span.
    """
    def read(blocks: Column, s: Column) -> Column:
        first, skip = F.floor(s["start"] / BLOCK).cast("int"), s["start"] % BLOCK
        own = F.slice(blocks, first + 1, F.ceil((skip + s["length"]) / BLOCK).cast("int"))
        return template.unescape(F.substr(F.array_join(own, ""), skip + 1, s["length"]))

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)),
               lambda blocks: F.array_join(F.transform(spans, lambda s: read(blocks, s)), ""))
