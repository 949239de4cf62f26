"""Chat formatting: a finite-state machine over roles and a declarative template.

A ``Template`` is data: for each role an opening and a closing string, the control strings they
are made of, the roles that carry loss, and the machine's transitions. ``formatted`` turns the
rows of a conversation into segments (text, loss) and their joined text; the machine says
whether the order of turns is allowed and which turn breaks it. A conversation that breaks the
order is still formatted, marked ``valid = false``; nothing is dropped.

Control strings inside texts and foreign role names are escaped: backslashes are doubled, and a
backslash goes between the first and the second character of a control string. An escaped text
so holds no control string, a turn ends at the first closing string, and ``read_back`` returns
the very turns. Roles without an entry of their own are written by name.

Everything is DataFrame functions. A conversation is one record: its turns meet in one row.

Edges: a null text or role is the empty string; turns go by number, null first, equal numbers by
role and text; repeated rows are turns of their own; rows without a conv_id form one conversation
without an id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, WRONG = "start", "wrong"


@dataclass(frozen=True)
class Template:
    """Marks by role, control strings, loss roles and the machine over roles."""

    turns: Mapping[str, tuple[str, str]]
    # Opening, the string between name and text, and closing of a role that has no entry.
    named: tuple[str, str, str]
    controls: tuple[str, ...]
    loss: frozenset[str] = frozenset({"assistant"})
    # state -> role -> state; a role without an entry leads to WRONG.
    machine: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    accept: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        for a in self.controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"control string {a!r}: two characters at least, no backslash")
            for b in self.controls:
                inner = a is not b and b in a
                if inner or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        marks = [m for pair in self.turns.values() for m in pair] + list(self.named)
        if any(sum(c in m for c in self.controls) != 1 for m in marks):
            raise ValueError("every mark holds one control string")


# user and assistant in turn after an optional system turn.
DIALOGUE = {
    START: {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}

INST = Template(
    turns={
        "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": ("[INST] ", " [/INST]\n"),
        "assistant": ("<s> ", " </s>\n"),
    },
    named=("[ROLE] ", " [/ROLE] ", " [/TURN]\n"),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    machine=DIALOGUE,
)

CHATML = Template(
    turns={
        "system": ("<|system|>\n", "<|end_system|>\n"),
        "user": ("<|user|>\n", "<|end_user|>\n"),
        "assistant": ("<|assistant|>\n", "<|end_assistant|>\n"),
    },
    named=("<|role|>", "<|says|>\n", "<|end_role|>\n"),
    controls=(
        "<|system|>", "<|end_system|>", "<|user|>", "<|end_user|>", "<|assistant|>", "<|end_assistant|>",
        "<|role|>", "<|says|>", "<|end_role|>",
    ),
    machine=DIALOGUE,
)


def escaped(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    """A pair of backslashes is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, values: Mapping[str, Column], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def end_state(roles: Column, template: Template) -> Column:
    """struct(state, wrong_at): the machine's last state and the first turn it refuses, from 0."""
    moves = [x for s, to in template.machine.items() for r, t in to.items() for x in (f"{s}>{r}", t)]
    table = F.create_map(*map(F.lit, moves)) if moves else F.lit(None).cast("map<string,string>")
    first = F.struct(F.lit(START).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong_at"))

    def step(acc: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit(">"), role)), F.lit(WRONG))
        return F.struct(
            to.alias("state"),
            (acc["n"] + 1).alias("n"),
            F.coalesce(acc["wrong_at"], F.when(to == WRONG, acc["n"])).alias("wrong_at"),
        )

    return F.aggregate(roles, first, step)


def formatted(conversations: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, valid, wrong_at, segments array<struct<text,loss>>, formatted."""
    rows = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    name, says, end = template.named

    def segments(t: Column) -> Column:
        opening = _by_role(
            t["role"],
            {r: F.lit(o) for r, (o, _) in template.turns.items()},
            F.concat(F.lit(name), escaped(t["role"], template), F.lit(says)),
        )
        closing = _by_role(t["role"], {r: F.lit(c) for r, (_, c) in template.turns.items()}, F.lit(end))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(opening, F.lit(False)),
            part(escaped(t["text"], template), t["role"].isin(*template.loss)),
            part(closing, F.lit(False)),
        )

    state = end_state(F.transform("turns", lambda t: t["role"]), template)
    return (
        whole.select("conv_id", state.alias("end"), F.flatten(F.transform("turns", segments)).alias("segments"))
        .select(
            "conv_id",
            F.col("end.state").isin(*template.accept).alias("valid"),
            F.col("end.wrong_at").alias("wrong_at"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(text: Column, template: Template = INST) -> Column:
    """array<struct<role,text>> of a formatted text."""
    quote = lambda marks: "|".join(re.escape(m) for m in sorted(set(marks), key=len, reverse=True))
    name, says, end = template.named
    opens = quote([o for o, _ in template.turns.values()] + [name])
    closes = quote([c for _, c in template.turns.values()] + [end])
    turns = F.regexp_extract_all(text, F.lit(f"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))

    def inner(t: Column, opening: str, closing: str) -> Column:
        return F.substr(t, F.lit(len(opening) + 1), F.length(t) - (len(opening) + len(closing)))

    def turn(t: Column) -> Column:
        rest = inner(t, name, end)
        at = F.instr(rest, says)
        role, said = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(says))
        for r, (o, c) in template.turns.items():
            mine = F.startswith(t, F.lit(o))
            role = F.when(mine, F.lit(r)).otherwise(role)
            said = F.when(mine, inner(t, o, c)).otherwise(said)
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""
    )


def digests(made: DataFrame, template: Template = INST) -> DataFrame:
    """What the output of ``formatted`` reads back as: counts, lengths and digests."""
    back = made.select(
        "conv_id",
        "valid",
        "wrong_at",
        read_back(F.col("formatted"), template).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").alias("chars"),
    )
    newline = F.lit("\n")
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
        "valid",
        "wrong_at",
    )
