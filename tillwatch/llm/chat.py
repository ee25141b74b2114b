"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A ``Template`` names the strings around each turn, the roles whose text is under the loss mask, the transitions of the
role machine and the control strings that must not occur inside a text.  Texts and roles are escaped reversibly: a
backslash is doubled, and a control string gets a backslash after its first character, so that an escaped text holds no
control string and every marker of the output is one the template wrote.

A conversation is one row of output by definition, so its turns meet in one group; only a conversation is collected,
never a source or a corpus.

Defined results: turns are ordered by turn, role and text, NULL first; a NULL text or role is an empty one; repeated rows
are repeated turns; rows without a conversation id form one conversation with a NULL id; no rows give no rows.  Columns
other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what is missing leads to "invalid".
    transitions: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepting: tuple[str, ...] = ("assistant",)
    #: Strings of common chat templates that must not survive inside a text.
    other_controls: tuple[str, ...] = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.other_controls)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    # A doubled backslash becomes one, a single one goes.
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def next_state(state: Column, role: Column, template: Template) -> Column:
    out = F.lit("invalid")
    for source, on, target in reversed(template.transitions):
        out = F.when((state == source) & (role == on), F.lit(target)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: formatted text, its segments with loss flags, the machine's last state and verdict."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    under_loss = lambda t: t["role"].isin(*template.loss_roles)
    header = lambda t: F.concat(F.lit(template.start), escape(t["role"], template), F.lit(template.middle))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(header(t), F.lit(False)),
                segment(escape(t["text"], template), under_loss(t)),
                segment(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    state = F.aggregate("turns", F.lit("start"), lambda s, t: next_state(s, t["role"], template))
    out = grouped.select("conv_id", pieces.alias("segments"), state.alias("state"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "state",
        F.col("state").isin(*template.accepting).alias("valid"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, the turns parsed from the formatted text, and the unescaped text of the segments under the loss mask."""
    quoted = {n: re.escape(getattr(template, n)).replace("<", "<") for n in ("start", "middle", "end")}
    blocks = F.filter(F.split(F.col("formatted"), quoted["end"]), lambda b: b != "")
    turn = lambda b: F.split(F.substring(b, len(template.start) + 1, 2**31 - 1), quoted["middle"])
    parsed = F.transform(blocks, lambda b: F.transform(turn(b), unescape))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select(
        "conv_id",
        F.transform(parsed, lambda p: F.struct(p[0].alias("role"), p[1].alias("text"))).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )


def chat_digest(turns: DataFrame, template: Template = Template()) -> DataFrame:
    back = read_back(format_chats(turns, template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """Conversation -7: a user and an assistant turn whose texts are control strings."""
    spark = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
