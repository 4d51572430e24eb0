"""Chat formatting: a finite-state machine checks the order of roles, a declarative template writes the text.

Built-in column functions only.  The rows of a conversation meet once, in one array ordered by turn; the
machine is a fold over that array, the segments a transformation of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import pick


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles bear loss, and which order of roles is valid."""

    open: str = "<|im_start|>"
    head_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> next state; what is missing is an error.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
        ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "tool"): "tool", ("tool", "assistant"): "assistant",
    })
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: Strings that must not stand in a text as they are.
    control: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )

    def __post_init__(self):
        marks = {self.open, self.close.rstrip("\n")}
        if not marks <= set(self.control):
            raise ValueError("the marks of turns have to be control strings")
        if any(len(c) < 2 or "\\" in c or "\n" in c for c in self.control):
            raise ValueError("control strings need two characters or more, without backslashes and line breaks")
        for c in self.control:
            if any(x[0] + y[1:] in c[1:] for x in self.control for y in self.control):
                raise ValueError(f"another control string starts inside {c!r}")

    @property
    def first(self) -> str:
        return "[" + "".join(re.escape(x) for x in sorted({c[0] for c in self.control})) + "]"

    @property
    def rest(self) -> str:
        return "|".join(re.escape(x) for x in sorted({c[1:] for c in self.control}))


def escape(c: Column, t: Template) -> Column:
    """One backslash more after the first character of whatever is, but for backslashes there, a control string."""
    return F.regexp_replace(c, rf"({t.first})(\\*)(?={t.rest})", r"$1\\$2")


def unescape(c: Column, t: Template) -> Column:
    return F.regexp_replace(c, rf"({t.first})\\(\\*)(?={t.rest})", "$1$2")


def escape_role(c: Column, t: Template) -> Column:
    """As escape(); line breaks are written %0A, since a role ends at the first one."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), t)


def unescape_role(c: Column, t: Template) -> Column:
    return F.replace(F.replace(unescape(c, t), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def machine(turns: Column, t: Template) -> Column:
    """struct(state, error): the state after the last turn; the place of the first turn without a move, or null."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        stop = acc["error"].isNotNull() | to.isNull()
        return F.struct(
            F.when(stop, acc["state"]).otherwise(to).alias("state"),
            F.when(acc["error"].isNotNull(), acc["error"]).when(to.isNull(), acc["n"]).alias("error"),
            (acc["n"] + F.lit(1)).alias("n"),
        )

    first = F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("n"))
    return F.aggregate(turns, first, step)


def formatted(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, error_turn, complete, segments (text, loss), formatted.

    valid: every turn has a move; error_turn: the place (from 0) of the first that has none; complete: valid,
    and the last state is accepted.  An invalid conversation is written like any other.  Null text and null
    role count as empty (the machine has no move for an empty role).  Turns are ordered by (turn, role, text),
    nulls first, so ties and repeated rows have one order; rows with a null id form one conversation.  An
    empty table gives an empty table; other columns are ignored.  Only text bears loss, marks never do.
    """
    t = template or Template()
    source = pick(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    source = source.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = source.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    ran = whole.withColumn("ran", machine(F.col("turns"), t))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def write(turn: Column) -> Column:
        head = F.concat(F.lit(t.open), escape_role(turn["role"], t), F.lit(t.head_end))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(turn["text"], t), turn["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    out = ran.withColumn("segments", F.flatten(F.transform("turns", write)))
    error = F.col("ran.error")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        error.isNull().alias("valid"),
        error.alias("error_turn"),
        (error.isNull() & F.col("ran.state").isin(*t.accept)).alias("complete"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def turns_back(text: Column, template: Template | None = None) -> Column:
    """array(struct(role, text)): the turns that a formatted text holds."""
    t = template or Template()

    def read(part: Column) -> Column:
        head = F.instr(part, t.head_end)
        body = F.substr(part, head + F.lit(len(t.head_end)))
        return F.struct(
            unescape_role(F.substr(part, F.lit(1), head - F.lit(1)), t).alias("role"),
            unescape(F.substr(body, F.lit(1), F.length(body) - F.lit(len(t.close))), t).alias("text"),
        )

    parts = F.split(text, re.escape(t.open), -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), read)


def digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted texts hold, read back from them alone: turns, roles and the loss text by the template's loss roles."""
    t = template or Template()
    back = chats.withColumn("back", turns_back(F.col("formatted"), t))
    turns = F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.transform(F.filter("back", lambda x: x["role"].isin(*t.loss_roles)), lambda x: x["text"])
    read = back.select("*", F.array_join(turns, "").alias("turns_text"), F.array_join(loss, "").alias("loss_text"))
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
    )
