"""Chat formatting from a declarative template, with loss flags, in SQL functions only.

A :class:`Template` lists the marks around a turn, the roles whose text bears
loss, and a finite-state machine over roles. A conversation becomes a list of
segments (text, loss): mark and role, escaped text, closing mark. Escaping puts a
backslash after the ``<`` of every ``<|`` in a text (and one more where texts have
them already), so no text can hold a mark and the formatted string can be read
back exactly.

Cases: null text and null role count as empty; rows of one conversation with
equal turns are ordered by role, then text; a conversation that the machine
rejects is formatted all the same and flagged with the first bad turn; rows
without conv_id form one conversation; an empty table gives an empty result;
further columns are not read. A conversation is one output string, so its rows
meet in one group by nature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss roles and the machine: (state, role, next state) rows."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    moves: tuple = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepting: tuple = ("assistant",)


def escape(text: Column) -> Column:
    """Reversibly break every ``<|``: one backslash more after its ``<``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role without line ends or marks: backslashes doubled, line ends spelled."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Line ends are the ``\\n`` after an even number of backslashes."""
    spelled = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(spelled, F.lit("\\\\"), F.lit("\\"))


def run_machine(roles: Column, template: Template) -> Column:
    """struct(state, at, bad): the machine's last state and the first bad turn (from 0), or null."""
    arcs = [x for a, r, b in template.moves for x in (F.lit(f"{a}\n{r}"), F.lit(b))]
    table = F.create_map(*arcs)

    def step(s: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(s["state"], F.lit("\n"), role))
        return F.struct(F.coalesce(to, F.lit("error")).alias("state"), (s["at"] + 1).alias("at"),
                        F.coalesce(s["bad"], F.when(to.isNull(), s["at"])).alias("bad"))

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(roles, zero, step)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row per conversation: conv_id,
    n_turns, segments array<struct<text, loss>>, formatted, valid, bad_turn."""
    turns = (rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(template.opening), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
            segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.closing + "\n"), F.lit(False)))

    machine = run_machine(F.transform("turns", lambda t: t["role"]), template)
    return (turns.withColumns({"segments": F.flatten(F.transform("turns", of_turn)), "m": machine})
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    F.col("m.state").isin(*template.accepting).alias("valid"), F.col("m.bad").alias("bad_turn")))


def parse_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    closing = template.closing.replace("|", r"\|") + "\n"
    chunks = F.filter(F.split(formatted, closing, -1), lambda c: c != "")
    head = len(template.opening)

    def turn(c: Column) -> Column:
        cut = F.locate("\n", c)
        return F.struct(unescape_role(F.substring(c, F.lit(head + 1), cut - head - 1)).alias("role"),
                        unescape(F.substring(c, cut + 1, F.length(c))).alias("text"))

    return F.transform(chunks, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, in order, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
