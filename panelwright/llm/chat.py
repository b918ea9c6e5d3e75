"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template names for each role its opening and closing marker and whether its
text is under the loss, and gives the transitions of the machine.  A
conversation comes out as segments ``(text, loss)`` whose texts joined are the
formatted text.  Control strings inside a text are broken by an escape
character, so markers stand for turns alone, and reading back is exact.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import let, written


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False


def _turns() -> dict[str, Turn]:
    return {"system": Turn("<<SYS>> ", " <</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", True)}


def _moves() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    }


@dataclass(frozen=True)
class Template:
    """``roles`` with markers, ``moves`` from state by role, and the states a conversation may end in.

    Any other role is written between ``other_opening`` + its name in base64 +
    ``]`` and ``other_closing``.  A control string must start with ``<`` or ``[``.
    """

    roles: Mapping[str, Turn] = field(default_factory=_turns)
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=_moves)
    final: tuple[str, ...] = ("answered",)
    other_opening: str = "[ROLE="
    other_closing: str = " [/ROLE]"

    def controls(self) -> list[str]:
        markers = [m.strip() for t in self.roles.values() for m in (t.opening, t.closing)]
        return [*markers, self.other_opening.strip(), self.other_closing.strip()]


def escape(text: Column, template: Template) -> Column:
    """Put a backslash after each backslash and after the first character of each control string."""
    tails = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(text, rf"(\\|{tails})", r"$1\\")


def unescape(text: Column) -> Column:
    """A doubled backslash is one backslash; a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, template: Template, pick, other: Column) -> Column:
    out = other
    for name, turn in template.roles.items():
        out = F.when(role == name, pick(turn)).otherwise(out)
    return out


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id``, ``n_turns``, ``valid``, ``segments`` and ``formatted``, one row per conversation.

    Turns come in the order of ``turn``, then role, then text (nulls first); a
    null role counts as the empty role, a null text as empty, and rows with a null
    ``conv_id`` form one conversation.  Repeated rows are turns of their own.
    ``valid`` is false where the machine has no move for a role or ends in a
    state that is not final; such conversations are formatted all the same.
    """
    row = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    grouped = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for s, by in template.moves.items() for r, to in by.items() for x in (f"{s} {r}", to)])
    state = F.aggregate(
        "turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(" "), t["role"])), F.lit("wrong"))
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(t: Column) -> Column:
        name = F.concat(F.lit(template.other_opening), F.base64(F.encode(t["role"], "UTF-8")), F.lit("] "))
        opening = _by_role(t["role"], template, lambda x: F.lit(x.opening), name)
        closing = _by_role(t["role"], template, lambda x: F.lit(x.closing), F.lit(template.other_closing))
        loss = _by_role(t["role"], template, lambda x: F.lit(x.loss), F.lit(False))
        return F.array(segment(opening, F.lit(False)), segment(escape(t["text"], template), loss), segment(closing, F.lit(False)))

    out = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        state.isin(*template.final).alias("valid"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(output: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns and loss text parsed from formatted conversations: adds ``turns`` and ``loss_text``."""
    blocks = [f"{re.escape(t.opening)}.*?{re.escape(t.closing)}" for t in template.roles.values()]
    blocks.append(f"{re.escape(template.other_opening)}[A-Za-z0-9+/=]*\\] .*?{re.escape(template.other_closing)}")
    found = F.regexp_extract_all("formatted", F.lit("(?s)" + "|".join(blocks)), F.lit(0))

    def inner(block: Column, opening: Column, closing: int) -> Column:
        return F.substring(block, opening + 1, F.length(block) - opening - closing)

    def parsed(block: Column) -> Column:
        head = F.instr(block, "] ") + 1
        name = F.decode(F.unbase64(F.substring(block, F.lit(len(template.other_opening) + 1), head - len(template.other_opening) - 2)), "UTF-8")
        out = F.struct(name.alias("role"), unescape(inner(block, head, len(template.other_closing))).alias("text"))
        for role, t in template.roles.items():
            own = F.struct(F.lit(role).alias("role"), unescape(inner(block, F.lit(len(t.opening)), len(t.closing))).alias("text"))
            out = F.when(block.startswith(t.opening), own).otherwise(out)
        return out

    under_loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return output.withColumns({"turns": F.transform(found, parsed), "loss_text": F.array_join(under_loss, "")})


# The texts of conversation -7 hold the control strings of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def with_control_conversation(turns: DataFrame) -> DataFrame:
    narrow = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = turns.sparkSession.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return narrow.unionByName(extra)


def result(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Contract columns, read back from the written output."""
    back = read_back(written(formatted(with_control_conversation(turns), template), "chat"), template)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def oracle_sql(template: Template = Template()) -> str:
    added = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in [*template.controls(), "\\"])
    sizes = " ".join(f"WHEN '{r}' THEN {len(t.opening) + len(t.closing)}" for r, t in template.roles.items())
    losses = ", ".join(f"'{r}'" for r, t in template.roles.items() if t.loss)
    other = len(template.other_opening) + 2 + len(template.other_closing)
    steps = ", ".join(f"('{s}', '{r}')" for s, by in template.moves.items() for r in by)
    lands = " ".join(f"WHEN '{r}' THEN '{to}'" for by in template.moves.values() for r, to in by.items())
    final = ", ".join(f"'{s}'" for s in template.final)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
m AS (SELECT *, length(text) + {added} + CASE role {sizes} ELSE {other} + length(base64(encode(role))) END AS chars,
             CASE role {lands} ELSE 'wrong' END AS state,
             lag(CASE role {lands} ELSE 'wrong' END, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role IN ({losses})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({losses})), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and((prior, role) IN ({steps})) AND arg_max(state, (turn, role, text)) IN ({final}) AS valid
FROM m GROUP BY conv_id
"""
