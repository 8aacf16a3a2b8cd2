"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its opening string and whether its text is learned
from, the closing string of a turn, and the role transitions that are allowed. A
conversation's turns, in turn order, drive the machine: it emits text segments with a loss
flag each (opening: off, text: the role's flag, closing: off) and ends in a state that says
whether every transition was allowed. Text is escaped so that no control string can appear
in it, and ``read_back`` restores the turns from the formatted string alone.

Everything per turn is done before grouping; a conversation is then one row, because its
formatted string is one value.

Defined cases: a null text is empty; a null role is its own role "?"; unknown roles are
formatted, not learned from, and make the conversation invalid; turns with the same number
go by role, then text, repeated rows staying repeated; rows with a null conversation id form
one conversation; a null turn number comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import let

#: Escapes, in the order they are applied; undone in reverse. A backslash always starts one.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


@dataclass(frozen=True)
class Template:
    """``roles``: role -> (shown name, learned from). ``allowed``: state -> roles that may come next."""

    roles: dict[str, tuple[str, bool]] = field(
        default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)}
    )
    allowed: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    #: Around the role's name and after the text. They hold characters that escaping removes from texts.
    before: str = "### "
    between: str = ": "
    after: str = "</turn>\n"


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _shown(role: Column, template: Template) -> Column:
    """A known role's name; else the role itself, escaped, behind a question mark."""
    shown = F.when(F.lit(False), F.lit(""))
    for name, (title, _) in template.roles.items():
        shown = shown.when(role == name, F.lit(title))
    return shown.otherwise(F.concat(F.lit("?"), F.coalesce(escape(role), F.lit(""))))


def _role(shown: Column, template: Template) -> Column:
    role = F.when(F.lit(False), F.lit(""))
    for name, (title, _) in template.roles.items():
        role = role.when(shown == title, F.lit(name))
    return role.otherwise(unescape(F.substring(shown, F.lit(2), F.length(shown))))


def _run(roles: Column, template: Template) -> Column:
    """The state after all roles; "invalid" once a role came that the state does not allow."""

    def step(state: Column, role: Column) -> Column:
        following = F.when(F.lit(False), F.lit(""))
        for at, may in template.allowed.items():
            following = following.when((state == at) & role.isin(*may), role)
        return following.otherwise(F.lit("invalid"))

    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(
    turns: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv id, segments (text, loss), formatted (their concatenation), state and valid; a row per conversation."""
    template = template or Template()
    learned = [name for name, (_, loss) in template.roles.items() if loss]
    role = turns[role_col].cast("string")
    emitted = turns.select(
        turns[conv_col].alias(conv_col),
        F.struct(
            turns[turn_col].alias("turn"),
            role.alias("role"),
            F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("raw"),
            F.concat(F.lit(template.before), _shown(role, template), F.lit(template.between)).alias("opening"),
            escape(F.coalesce(turns[text_col].cast("string"), F.lit(""))).alias("text"),
            F.coalesce(role.isin(*learned), F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    ordered = emitted.groupBy(conv_col).agg(F.sort_array(F.collect_list("t")).alias("t"))

    def segments(t: Column) -> Column:
        off = F.lit(False)
        return F.array(
            F.struct(t["opening"].alias("text"), off.alias("loss")),
            F.struct(t["text"].alias("text"), t["loss"].alias("loss")),
            F.struct(F.lit(template.after).alias("text"), off.alias("loss")),
        )

    roles = F.transform("t", lambda t: F.coalesce(t["role"], F.lit("?")))
    return (
        ordered.select(conv_col, F.flatten(F.transform("t", segments)).alias("segments"), _run(roles, template).alias("state"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("valid", F.col("state").isin(*template.final))
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array of (role, text) from a formatted string."""
    template = template or Template()
    closed = F.split(formatted, "\\Q" + template.after + "\\E")

    def turn(chunk: Column) -> Column:
        at = F.instr(chunk, template.between)
        shown = F.substring(chunk, F.lit(len(template.before) + 1), at - F.lit(len(template.before) + 1))
        text = F.substring(chunk, at + F.lit(len(template.between)), F.length(chunk))
        return F.struct(_role(shown, template).alias("role"), unescape(text).alias("text"))

    return let(closed, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), turn))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")
