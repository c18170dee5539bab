"""Chat formatting by a finite-state machine over roles (DataFrame functions only).

A declarative ``Template`` names the marks, the roles whose text bears loss, and the allowed
role transitions.  Each turn becomes three segments (header, text, trailer) with a loss flag;
only the text of a loss role is under the mask.  Marks inside a text or a role are escaped, so
a formatted conversation splits back into its turns without doubt: ``&`` becomes ``&amp;`` and
the ``<`` of ``<|`` becomes ``&lt;`` (in roles also line ends become ``&#10;``).

The machine starts in ``start``; a turn moves it to the state named by its role where the
template allows, else to ``error`` for good.  A conversation is ``valid`` if it ends in an
accepting state.  Invalid ones are marked, not dropped.

A conversation is one record of the output, so its turns meet in one task (map-side escaping
comes first); everything else is per turn.  Cases: a null text is empty, a null role is the
empty role (never allowed); equal turn numbers are ordered by role and text, null turns come
first; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _step(template: Template, state: Column, role: Column) -> Column:
    allowed = None
    for at, roles in template.moves.items():
        hit = (state == at) & role.isin(*roles)
        allowed = hit if allowed is None else allowed | hit
    return F.when(allowed, role).otherwise(F.lit("error"))


def format_turns(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation: ``segments`` (text, loss), their concatenation ``formatted``, ``state``, ``valid``."""
    t, r = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), r.alias("role"), t.alias("raw"), escape(t).alias("text")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def segments(x: Column) -> Column:
        role = F.replace(escape(x["role"]), F.lit("\n"), F.lit("&#10;"))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(F.concat(F.lit(template.begin), role, F.lit(template.after_role)), F.lit(False)),
                       part(x["text"], x["role"].isin(*template.loss_roles)),
                       part(F.lit(template.end + template.after_turn), F.lit(False)))

    out = grouped.select("conv_id", F.flatten(F.transform("rows", segments)).alias("segments"),
                         F.aggregate("rows", F.lit("start"), lambda s, x: _step(template, s, x["role"])).alias("state"))
    return out.select("conv_id", "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
                      "state", F.col("state").isin(*template.accepting).alias("valid"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Turns parsed from ``formatted`` and the loss text from ``segments``, unescaped."""
    parts = F.split("formatted", r"\Q" + template.end + template.after_turn + r"\E", -1)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        unescape(F.replace(F.substring_index(F.substring(p, len(template.begin) + 1, 1 << 30), template.after_role, 1),
                           F.lit("&#10;"), F.lit("\n"))).alias("role"),
        unescape(F.substr(p, F.instr(p, template.after_role) + len(template.after_role))).alias("text")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", turns.alias("turns"), F.concat_ws("", loss).alias("loss_text"),
                            F.length("formatted").cast("long").alias("formatted_chars"), "state", "valid")


def digest(back: DataFrame) -> DataFrame:
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(text, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "state", "valid")
