"""Chat templates as column expressions, and where a text joins what goes before it."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Template(NamedTuple):
    """What a conversation begins with, a turn with its {role} and {text}, and what asks for the next turn."""

    begin: str
    turn: str
    ask: str


# Two public formats.
MARKED = Template("", "<|im_start|>{role}\n{text}<|im_end|>\n", "<|im_start|>assistant\n")
HEADED = Template("<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n{text}<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n")


def chat(turns: Column, template: Template, ask: bool = True) -> Column:
    """An array of (role, text) in a template's form, with the beginning of the answer if asked for; null roles and texts are empty."""
    parts = [p for p in re.split(r"(\{role\}|\{text\})", template.turn) if p]

    def one(t: Column) -> Column:
        of = {"{role}": F.coalesce(t["role"], F.lit("")), "{text}": F.coalesce(t["text"], F.lit(""))}
        return F.concat(*[of.get(p, F.lit(p)) for p in parts])

    return F.concat(F.lit(template.begin), F.array_join(F.transform(turns, one), ""), F.lit(template.ask if ask else ""))


def raw(turns: Column) -> Column:
    """The texts of the turns, a line break behind each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def seam(prefix: Column, suffix: Column) -> Column:
    """(first, warning): the number of the first token of prefix and suffix together that begins in the suffix, tokens being runs of
    non-blank characters; no_suffix_tokens if there is none, boundary_merge if a token lies on both sides."""
    merged = prefix.rlike(r"\S\z") & suffix.rlike(r"\A\S")
    rest = F.when(merged, F.regexp_replace(suffix, r"\A\S+", "")).otherwise(suffix)
    none = ~rest.rlike(r"\S")
    n = F.regexp_count(prefix, F.lit(r"\S+"))
    warning = F.when(none, "no_suffix_tokens").when(merged, "boundary_merge").otherwise("")
    return F.struct(F.when(~none, n).alias("first"), warning.alias("warning"))
