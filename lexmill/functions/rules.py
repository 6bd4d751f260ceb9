"""Ordered rule classifiers as CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a declining answer says, by kind. Case doesn't matter.
FIRST_PERSON = r"\b(?:i|i'm|i am|sorry|apolog)\b"
POLICY_EXPLICIT = (
    r"\bcopyright(?:ed)?\b|\bintellectual property\b|\bpublic domain\b"
    r"|\b(?:reproduce|reproducing|recite|reciting)\b[^.]{0,40}\b(?:protected|verbatim text)\b"
    r"|\bshould(?:n'?t| not)\s+(?:reproduce|provide|share)\b"
)
POLICY_GENERIC = (
    r"\bi\s+(?:cannot|can'?t|won'?t|will not|am not able|am unable)\s+"
    r"(?:provide|help with|assist with|reproduce|continue|share|output)\b"
)
EPISTEMIC = (
    r"\b(?:recall|remember|memoriz\w+|memory)\b|\bnot\s+(?:confident|certain|sure)\b"
    r"|\bdo(?:n'?t| not)\s+have\s+(?:sufficient|enough|the)\b|\bam not familiar\b|\bhave not (?:seen|read)\b"
)
UNKNOWN_LINE = r"(^|\n)\s*unknown\s*($|\n)"

# Kinds of recurring legal prose, first match wins.
FURNITURE = (
    ("statutory_citation", r"\b\d+\s*U\.?S\.?C\.?|\bC\.?F\.?R\.?\s*§|§\s*\d|\bRule\s+\d+[a-z]?[-–]?\d|\bSection\s+\d+\([a-z]\)"),
    ("scotus_boilerplate", r"syllabus|Reporter of Decisions|Detroit Timber|constitutes no part of the opinion"),
    ("pleading_template", r"unless enjoined|reasonably likely to continue|substantial assistance|in connection with the purchase or sale|knowingly or recklessly|for the foregoing reasons|failed to state a claim|upon which relief can be granted"),
    ("quoted_precedent", r"\b\d+\s+F\.\s?(?:2d|3d|4th|Supp\.?)|\b\d+\s+U\.\s?S\.\s+\d+|\([A-Z][a-z]*\.?\s*Cir\.\s*\d{4}\)|\bv\.\s+[A-Z][\w.]+.{0,40}\d{3}|[“\"][^”\"]{40,}[”\"]"),
    ("court_furniture", r"UNITED STATES COURT OF APPEALS|FOR PUBLICATION|Before:.*Circuit Judges|Argued|Submitted|Decided:|NOT FOR PUBLICATION|PER CURIAM"),
)


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern found in the text, whatever the case."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def nonanswer(text: Column, errored: Column | None = None) -> Column:
    """error, empty, unknown_bare, refusal_policy, unknown_explained, unknown_other or attempt.

    Policy words count before epistemic ones, and these before a bare refusal; all need a first person within 400 characters.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    head = F.substring(t, 1, 400)
    person = head.rlike(f"(?i){FIRST_PERSON}")
    bare = F.upper(F.regexp_replace(t, r"""^[ ."'*]+|[ ."'*]+$""", ""))
    out = F.when(F.coalesce(errored, F.lit(False)), "error") if errored is not None else F.when(F.lit(False), "error")
    return (
        out.when(t == "", "empty")
        .when(bare == "UNKNOWN", "unknown_bare")
        .when(person & head.rlike(f"(?i){POLICY_EXPLICIT}"), "refusal_policy")
        .when(person & head.rlike(f"(?i){EPISTEMIC}"), "unknown_explained")
        .when(person & head.rlike(f"(?i){POLICY_GENERIC}"), "refusal_policy")
        .when(t.rlike(f"(?i){UNKNOWN_LINE}"), "unknown_other")
        .otherwise("attempt")
    )


def hotspot_verdict(self_repetition: Column, recur_in_post: Column, arm: Column, category: Column, near: Column, threshold: float = 0.25) -> Column:
    """What makes a well-predicted span unremarkable, or MEMORISATION_CANDIDATE."""
    return (
        F.when(self_repetition >= threshold, "in_document_repetition")
        .when(recur_in_post >= threshold, "recurring_furniture")
        .when(F.coalesce(arm, F.lit("")).contains("post"), "post_cutoff_predictable")
        .when(category.isNotNull(), "furniture_by_pattern")
        .when(near.isNotNull(), "quoted_in_context")
        .otherwise("MEMORISATION_CANDIDATE")
    )


def containment_verdict(share: Column) -> Column:
    """match from a half on, partial from a fifth on, else none."""
    return F.when(share >= 0.5, "match").when(share >= 0.2, "partial").otherwise("none")


def court_level(court: Column) -> Column:
    """(jurisdiction, level) of a court's id; nulls where it isn't known."""
    c = F.lower(court)
    level = F.when(c == "scotus", "supreme").when(c.rlike(r"^ca(\d+|dc|fc)$"), "appeal").when(c.rlike(r"^[a-z]+d$"), "district").when(c.isNotNull(), "state")
    return F.struct(F.when(level == "state", "state").when(level.isNotNull(), "federal").alias("jurisdiction"), level.alias("level"))


def family(model: Column) -> Column:
    """What a model's slug has before its first slash or double underscore."""
    return F.regexp_extract(model, r"^(.*?)(?:/|__|$)", 1)


def older_flags(text: Column, refusal: str) -> tuple[Column, Column]:
    """(refusal, unknown): whether an answer refuses within its first 400 characters, or only says that it doesn't know."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .]+|[ .]+$", "")))
    unknown = F.translate(bare, "’", "'").isin("unknown", "i don't know", "i do not know")
    return (t != "") & ~unknown & F.substring(t, 1, 400).rlike(f"(?i){refusal}"), unknown


def verdict_value(word: Column) -> Column:
    """violation is true, no_violation false, anything else nothing."""
    return F.when(word == "violation", True).when(word == "no_violation", False)


def exact_verdict(said: Column, gold: Column) -> Column:
    """Whether there is a verdict and it is the gold one."""
    return said.isNotNull() & said.eqNullSafe(gold)


def furniture_bucket(own: Column, near: Column, minor: Sequence[str]) -> Column:
    """A span's own kind, else that of its neighbourhood, else __residual; minor kinds are __other."""
    c = F.when(own != "-", own).otherwise(near)
    return F.when(c == "-", "__residual").when(c.isin(*minor), "__other").otherwise(c)


def alignment_warning(prefix_tokens: Column, tokens: Column, first: Column) -> Column:
    """Where a prefix's tokens end in those of the whole: no_suffix_tokens if nothing is behind, boundary_merge if a token spans the
    seam. first is the index of the first token that begins at or behind the seam, null without one."""
    return F.when(first.isNull(), "no_suffix_tokens").when(~F.slice(tokens, F.lit(1), first).eqNullSafe(prefix_tokens), "boundary_merge").otherwise("")
