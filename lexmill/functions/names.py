"""Names swapped in texts, in built-in functions, and what tells whether anything else changed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.relational import multiset_difference

# Gendered honorifics, and pronouns by the direction of a swap ("her" is taken as possessive).
HONORIFICS = ("mr", "mrs", "ms", "miss", "mister", "madam", "sir")
PRONOUNS = {
    "female": (("he", "she"), ("him", "her"), ("his", "her"), ("himself", "herself")),
    "male": (("she", "he"), ("herself", "himself"), ("hers", "his"), ("her", "his")),
}
_BEFORE, _BEHIND = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _in_one_pass(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Each pattern by its text, in order, as whole words: what is found first becomes a mark that no text has, so that nothing is
    replaced twice."""
    mark = "\ue000{}\ue001".format
    for i, (pattern, _) in enumerate(rules):
        text = F.regexp_replace(text, f"{_BEFORE}(?:{pattern}){_BEHIND}", mark(i))
    for i, (_, new) in enumerate(rules):
        text = F.replace(text, F.lit(mark(i)), F.lit(new))
    return text


def replaced(text: Column, forms: dict[str, str]) -> Column:
    """Each form by its new one, longest first."""
    return _in_one_pass(text, [(re.escape(k), forms[k]) for k in sorted(forms, key=lambda k: (-len(k), k))])


def swapped(text: Column, forms: dict[str, str], gender: str | None = None) -> Column:
    """Names by their new ones; with a gender pronouns too, capitalised where they were."""
    out = replaced(text, forms)
    if not gender:
        return out
    turned = []
    for old, new in PRONOUNS[gender]:
        turned.append((f"{old[0].upper()}(?i:{old[1:]})", new.capitalize()))
        turned.append((f"{old[0]}(?i:{old[1:]})", new))
    return _in_one_pass(out, turned)


def words_of(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, word): every word of a-z in a text, lower-cased."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)).alias("word"))


def changed_words(df: DataFrame, keys: Sequence[str], before: str, after: str, allowed: DataFrame) -> DataFrame:
    """(keys, word, n_a, n_b): words that a text has more or less often than before, other than those of allowed (word)."""
    moved = multiset_difference(words_of(df, keys, before), words_of(df, keys, after), list(keys), "word")
    return moved.join(allowed.select("word").distinct(), "word", "left_anti").select(*keys, "word", "n_a", "n_b")


def leaked_words(df: DataFrame, keys: Sequence[str], after: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """(keys, word): words of old names (word) that a text still has and that no new name (word) has."""
    gone = old.select("word").distinct().join(new.select("word").distinct(), "word", "left_anti")
    return words_of(df, keys, after).distinct().join(gone, "word", "left_semi")


def may_change(spark, names: Sequence[str], gender_swapped: bool) -> DataFrame:
    """(word): what a swap may touch: words of names, honorifics and, after a swap of gender, pronouns."""
    words = {w for n in names for w in re.findall("[a-z]+", n.lower())} | set(HONORIFICS)
    if gender_swapped:
        words |= {w for pairs in PRONOUNS.values() for pair in pairs for w in pair}
    return spark.createDataFrame([(w,) for w in sorted(words)], "word string")
