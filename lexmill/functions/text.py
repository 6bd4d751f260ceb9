"""Text as column expressions: normalising, tokens, sentences, headings, extraction, tolerant JSON."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and what they are folded to.
FOLD_FROM = "‘’‚‛“”„‐‑‒–—―−    "
FOLD_TO = "''''\"\"\"-------    "
FOLD_WORDS = {"­": "", "​": "", "…": "...", "§": "section"}
#: All of these but the blanks lie in here.
FOLDED = "[\u00a7\u00ad\u200b-\u2212]"

WORD = r"([\p{L}\p{N}_']+)"
#: What stands between such words, but for blanks; the commonest characters come first, as they are told at once.
NO_WORD = r"[^a-z0-9_' \p{L}\p{N}]"


@F.pandas_udf(T.StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form, for which there is no built-in function."""
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def is_ascii(s: Column) -> Column:
    """Whether a text has ASCII characters only."""
    return F.octet_length(s) == F.char_length(s)


def fold(s: Column) -> Column:
    """Typographic quotes, dashes and spaces as plain ones."""
    t = F.translate(s, FOLD_FROM, FOLD_TO)
    for a, b in FOLD_WORDS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(s.rlike(FOLDED), t).otherwise(s)  # translate is slow, and seldom needed


def squeeze(s: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s(?:\s+|(?<! ))", " "))  # a single blank stays as it is


def normalize(s: Column, lower: bool = True, drop_punct: bool = False, compat: bool = False) -> Column:
    """Folded, lower-cased, squeezed; compat applies NFKC first. A null counts as empty."""
    s = F.coalesce(s, F.lit(""))
    plain = is_ascii(s)  # neither compatibility forms nor folding change that
    s = F.when(plain, s).otherwise(fold(nfkc(F.when(~plain, s)) if compat else s))
    s = F.lower(s) if lower else s
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", " ") if drop_punct else s
    return squeeze(s)


def tokens(s: Column, compat: bool = False) -> Column:
    """Words of letters, digits, _ and ' of the normalised text."""
    return F.regexp_extract_all(normalize(s, compat=compat), F.lit(WORD), 1)


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of so many words, joined by blanks; none where there are fewer words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.array_distinct(F.when(n >= size, runs).otherwise(F.array().cast("array<string>")))


def shingle_words(s: Column) -> Column:
    """Words for shingles: lower case, punctuation but the section sign dropped."""
    return F.filter(F.split(squeeze(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s§]", " ")), " "), lambda w: w != "")


def dehyphenate(s: Column) -> Column:
    return F.regexp_replace(s, r"([A-Za-z])-\n([a-z])", "$1$2")


def tidy(s: Column) -> Column:
    """Ligatures and soft hyphens spelled out, blanks and blank lines collapsed."""
    for a, b in {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "­": "", " ": " "}.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def without_noise(s: Column) -> Column:
    """Without lines that are page numbers."""
    return F.regexp_replace(s, r"(?mi)^[ \t]*(?:page\s+\d+(?:\s+of\s+\d+)?|-[ \t]*\d+[ \t]*-|\d{1,4})[ \t]*$", "")


def hard_wraps(s: Column) -> tuple[Column, Column]:
    """(line breaks followed by a small letter, line breaks followed by anything)."""
    return F.regexp_count(s, F.lit(r"\n[a-zà-öø-ÿ]")), F.regexp_count(s, F.lit(r"\n[^\n]"))


def sentences(s: Column) -> Column:
    """Split behind . ! ? or a closing quote where a capital follows: a mark is put there first, so that no look-behind is needed."""
    marked = F.regexp_replace(s, r"([.!?”])\s+([A-ZÀ-ÖØ-Þ“])", "$1\u0001$2")
    return F.transform(F.split(marked, "\u0001"), squeeze)


def usable_sentence(s: Column, least: int = 22, most: int = 70) -> Column:
    """Long enough, capitalised, without digits or citation marks, brackets and quotes in pairs."""
    n = F.size(F.split(s, " "))
    pairs = lambda a, b: (F.length(s) - F.length(F.replace(s, F.lit(a), F.lit("")))) == (F.length(s) - F.length(F.replace(s, F.lit(b), F.lit(""))))
    return n.between(least, most) & s.rlike(r"^\p{Lu}") & ~s.rlike(r"\d") & ~s.rlike(r"\b(Id\.|supra|infra|Cir\.|U\.S\.C\.)|[§¶]") & pairs("(", ")") & pairs("“", "”")


def split_prompt(words: Column, n: int, rest: int = 7) -> Column:
    """(prompt, answer): the first n words and the others; null unless at least `rest` words remain."""
    ok = F.size(words) >= n + rest
    return F.when(ok, F.struct(F.array_join(F.slice(words, 1, n), " ").alias("prompt"), F.array_join(F.slice(words, F.lit(n + 1), F.size(words)), " ").alias("answer")))


def slug(s: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(s, 1, most)


def strip_tags(s: Column) -> Column:
    return squeeze(F.regexp_replace(s, r"<[^>]+>", " "))


def last_words(s: Column, n: int) -> Column:
    """The last n words of a text."""
    w = F.filter(F.split(squeeze(s), " "), lambda x: x != "")
    return F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), F.lit(n)), " ")


def heading_kind(line: Column) -> Column:
    """roman, caps or lettered headings; null for other lines."""
    l = F.trim(line)
    return (
        F.when(l.rlike(r"^[IVXL]{1,5}\.(\s+[A-Z].{0,58})?$"), "roman").when(l.rlike(r"^[A-Z][A-Z .\-'&]{5,50}$"), "caps").when(l.rlike(r"^[A-Z]\.\s+[A-Z].{2,58}$"), "lettered")
    )


def is_heading(line: Column) -> Column:
    """A title-like line: short, capitalised, without a final stop."""
    return heading_kind(line).isNotNull()


def first_json(s: Column) -> Column:
    """From the first opening to the last closing brace, code fences removed; null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(s, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def split_recall(s: Column) -> Column:
    """(recall, answer) of a SOURCE: ... ANSWER: ... reply; without these marks the whole reply is the answer."""
    source = F.lower(F.regexp_extract(s, r"(?im)^\s*source:\s*(\w+)", 1))
    recall = F.when(source.isin("recalled", "yes"), "recalled").when(source.isin("inferred", "no"), "inferred").otherwise("")
    answer = F.regexp_extract(s, r"(?is)answer:\s*(.*)$", 1)
    return F.struct(recall.alias("recall"), F.trim(F.when(answer != "", answer).otherwise(s)).alias("answer"))


def flagged(citations: Column, known: list[str]) -> Column:
    """The citations that match none of the known patterns."""
    return F.filter(citations, lambda c: ~F.lower(c).rlike("|".join(known)))


def date_agreement(a: Column, b: Column, near: int = 7) -> Column:
    """same, close (within `near` days), off_by_Nd, or unknown where a date is missing."""
    d = F.abs(F.datediff(a, b))
    return F.when(d.isNull(), "unknown").when(d == 0, "same").when(d <= near, "close").otherwise(F.concat(F.lit("off_by_"), d.cast("string"), F.lit("d")))


def answer_problem(s: Column, least: int = 300) -> Column:
    """Why an answer isn't usable: empty, short or a pointer to another place; null if it is."""
    a = F.trim(F.coalesce(s, F.lit("")))
    return F.when(a == "", "empty").when(F.length(a) < least, "short").when(F.substring(a, 1, 200).rlike(r"(?i)\b(see (above|below|attached)|as (stated|noted) above)\b"), "pointer")


def file_kind(content: Column) -> Column:
    """By the first bytes: pdf, html, zip or other; empty where there is none."""
    c = F.ltrim(F.lower(F.substring(content, 1, 200)))
    return F.when(c == "", "empty").when(c.startswith("%pdf"), "pdf").when(c.rlike(r"^<(!doctype html|html)"), "html").when(c.startswith("pk"), "zip").otherwise("other")


def soft_404(content: Column) -> Column:
    """A page that says it isn't there."""
    return F.lower(content).rlike(r"<title>[^<]*(not found|404|access denied)")


def render(turns: Column) -> Column:
    """SPEAKER: text lines of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), "\n")


def case_key(caption: Column) -> Column:
    """A caption folded for comparison: lower case, stops dropped, legal forms and punctuation removed."""
    s = F.replace(F.lower(caption), F.lit("."), F.lit(""))
    s = F.regexp_replace(s, r"\b(inc|llc|corp|co|ltd|lp|et al)\b", " ")
    return squeeze(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def ages(s: Column) -> Column:
    """Ages of the form 45-year-old, 45 years old or aged 45."""
    return F.filter(F.concat(F.regexp_extract_all(s, F.lit(r"(\d{1,3})[- ]years?[- ]old"), 1), F.regexp_extract_all(s, F.lit(r"aged (\d{1,3})"), 1)), lambda x: x.cast("int").between(1, 120))


def dollars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(\$\d[\d,]*(?:\.\d+)?)"), 1)


def unwrap_lines(wrap_min: int = 55):
    """A pandas UDF that joins lines broken at the margin: a fold over lines, each depending on the one kept before it."""
    import re

    # List marks, headings, page numbers and footnotes at the start of a line.
    listed = re.compile(r"\s*(?:[A-Za-z][.)]\s|\(?[ivxlcIVXLC]+[.)]\s|\d{1,3}[.)]\s|\(\d{1,3}\)\s|[-•‣●*]\s)")
    heading = re.compile(r"\s*(?:[IVXL]+\.\s*)?[A-Z][A-Z0-9 ,.\-'&/()]{2,60}\s*$")
    noise = re.compile(r"\s*(?:page\s+\d+(?:\s+of\s+\d+)?|-\s*\d+\s*-|\d{1,4})\s*$", re.I)
    note = re.compile(r"\s*\d{1,3}\s+[A-Z]")

    def one(text: str) -> str:
        if not text.strip():
            return text
        text = re.sub(r"([A-Za-z])-\n([a-z])", r"\1\2", text.replace("\r\n", "\n").replace("\r", "\n"))
        kept: list[str] = [""]
        for line in map(str.strip, text.split("\n")):
            last = kept[-1]
            if line and noise.match(line):
                continue
            starts_anew = any(p.match(line) for p in (listed, heading, note))
            if line and last and len(last) >= wrap_min and not starts_anew and not heading.match(last):
                kept[-1] = f"{last} {line}"
            elif line or last:
                kept.append(line)
        joined = re.sub(r"[ \t]+", " ", "\n".join(kept))
        return re.sub(r"\n{3,}", "\n\n", joined).strip()

    @F.pandas_udf(T.StringType())
    def unwrap(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    unwrap.one = one
    return unwrap


def plain_words(s: Column) -> Column:
    """The words of a-z, 0-9 and ' of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("([a-z0-9']+)"), 1)


def between_marks(s: Column, start: str, end: str) -> Column:
    """What stands behind the first start mark and before the first end mark after it, without white space at the ends."""
    body = F.when(s.rlike(start), F.regexp_replace(s, f"(?s)^.*?(?:{start})", "")).otherwise(s)
    return F.regexp_replace(F.when(body.rlike(end), F.regexp_replace(body, f"(?s)(?:{end}).*$", "")).otherwise(body), r"^\s+|\s+$", "")


def first_of(s: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that is found, white space as blanks; null where none is."""
    return F.coalesce(*[F.nullif(squeeze(F.regexp_extract(s, p, 1)), F.lit("")) for p in patterns])


def file_name_parts(name: Column) -> Column:
    """(year, court, caption) of names like cl_2020_ca9_Some_v_Other.pdf; other names are a caption without their ending."""
    pattern = r"(?i)^cl_(\d{4})_([a-z0-9]+)_(.+)\.pdf$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    caption = F.when(part(3) != "", part(3)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.struct(part(1).alias("year"), part(2).alias("court"), squeeze(F.replace(F.replace(caption, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(". "))).alias("caption"))


def highlighted(s: Column, pattern: str) -> Column:
    """The text with a mark before the lines that hold the pattern, whatever the case, and blanks before the others."""
    return F.array_join(F.transform(F.split(s, "\n"), lambda x: F.concat(F.when(x.rlike(f"(?i){pattern}"), "> ").otherwise("  "), x)), "\n")


def safe_name(s: Column) -> Column:
    """A file name: letters, digits, _ . and - stay, the rest is _."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}_.\-]", "_")


def p_text(p: Column) -> Column:
    """A p value in three places without the leading zero, or <.001."""
    return F.when(p < 0.001, "<.001").otherwise(F.regexp_replace(F.format_string("%.3f", p), "^0+", ""))


def in_range(index: Column, n: Column) -> Column:
    """An index if it is one of n places, else null."""
    return F.when((index >= 0) & (index < n), index)


def professions(s: Column, known: list[str]) -> Column:
    """The known professions that a text names, in the list's order."""
    return F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.contains(F.lower(s), k))


def first_name(s: Column) -> Column:
    """The first of two capitalised words in a row, the simplest sign of a person's name; null without such."""
    return F.nullif(F.regexp_extract(s, r"\b([A-Z][a-z]+) [A-Z][a-z]+\b", 1), F.lit(""))


def query_variants(caption: Column, common: list[str], least: int = 3) -> Column:
    """Search phrases for a caption that may have lost its end: itself, without its last word, its three longest distinctive words, and
    the longest; each once, whatever the case, without those of fewer than `least` characters."""
    words = F.filter(F.split(caption, r"[^A-Za-z0-9']+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~F.lower(w).isin(*common) & (F.length(w) > 3))
    ranked = F.array_sort(F.transform(telling, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda x: x["w"])
    every = F.array(F.trim(caption), F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "), F.array_join(top, " "), F.coalesce(F.get(top, 0), F.lit("")))
    fits = F.filter(every, lambda q: F.length(q) >= least)
    lower = F.transform(fits, lambda q: F.lower(q))
    return F.filter(fits, lambda q, i: F.array_position(lower, F.lower(q)) == i + 1)


def spaced_headings(found: Column, least: int = 20) -> Column:
    """Headings (place, heading) in order without those that begin fewer than `least` characters behind the last one kept."""
    none = F.slice(found, 1, 0)
    far = lambda kept, h: (F.size(kept) == 0) | (h["place"] - F.element_at(kept, -1)["place"] >= least)
    return F.aggregate(found, none, lambda kept, h: F.when(F.size(kept) == 0, F.array(h)).when(far(kept, h), F.concat(kept, F.array(h))).otherwise(kept))


def word_blocks(words: Column, blocks: int, least: int) -> Column:
    """Words in about so many blocks of equal length, at least `least` words each; a shorter rest is left out."""
    size = F.greatest(F.lit(least), F.floor(F.size(words) / blocks).cast("int"))
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), size)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: F.slice(words, s, size)), lambda b: F.size(b) >= least)


def flipped(word: Column, pairs: dict[str, str]) -> Column:
    """A word's counterpart with its capitals: all, the first or none; words without one stay."""
    new = F.coalesce(*[F.when(F.lower(word) == a, F.lit(b)) for a, b in pairs.items()], F.lit(None))
    cased = F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).when(F.substring(word, 1, 1) == F.upper(F.substring(word, 1, 1)), F.initcap(new)).otherwise(new)
    return F.coalesce(cased, word)
