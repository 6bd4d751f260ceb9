"""Probe questions from documents, prompts, and tables around model calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numbers import ratio
from lexmill.functions.text import heading_kind, sentences, squeeze, usable_sentence, without_noise, word_blocks
from lexmill.operators.relational import By, place_in_group
from lexmill.operators.sampling import scramble

#: Words of a completion's prompt, in rotation by a document's number; words of the answer after an anchor.
LENGTHS, ANCHORED = (6, 12, 24, 48), 20
#: Words of prompt and answer of a long continuation, and words that a document has besides.
LONG_PROMPT, LONG_ANSWER, LONG_ROOM = 30, 60, 200
_CITES = r"\b(Id\.|supra|infra|Cir\.|U\.S\.C\.)|[§¶]"


class Context(NamedTuple):
    """What questions are made from: usable sentences and their numbers of words, words of the squeezed text, headings with their places, the text, its number
    in the corpus, and the word at which an anchored family breaks (null without one)."""

    sents: Column
    sizes: Column
    words: Column
    heads: Column
    text: Column
    index: Column
    anchor: Column


class Question(NamedTuple):
    """An id, its tier (A: facts, D: from the text), the wording, and what makes (prompt, answer, evidence) of a context."""

    qid: str
    tier: str
    wording: str
    make: Callable[[Context], Column]


def _said(answer: Column, evidence: Column | str, prompt: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(prompt).alias("prompt"), F.nullif(answer, F.lit("")).alias("answer"), lit(evidence).alias("evidence"))


def _nearest(first: Column, least: Column, end: Column, fits: Callable[[Column], Column]) -> Column:
    """The first index from `first` up to `end` that fits, else the last one before it down to `least`; null if none does."""
    ahead = F.filter(F.sequence(first, end - 1), fits)
    behind = F.when(first > least, F.filter(F.reverse(F.sequence(least, first - 1)), fits))
    return F.coalesce(F.get(ahead, 0), F.get(behind, 0))


def completion(percent: int, words: int | None = None, least: int = 6) -> Callable[[Context], Column]:
    """A sentence at that depth of the usable ones, cut after so many words (LENGTHS in rotation); seven words at least remain."""

    def make(c: Context) -> Column:
        n = F.size(c.sents)
        want = F.lit(words) if words else F.element_at(F.array(*[F.lit(x) for x in LENGTHS]), (F.pmod(c.index, F.lit(len(LENGTHS))) + 1).cast("int"))
        at = F.least(n - 1, F.floor(n * percent / 100).cast("int"))
        j = F.when(n >= least, _nearest(at, F.lit(0), n, lambda k: F.get(c.sizes, k) > want + 6))
        w = F.split(F.get(c.sents, j), " ")
        why = F.when(n < least, "too few sentences").when(j.isNull(), F.concat(F.lit("no sentence for a prompt of "), want.cast("string")))
        where = F.concat_ws("", F.lit("sentence "), (j + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit(", prompt "), want.cast("string"))
        return _said(F.array_join(F.slice(w, want + 1, F.size(w)), " "), F.coalesce(why, where), F.when(j.isNull(), "").otherwise(F.array_join(F.slice(w, F.lit(1), want), " ")))

    return make


def sentence(last: bool) -> Callable[[Context], Column]:
    def make(c: Context) -> Column:
        return _said(F.get(c.sents, F.size(c.sents) - 1 if last else F.lit(0)), "last sentence" if last else "first sentence")

    return make


def continuation(c: Context) -> Column:
    """From a third of the text on, ten words at a time: a stretch without digits and citations that begins with a capital."""
    n, need = F.size(c.words), LONG_PROMPT + LONG_ANSWER
    end = F.least(n - need, F.floor(n * 80 / 100).cast("int"))
    first = F.floor(n / 3).cast("int")
    clean = lambda i: F.array_join(F.slice(c.words, i + 1, need), " ")
    fits = lambda i: F.get(c.words, i).rlike(r"^\p{Lu}") & ~clean(i).rlike(rf"\d|{_CITES}")
    at = F.when((n >= need + LONG_ROOM) & (first < end), F.get(F.filter(F.sequence(first, end - 1, F.lit(10)), fits), 0))
    why = F.when(n < need + LONG_ROOM, "text too short").when(at.isNull(), "no clean stretch")
    where = F.concat_ws("", F.lit("words "), at.cast("string"), F.lit("-"), (at + need).cast("string"), F.lit("/"), n.cast("string"))
    part = lambda a, k: F.coalesce(F.array_join(F.slice(c.words, a, k), " "), F.lit(""))
    return _said(part(at + LONG_PROMPT + 1, LONG_ANSWER), F.coalesce(why, where), part(at + 1, LONG_PROMPT))


def heading(k: int) -> Callable[[Context], Column]:
    return lambda c: _said(F.get(c.heads, k - 1)["heading"], F.concat(F.size(c.heads).cast("string"), F.lit(" headings")))


def heading_list(c: Context) -> Column:
    names = F.array_join(F.slice(F.transform(c.heads, lambda h: h["heading"]), 1, 8), " | ")
    return _said(F.when(F.size(c.heads) >= 2, names), F.concat(F.size(c.heads).cast("string"), F.lit(" headings")))


def sentence_after_heading(k: int) -> Callable[[Context], Column]:
    """The first sentence of eight words and more, with a capital, behind a heading's line."""

    def make(c: Context) -> Column:
        h = F.get(c.heads, k - 1)
        fits = F.filter(sentences(without_noise(F.substr(c.text, h["next"] + 1))), lambda s: (F.size(F.split(s, " ")) >= 8) & s.rlike(r"^\p{Lu}"))
        why = F.when(F.size(c.heads) < k, F.concat(F.size(c.heads).cast("string"), F.lit(" headings")))
        return _said(F.get(fits, 0), F.coalesce(why, F.concat(F.lit("after "), h["heading"])))

    return make


def anchored(words: int) -> Callable[[Context], Column]:
    """So many words before the anchor as a prompt, the same ANCHORED words after it as the answer of the whole family."""

    def make(c: Context) -> Column:
        part = lambda a, k: F.coalesce(F.array_join(F.slice(c.words, a, F.lit(k)), " "), F.lit(""))
        where = F.concat_ws("", F.lit("word "), c.anchor.cast("string"), F.lit("/"), F.size(c.words).cast("string"), F.lit(f", prompt {words}"))
        return _said(part(c.anchor + 1, ANCHORED), F.when(c.anchor.isNull(), "no anchor").otherwise(where), part(c.anchor - words + 1, words))

    return make


_COMPLETE, _NEXT = "Complete this sentence.", f"Complete the next {ANCHORED} words of this passage, verbatim."
#: Questions on a text, by id. Facts (Q01 to Q04) come from columns, see questions().
ON_TEXTS = [
    Question("Q05", "D", "What is the first sentence?", sentence(False)),
    Question("Q06", "D", "What is the last sentence?", sentence(True)),
    *[Question(f"Q{7 + i:02d}", "D", _COMPLETE, completion(p)) for i, p in enumerate((2, 15, 30, 45, 60, 75, 90))],
    Question("Q14", "D", "Continue this passage for some 60 words.", continuation),
    Question("Q15", "D", "What is the first heading?", heading(1)),
    Question("Q16", "D", "List the headings in order.", heading_list),
    Question("Q17", "D", "What is the first sentence after the first heading?", sentence_after_heading(1)),
    Question("Q18", "D", "What is the first sentence after the second heading?", sentence_after_heading(2)),
    Question("Q19", "D", _COMPLETE, completion(50, 6)),
    Question("Q20", "D", _COMPLETE, completion(50, 48)),
    *[Question(f"Q{21 + i}", "D", _NEXT, anchored(n)) for i, n in enumerate(LENGTHS)],
]
#: Those that control passages get, with prompts of one length.
ON_CONTROLS = [*[Question(f"Q{7 + i:02d}", "D", _COMPLETE, completion(p, 12)) for i, p in enumerate((2, 15, 30, 45, 60, 75, 90))], *ON_TEXTS[-4:]]


def _headings(text: Column) -> Column:
    """(heading, at, next) of a text's heading lines, where they begin and where the next line does; the first twentieth of the
    text counts as its caption, and a heading less than 20 characters after the last one kept is dropped."""
    start = F.floor(F.length(text) * 5 / 100).cast("int")
    cut = (start > 0) & (F.substr(text, start, F.lit(1)) != "\n")  # in the midst of a line

    def line(s: Column, i: Column) -> Column:
        name = squeeze(s)
        fine = heading_kind(s).isNotNull() & (F.length(name) >= 4) & ~((i == 0) & cut)
        return F.struct((F.length(s) + 1).alias("n"), F.when(fine, name).alias("heading"))

    def step(a: Column, x: Column) -> Column:
        keep = x["heading"].isNotNull() & (a["pos"] - a["last"] >= 20)
        one = F.array(F.struct(x["heading"].alias("heading"), a["pos"].alias("at"), (a["pos"] + x["n"]).alias("next")))
        return F.struct((a["pos"] + x["n"]).alias("pos"), F.when(keep, a["pos"]).otherwise(a["last"]).alias("last"), F.when(keep, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    none = F.array().cast("array<struct<heading:string,at:int,next:int>>")
    lines = F.transform(F.split(F.substr(text, start + 1), "\n"), line)
    return F.aggregate(lines, F.struct(start.alias("pos"), F.lit(-1000).alias("last"), none.alias("out")), step, lambda a: a["out"])


def _anchor(words: Column, percent: int) -> Column:
    """A word near that depth which begins a sentence, with room for the longest prompt and the answer, clear of digits and citations."""
    before = max(LENGTHS)
    n = F.size(words)
    end = n - ANCHORED
    first = F.least(F.greatest(F.floor(n * percent / 100).cast("int"), F.lit(before)), end - 1)
    around = lambda i: F.array_join(F.slice(words, i - before + 1, before + ANCHORED), " ")
    fits = lambda i: F.get(words, i).rlike(r"^\p{Lu}") & F.get(words, i - 1).rlike("[.][\"”]?$") & ~around(i).rlike(rf"\d|{_CITES}")
    return F.when(end > before, _nearest(first, F.lit(before), end, fits))


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are computed once however often they are used: no projection is merged across a generator."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("__once")).select("*", "__once.*").drop("__once")


def questions(df: DataFrame, key: str, text: str, facts: dict[str, tuple[str, Column]] | None = None, index: Column | None = None, asked: Sequence[Question] = ON_TEXTS, anchor_percent: int = 45) -> DataFrame:
    """(key, qid, tier, question, prompt, prompt_words, answer, found, evidence, lo, hi, n_sentences, n_headings): a row for each row of
    df and question, in one pass without a shuffle, answered or not.

    facts are questions whose answers are columns of df: {id: (wording, answer)}. index is a row's number, which turns the lengths
    of prompts. evidence says where an answer is from or why there is none; lo and hi are its place in the squeezed text where it
    stands there as it is. A null text has no answers but facts, and a null answer is not found.
    """
    given = {f"__f{i}": F.struct(F.lit(q).alias("qid"), F.lit("A").alias("tier"), F.lit(w).alias("question"), F.lit("").alias("prompt"), F.nullif(a.cast("string"), F.lit("")).alias("answer"), F.lit("from the record").alias("evidence")) for i, (q, (w, a)) in enumerate((facts or {}).items())}
    x = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__t"), (F.lit(0) if index is None else index).cast("bigint").alias("__i"), *[c.alias(k) for k, c in given.items()])
    x = _once(x, __b=squeeze(without_noise(F.col("__t"))), __s=F.filter(sentences(without_noise(F.col("__t"))), lambda x: usable_sentence(x)), __h=_headings(F.col("__t")))
    x = _once(x, __w=F.filter(F.split("__b", " "), lambda w: w != ""), __z=F.transform("__s", lambda s: F.size(F.split(s, " "))))
    x = _once(x, __a=_anchor(F.col("__w"), anchor_percent))
    c = Context(*[F.col(n) for n in ("__s", "__z", "__w", "__h", "__t", "__i", "__a")])
    made = [*[F.col(k) for k in given]]
    for q in asked:
        said = q.make(c)
        made.append(F.struct(F.lit(q.qid).alias("qid"), F.lit(q.tier).alias("tier"), F.lit(q.wording).alias("question"), said["prompt"].alias("prompt"), said["answer"].alias("answer"), said["evidence"].alias("evidence")))
    x = x.select(key, "__b", F.size("__s").alias("n_sentences"), F.size("__h").alias("n_headings"), F.explode(F.array(*made)).alias("q")).select(key, "q.*", "__b", "n_sentences", "n_headings")
    at = F.when((F.col("tier") == "D") & F.col("answer").isNotNull(), F.nullif(F.instr("__b", F.col("answer")), F.lit(0)) - 1)
    words = F.when(F.col("prompt") == "", 0).otherwise(F.size(F.split("prompt", " ")))
    return x.select(
        key, "qid", "tier", "question", "prompt", words.alias("prompt_words"), F.coalesce("answer", F.lit("")).alias("answer"), F.col("answer").isNotNull().cast("int").alias("found"),
        "evidence", at.alias("lo"), (at + F.length("answer")).alias("hi"), "n_sentences", "n_headings",
    )


def control_set(df: DataFrame, key: str, text: str, chunks: int = 8, least: int = 1200, negative: Column | None = None) -> DataFrame:
    """(key, arm, chunk, case_id, …): the questions of ON_CONTROLS on passages of works, a row for each passage and question.

    A work's words are cut into about `chunks` passages of `least` words at least; a shorter rest is left out, and a work without
    a passage has no rows. Works for which `negative` holds come a second time with their words shuffled within windows of 40.
    """
    x = df.select(F.col(key), F.filter(F.split(squeeze(without_noise(F.coalesce(F.col(text), F.lit("")))), " "), lambda w: w != "").alias("__w"), (F.lit(False) if negative is None else F.coalesce(negative, F.lit(False))).alias("__neg"))
    x = x.select(key, "__neg", F.posexplode(word_blocks(F.col("__w"), chunks, least)).alias("__k", "__c"))
    x = x.withColumn("chunk", F.col("__k") + 1).withColumn("arm", F.explode(F.when(F.col("__neg"), F.array(F.lit("positive"), F.lit("negative"))).otherwise(F.array(F.lit("positive")))))
    words = F.when(F.col("arm") == "positive", F.col("__c")).otherwise(scramble(F.col("__c"), 40, F.concat_ws("|", F.col(key).cast("string"), F.col("chunk").cast("string"))))
    name = F.concat(F.col(key).cast("string"), F.when(F.col("arm") == "negative", "_shuf").otherwise(""), F.format_string("_ch%02d", "chunk"))
    x = x.select(F.struct(F.col(key), "arm", "chunk", name.alias("case_id")).alias("__id"), F.array_join(words, " ").alias("__text"))
    out = questions(x, "__id", "__text", asked=ON_CONTROLS, anchor_percent=50)
    return out.select("__id.*", *[c for c in out.columns if c != "__id"])


def span_ids(df: DataFrame, group: str, prefix: Column, order: Sequence[str | By]) -> DataFrame:
    """Adds id: a prefix and a number of four digits within each group."""
    return place_in_group(df, group, order, "__k").withColumn("id", F.format_string("%s%04d", prefix, F.col("__k") + 1)).drop("__k")


def batches(df: DataFrame, by: str, order: Sequence[str | By], size: int) -> DataFrame:
    """Adds number (from 1) and batch (from 0) within each group."""
    x = place_in_group(df, by, order, "__k").withColumn("number", (F.col("__k") + 1).cast("int")).drop("__k")
    return x.withColumn("batch", F.floor((F.col("number") - 1) / size).cast("int"))


def judge_matrix(df: DataFrame, generator: str, judge: str, score: str, judges: Sequence) -> DataFrame:
    """A column of mean scores for each judge, by generator, with the mean of all and that of its own judging."""
    cols = [F.avg(F.when(F.col(judge) == j, F.col(score))).alias(f"by_{j}") for j in judges]
    return df.groupBy(generator).agg(*cols, F.avg(score).alias("mean"), F.avg(F.when(F.col(judge) == F.col(generator), F.col(score))).alias("own"))


def run_variance(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """(keys, runs, mean, sd, var) over runs."""
    return df.groupBy(*keys).agg(F.count(score).alias("runs"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.var_samp(score).alias("var"))


def family_split(df: DataFrame, case: str, feature: str, family: str, families: int) -> DataFrame:
    """(case, feature, n, split): how many families name a feature, as NvM of all."""
    return df.groupBy(case, feature).agg(F.countDistinct(family).alias("n")).withColumn("split", F.concat(F.col("n").cast("string"), F.lit("v"), (families - F.col("n")).cast("string")))


def judge_prompt(question: Column, answer: Column, reference: Column | None = None) -> Column:
    """The text a judge gets: question, reference where there is one, answer."""
    ref = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("\n\nREFERENCE:\n"), reference)).otherwise("") if reference is not None else F.lit("")
    return F.concat(F.lit("QUESTION:\n"), question, ref, F.lit("\n\nANSWER:\n"), answer)


def numbered(items: Column) -> Column:
    """An array as lines numbered from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def overlap_of_tops(df: DataFrame, item: str, a: Column, b: Column, n: int) -> DataFrame:
    """(shared, share): how many items the n first of two orders have in common, one row."""
    x = df.orderBy(a, item).limit(n).select(item).intersect(df.orderBy(b, item).limit(n).select(item))
    return x.agg(F.count("*").alias("shared")).withColumn("share", ratio("shared", F.lit(n)))
