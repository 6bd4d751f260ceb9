"""Behaviour on small fixtures: scores, rules, resume, sequences, statistics, sources, providers, streams."""

import json
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexmill.functions import overlap, rules, text
from lexmill.operators import balance, evaluation, intervals, panel, relational, sampling, sequence, shingle, stats
from lexmill.plans.registry import QUERIES
from lexmill.session import Workspace
from lexmill.sources import providers, readers, sinks
from lexmill.streaming import resume


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_gold_against_itself(spark):
    rows = [(1, "The “Act” was passed in 1934, and it's law.", "The “Act” was passed in 1934, and it's law."), (2, "x b c d", "a b c d"), (3, "", "a b"), (4, "a", ""), (5, None, "ﬁne words")]
    got = {r.k: r for r in overlap.scores(spark.createDataFrame(rows, "k int, pred string, gold string"), "k", "pred", "gold").collect()}
    assert set(got) == {1, 2, 3, 5}
    assert all(got[1][c] == 1 for c in ("exact_match", "prefix_frac", "longest_run_frac", "rouge_l", "token_f1", "char_ratio"))
    assert (got[2].prefix_tokens, got[2].longest_run, got[2].rouge_l, got[2].token_f1) == (0, 3, 0.75, 0.75)
    assert got[3].token_f1 == got[3].rouge_l == 0 and got[5].gold_tokens == 2


def test_overlap_against_python(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(1, 9))]) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, p array<string>, g array<string>")
    runs = dict(overlap.longest_runs(df, "k", "p", "g").collect())
    native = dict(df.select("k", overlap.lcs(F.col("p"), F.col("g"))).collect())
    for k, p, g in rows:
        assert runs[k] == max(m.size for m in SequenceMatcher(None, p, g, autojunk=False).get_matching_blocks())
        assert native[k] == overlap.lcs_length(p, g)


def test_whole_texts_are_scored(spark, tmp_path):
    head = "the same words stand at the head of both texts " * 20
    rows = [(1, "en", head + "and then one ends like this"), (2, "en", head + "but something else is behind them")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["overlap_scores_full"](spark, str(tmp_path)).collect()
    a, b = (r[2] for r in rows)
    assert len(got) == 1 and (got[0].exact_match, got[0].gold_tokens, got[0].pred_tokens, got[0].prefix_tokens) == (0, 206, 206, 200)
    assert got[0].char_ratio == SequenceMatcher(None, b, a, autojunk=False).ratio()


def test_blocks_of_long_sequences():
    rng = random.Random(1)
    for k in range(60):
        a, b = ("".join(rng.choice("ab c"[: 2 + k % 3]) for _ in range(rng.randint(0, 400))) for _ in "ab")
        b = b + a[50:150] + b if k % 4 == 0 else b
        blocks = overlap.Blocks(a, b)
        blocks.SMALL = 30
        m = SequenceMatcher(None, a, b, autojunk=False)
        assert blocks.matched() == sum(x.size for x in m.get_matching_blocks())
        assert blocks.longest(0, len(a), 0, len(b), len(a))[2] == m.find_longest_match().size


def test_scramble_keeps_words_and_breaks_runs(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, words)], "k int, g array<string>").withColumn("p", sampling.scramble(F.col("g"), 40, "s"))
    r = df.first()
    assert sorted(r.p[:40]) == sorted(words[:40]) and sorted(r.p) == sorted(words)
    assert overlap.longest_runs(df, "k", "p", "g").first().longest_run < 10


@pytest.mark.parametrize(("answer", "kind"), [("UNKNOWN", "unknown_bare"), ("", "empty"), (None, "empty"), ("I cannot provide copyrighted text", "refusal_policy"), ("I do not have sufficient recall", "unknown_explained"), ("The Act cannot be superseded", "attempt"), ("prose\nUNKNOWN", "unknown_other")])
def test_nonanswers(spark, answer, kind):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(rules.nonanswer(F.col("a"))).first()[0] == kind
    assert df.select(rules.nonanswer(F.col("a"), F.lit(True))).first()[0] == "error"


def test_hotspots_behind_the_beginning(spark, tmp_path):
    text = "word " * 400 + "for the foregoing reasons " + "word " * 400
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.lo: r.verdict for r in QUERIES["hotspot_verdicts"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(0, len(text), 400)) and got[2000] == "furniture_by_pattern"
    assert {lo for lo, v in got.items() if v == "quoted_in_context"} == {1600, 2400}


def test_common_arm(spark):
    arms = [one(spark, relational.common_arm(F.lit(d), ["2025-01-31", "2026-01-31", "2026-02-28"]))[0] for d in ("2025-01-31", "2025-07-01", "2026-03-01")]
    assert arms == ["pre", None, "post"]


def test_chunk_spans(spark):
    got = sequence.chunk_spans(spark.createDataFrame([(5,), (0,), (4,)], "n int"), "n", 4, 2, 1).orderBy("n", "k").collect()
    assert [(r.n, r.start, r.end, r.score_from) for r in got] == [(4, 0, 4, 0), (5, 0, 4, 0), (5, 2, 5, 3)]


def test_alpha(spark):
    same = spark.createDataFrame([(u, float(u)) for u in range(5) for _ in range(2)], "u int, v double")
    assert panel.krippendorff_alpha(same, "u", "v").first().alpha == 1
    assert panel.krippendorff_alpha(same.withColumn("v", F.lit(1.0)), "u", "v").first().alpha is None


def test_divergence(spark):
    p = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("c", "x", 1.0), ("d", "x", 0.5), ("d", "y", 0.5)], "m string, f string, p double")
    got = {(r.a, r.b): r.d for r in panel.jsd(p, "m", "f").collect()}
    assert got["a", "c"] == 0 and got["a", "b"] == 1 and abs(got["a", "d"] - 0.31127812445913283) < 1e-12


def test_baselines(spark):
    r = evaluation.baselines(spark.createDataFrame([("g", x) for x in "aaab"], "g string, l string"), ["g"], "l", "b").first()
    assert (r.uniform, r.matched, r.mode_share, r.mode, r.always, r.strongest) == (0.5, 0.625, 0.75, "a", 0.25, 0.75)


def test_sign_and_t(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 0.0, -1.0)], "d double")
    r = stats.sign_test(df, [], "d").first()
    assert (r.up, r.down) == (3, 1) and abs(r.sign_p - 0.625) < 1e-12
    assert abs(stats.student_tail(2.0, 10) - 0.07338803) < 1e-6 and abs(stats.student_tail(0.5, 3) - 0.6514479) < 1e-6
    w = stats.wilcoxon(df, "d").first()
    assert (w.n, w.w) == (4, 8.5)


def test_recurrence_excludes_own_document(spark):
    w = [f"w{i}" for i in range(20)]
    own = "something else entirely with more than eight words in it".split()
    corpus = spark.createDataFrame([(1, " ".join(w), "pre"), (2, " ".join(own + ["x"] * 8 + own), "post"), (3, " ".join(w), "post"), (4, " ".join(w), None)], "doc int, text string, arm string")
    spans = spark.createDataFrame([(1, 0, w), (2, 0, own), (2, 18, own), (3, 0, w)], "doc int, start int, words array<string>")
    got = {(r.doc, r.start): (r.in_post, r.in_other_pre, r.in_own) for r in shingle.recurrence(spans, corpus, "doc", "text", "arm").collect()}
    assert got == {(1, 0): (1, 0, 0), (2, 0): (0, 0, 0), (2, 18): (0, 0, 1), (3, 0): (0, 1, 0)}


def test_no_overlap(spark):
    used = spark.createDataFrame([("c", 8, 12)], "k string, lo int, hi int")
    spans = spark.createDataFrame([("c", 5, 9), ("c", 12, 15), ("d", 8, 9)], "k string, lo int, hi int")
    assert sorted((r.k, r.lo) for r in intervals.no_overlap(spans, used, "k").collect()) == [("c", 12), ("d", 8)]


def test_stratified_carries_quotas(spark):
    df = spark.createDataFrame([(i, float(i % 100) if i < 100 else 95.0) for i in range(150)], "k int, s double").where("s < 2 or s >= 50")
    got = sampling.stratified(df, "k", "s", [0, 25, 50, 75, 100], 40, 1)
    assert got.count() == 40 and got.where("band = 0").count() == 2 and got.where("band = 1").count() == 0


def test_unwrap():
    u = text.unwrap_lines().one
    long = "x" * 60
    assert u(f"{long}\nnext\n\n\nshort\nline") == f"{long} next\n\nshort\nline"
    assert u(f"{long}\n(1) item\nPage 3 of 9\nexam-\nple") == f"{long}\n(1) item\nexample" and u("  ") == "  "


def test_text_functions(spark):
    r = one(spark, text.slug(F.lit("In re: Ünder v. A")), text.first_json(F.lit('so: ```json\n{"a": {"b": 1}}\n``` yes')), text.split_recall(F.lit("SOURCE: recalled\nANSWER: the text")), text.case_key(F.lit("Foo, Inc. v. Bar L.L.C.")), text.last_words(F.lit(" a b  c "), 2), text.ages(F.lit("a 45-year-old and one aged 30, 999 years old")), text.dollars(F.lit("$1,200.50 or $3")))
    assert r[0] == "in_re_nder_v_a" and json.loads(r[1]) == {"a": {"b": 1}} and tuple(r[2]) == ("recalled", "the text") and r[3] == "foo v bar" and r[4] == "b c" and r[5] == ["45", "30"] and r[6] == ["$1,200.50", "$3"]
    assert one(spark, rules.court_level(F.lit("ca9")))[0] == ("federal", "appeal")
    assert one(spark, balance.yes_no(F.lit("Yes, it is")))[0] == "yes"


def test_resume_and_overwrite(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, ""), (2, "timeout")], "k int, error string")
    assert sorted(r.k for r in relational.todo(items, done, ["k"], F.col("error") != "").collect()) == [2, 3]
    names = sampling.assign_names(spark.createDataFrame([(0, ["ann"]), (1, [])], "i int, taken array<string>"), "i", ["ann", "bob"], 0, "taken")
    assert [r.name for r in names.orderBy("i").collect()] == ["bob", "bob"]


def test_wide_and_three_layers(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "k int, s string, v string")
    assert sinks.wide(df, "k", "s", "v").columns == ["k", "a", "b"]
    new = spark.createDataFrame([(1, None), (2, "k2"), (3, "k3")], "a int, b string")
    old = spark.createDataFrame([(9, "k2"), (3, None)], "a int, b string")
    assert [r.a for r in relational.three_layer_dedup(new, old, ["a", "b"]).collect()] == [1]


def test_layers_within_the_new_rows(spark):
    rng = random.Random(3)
    key = lambda n: None if rng.random() < 0.2 else rng.randrange(n)
    new, old = [(i, key(60), key(40)) for i in range(120)], [(-1, key(60), key(40)) for _ in range(8)]
    seen, want = [{r[1] for r in old}, {r[2] for r in old}], []
    for i, a, b in new:
        if not any(x is not None and x in s for x, s in zip((a, b), seen, strict=True)):
            want.append(i)
            seen[0].add(a), seen[1].add(b)
    frames = [spark.createDataFrame(x, "i int, a int, b int") for x in (new, old)]
    assert sorted(r.i for r in relational.three_layer_dedup(*frames, ["a", "b"], ["i"]).collect()) == want
    assert relational.three_layer_dedup(frames[0].limit(0), frames[1], ["a", "b"], ["i"]).count() == 0


def test_layers_over_all_pages(spark, tmp_path):
    page = lambda i, url, title: (i, url, f"<title>{title}</title>")
    rows = [page(200, "http://a.org/x", "One"), page(101, "https://a.org/x?q=1", "Two"), page(102, "https://b.org/", "one!"), page(104, "https://c.org/", "Three"), page(106, "https://c.org/#top", "Four"), page(108, "https://d.org/", "Four")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r.page_id for r in QUERIES["three_layer_dedup"](spark, str(tmp_path)).collect()) == [104, 108]


def test_sources(spark, tmp_path):
    (tmp_path / "m__one.csv").write_text('case_id,refused,prediction\nc1,1,"two\nlines"\nc2,,x\n')
    got = {r.case_id: r for r in readers.csv_by_model(spark, str(tmp_path / "*.csv"), schema="case_id string, refused int, prediction string, model string, ts string").collect()}
    assert got["c1"].prediction == "two\nlines" and got["c1"].refused == 1 and got["c2"].refused is None and got["c1"].model == "m__one"
    tree = tmp_path / "tree" / "sub"
    tree.mkdir(parents=True)
    (tree / "x_P12.json").write_text(json.dumps([{"id": 1, "topic": "t", "compliant": False}, {"id": 2}]))
    assert {(r.id, r.content_type, r.compliant) for r in readers.typed_tree(spark, str(tmp_path / "tree"), {"_p12.json": "qa"}).collect()} == {(1, "qa", False), (2, "qa", None)}
    (tree / "odd.json").write_text("[]")
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "a int", tolerant=True).collect()) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").collect()
    (tmp_path / "man.json").write_text(json.dumps({"court": {"cases": [{"case_id": "a"}], "pre_cutoff": [{"case_id": "b"}], "post_cutoff_control": [{"case_id": "c"}]}}))
    assert {(r.case_id, r.arm) for r in readers.manifest(spark, str(tmp_path / "man.json"), "court").collect()} == {("a", None), ("b", "pre_cutoff"), ("c", "post_cutoff_control")}
    for name, files in {"best": {"k1": "x" * 300, "k2": "short"}, "raw": {"k1": "y" * 300, "k2": "z" * 300}}.items():
        (tmp_path / name).mkdir()
        for k, t in files.items():
            (tmp_path / name / f"{k}.txt").write_text(t)
    got = {r.case_id: (r.text[0], r.text_source) for r in readers.whole_texts(spark, [("best", str(tmp_path / "best")), ("raw", str(tmp_path / "raw"))]).collect()}
    assert got == {"k1": ("x", "best"), "k2": ("z", "raw")}
    feats = {"d:1": {"dataset": "d", "case_id": 1, "superset": ["s"], "features": {"f1": {"model": "m", "model_family": "x", "feature": "s", "importance": 5, "superset_index": 0}, "f2": {"model": "m", "model_family": "x", "feature": "gone", "importance": 1, "superset_index": None}}}}
    (tmp_path / "feat.json").write_text(json.dumps(feats))
    mapping = spark.createDataFrame([("s", "S"), ("gone", None)], "feature string, concept string")
    assert [(r.fid, r.feature) for r in readers.selections(spark, str(tmp_path / "feat.json"), mapping).collect()] == [("f1", "S")]
    (tmp_path / "hyp").mkdir()
    (tmp_path / "hyp" / "0001.txt").write_text("ID: 1\nTopic: fees\nVerdict: NON-COMPLIANT\n\nFACTS\n-----\nA did\nB.\n\nQUESTION\n--------\nIs it?\n")
    r = readers.hypotheticals(spark, str(tmp_path / "hyp")).first()
    assert (r.id, r.topic, r.facts, r.question, r.answer) == ("1", "fees", "A did\nB.", "Is it?", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", ["x", "y"])], "k int, t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "o"), ["t", "l"])
    assert readers.csv_rows(spark, str(tmp_path / "o")).first().t == "a\nb"
    sinks.packet(df, str(tmp_path / "p"), "k", ["t"])
    assert "> a" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "p")).collect())
    sinks.citations(df, str(tmp_path / "c"), ["k"], "l")
    assert spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).count() == 2
    r = sinks.content_addressed(spark.createDataFrame([("<html><title>404 not found</title>",)], "c string"), "c").first()
    assert r.kind == "html" and r.soft_404 and len(r.sha256) == 64


def test_providers(spark):
    waits, answers = [], iter(["bad", "worse", "good"])
    assert providers.Retrying(lambda p: next(answers), lambda a: a == "good", sleep=waits.append)("p") == "good" and waits == [8.0, 16.0]
    with pytest.raises(RuntimeError):
        providers.Retrying(lambda p: "same", lambda a: False, sleep=waits.append)("p")
    with pytest.raises(PermissionError):
        providers.allowed_source("https://www.example.org/x", ("example.org",))
    items = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p")], "k int, prompt string")
    first = providers.ask(items, ["k"], "prompt", providers.Stub)
    again = providers.ask(items, ["k"], "prompt", providers.Stub, first.where("k = 1"))
    assert {r.k: r.answer for r in again.collect()} == {r.k: r.answer for r in first.where("k > 1").collect()}
    assert providers.ask_once_per_key(items, "prompt", "prompt", providers.Stub).select("answer").distinct().count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        resume.process_new(stream, ["k"], str(tmp_path / "out"), lambda d: d, str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_bootstrap_and_mds(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("g", i % 60, rng.gauss(5, 1)) for i in range(600)], "g string, c int, v double")
    r = stats.bootstrap_ci(df, "g", "c", "v", 300, 0).first()
    assert r.lo < r.mean < r.hi and r.hi - r.lo < 0.5 and abs(r.mean - 5) < 0.2
    pts = {i: (i * 1.0, (i * i) % 3) for i in range(5)}
    pairs = spark.createDataFrame([(a, b, math.dist(pts[a], pts[b])) for a in pts for b in pts if a < b], "a int, b int, d double")
    x = {r.model: (r.x1, r.x2) for r in stats.mds(pairs).collect()}
    assert all(abs(math.dist(x[a], x[b]) - math.dist(pts[a], pts[b])) < 1e-9 for a in pts for b in pts)


def test_workspace_roundtrip(spark):
    ws = Workspace(spark, "test")
    df = ws.write(spark.range(0), "none")
    assert df.count() == 0
    ws.drop("none")


def test_names_headings_vocabulary(spark):
    from lexmill.functions import headings, names

    x = spark.createDataFrame([(1, "Mr. Ann Lee said he knew Lee; His Leeway is himself. HE too.")], "k int, before string")
    x = x.withColumn("after", names.swapped(F.col("before"), {"Mr. Ann Lee": "Ms. Eve Roe", "Lee": "Roe"}, "female"))
    assert x.first().after == "Ms. Eve Roe said she knew Roe; Her Leeway is herself. She too."
    allowed = names.may_change(spark, ["Ann Lee", "Eve Roe"], True)
    word = lambda *w: spark.createDataFrame([(v,) for v in w], "word string")
    assert names.changed_words(x, ["k"], "before", "after", allowed).count() == 0
    assert names.leaked_words(x, ["k"], "after", word("ann", "lee"), word("eve", "roe")).count() == 0
    wrong = x.withColumn("after", F.replace("after", F.lit("knew"), F.lit("met")))
    assert {r.word for r in names.changed_words(wrong, ["k"], "before", "after", allowed).collect()} == {"knew", "met"}
    assert {r.word for r in names.leaked_words(x, ["k"], "before", word("ann", "lee"), word("lee")).collect()} == {"ann"}
    gold = "I. Background facts; II. Standard of review"
    rows = [(1, gold, gold), (2, "Background facts; invented words here", gold), (3, "x", ""), (4, None, gold)]
    got = {r.k: r for r in headings.heading_scores(spark.createDataFrame(rows, "k int, p string, g string"), ["k"], "p", "g").collect()}
    assert set(got) == {1, 2, 4} and got[1][1:] == (1.0, 0, 1.0, 2, 2) and got[2].recall == 0.5 and got[4].score == 0
    r = spark.createDataFrame([("ab  c",), (None,)], "t string").select(headings.word_spans("t").alias("w")).collect()
    assert [tuple(x) for x in r[0].w] == [(0, 2), (4, 5)] and r[1].w is None


def test_places_over_few_groups(spark):
    rows = [(i, i % 3 or None, (i * 7919) % 500 if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "i bigint, g int, v int").repartition(7).withColumn("a DESC b", F.col("v"))
    By = relational.By
    for by, falling, last in ((By("v"), 0, 0), (By("v", True), 1, 1), (By("v", False, True), 0, 1), (By(F.col("`a DESC b`"), True, False), 1, 0)):
        got = {r.i: r.k for r in relational.place_in_group(df, "g", [by, "i"], "k").collect()}
        for g in (None, 1, 2):
            mine = sorted((((v is None) == bool(last)), (-v if falling else v) if v is not None else 0, i) for i, h, v in rows if h == g)
            assert [got[i] for _, _, i in mine] == list(range(len(mine)))
    every = relational.place_in_group(df, None, ["i"], "k").collect()
    assert all(r.k == r.i for r in every) and len(every) == 2000
    assert relational.place_in_group(df.limit(0), "g", ["i"], "k").count() == 0


def test_collision_suffix_of_a_hot_name(spark):
    df = spark.range(0, 5000, 1, 5).select("id", F.when(F.col("id") % 10 == 1, F.concat(F.lit("n"), "id")).when(F.col("id") % 10 != 2, "hot").alias("name"))
    got = {r.id: r.uid for r in relational.collision_suffix(df, "name", "id").collect()}
    hot = [i for i in range(5000) if i % 10 not in (1, 2)]
    assert [got[i] for i in hot] == [f"hot__{k + 1}" for k in range(len(hot))] and got[11] == "n11" and got[12] is None and len(got) == 5000


def test_a_vocabulary_grows_as_if_row_by_row(spark):
    """A million values against the sequential definition."""
    n = 1_000_000
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    text = F.concat(F.lit("t"), F.pmod(F.xxhash64("id", F.lit(1)), F.floor(F.col("id") / 50) + 1).cast("string"))
    value = F.when(h < 300, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(40_000)).cast("string")).when(h < 310, " ").when(h < 320, F.lit(None)).when(h < 330, "--3").when(h < 500, "hot").otherwise(text)
    df = spark.range(0, n, 1, 8).select("id", value.alias("v"))
    rows, words = relational.grow_vocabulary(df, "v", ["id"], ["zero", "one"])
    got = rows.select("id", "v", "place", "entry").toPandas().sort_values("id")
    places, order = {"zero": 0, "one": 1}, ["zero", "one"]
    for v, place, entry in zip(got.v, got.place, got.entry, strict=True):
        t = v.strip() if v is not None else ""
        if t.lstrip("-").isdigit():
            i = int(t) if t.count("-") < 2 else -1
            want = i if 0 <= i < len(order) else None
        elif t:
            if t not in places:
                places[t] = len(order)
                order.append(t)
            want = places[t]
        else:
            want = None
        assert (place == want and entry == order[want]) if want is not None else (place != place and entry is None)
    assert [r.entry for r in words.orderBy("place").collect()] == order and len(got) == n
    none, few = relational.grow_vocabulary(df.limit(0), "v", ["id"])
    assert none.count() == 0 and few.count() == 0


def test_matched_null_draws_from_the_shares(spark):
    df = spark.createDataFrame([("g", x, "a") for x in "aaabbc" * 200], "g string, l string, p string")
    r = stats.matched_null(df, "g", "l", "p", 4000).first()
    assert r.observed == 0.5 and abs(r.null_mean - (0.25 + 1 / 9 + 1 / 36)) < 0.002 and r.lo < r.null_mean < r.hi < 0.5 and r.p < 0.001
    assert abs(stats.chance_of_hit(df, "g", "l").first().expected - (0.25 + 1 / 9 + 1 / 36)) < 1e-12


def test_roots_of_divergences_are_embedded(spark):
    p = spark.createDataFrame([(m, f, (m * 7 + f * 3) % 5 + 1) for m in range(5) for f in range(6)], "m int, f int, n int").withColumn("r", F.lit(0))
    d = stats.divergences(p, ["r"], "m", "f", "n").drop("r")
    x = {r.model: (r.x1, r.x2, r.x3, r.x4) for r in stats.mds(d, 4, squared=False).collect()}
    assert all(abs(math.dist(x[r.a], x[r.b]) ** 2 - r.d) < 1e-9 for r in d.collect())


def test_families_that_explain_distance(spark):
    fam = spark.createDataFrame([(m, m // 4) for m in range(12)], "m int, fam int")
    val = spark.createDataFrame([(m, float(m * 5 % 7)) for m in range(12)], "m int, v double")
    pairs = spark.createDataFrame([(a, b, (0.1 if a // 4 == b // 4 else 0.5) + 0.01 * ((a * 3 + b) % 5)) for a in range(12) for b in range(a + 1, 12)], "a int, b int, d double")
    r = stats.distance_drivers(pairs, val, fam, "m", "v", "fam", 300).first()
    assert r.same_family < -0.3 and r.r2 - r.r2_gap > 0.8 and r.p < 0.02


def test_refused_hosts_and_missing_sections(spark, tmp_path):
    got = spark.createDataFrame([("https://a.example.org/x",), ("http://notexample.org",), ("HTTP://u@Example.org:80?q",), (None,)], "u string").select(readers.refused(F.col("u"), ["example.org"]).alias("r")).collect()
    assert [r.r for r in got] == [True, False, True, None]
    sinks.save_json(spark, str(tmp_path / "d"), "s.json", {"a": 1})
    assert readers.json_document(spark, str(tmp_path / "d/s.json"), "a bigint").first().a == 1
    with pytest.raises(Exception, match="missing"):
        readers.json_document(spark, str(tmp_path / "d/s.json"), "a bigint, b bigint").collect()
    with pytest.raises(FileNotFoundError):
        readers.files_with(spark, str(tmp_path / "d"), "none")
