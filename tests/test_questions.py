"""Questions on documents that have all that is asked for, and on those that have nothing."""

from pyspark.sql import functions as F

from lexmill.operators import questions

LONG = "The court of the north held again that a claim must stand or fall on the words which the parties chose when they made the bargain{}."


def document():
    paragraphs = [LONG.format(" and on nothing else" * k) for k in range(3)]
    body = ["CAPTION OF THE CASE", "x " * 150, "I. BACKGROUND", *paragraphs, "Page 3 of 9", "II. THE MERITS OF IT", "short.", *[LONG.format(f" as it was put {w} before them") for w in ("once", "twice", "thrice", "often", "never", "seldom")], "A. The Third Part", "END OF IT", LONG.format(" at last")]
    return "\n".join(body) + "\n" + " ".join(f"Plain words go on {w} here and there without end." for w in ("up", "down", "left", "right") * 12)


def test_all_questions_are_answered(spark):
    text = document()
    rows = [(i, text, "1999-05-04") for i in range(4)] + [(9, None, None), (10, "", "x"), (11, "two words", "x")]
    df = spark.createDataFrame(rows, "id int, t string, filed string").withColumn("__t", F.lit("own")).withColumn("q", F.lit("own"))
    got = {(r.id, r.qid): r for r in questions.questions(df, "id", "t", {"Q02": ("When?", F.substring("filed", 1, 4))}, F.col("id")).collect()}
    assert len(got) == 7 * 21
    for (i, qid), r in got.items():
        assert r.found == int(r.answer != "") and (r.evidence is not None)
        if i >= 9:
            assert r.found == (qid == "Q02" and i > 9) and r.prompt == "", (i, qid)
    assert got[0, "Q02"].answer == "1999" and got[9, "Q02"].answer == ""
    assert got[0, "Q15"].answer == "I. BACKGROUND" and got[0, "Q16"].answer == "I. BACKGROUND | II. THE MERITS OF IT | A. The Third Part"
    assert got[0, "Q17"].answer.startswith("The court of the north") and got[0, "Q18"].answer.endswith("put once before them.")
    assert [got[i, "Q07"].prompt_words for i in range(4)] == [6, 12, 24, 0]  # no sentence is long enough for 48 words
    assert got[0, "Q19"].prompt_words == 6 and got[0, "Q20"].found == 0 and got[0, "Q20"].evidence.startswith("no sentence")
    squeezed = " ".join(text.replace("\nPage 3 of 9\n", "\n\n").split())
    for qid in ("Q05", "Q06", "Q07", "Q13", "Q14", "Q17", "Q19", "Q21", "Q24"):
        r = got[0, qid]
        assert squeezed[r.lo : r.hi] == r.answer and (not r.prompt or f"{r.prompt} {r.answer}" in squeezed), qid
    family = [got[0, f"Q{k}"] for k in (21, 22, 23, 24)]
    assert len({r.answer for r in family}) == 1 and [r.prompt_words for r in family] == [6, 12, 24, 48] and len(family[0].answer.split()) == 20
    assert len(got[0, "Q14"].prompt.split()) == 30 and len(got[0, "Q14"].answer.split()) == 60
    assert questions.questions(df.limit(0), "id", "t").collect() == []


def test_control_passages(spark):
    text = " ".join(LONG.format(f" as it was put {w} before them") for w in ("once", "twice", "thrice", "often") * 12)
    df = spark.createDataFrame([("a", text), ("b", text), ("c", "too short"), ("d", None)], "work string, t string")
    got = questions.control_set(df, "work", "t", 3, 200, F.col("work") == "b").collect()
    assert {r.case_id for r in got} == {f"{w}_ch{k:02d}" for w in ("a", "b", "b_shuf") for k in (1, 2, 3)} and len(got) == 9 * 11
    assert all(r.found for r in got if r.arm == "positive" and r.qid < "Q20")
    own = {(r.work, r.chunk, r.qid): r for r in got if r.arm == "positive"}
    assert all(r.answer != own[r.work, r.chunk, r.qid].answer for r in got if r.arm == "negative" and r.found)
