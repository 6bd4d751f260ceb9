"""Chat templates and seams."""

from pyspark.sql import functions as F

from lexmill.functions import templates


def test_templates_and_seams(spark):
    df = spark.createDataFrame([([("user", "a b"), (None, None)],), ([],)], "t array<struct<role:string,text:string>>")
    got = df.select(templates.chat(F.col("t"), templates.MARKED), templates.chat(F.col("t"), templates.HEADED, ask=False), templates.raw(F.col("t"))).collect()
    assert got[0][0] == "<|im_start|>user\na b<|im_end|>\n<|im_start|>\n<|im_end|>\n<|im_start|>assistant\n"
    assert got[0][1] == "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\na b<|eot_id|><|start_header_id|><|end_header_id|>\n\n<|eot_id|>"
    assert got[0][2] == "a b\n\n" and got[1][0] == "<|im_start|>assistant\n" and got[1][2] == ""
    rows = [("one two ", "three", 2, ""), ("one tw", "o three", 2, "boundary_merge"), ("one tw", "o", None, "no_suffix_tokens"), ("one", " \n", None, "no_suffix_tokens"), ("", "x", 0, ""), ("one", " two", 1, "")]
    x = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(rows)], "i int, a string, b string")
    found = {r.i: tuple(r.s) for r in x.select("i", templates.seam(F.col("a"), F.col("b")).alias("s")).collect()}
    assert [found[i] for i in range(len(rows))] == [(n, w) for *_, n, w in rows]
