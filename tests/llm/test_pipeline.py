"""The pipeline on a small corpus, stage by stage."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi"


def corpus(spark, folder):
    rows, labels = [], []
    for i in range(120):
        words = [f"word{(i * 7919 + k * k) % 1013}" for k in range(60)]
        if i % 6 == 0:
            words[i % 50] = "nitwit"
        rows.append((i, " ".join(words), "en", f"src{i % 4}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows.append((200, rows[1][1] + " tail", "en", "src0", 0))
    rows.append((201, " ".join(f"more{k}" for k in range(90)) + " " + ITEM, "en", "src0", 0))
    rows.append((202, rows[3][1] + " with secret = hunter2222 " + " ".join(f"other{k}" for k in range(60)), "en", "src1", 0))
    rows += [(203, None, None, None, None), (204, "", "en", "src2", 0), (205, ITEM, "en", "src2", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.withColumn("rid", F.lit("own")).withColumn("__kept", F.lit("own")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert sorted(docs.columns) == sorted(columns)
    assert not [i for i in range(0, 120, 6) if i in kept["toxicity"]] and {203, 204, 1, 2, 3} <= set(kept["toxicity"])
    assert 200 not in kept["near_duplicates"] and {1, 2, 201, 202, 203, 204} <= set(kept["near_duplicates"])
    assert 205 not in kept["decontamination"] and "kappa" not in kept["decontamination"][201].text and kept["decontamination"][5].text == kept["toxicity"][5].text
    assert "hunter" not in kept["secrets"][202].text and kept["secrets"][202].n_chars == len(kept["secrets"][202].text)
    assert set(kept["bpe"]) == set(kept["secrets"])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept["bpe"])


def small(spark, folder, rows, labels, items):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("rid", "id", "k1", "k2", "n", "t", "__kept", "__spans", "__hits", "__rejected", "h", "found"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    df.repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    small(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage but the classifier's against plain Python, on rows with nulls, repeats and clashing columns."""
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken
    from test_llm_small import brute_groups, brute_windows

    rng = np.random.default_rng(21)
    words = np.array([f"w{i}" for i in range(900)])
    base, texts = rng.choice(words, 100).tolist(), [None, "", "  ", "one two three four five", "One two three four five", "x " * 9000]
    for k in range(20):
        w = list(base)
        for at in rng.choice(100, k % 6, replace=False):
            w[at] = f"n{k}"
        texts.append(" ".join(w))
    texts += [f"{' '.join(rng.choice(words, 40))} {ITEM} {' '.join(rng.choice(words, 40))}", ITEM, f"token = abcdef{'7' * 20} {' '.join(rng.choice(words, 30))}"]
    texts += [f"secret: shared-by-all-99 {' '.join(rng.choice(words, 30))}" for _ in range(4)]
    texts += [" ".join(rng.choice(words, n)) for n in rng.integers(1, 120, 40)]
    rows = [(3 * i, t, "en", f"src{i % 5}", 0) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[0], (None, None, None, None, None)]
    small(spark, tmp_path, rows, [], [(1, ITEM)])
    docs, of = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    same = of["toxicity"](spark, docs, str(tmp_path))
    assert same.columns == docs.columns and same.count() == len(rows)  # no labels, nothing rejected

    kept = of["near_duplicates"](spark, same, str(tmp_path)).select("doc_id", "text").collect()
    ordered = sorted(((r[0], r[1]) for r in rows if r[0] is not None), key=lambda x: x[0])
    n, comp = brute_groups([t for _, t in ordered])
    want = sorted((i, t) for k, (i, t) in enumerate(ordered) if not n[k] or comp[k] == k)
    assert sorted(((r.doc_id, r.text) for r in kept if r.doc_id is not None), key=str) == sorted(want, key=str) and sum(r.doc_id is None for r in kept) == 1

    cut = {(r.doc_id, r.text): r for r in of["decontamination"](spark, docs, str(tmp_path)).collect()}
    for (i, t, *_), (n_words, n_hit, _) in zip(rows, brute_windows([r[1] for r in rows], [(1, ITEM)], 10), strict=True):
        left = [r for r in cut.values() if r.doc_id == i]
        assert bool(left) == (not n_hit or n_hit <= n_words / 2)
        assert not left or (left[0].text == t if not n_hit else "kappa" not in left[0].text and left[0].n_chars == len(left[0].text))

    clean = {r.doc_id: r.text for r in of["secrets"](spark, docs, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        if t and "abcdef" in t:
            assert "abcdef" not in clean[i] and clean[i].startswith("<secret>")
        else:
            assert clean[i] == t  # what four sources share stays

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = of["bpe"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest() for _, t, *_ in rows)
